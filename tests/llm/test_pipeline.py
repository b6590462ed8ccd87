"""The corpus pipeline stage by stage, and the queries with SQL."""

import hashlib
import re
from collections import Counter

import pytest

from plaintide.llm import lines, neardup, quality, queries
from tests.compare import connection, rows
from tests.llm.test_operators import SCHEMA, WORD, brute_mix, groups, odd_rows, plain_code, plain_lines  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(connection(SF).execute(queries.oracle_sql()[name]).fetchdf())


def plain_kept(text):
    """The quality verdict from windows of words, without a suffix array."""
    words = re.findall(WORD, text or "")
    n = len(words)

    def repeated(size):
        at = {}
        for i in range(n - size + 1):
            at.setdefault(tuple(words[i : i + size]), []).append(i)
        return [i for places in at.values() if len(places) > 1 for i in places]

    inside = lambda size: len({i + k for i in repeated(size) for k in range(size)})
    longest = 0
    while longest < n and repeated(longest + 1):
        longest += 1
    return n >= 50 and 100 * inside(3) <= 50 * n and inside(quality.MIN_WORDS) <= quality.MAX_COVERED * n and longest <= quality.MAX_REPEAT


def test_stages(spark, tmp_path):
    """Every stage's rows against plain Python over the rows that the stage before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {"input": docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        held[name] = docs.collect()
        if i + 1 < len(pipeline.STAGES):
            assert docs.columns == columns
    text = lambda rows: sorted((r["doc_id"], r["source"], r["text"]) for r in rows)

    assert text(held["quality rules"]) == text(r for r in held["input"] if plain_kept(r["text"]))

    rows = [(r["doc_id"], r["text"], r["source"]) for r in held["quality rules"]]
    gone = plain_lines(rows, lines.RATIO, 3, True)
    assert gone and text(held["line dedup"]) == sorted((i, s, "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone)) for i, t, s in rows)

    codes = [plain_code(r["text"]) for r in held["line dedup"]]
    least = {}
    for r, g in zip(held["line dedup"], groups(codes, neardup.RADIUS), strict=True):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert len(least) < len(codes) and text(held["near dedup"]) == text(r for r in held["line dedup"] if r["doc_id"] in set(least.values()))

    total, target = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in held["near dedup"]])
    whole = {r["doc_id"]: r["text"] for r in held["near dedup"]}
    taken = Counter()
    cut_rows = Counter()
    for r in held["mixing"]:
        size = len(re.findall(WORD, r["text"]))
        taken[r["source"]] += size
        assert size and whole[r["doc_id"]].startswith(r["text"])
        cut_rows[r["source"]] += r["text"] != whole[r["doc_id"]]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in total) and max(cut_rows.values()) <= 1

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    coded = lambda t: tuple(lib.encode(t, add_special_tokens=False).ids)
    want = Counter((r["doc_id"], r["source"], coded(r["text"])) for r in held["mixing"])
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in held["bpe"]) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(lib.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest() for r in held["bpe"])


def test_run_with_odd_rows(spark, odd_rows, tmp_path):
    """Nulls, empty and repeated rows, and extra columns go through the whole pipeline; an empty table gives no rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, rows in (("some", odd_rows), ("none", [])):
        spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), -1, "k", "c") for i, t, s in rows], SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
        assert (out.count() > 0) == bool(rows)
