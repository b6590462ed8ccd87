"""Similarity and the review band look at all content words of a text, however many it has; candidates of long sets."""

import random

import pytest

from plaintide.operators import pool
from plaintide.plans import texts


def written(spark, path, rows):
    spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_words_after_the_64th_count(spark, tmp_path):
    w = [f"word{i}" for i in range(400)]
    rows = [
        (1, " ".join(w[:164])), (2, " ".join(w[:64] + w[300:400])),  # alike in their first 64 alone
        (3, " ".join(["x" + x for x in w[:70]] + w[164:300])), (4, " ".join(["y" + x for x in w[:30]] + w[164:300])),  # alike after them
        (5, " ".join(w[:144])),  # 0.88 with 1; of the first 64, all
        (6, " ".join(w[:130])),  # 0.79 with 1, 0.90 with 5
    ]
    sf = written(spark, tmp_path, rows)
    sets = {i: set(t.split()) for i, t in rows}
    sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a > b}
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in texts.st_jaccard(spark, sf).collect()}
    assert got == {k: v for k, v in sims.items() if v >= 0.45} and (4, 3) in got and (2, 1) not in got
    assert {(r["left_id"], r["right_id"]) for r in texts.join_band(spark, sf).collect()} == {(6, 1)}


@pytest.mark.parametrize("told", [True, False])
def test_long_sets_against_all_pairs(spark, monkeypatch, told):
    """Bitmaps in every task or beside the rows; few candidates that are no pairs."""
    counts, cut = {}, pool.cut

    def counted(df, name):
        out = cut(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(pool, "cut", counted)
    if not told:
        monkeypatch.setattr(pool, "MAPS", 0)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    sets = []
    for i in range(30):
        base = rng.sample(words, rng.choice((5, 60, 300, 1000)))
        near = [x for x in base if rng.random() < rng.choice((0.5, 0.8, 0.95))] + rng.sample(words, len(base) // 10)
        sets += [(2 * i, base), (2 * i + 1, list(dict.fromkeys(near)))]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    for threshold in (0.45, 0.78):
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a > b}
        want = {k: v for k, v in want.items() if v >= threshold}
        assert {(r["left_id"], r["right_id"]): r["similarity"] for r in pool.similar(df, threshold).collect()} == want
        assert want and 10 * counts["pairs"] < len(sets) * (len(sets) - 1) // 2
        ask, known = df.where("id % 2 = 0"), df.where("id % 2 = 1")
        got = {(r["left_id"], r["right_id"]): r["similarity"] for r in pool.similar(ask, threshold, known).collect()}
        both = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a % 2 == 0 and b % 2 == 1}
        assert got == {k: v for k, v in both.items() if v >= threshold}
