"""Context of replies, added lines of versions, dashes of comments, guarded names, inversions over several levels: against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaintide.functions import redaction
from plaintide.operators import drift, guard, messages, records, versions

MESSAGES = "thread long, seq long, title string, author string, bot boolean, text string, reply_to long"


def context_of(rows, pseudonym, size=6):
    """Every message's context, message by message."""
    out = {}
    red = lambda x: redaction.redact_text(x)[0]
    shown = lambda x: bool((x or "").strip(" "))
    for r in rows:
        thread = sorted((x for x in rows if x[0] == r[0]), key=lambda x: x[1])
        parts = []
        if shown(r[2]):
            parts.append("[thread title] " + red(r[2])[:150])
        if thread[0][1] != r[1] and shown(thread[0][5]):
            parts.append("[opening post] " + red(thread[0][5])[:400])
        for x in thread:
            if x[1] == r[6] and shown(x[5]):
                parts.append(f"[replying to {'the bot' if x[4] else pseudonym[x[3]][:8]}] " + red(x[5])[:300])
        before = [x for x in thread if x[1] < r[1]][-size:]
        said = [f"{pseudonym[x[3]][:8]}: {red(x[5])[:160]}" for x in before if not x[4] and shown(x[5])]
        if said:
            parts.append("[recent] " + " | ".join(said))
        out[r[0], r[1]] = "\n".join(parts)[:1500]
    return out


@pytest.mark.parametrize("block", [4, 7, 1024])
def test_context_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = []
    for thread, n in ((1, 40), (2, 1), (3, 9), (4, 2)):
        for seq in sorted(rng.sample(range(100), n)):
            text = rng.choice(["", "  ", None, "short", "mail a.b@corp.org now " * rng.randint(1, 30), "x" * rng.choice([155, 500]) + " me@corp.org end"])
            reply = rng.choice([None, 1000, seq, *(x[1] for x in rows if x[0] == thread)])
            rows.append((thread, seq, {1: "about me@corp.org", 3: " "}.get(thread), rng.choice("abc"), rng.random() < 0.3, text, reply))
    who = {x: spark.range(1).select(redaction.pseudonym(F.lit(x), "salt")).first()[0] for x in "abc"}
    got = messages.context(spark.createDataFrame(rows, MESSAGES), "salt", block=block).collect()
    assert {(r["thread"], r["seq"]): r["context"] for r in got} == context_of(rows, who) and len(got) == len(rows)


def test_context_of_no_messages(spark):
    assert messages.context(spark.createDataFrame([], MESSAGES), "salt").collect() == []


@pytest.mark.parametrize("n", [0, 1, 16, 17, 100, 1000])
def test_inversions_over_levels(spark, n):
    rng = random.Random(n)
    r2 = list(range(1, n + 1))
    rng.shuffle(r2)
    want = sum(r2[i] > r2[j] for i in range(n) for j in range(i + 1, n))
    rows = [(i + 1, v) for i, v in enumerate(r2)]
    rng.shuffle(rows)
    got = drift.inversions(spark.createDataFrame(rows, "r1 long, r2 long"), block_bits=4, digit_bits=2).first()
    assert (got["n"], got["discordant"]) == (n, want)


def test_added_lines_equal_brute_force(spark):
    rng = random.Random(3)
    rows, edges = [], []
    for path in range(4):
        for v in range(8):
            rows.append((path, v, rng.choice([None, ""]) if rng.random() < 0.15 else "\n".join(rng.choice("abcd ") for _ in range(rng.randint(1, 6)))))
            edges += [(path, v, p) for p in rng.sample(range(9), rng.randint(0, 3)) if p != v]  # 8 is not there
    lines = {(p, v): Counter([] if t is None else t.split("\n")) for p, v, t in rows}
    want = Counter()
    for (p, v), own in lines.items():
        parents = [lines.get((p, q), Counter()) for a, b, q in edges if (a, b) == (p, v)]
        for line, n in own.items():
            more = n - max((x[line] for x in parents), default=0)
            if more > 0:
                want[p, v, line] = more
    df = spark.createDataFrame(rows, "path long, version int, text string")
    links = spark.createDataFrame(edges, "path long, version int, parent int")
    for twice in (False, True):
        got = versions.added_lines(df, links.union(links) if twice else links).collect()
        of = {hashlib.md5(x.encode()).digest(): x for x in ("", *"abcd ")}
        assert {(r["path"], r["version"], of[bytes(r["digest"])]): r["times"] for r in got} == dict(want) and len(got) == len(want)
    assert versions.added_lines(df.limit(0), links.limit(0)).count() == 0


def test_contents_once(spark):
    rows = [(2, 1, "x"), (1, 1, "x"), (1, 0, "y"), (1, 2, None), (3, 5, ""), (3, 6, "x")]
    df = spark.createDataFrame(rows, "path long, version int, text string")
    got = versions.texts_of(df, versions.contents(df, F.col("version"))).select("path", "version", "text", "times").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "y", 1), (1, 1, "x", 3), (3, 5, "", 1)]


def test_dashes_of_prose(spark):
    cases = {
        "one — two": "one, two", "pages 3–5": "pages 3 to 5", "a——b": "a to b", "é–a": "é,a", "$2.0B–$4.6B": "$2.0B,$4.6B", "foo —bar": "foo, bar", "foo— bar": "foo, bar", "ends —": "ends,",
        "ends —\r": "ends, ", "— starts": "starts", "`a — b` c — d": "`a — b` c, d", "a —` b": "a, ` b", "x `y` —`z — z`": "x `y`,`z — z`", "": "", "1–2–3": "1 to 2,3", "—": ",",
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r[0]: r[1] for r in df.select("line", guard.fix_dashes(F.col("line"))).collect()} == cases


def test_dashes_of_python_comments(spark):
    source = 'a = "x — y"  # one — two\n"""doc — string\n# not — a comment\n"""\n# 3–5\n# left — alone (dashes: allow)\nb = "é#"  # é — z'
    rows = [(1, source), (2, "def f(:\n  '''open\n# a — b"), (3, None), (4, ""), (5, "x = (  # a — b\n 1)")]
    got = guard.fix_python(spark.createDataFrame(rows, "place long, text string")).orderBy("place", "n").collect()
    fixed = lambda i: "\n".join(r["fixed"] for r in got if r["place"] == i)
    assert fixed(1) == source.replace("# one — two", "# one, two").replace("# 3–5", "# 3 to 5").replace("é — z", "é, z")
    assert fixed(2) == rows[1][1] and not any(r["examined"] for r in got if r["place"] == 2)
    assert fixed(4) == "" and fixed(5) == "x = (  # a, b\n 1)" and {r["place"] for r in got} == {1, 2, 4, 5}


def test_guarded_names(spark):
    names = [("o", "Main-data", 5), ("p", "main-data", 7), ("p", "tool-x-y", 1), ("o", "plain", 2), ("o", "own-config", 3), ("o", "own", 3), ("o", "a-b", 4), ("q", "lone-private", 9)]
    public = spark.createDataFrame([("o", "Main"), ("o", "main"), ("p", "lone")], "owner string, name string")
    df = spark.createDataFrame(names, "owner string, name string, ordinal long")
    day = 86400
    for age, kind in ((day, "derived"), (30 * day, "derived"), (30 * day + 1, "linkage"), (None, "linkage")):
        got = {r["name"]: (r["ordinal"], r["kind"], r["witness"]) for r in records.cross_names(df, "own", public, F.lit(age).cast("long")).collect()}
        assert got == {"main-data": (5, kind, "main" if kind == "derived" else None), "tool-x-y": (1, "linkage", None), "lone-private": (9, "linkage", None)}
