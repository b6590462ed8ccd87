"""Embedding links, Merkle proofs and periodic runs against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plaintide.llm import merkle, periodic, queries, vectors
from tests.compare import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, site string, place long, path string, word string"
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] + [None] * 15, [float("inf")] + [0.0] * 15, [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15, [1e-300] * 16, [1e300] * 16, [1.0, 2.0], [2.0, 4.0], [5.0], [7.0], [-7.0]]


# 11 embedding links


@pytest.fixture(scope="module")
def some_vectors():
    """Groups around one direction, a chain of which only neighbours are linked, a dense group, copies, and odd rows."""
    rng, d = np.random.default_rng(5), 16
    base, out = rng.normal(size=(30, d)), []
    for b in base:
        out += [b * rng.choice([1, 3]) + s * np.linalg.norm(b) * rng.normal(size=d) / np.sqrt(d) for s in (0, 0.1, 0.2, 0.25, 0.3, 0.33)]
    x = base[0] / np.linalg.norm(base[0])
    for _ in range(25):
        x = x + 0.25 * rng.normal(size=d) / np.sqrt(d)
        out.append(x)
    out += [base[1] / np.linalg.norm(base[1]) + 0.1 * rng.normal(size=d) / np.sqrt(d) for _ in range(60)] + [out[3]] * 20
    data = [(i, v if v is None or isinstance(v, list) else v.tolist(), "x") for i, v in enumerate([*out, *ODD])]
    data += [(3, out[9].tolist(), "x"), (None, out[0].tolist(), "y"), (None, [0.0] * 16, "y")]
    random.Random(2).shuffle(data)
    return data


def by_sql(data):
    found = duckdb.connect()
    found.register("embeddings", pa.table({"vec_id": pa.array([x[0] for x in data], pa.int64()), "embedding": pa.array([x[1] for x in data], pa.list_(pa.float64()))}))
    return rows(found.execute(queries.OP11).fetchdf())


@pytest.mark.parametrize("chunk", [None, 13])
def test_links_brute_force(spark, some_vectors, monkeypatch, chunk):
    if chunk:  # hot cells cut into many chunks and tiles
        monkeypatch.setattr(vectors, "CHUNK", 3 * chunk)
        monkeypatch.setattr(vectors, "EXACT_CHUNK", chunk)
        monkeypatch.setattr(vectors, "TILE", 7)
    df = spark.createDataFrame(some_vectors, "vec_id long, embedding array<double>, node string").repartition(5)
    want = by_sql(some_vectors)
    assert sum(r[2] for r in want) > 3000
    assert rows(vectors.link_vectors(df).toPandas()) == want


def test_links_of_none_and_one(spark):
    schema = "vec_id long, embedding array<double>"
    assert vectors.link_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in vectors.link_vectors(spark.createDataFrame([(4, [1.0, 2.0])], schema)).collect()] == [(4, 0, 4, True)]
    with pytest.raises(ValueError):
        vectors.link_vectors(spark.createDataFrame([], schema), least=-1.0)


def test_vectors_within_reach_share_one_cell():
    """Of two vectors within the radius one stands in, or visits, the cell of the other, and only there do they meet."""
    rng = np.random.default_rng(1)
    for d in (1, 2, 6, 9):
        a = rng.normal(size=(300, d)) * 0.2
        b = a + rng.normal(size=a.shape) * 0.05
        both = np.concatenate([a, b])
        home, row, cell = vectors.cells_of(both, 0.1, 6)
        at = [{int(h)} for h in home]
        for r, c in zip(row, cell, strict=True):
            at[r].add(int(c))
        near = np.flatnonzero(np.linalg.norm(a - b, axis=1) <= 0.1)
        assert len(near)
        for i in near:
            assert len({int(home[i])} & at[i + 300] | {int(home[i + 300])} & at[i]) == 1


# 12 Merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """Root and each node's steps (siblings left, right), level by level over whole lists."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        groups = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, k in enumerate(at):
            g = groups[k // 16]
            steps[i].append(("".join(g[: k % 16]), "".join(g[k % 16 + 1 :])))
        at, nodes = [k // 16 for k in at], [sha("".join(g)) for g in groups]
    return nodes[0], steps


def plain_proofs(data):
    said = lambda xs: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs)
    sites = {}
    for i, t, lang, s, n in data:
        leaf = sha(said((i, s, lang, n, t)))
        other = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t is not None:
            other = sha(said((i, s, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))))
        sites.setdefault((s is not None, (s or "").encode()), []).append((i is not None, i or 0, leaf, i, other))
    sites = {k: sorted(v) for k, v in sorted(sites.items())}
    trees = [plain_tree([x[2] for x in v]) for v in sites.values()]
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for v, (sub, steps), up in zip(sites.values(), trees, above, strict=True):
        for (_, _, leaf, i, other), own in zip(v, steps, strict=True):
            cur = other
            for left, right in own + up:
                cur = sha(left + cur + right)
            out.append((i, leaf, sub, root, sha("".join(a + b for a, b in own + up)), cur, cur == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_proofs_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)  # blocks of 16, 256 and 4096: trees above, within and over them
    rng = random.Random(levels)
    sizes = {"a": 300, "b": 1, "c": 16, "d": 17, None: 257, "É": 2, "": 33, "Z": 256} | {f"s{i}": 1 for i in range(20)}
    data = [(100 * k + i if k < 5 else 7000 + 300 * k + i, rng.choice(["Some Text", "none", None, "", "ÀB" * 50]), rng.choice(["en", None]), s, rng.choice([3, None])) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    data += [(None, "no id", "en", "a", 1), (None, "No id", "en", "a", 1), data[0], data[0], (data[0][0], "same id", "en", "a", 2)]
    rng.shuffle(data)
    df = spark.createDataFrame([(i, t, lang, s, n, "x", -1, "p", "w") for i, t, lang, s, n in data], SCHEMA).repartition(4)
    got = merkle.check_tampered(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_proofs(data)
    assert {r["verified"] for r in got} == {True, False}


def test_walk_holds_few_digests():
    leaves = [sha(str(i)) for i in range(1000)]
    root, steps = plain_tree(leaves)
    walk, most = merkle.Traversal(leaves.__getitem__, len(leaves), merkle.depth_of(len(leaves))), 0
    for i in range(len(leaves)):
        own = [merkle.Step("".join(r[: walk.place(h)]), "".join(r[walk.place(h) + 1 :])) for h, r in enumerate(walk.runs)]
        assert [tuple(s) for s in own] == steps[i] and merkle.fold(leaves[i], own) == root
        most = max(most, sum(map(len, walk.runs)) + sum(len(s) for t in walk._next for s in t.stack))
        walk.advance()
    assert merkle.block_root(leaves, 3) == root and most <= 3 * 3 * 16


def test_proofs_of_nothing(spark):
    assert merkle.check_tampered(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.check_tampered(spark.createDataFrame([(9, "A", None, None, None, "x", 0, "p", "w")], SCHEMA)).collect()
    assert [tuple(r) for r in one] == plain_proofs([(9, "A", None, None, None)]) and one[0]["leaf"] == one[0]["root"]


# 13 periodic runs


def plain_runs(s, least_words=6, least_periods=4):
    n, out = len(s), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least_words, least_periods * q) and not any(all(s[x] == s[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
        for least in ((6, 4), (2, 2), (3, 3)):
            assert periodic.find_runs(s, *least) == plain_runs(s, *least)


def test_runs_when_hashes_lie(monkeypatch):
    monkeypatch.setattr(periodic.Extensions, "_same", lambda self, i, j, k: True)
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(20)] * rng.randint(1, 4) + [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        assert periodic.find_runs(s) == plain_runs(s)


def test_runs_of_long_texts():
    """A word, two words and a Fibonacci string over a long text take no square of its length."""
    a, b = [0], [0, 1]
    while len(b) < 50000:
        a, b = b, b + a
    assert periodic.find_runs([0] * 100000) == [(0, 100000, 1)]
    assert periodic.find_runs([0, 1] * 50000) == [(0, 100000, 2)]
    assert periodic.find_runs(b) == []
    assert periodic.find_runs([5, *range(3000)] * 20) == [(0, 60020, 3001)]


def test_run_digests_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a", "x y " * 40, "é  日本\x1c " * 9] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    data = [*enumerate(texts), (None, "z " * 10), (4, "x y " * 40), (4, "other")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x", 0, "p", "w") for i, t in data], SCHEMA).repartition(3)
    want, planted = [], 0
    for i, t in data:
        words = (t or "").encode().split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = plain_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert planted > 5
    assert sorted((tuple(r) for r in periodic.digest_planted(df).collect()), key=repr) == sorted(want, key=repr)
    shown = {r["doc_id"]: r for r in periodic.document_runs(df.where("doc_id in (3, 5)")).collect()}
    assert shown[3]["collapsed"] == "a" and [tuple(x) for x in shown[5]["runs"]] == [(0, 18, 2)] and shown[5]["collapsed"].split(" ") == ["é", "日本\x1c"]
    assert periodic.digest_planted(spark.createDataFrame([], SCHEMA)).count() == 0
