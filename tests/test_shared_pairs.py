"""Pairs of texts by shared shingles: cut where they lie, sorted once in tasks of bounded size."""

import pyarrow as pa

from plaintide.operators import guard

WORDS = "the quick brown fox jumps over a lazy dog near the old river bank while seven geese walk home in rain"


def test_owners_without_a_place_come_last(spark):
    texts = spark.createDataFrame([(None, WORDS), (5, WORDS), (6, WORDS)], "place long, text string")
    assert [(r["a"], r["b"]) for r in guard.shared_pairs(texts, least=2).collect()] == [(5, 6)]
    assert [(r["a"], r["b"]) for r in guard.shared_pairs(texts.where("place is null or place = 5"), least=2).collect()] == [(5, 5)]


def test_only_two_owners_leave_a_task(monkeypatch):
    monkeypatch.setattr(guard, "HELD", 6)
    rows = [(9, 1), (8, 2), (7, 1), (6, 1), (5, 1), (4, 3), (3, 1), (2, 1), (1, 1)]
    batches = [pa.RecordBatch.from_pylist([{"place": p, "h": h} for p, h in rows[i : i + 3]]) for i in range(0, len(rows), 3)]
    got = [(r["place"], r["h"]) for b in guard._first_two(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted([(8, 2), (4, 3), (5, 1), (6, 1), (1, 1), (2, 1)])


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    texts = spark.range(40).selectExpr("id as place", f"concat('{WORDS} ', id div 2) as text")
    want = sorted(map(tuple, guard.shared_pairs(texts).collect()))
    plan = lambda: guard.shared_pairs(texts)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h" in plan() and plan().index("WindowGroupLimit") < plan().index("REPARTITION_BY_NUM")
    monkeypatch.setattr(guard, "CHARS", 100)
    assert f", {-(-sum(len(r['text']) for r in texts.collect()) // 100)}), REPARTITION_BY_NUM" in plan()
    assert sorted(map(tuple, guard.shared_pairs(texts).collect())) == want == [(0, 1, 14)]
