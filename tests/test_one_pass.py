"""Mentions are read and shuffled once for all that is asked of them; where a demand is too frequent for one task, the results are the same."""

import re

import pytest
from pyspark.sql import functions as F

from plaintide import catalog
from plaintide.operators import demand, ranking
from plaintide.plans import adapters, scored

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["evo_process", "evo_decide"])
def test_both_sides_come_from_one_pass(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(scored, "mentions", lambda *a: asked.append(1) or adapters.mentions(*a))
    catalog.queries()[name](spark, SF)
    assert len(asked) == 1


def test_cards_are_made_once_for_a_summary(spark, monkeypatch):
    plan = catalog.queries()["rnd_summary"](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem" not in plan
    cards = scored.scored(spark, SF).withColumns({"summary": F.lit("x"), "evidence": F.array()})
    assert "lineitem" not in ranking.gate(cards.drop("evidence"))._jdf.queryExecution().toString()


def test_a_frequent_demand_is_not_dealt_to_one_task(spark, monkeypatch):
    names = ("evo_decide", "fn_score", "agg_confidence")
    want = {x: rows_of(catalog.queries()[x](spark, SF)) for x in names}
    monkeypatch.setattr(adapters, "FREQUENT", 1)
    assert adapters.crowded(spark, SF)
    monkeypatch.setattr(demand, "gathered", lambda *_, **__: pytest.fail("dealt to one task"))
    assert {x: rows_of(catalog.queries()[x](spark, SF)) for x in names} == want


def test_sides_of_odd_mentions(spark):
    """Null authors and channels, an author with two weights in two channels, a demand that only one side has."""
    rows = [
        (1, 7, "blocking", "free", "a", "internal", "R", "1999-01-01"), (1, 7, "need", "enterprise", "b", "external", "A", "2001-01-01"), (1, None, "need", "free", "", None, None, "2001-01-01"),
        (2, 8, "should", "team", None, "internal", "A", "2001-01-01"), (3, None, "need", "free", "a", "internal", "R", "1999-01-01"),
    ]
    m = spark.createDataFrame(rows, "demand_id long, author long, urgency string, segment string, channel string, origin string, flag string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    old = F.col("ts") < F.lit("2000-01-01").cast("timestamp")
    found = demand.gathered(m, 2, all=F.lit(True), old=old)
    for name, part in (("all", m), ("old", m.where(old))):
        want = demand.evidence(part).join(demand.intensity(part), "demand_id")
        assert rows_of(demand.side(found, name).select(want.columns)) == rows_of(want)
    assert {r["demand_id"]: r["source_set"] for r in demand.side(found, "all").collect()} == {1: ["", "a", "b"], 2: []}
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString() and found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_mentions_get_tasks_by_their_number(spark, monkeypatch):
    """No task is given more line items on average than ``ROWS``, whatever the session's partitions."""
    want = rows_of(catalog.queries()["agg_confidence"](spark, SF))
    monkeypatch.setattr(adapters, "ROWS", 500)
    n = adapters.tasks(spark, SF)
    assert n > 8
    df = catalog.queries()["agg_confidence"](spark, SF)
    dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert {k for k in ("l_orderkey", "o_orderkey", "demand_id") if any(f"{k}#" in x for x in dealt)} == {"l_orderkey", "o_orderkey", "demand_id"}
    assert all(f", {n}), REPARTITION_BY_NUM" in x for x in dealt)
    assert rows_of(df) == want


def dealt_by(df):
    """Keys of the exchanges that keep their number of tasks, with that number."""
    return {tuple(x) for x in re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def test_mentions_keep_their_tasks_where_the_session_has_more(spark, monkeypatch):
    """Spark joins partitions of its own exchanges to as few as there are cores, whatever their rows."""
    want = rows_of(catalog.queries()["agg_confidence"](spark, SF))
    monkeypatch.setattr(adapters, "ROWS", 500)
    had = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert spark.sparkContext.defaultParallelism < adapters.tasks(spark, SF) < 64
        df = catalog.queries()["agg_confidence"](spark, SF)
        assert dealt_by(df) == {("l_orderkey", "64"), ("o_orderkey", "64"), ("demand_id", "64")}
        assert rows_of(df) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_many_customers_get_tasks_by_their_number(spark, monkeypatch):
    """Unless one has more orders than should meet in one task."""
    want = rows_of(catalog.queries()["agg_confidence"](spark, SF))
    monkeypatch.setattr(adapters, "ROWS", 500)
    monkeypatch.setattr(adapters, "CUSTOMERS", 1, raising=False)
    n = str(adapters.tasks(spark, SF))
    df = catalog.queries()["agg_confidence"](spark, SF)
    assert dealt_by(df) == {(x, n) for x in ("o_custkey", "c_custkey", "l_orderkey", "o_orderkey", "demand_id")}
    assert rows_of(df) == want
    monkeypatch.setattr(adapters, "FREQUENT", 1)
    df = catalog.queries()["agg_confidence"](spark, SF)
    assert dealt_by(df) == {("l_orderkey", n), ("o_orderkey", n)}
    assert rows_of(df) == want


def test_intensity_gets_tasks_by_its_mentions(spark, monkeypatch):
    want = rows_of(catalog.queries()["agg_intensity"](spark, SF))
    monkeypatch.setattr(adapters, "ROWS", 500)
    n = str(adapters.tasks(spark, SF))
    df = catalog.queries()["agg_intensity"](spark, SF)
    assert dealt_by(df) == {(x, n) for x in ("l_orderkey", "o_orderkey", "demand_id")}
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert rows_of(df) == want
    monkeypatch.setattr(adapters, "FREQUENT", 1)
    assert rows_of(catalog.queries()["agg_intensity"](spark, SF)) == want
