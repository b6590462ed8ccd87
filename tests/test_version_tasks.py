"""Lines of versions are dealt to tasks by their number; odd versions and edges."""

from plaintide import catalog
from plaintide.operators import versions

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=repr)


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    names = ("src_git", "src_git_range")
    want = {x: rows_of(catalog.queries()[x](spark, SF)) for x in names}
    monkeypatch.setattr(versions, "LINES", 100)
    df = spark.range(90).selectExpr("id as path", "0 as version", "'a\\nb\\n\\na' as text")
    assert versions.tasks(df) == 4
    plan = catalog.queries()["src_git"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 2 and all("REPARTITION_BY_NUM" in x and ", 8), " not in x for x in exchanges)
    assert {x: rows_of(catalog.queries()[x](spark, SF)) for x in names} == want


def test_odd_versions_and_edges(spark):
    """Keys given twice are one version, nulls are no keys of edges, parents and children that are not there hold nothing."""
    v = [(1, 0, "a\na\nb"), (1, 1, "a\na\na\nb"), (1, 1, "c"), (1, 2, None), (1, 3, ""), (None, 0, "x"), (None, 1, "x"), (1, None, "a\nz")]
    e = [(1, 1, 0), (1, 1, 0), (1, 3, 2), (1, 7, 0), (1, 3, 9), (None, 1, 0), (1, None, 0), (1, 0, None)]
    got = versions.added_lines(spark.createDataFrame(v, "path long, version int, text string"), spark.createDataFrame(e, "path long, version long, parent long"))
    lines = {x: spark.sql(f"select unhex(md5('{x}')) as d").first()["d"] for x in ("a", "b", "c", "", "x", "z")}
    named = {bytes(d): x for x, d in lines.items()}
    found = sorted(((r["path"], r["version"], named[bytes(r["digest"])], r["times"]) for r in got.collect()), key=repr)
    want = [(1, 0, "a", 2), (1, 0, "b", 1), (1, 1, "a", 1), (1, 1, "c", 1), (1, 3, "", 1), (1, None, "a", 1), (1, None, "z", 1), (None, 0, "x", 1), (None, 1, "x", 1)]
    assert found == sorted(want, key=repr)
