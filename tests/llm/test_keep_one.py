"""Rows that share a doc_id, or have none, are kept or dropped each for itself."""

from plaintide.llm import neardup
from tests.llm.test_operators import docs_of


def test_rows_and_missing_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (5, b, "t"), (6, b, "s"), (7, None, "s"), (7, "", "s"), (None, c, "s"), (None, c, "t"), (None, d, "s"), (None, a, "s"), (None, a, "s")]
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in neardup.keep_one(docs_of(spark, rows).repartition(3)).collect())
    assert kept == sorted([("3", a), ("5", b), ("7", "None"), ("7", ""), ("None", c), ("None", d), ("None", a)])
