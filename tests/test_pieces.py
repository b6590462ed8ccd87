"""Rules over large columns: what is held and tried for a text is bounded, and the results are those of the plain rules."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from plaintide.functions import redaction


def test_batches_stay_in_arrow(spark):
    """A batch of texts is not made into Python objects whole."""
    for f in (redaction.redact, redaction.redact_each, redaction.pii_each, redaction.normalised):
        assert f.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    got = redaction.in_pieces(pa.array([None, "a", "b"] * 100), lambda x: x and x + "!", pa.string())
    assert got.to_pylist() == [None, "a!", "b!"] * 100 and redaction.in_pieces(pa.array([], pa.string()), len, pa.int64()).to_pylist() == []
    rows = spark.createDataFrame([(i, "mail a@b.co" if i % 3 else None) for i in range(300)], "i int, t string").coalesce(1)
    done = rows.select("i", redaction.redact(F.col("t")).alias("r"), redaction.by_rule(1, F.col("t")).alias("one")).orderBy("i").collect()
    assert [r["r"]["redacted"] for r in done] == ["mail [EMAIL_1]" if i % 3 else "" for i in range(300)] and [r["one"]["found"] for r in done] == [int(i % 3 > 0) for i in range(300)]
    assert done[1]["r"]["placeholders"] == {"[EMAIL_1]": "EMAIL"} and done[1]["r"]["found"] == {"EMAIL": 1} and done[0]["r"]["found"] == {}


@pytest.mark.parametrize("said", ["", "plain words", "a@b.co", "card 4111 1111 1111 1111", "+1 415 867 5309", "٤١١١١١١١١١١١١١١١", "１.２.３.４", "key AbCdEf0123456789GhIjKlMnOpQr", "::1", "<@123456789012345678>", "@joe a@b.co"])
def test_rules_that_cannot_fire_are_left_out(monkeypatch, said):
    got, first = redaction.redact_text(said), redaction.redact_text(said, first=True)
    monkeypatch.setattr(redaction, "_possible", lambda *_: True)
    assert got == redaction.redact_text(said) and bool(first[2]) == bool(got[2])
