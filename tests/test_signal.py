"""The signal words, grouped by their first letters."""

from pyspark.sql import functions as F

from plaintide.functions import text


def test_signal_by_first_letter(spark):
    """The grouped pattern finds what the plain one does, in any case, with letters that only case folding takes to a plain one."""
    words = ["ERROR", "buK", "ſtuck", "stucK", "İmport", "ımport", "rate-LIMIT", "rate\nlimit", "rate\n\nlimit", "can't", "CANT FIND", "is there any way", "is there no way", "why does", "报错", "报", "为什么没", "为什么", "为", "崩", "", None, "ẞug", "xplan", "la g", "how Do i"]
    rows = spark.createDataFrame([(x,) for x in words], "t string")
    plain = F.coalesce("t", F.lit("")).rlike("(?iu)" + text.SIGNAL)
    got = rows.select("t", text.has_signal(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got] and any(r["got"] for r in got) and not all(r["got"] for r in got)
    assert text.by_letter("(ab|a(c|d)|e)") == "(?=[ae])(?:a(?:b|(c|d))|e(?:))"
