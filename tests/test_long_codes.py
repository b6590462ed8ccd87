"""SimHash of texts whose counts fill a lane of a long, the topmost included."""

import hashlib

from pyspark.sql import functions as F

from plaintide.functions import text


def test_counts_do_not_overflow(spark):
    code = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
    word = next(w for w in (f"word{i}" for i in range(99)) if code(w) >> 63)
    rows = [(n, " ".join([word] * n)) for n in (127, 128, 255, 256, 32767, 32768, 40000)]
    got = spark.createDataFrame(rows, "n int, text string").select("n", text.simhash(F.col("text")).alias("c")).collect()
    assert {r["n"]: r["c"] & (2**64 - 1) for r in got} == {n: code(word) for n, _ in rows}
