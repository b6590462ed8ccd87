"""Postal codes beside the names of archives."""

from plaintide.operators import guard


def test_codes_that_begin_like_an_archive(spark):
    """64 names an archive, 64123 is a postal code."""
    texts = spark.createDataFrame([(1, "ZIP 64123"), (2, "a zip 64 of 64123 bytes"), (3, "the zip archive is 64123 bytes"), (4, "zip 64, 70001")], "place long, text string")
    assert [(r["place"], r["value"]) for r in guard.zips(texts).collect()] == [(1, "64123")]
