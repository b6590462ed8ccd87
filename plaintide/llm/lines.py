"""Line dedup by site-relative frequency, with DataFrame operations only.

A line is boilerplate on its host if the host's pages that hold it are more than ``ratio`` of all its pages, and more than one: what stands once
is not repeated. The rule is the same for hosts of every size. Lines are compared without spaces at their ends, by a
64-bit hash; blank lines are never boilerplate. At most (lines per page / ratio) lines of a host can be boilerplate, so
what is joined back is small beside the texts.

Two parameters are apart from that rule: ``once`` counts pages of a host with equal texts as one page, here and in the total, so that the lines of a text that was copied
are no boilerplate for that; ``least`` asks for more pages than two. The pipeline sets both, since its next stage takes one of each group of copies and must find them whole.

A null text stays null with 0 lines and is no page; a null host is a host of its own; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.llm.work import cut, join_groups

#: On sf0.1 (20 hosts of 500 pages) nine lines stand on every host, on 1.0 % to 13.2 % of its pages; half the lowest share is taken.
RATIO, LEAST = 0.005, 2


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _mark(line: Column) -> Column:
    """Hash of a line; blank lines have none."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST, once: bool = False) -> DataFrame:
    """host and the array ``marks`` of its boilerplate lines' hashes; hosts without any give no row.

    Pages are counted per (host, line) with map-side sums: a hot host or line reaches a reducer as one row per task.
    """
    return _found(_pages(docs, host, once), ratio, least)


def _pages(docs: DataFrame, host: str, once: bool) -> DataFrame:
    """A row for each page with a text, or for each different text of a host: host and its lines' hashes."""
    marks = F.array_distinct(F.array_compact(F.transform(_lines("text"), _mark)))
    told = docs.where(F.col("text").isNotNull())
    site = F.col(host).cast("string").alias("host")
    pages = told.groupBy(site, F.xxhash64("text").alias("same")).agg(F.first(marks).alias("marks")) if once else told.select(site, marks.alias("marks"))
    return cut(pages, "pages")


def _found(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    counts = pages.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("held"))
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("site_pages"))
    often = counts.where(F.col("held") >= least)
    found = often.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("held") > ratio * F.col("site_pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("mark")).alias("marks"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST, once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``__pt_lines`` and ``__pt_dropped`` counts."""
    pages = _pages(docs, host, once)
    table = cut(_found(pages, ratio, least), "boilerplate").withColumnsRenamed({"host": "__pt_host", "marks": "__pt_marks"})
    values = table.agg(F.coalesce(F.sum(F.size("__pt_marks") + 1), F.lit(0)).alias("n")).first()["n"]
    sizes = docs.groupBy(F.col(host).cast("string").alias("__pt_host")).agg(F.count(F.lit(1)).alias("rows"))
    joined = join_groups(docs, F.col(host).cast("string"), F.col("text"), table, "__pt_host", values, sizes)
    kept = F.filter(_lines("text"), lambda x: F.coalesce(~F.array_contains(F.col("__pt_marks"), _mark(x)), F.lit(True)))
    text = F.when(F.col("__pt_marks").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = F.coalesce(F.size(_lines("text")), F.lit(0)).cast("long")
    left = F.when(F.col("__pt_marks").isNull(), lines).otherwise(F.coalesce(F.size(kept), F.lit(0)).cast("long"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long")
    left = F.when(F.col("text").isNull(), 0).otherwise(left).cast("long")
    names = [c for c in docs.columns if c != "text"]
    return joined.select(*names, text.alias("text"), lines.alias("__pt_lines"), (lines - left).alias("__pt_dropped"))


def clean_documents(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST, once: bool = False) -> DataFrame:
    """Columns as in ``docs``; ``n_chars`` follows the text."""
    done = drop_boilerplate(docs, host, ratio, least, once)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__pt_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
