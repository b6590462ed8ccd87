"""Versions of texts: the lines a version adds, and every content once, so that scanners read what is new.

A version is a row (path, version, text), ``(path, version)`` its key; an edge (path, version, parent) says what it was made from. A version may have several parents
(a merge) or none (the first one). Lines and contents are compared by digest, and only digests are shuffled: scan lines first (:func:`lines`) and keep the findings whose
line was added, or fetch the texts of what is left (:func:`texts_of`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions import text
from plaintide.storage import shuffle_partitions

#: Lines of versions that a task is given, on average.
LINES = 1 << 20


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def lines(versions: DataFrame) -> DataFrame:
    """Each line of each version: path, version, digest, line. A null text has none, an empty one has one empty line."""
    return versions.select("path", "version", F.explode(F.split("text", "\n", -1)).alias("line")).select("path", "version", _digest(F.col("line")).alias("digest"), "line")


def added_lines(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines that a version holds more often than each of its parents: path, version, digest, ``times`` (how much more often).

    Lines are counted, not aligned, so a line that moved is not added. A merge adds only what no parent has; all lines of a version without parents are added,
    and a parent that is not there has no lines. Removed lines are never told. Edges given twice count once.
    Every step deals lines to tasks by their number, and none reduces them before they are dealt, so that a task's memory does not grow with the input.
    """
    c = F.col
    n = max(tasks(versions), shuffle_partitions(versions.sparkSession))
    own = versions.select("path", "version", F.transform(F.split("text", "\n", -1), _digest).alias("digests"))
    links = edges.dropna(subset=["path", "version", "parent"]).select("path", c("parent").alias("version"), c("version").alias("child"))
    # a version's digests are one row, which meets its children; lines are rows of their own only from there on
    met = own.unionByName(links, allowMissingColumns=True).repartition(n, "path", "version").groupBy("path", "version")
    rows = met.agg(F.flatten(F.collect_list("digests")).alias("digests"), F.collect_set("child").alias("children")).where(F.size("digests") > 0)
    counted = rows.select("path", "version", "children", F.explode(_counted(c("digests"))).alias("line"))
    zero, times = F.lit(0).cast("long"), c("line.times")
    own_line = F.struct("version", times.alias("own"), zero.alias("of_parent"))
    told = F.concat(F.array(own_line), F.transform("children", lambda v: F.struct(v.alias("version"), zero.alias("own"), times.alias("of_parent"))))
    each = counted.select("path", "line.digest", F.explode(told).alias("t")).select("path", "t.version", "digest", "t.own", "t.of_parent")
    by_line = each.repartition(n, "path", "version", "digest").groupBy("path", "version", "digest")
    return by_line.agg((F.max("own") - F.max("of_parent")).alias("times")).where("times > 0")


def tasks(versions: DataFrame) -> int:
    """How many tasks the lines of versions are enough for."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return -(-(versions.agg(F.sum(breaks + 1)).first()[0] or 0) // LINES)


def _counted(digests: Column) -> Column:
    """Each digest of a list that is not empty, once, as (digest, times)."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return text.once(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("digest"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("times"))))

    return text.once(F.sort_array(digests), runs)


def contents(versions: DataFrame, order: Column) -> DataFrame:
    """Each distinct text once, by the version that had it first by ``order`` (ties: the smallest path), and how many versions hold it: path, version, digest, ``times``. Null texts are none."""
    named = versions.where("text is not null").select("path", "version", F.sha2("text", 256).alias("digest"), order.alias("_order"))
    first = named.groupBy("digest").agg(F.min(F.struct("_order", "path", "version")).alias("at"), F.count(F.lit(1)).alias("times"))
    return first.select("at.path", "at.version", "digest", "times")


def texts_of(versions: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``kept`` (path, version and more) with the text of their version."""
    return kept.join(versions.select("path", "version", "text"), ["path", "version"])
