"""Pairs of 64-bit codes that share a cell key, without listing all pairs of a large cell.

Callers derive ``key`` columns so that every pair they look for shares at least one key. Cells of more than
``CHUNK`` codes are cut into chunks by a hash, and each pair of chunks becomes a unit of work of its own,
so that no task gets a whole hot cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.llm.work import cut, shuffle_partitions

#: Codes of one chunk of a cell.
CHUNK = 2048


def units(entries: DataFrame, keys: list[str], extra: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Entries of the cells with two or more codes, dealt to units of work.

    ``entries`` has the key columns, ``code`` (distinct within a key) and the ``extra`` columns. Returns them with
    ``lo``, ``hi`` (the two chunks that meet in the unit) and ``own`` (the chunk of the code), partitioned and
    sorted by unit.
    """
    spark = entries.sparkSession
    counted = entries.withColumn("members", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("members > 1")
    shared = cut(counted, "cells")
    whole = shared.where(F.col("members") <= chunk).select(*keys, "code", *extra, F.lit(0).alias("own"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    split = F.ceil(F.col("members") / F.lit(float(chunk))).cast("int")
    own = F.pmod(F.xxhash64("code"), split).cast("int")
    large = shared.where(F.col("members") > chunk)
    dealt = large.select(*keys, "code", *extra, own.alias("own"), F.explode(F.sequence(F.lit(0), split - 1)).alias("other"))
    unit = whole.union(dealt.select(*keys, "code", *extra, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    by = [*keys, "lo", "hi"]
    return unit.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by)


def asked_units(entries: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """:func:`units` for a search: ``asks`` is 1 for codes that are looked up, and only cells that hold one are kept.

    A unit holds a chunk ``hi`` of a cell's codes (asks 0), then a chunk ``lo`` of its askers (asks 1). Each asker
    meets each code of its cell in one unit; a cell of g codes with q askers is written g * q / chunk times at most.
    """
    cell = W.partitionBy(*keys)
    counted = entries.withColumn("members", F.count(F.lit(1)).over(cell)).withColumn("askers", F.sum("asks").over(cell))
    shared = cut(counted.where("members > 1 and askers > 0"), "cells")
    chunks = lambda n: F.ceil(F.col(n) / F.lit(float(chunk))).cast("int")
    place = lambda n: F.pmod(F.xxhash64("code"), chunks(n)).cast("int")
    known = shared.select(*keys, "code", F.lit(0).alias("own"), F.lit(0).alias("asks"), F.explode(F.sequence(F.lit(0), chunks("askers") - 1)).alias("lo"), place("members").alias("hi"))
    asking = shared.where("asks = 1").select(*keys, "code", F.lit(0).alias("own"), F.lit(1).alias("asks"), place("askers").alias("lo"), F.explode(F.sequence(F.lit(0), chunks("members") - 1)).alias("hi"))
    by = [*keys, "lo", "hi"]
    return known.union(asking).repartition(shuffle_partitions(entries.sparkSession), *by).sortWithinPartitions(*by, "asks")


def run_units(sorted_units: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray], np.ndarray], list[np.ndarray]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``work(columns, start)`` to whole units; ``start`` holds where units begin, and the end.

    Rows arrive sorted by unit; a unit that spans two Arrow batches is carried over.
    """
    by = [*keys, "lo", "hi"]
    names = [*by, "code", "own", *extra]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _fields(schema)
        held: list[np.ndarray] = []

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(columns[0]), bool)
            change[0] = True
            for x in columns[: len(by)]:
                change[1:] |= x[1:] != x[:-1]
            start = np.concatenate((np.flatnonzero(change), [len(change)]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in work(dict(zip(names, columns, strict=True)), start)], schema=fields)

        for part in parts:
            if not part.num_rows:
                continue
            new = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
            if held:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            last = np.ones(len(new[0]), bool)
            for x in new[: len(by)]:
                last &= x == x[-1]
            if last.all():
                held = new
                continue
            cut_at = len(last) - int(np.argmin(last[::-1]))
            yield done([x[:cut_at] for x in new])
            held = [x[cut_at:] for x in new]
        if held:
            yield done(held)

    return sorted_units.select(*names).mapInArrow(run, schema)


def _fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def links(sorted_units: DataFrame, keys: list[str], accept: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Links ``a < b`` between codes that ``accept`` takes, connecting what each unit connects.

    ``accept(columns, i, j)`` tells for rows i and j of a unit whether they are linked. Small units give their links one by one. Of a large
    one only as many are kept as hold its components together, so a cell of g codes gives O(g) rows and not O(g * g).
    """

    def work(columns: dict[str, np.ndarray], start: np.ndarray) -> list[np.ndarray]:
        code, own = columns["code"], columns["own"]
        sizes = np.diff(start)
        end = np.repeat(start[1:], sizes)
        i = np.flatnonzero(np.repeat(sizes <= 16, sizes))
        left, right, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        while len(i := i[i + step < end[i]]):
            near = i[accept(columns, i, i + step)]
            left.append(near)
            right.append(near + step)
            step += 1
        for a, b in zip(start[:-1][sizes > 16], start[1:][sizes > 16], strict=True):
            x, y = _forest(a, b, own, lambda i, rest: accept(columns, np.full(len(rest), i), rest))
            left.append(x)
            right.append(y)
        a, b = code[np.concatenate(left)], code[np.concatenate(right)]
        return [np.minimum(a, b), np.maximum(a, b)]

    return run_units(sorted_units, keys, work, "a long, b long")


def _forest(start: int, end: int, own: np.ndarray, accept: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the unit of rows ``start`` to ``end``: pairs across its two chunks, or within its only one."""
    label = np.arange(start, end)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    two = own[start:end].min() != own[start:end].max()
    for i in range(start, end):
        rest = np.arange(i + 1, end)
        if two:
            rest = rest[own[rest] != own[i]]
        rest = rest[label[rest - start] != label[i - start]]
        rest = rest[accept(i, rest)]
        if len(rest):
            _, one = np.unique(label[rest - start], return_index=True)
            left.append(np.full(len(one), i))
            right.append(rest[one])
            label[np.isin(label, label[rest - start])] = label[i - start]
    return np.concatenate(left), np.concatenate(right)
