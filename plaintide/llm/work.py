"""Scratch tables of the training-data operators, and joins of texts with a row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.storage import clear, cut, new_path, shared_dir, shuffle_partitions

__all__ = ["clear", "cut", "join_groups", "new_path", "shared_dir", "shuffle_partitions"]

#: Values (array elements or rows) of a table that goes to every task; beyond them it is shuffled.
BROADCAST_VALUES = 1 << 18


def join_groups(rows: DataFrame, key: Column, spread_by: Column, groups: DataFrame, of: str, values: int, sizes: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``groups``, one row for each value of ``of``, null keys included.

    ``values`` counts what ``groups`` holds: up to ``BROADCAST_VALUES`` it is broadcast. Beyond, both sides are shuffled, and the keys with
    more rows than a fair share of a partition are salted by a hash of ``spread_by``. ``sizes`` (of, rows) tells them; fewer than the number
    of partitions can have so many, so that list is always broadcast. The result is the same either way.
    """
    if values <= BROADCAST_VALUES:
        return rows.join(F.broadcast(groups), key.eqNullSafe(F.col(of)), "left")
    n = shuffle_partitions(rows.sparkSession)
    total = float(sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"])
    hot = sizes.where(F.col("rows") * n > total).select(F.col(of).alias("__pt_join_hot"), F.ceil(F.col("rows") * n / F.lit(max(total, 1.0))).cast("int").alias("__pt_join_salts"))
    hot = F.broadcast(cut(hot, "hot"))
    salts = F.coalesce("__pt_join_salts", F.lit(1))
    salted = rows.withColumn("__pt_join_key", key).join(hot, F.col("__pt_join_key").eqNullSafe(F.col("__pt_join_hot")), "left").withColumn("__pt_join_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("__pt_join_hot", "__pt_join_salts")
    copies = groups.join(hot, F.col(of).eqNullSafe(F.col("__pt_join_hot")), "left").withColumn("__pt_join_copy", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__pt_join_hot", "__pt_join_salts")
    return salted.join(copies, F.col("__pt_join_key").eqNullSafe(F.col(of)) & (F.col("__pt_join_salt") == F.col("__pt_join_copy")), "left").drop("__pt_join_key", "__pt_join_salt", "__pt_join_copy")
