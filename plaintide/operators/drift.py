"""How far a change of weights reorders the scored demands."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.config import SCORING
from plaintide.functions import scoring
from plaintide.storage import cut


def rescored(items: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Final scores with the RICE factors weighted; here an effort of 0 counts as unknown."""
    effort = F.when(F.col("effort_weeks").isNull() | (F.col("effort_weeks") == 0), SCORING["effort_unknown"]).otherwise(F.col("effort_weeks"))
    raw = scoring.rice(
        F.col("reach") * F.lit(weights.get("reach", 1.0)), F.col("impact") * F.lit(weights.get("impact", 1.0)), F.col("confidence") * F.lit(weights.get("confidence", 1.0)), effort * F.lit(weights.get("effort", 1.0))
    )
    return items.select("demand_id", scoring.final_score(raw).alias("score"))


def count_inversions(order: np.ndarray) -> int:
    """Pairs that stand in falling order, of distinct numbers: bit by bit from the highest, as a radix sort parts them."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(n)
    total = 0
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        # numbers equal in their higher bits stand together, in the order they came in
        group = rank >> (bit + 1)
        start = np.searchsorted(group, group)
        one = rank >> bit & 1
        ones = np.concatenate(([0], np.cumsum(one)))
        larger = ones[:-1] - ones[start]
        total += int(larger[one == 0].sum())
        zeros_of_group = np.bincount(group, one == 0)[group].astype(np.int64)
        at = np.arange(n)
        to = np.where(one == 0, at - larger, start + zeros_of_group + larger)
        moved = np.empty(n, np.int64)
        moved[to] = rank
        rank = moved
    return total


def _falling(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block in falling order of ``v``, taken in the order of ``pos``; equal values are no pair."""
    v = rows.sort_values("pos")["v"].to_numpy()
    return pd.DataFrame({"v": [count_inversions(v * len(v) + np.arange(len(v)))]})


def inversions(pairs: DataFrame, block_bits: int = 16, digit_bits: int = 8) -> DataFrame:
    """Discordant pairs of two rankings: rows (id, r1, r2), ranks from 1 and without ties, to (n, discordant).

    The rows are sorted by ``r2`` from its highest digit on, as a radix sort does, starting in the order of ``r1``. At each level those equal in their
    higher digits hold a run of places of their own; what stands earlier there with a larger digit is an inversion, counted inside blocks of ``2 ** block_bits``
    places and, across blocks, from their digit counts. Once a run fits a block it is finished there. A task holds a block at most; 10^10 rows take three levels.
    """
    pairs = cut(pairs.select((F.col("r1") - 1).cast("long").alias("pos"), (F.col("r2") - 1).cast("long").alias("r2")), "ranks")
    n = pairs.count()
    block, digit = F.shiftright("pos", block_bits), F.col("digit")
    high, found = max(n - 1, 0).bit_length(), []
    while high > block_bits:
        step = min(digit_bits, high - block_bits)
        low = high - step
        rows = pairs.withColumn("block", block).withColumn("digit", F.shiftright("r2", low).bitwiseAND((1 << step) - 1))
        found.append(rows.select("block", "pos", digit.alias("v")).groupBy("block").applyInPandas(_falling, "v long"))

        # digits of each block, also those it does not hold, and how many of each stand in earlier blocks of its run
        held = rows.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("k"))
        every = rows.select("block").distinct().withColumn("digit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << step) - 1).cast("long"))))
        run = F.shiftright("block", high - block_bits)
        earlier = W.partitionBy(run, "digit").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        counts = every.join(held, ["block", "digit"], "left").fillna(0, "k").withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
        counts = cut(counts, "digits")
        larger = F.coalesce(F.sum("before").over(W.partitionBy("block").orderBy(F.desc("digit")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found.append(counts.select((F.col("k") * larger).alias("v")))

        nth = F.row_number().over(W.partitionBy("block", "digit").orderBy("pos")) - 1
        start = F.shiftleft(F.shiftright("r2", low), low)
        moved = rows.withColumn("nth", nth).join(counts.select("block", "digit", "before"), ["block", "digit"])
        pairs, high = cut(moved.select((start + F.col("before") + F.col("nth")).alias("pos"), "r2"), "ranks"), low
    found.append(pairs.select(block.alias("block"), "pos", F.col("r2").alias("v")).groupBy("block").applyInPandas(_falling, "v long"))
    return functools.reduce(DataFrame.union, found).agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("discordant"))


def decision(tau: Column, churn: Column) -> Column:
    s = SCORING
    return (
        F.when((tau >= s["block_tau"]) | (churn >= s["block_churn"]), "block").when((tau > s["max_tau"]) | (churn > s["max_churn"]), "needs_review").otherwise("auto_pass")
    )
