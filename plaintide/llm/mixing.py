"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within a source rows stand in key order, sorted in ranges: the leading bits of the key number the ranges, as
many as give ``RANGE_ROWS`` rows each if all were one source. The words before a row are the sum of its source's ranges before its own and a
running sum inside the range, so a source with a third of all rows is spread over a third as many windows. Each source
is cut at its exact budget of words, and begun again when the budget is larger.

Null text has size 0. A null source is a source of its own, the last. Rows with equal keys (repeated rows) stand next
to each other. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.llm.work import cut, join_groups

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MOST = 3
RANGE_ROWS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Words of each source and its target: shares by weight, none above ``most`` times its words.

    Handing the excess out again by weight until none is above ends where every source has the smaller of its cap and
    ``level * weight``; the level follows from the caps in order of cap per weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    caps = total.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = W.partitionBy()
    ranked = (
        caps.withColumn("place", F.row_number().over(rising))
        .withColumn("below", F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(everything) - F.sum("weight").over(rising.rowsBetween(W.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("below")) / F.col("left"))
    )
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(everything)["level"]
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(0.0))).alias("target"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text", "source")


def _range(key: str, bits: int) -> Column:
    """Number of the key's range, in key order."""
    return (F.shiftright(key, 64 - bits) + (1 << bits - 1)).cast("long") if bits else F.lit(0).cast("long")


def _budgets(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, range_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows as (doc_id, source, size, key, range), key ranges with the words before them and their source's budget, and the bits of a range's number."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(seed).alias("key"))
    sizes = cut(slim, "sizes")
    bits = (max(sizes.count() - 1, 0) // range_rows).bit_length()
    sizes = sizes.withColumn("range", _range("key", bits))
    targets = cut(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "of")
    filled = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("range_size")
    placed = filled.withColumn("before", before).join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    return sizes, placed.withColumnsRenamed({"source": "of", "range": "in_range"}), bits


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; taken counts words, repeats included."""
    sizes, placed, _ = _budgets(docs, weights, most, seed, range_rows)
    inside = F.sum("size").over(W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = sizes.withColumn("inside", inside).join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    rest = F.col("rest") - F.col("before") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: every document as often as it is taken, the one at a source's budget cut to its last words taken.

    Columns as in ``docs``; ``n_chars`` follows a cut text. All rows of a range are taken alike but for the one range of
    each source that holds its budget's end, so texts are not shuffled for their place: the end of each source, one row a source, is
    joined to them (broadcast up to a counted size, beyond it with hot sources salted), and only rows of the end ranges go through a window.
    """
    sizes, placed, bits = _budgets(docs, weights, most, seed, range_rows)
    ends = cut(
        placed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("range_size"))).select(
            F.col("of").alias("__pt_of"), F.col("in_range").alias("__pt_end"), F.col("epochs").alias("__pt_epochs"), (F.col("rest") - F.col("before")).alias("__pt_rest")
        ),
        "ends",
    )
    keyed = docs.withColumn("__pt_key", _key(seed))
    keyed = keyed.withColumn("__pt_range", _range("__pt_key", bits))
    rows = sizes.groupBy(F.col("source").alias("__pt_of")).agg(F.count(F.lit(1)).alias("rows"))
    joined = join_groups(keyed, F.col("source").cast("string"), F.col("text"), ends, "__pt_of", 4 * ends.count(), rows).where("__pt_epochs is not null")
    whole = joined.where(F.col("__pt_range") != F.col("__pt_end")).withColumn("__pt_words", F.explode(F.array_repeat(F.lit(-1), (F.col("__pt_epochs") + (F.col("__pt_range") < F.col("__pt_end")).cast("int")).cast("int"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    edge = joined.where(F.col("__pt_range") == F.col("__pt_end")).withColumn("__pt_size", size)
    through = F.sum("__pt_size").over(W.partitionBy("__pt_of").orderBy("__pt_key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    part = F.greatest(F.lit(0), F.least("__pt_size", F.col("__pt_rest") - through + F.col("__pt_size"))).cast("int")
    last = F.when(part == 0, F.array().cast("array<int>")).otherwise(F.array(F.when(part == F.col("__pt_size"), -1).otherwise(part)))
    edge = edge.withColumn("__pt_copies", F.concat(F.array_repeat(F.lit(-1), F.col("__pt_epochs").cast("int")), last)).withColumn("__pt_words", F.explode("__pt_copies"))
    # a piece is a word and the white space before it
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(F.col("__pt_words") < 0, F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, F.greatest(F.col("__pt_words"), F.lit(1))), ""))
    shaped = {"text": text, "n_chars": F.when(F.col("__pt_words") < 0, F.col("n_chars")).otherwise(F.length(text)).cast("long")} if "n_chars" in docs.columns else {"text": text}
    # rows without words have no share of the budget
    cut_rows = edge.where("__pt_size > 0").select(*(shaped[c].alias(c) if c in shaped else F.col(c) for c in docs.columns))
    return whole.where(size > 0).select(*docs.columns).unionByName(cut_rows)
