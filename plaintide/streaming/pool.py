"""The live pool: micro-batches of messages become demands in a versioned table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plaintide.functions import text
from plaintide.operators import merging, pool
from plaintide.operators.messages import human
from plaintide.sources import readers


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events per type and window of event time; rows later than ``late`` are dropped. An extension: the batch side has no windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of one author: an event joins the session whose last event is less than ``gap`` before."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def merge_into(root: str, key: str) -> Callable[[DataFrame, int], None]:
    """A batch function that lays each micro-batch over the snapshot at ``root``: running it again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = readers.snapshot(spark, root)
        readers.write_snapshot(batch if old is None else pool.upsert(old, batch, key), root)

    return merge


def merge_demands(root: str, now: Column | None = None) -> Callable[[DataFrame, int], None]:
    """As :func:`merge_into` for whole demands (:func:`plaintide.operators.merging.merge_pool`): stored rows come first, so authors and evidence of
    earlier batches stay. A batch that is run again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        old = readers.snapshot(batch.sparkSession, root)
        rows = batch if old is None else old.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(batch, allowMissingColumns=True)
        readers.write_snapshot(merging.merge_pool(rows, F.current_timestamp() if now is None else now).drop("action", "merged"), root)

    return merge


def flush(messages: DataFrame, classify: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, every: str | None = None, now: Column | None = None) -> StreamingQuery:
    """Messages to the pool, batch by batch: human ones, those with a signal, what ``classify`` makes demands of them, the merge."""
    wanted = human(messages).where(text.has_signal(F.col("text")))
    merge = merge_demands(root, now)
    writer = wanted.writeStream.foreachBatch(lambda batch, n: merge(classify(batch), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_pool(demands: DataFrame, root: str, checkpoint: str, key: str = "canonical_key", every: str | None = None) -> StreamingQuery:
    """Upsert a stream of demands into the snapshot; without ``every`` it works off what is there and stops. Demands with authors and evidence are merged
    whole, other rows replace the ones with their key."""
    whole = {"ordinal", "authors", "evidence", "reach"} <= set(demands.columns)
    writer = demands.writeStream.foreachBatch(merge_demands(root) if whole else merge_into(root, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
