"""Queries over readers and writers: each writes what it reads below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide import config
from plaintide.operators import ranking
from plaintide.plans.registry import query, table
from plaintide.sources import readers
from plaintide.storage import new_path

KEYED = "canonical_key string, final_score double"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("canonical_key"), F.col("c_acctbal").cast("double").alias("final_score"))


@query("SELECT c_name AS canonical_key, CAST(c_acctbal AS DOUBLE) AS final_score FROM customer WHERE c_custkey % 10 <> 0")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per customer, every tenth broken or blank."""
    k, path = F.col("c_custkey"), new_path(spark, "lines")
    line = F.when(k % 20 == 0, "").when(k % 10 == 0, '{"canonical_key": ').otherwise(F.to_json(F.struct("canonical_key", "final_score")))
    _customers(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.jsonl(spark, path, spark.createDataFrame([], KEYED).schema).where("canonical_key is not null")


@query("SELECT c_name AS canonical_key, CAST(c_acctbal AS DOUBLE) AS final_score FROM customer")
def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of candidates, half of them bare lists."""
    path, rows = new_path(spark, "candidates"), _customers(spark, sf_dir)
    files = rows.groupBy((F.col("c_custkey") % 8).alias("f")).agg(F.to_json(F.collect_list(F.struct("canonical_key", "final_score"))).alias("l"))
    text = F.when(F.col("f") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"candidates": '), "l", F.lit("}")))
    files.select(text.alias("value"), "f").write.partitionBy("f").text(path)
    return readers.candidates(spark, f"{path}/*", spark.createDataFrame([], KEYED).schema)


@query("SELECT c_custkey, c_mktsegment AS source, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 3 <> 0")
def src_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active rows of one source in the newest version of a snapshot."""
    root = new_path(spark, "ledger")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"), "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, "shipped").otherwise("new").alias("status"))
    readers.write_snapshot(rows.withColumn("c_acctbal", F.col("c_acctbal") * 0), root)
    readers.write_snapshot(rows, root)
    found = readers.snapshot(spark, root)
    return found.where((F.col("source") == "MACHINERY") & ~F.col("status").isin(*config.CLOSED)).select("c_custkey", "source", "c_acctbal")


@query("""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, concat('orders ', CAST(count(*) AS VARCHAR)) AS summary, o_orderkey % 2 = 0 AS later FROM orders GROUP BY 1, 3),
a AS (SELECT date, max(summary) FILTER (WHERE NOT later) AS o, max(summary) FILTER (WHERE later) AS n FROM d GROUP BY 1)
SELECT concat('demand:digest:', date) AS key, concat('demand digest ', date) AS title, date, coalesce(n, o) AS summary FROM a""")
def snk_digest_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the days of odd orders, then those of even orders laid over them."""
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 2 == 0).alias("later")).agg(F.concat(F.lit("orders "), F.count(F.lit(1)).cast("string")).alias("summary"))
    none = spark.createDataFrame([], "key string, title string, date string, summary string")
    first = ranking.digest_items(none, days.where("not later").select("date", "summary"))
    return ranking.digest_items(first, days.where("later").select("date", "summary"))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def snk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as JSON lines and read back."""
    path = new_path(spark, "corpus")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)
