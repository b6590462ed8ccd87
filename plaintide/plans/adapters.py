"""Demands, messages and pools made from the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.operators.demand import FREQUENT
from plaintide.plans.registry import table
from plaintide.storage import shuffle_partitions

#: Demands seen before this day make the prior pool.
CUTOFF = "2000-01-01"
#: Rows of a shuffled table that a task is given at most, on average.
ROWS = 1 << 19
#: Customers beyond these are shuffled; Spark broadcasts about as many by its own limit of 10 MB.
CUSTOMERS = 1 << 20


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention of a demand: line items with their order, customer and part.

    Orders meet their customers first, so that the line items, which are many, are shuffled once. Where there are rows for it, tasks are made by the number of rows: the session's partitions may be
    fewer, or be joined to as few as there are cores.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_suppkey") % 3).alias("third"), "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows, session = tasks(spark, sf_dir), shuffle_partitions(spark)
    n, many = max(rows, session), rows > min(session, spark.sparkContext.defaultParallelism)
    if many and customer.count() > CUSTOMERS and not _frequent(orders, "o_custkey"):
        orders, customer = orders.repartition(n, "o_custkey"), customer.repartition(n, "c_custkey")
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    if many:
        li, buyers = li.repartition(n, "l_orderkey"), buyers.repartition(n, "o_orderkey")
    rank = F.left("o_orderpriority", F.lit(1))
    return (
        li.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_partkey").alias("demand_id"),
            F.col("o_custkey").alias("author"),
            F.when(rank.isin("1", "2"), "blocking").when(rank.isin("3", "4"), "need").otherwise("should").alias("urgency"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "free").when(F.col("c_mktsegment") == "FURNITURE", "pro").when(F.col("c_mktsegment") == "MACHINERY", "team").otherwise("enterprise").alias("segment"),
            F.concat(F.lit("s"), F.col("third").cast("string")).alias("channel"),
            F.when(F.col("third") == 0, "internal").otherwise("external").alias("origin"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_shipdate").alias("ts"),
        )
    )


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the mentions are enough for."""
    return -(-table(spark, sf_dir, "lineitem").count() // ROWS)


def crowded(spark: SparkSession, sf_dir: str) -> bool:
    """Whether a demand has more mentions than should meet in one task."""
    return _frequent(table(spark, sf_dir, "lineitem"), "l_partkey")


def _frequent(rows: DataFrame, key: str) -> bool:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return not n.where(F.col("n") > FREQUENT).isEmpty()


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mentions`, those of a demand in one task, so that what is asked of it needs no further shuffle; as they lie if a demand is too frequent."""
    m = mentions(spark, sf_dir)
    return m if crowded(spark, sf_dir) else m.repartition(max(tasks(spark, sf_dir), shuffle_partitions(spark)), "demand_id")


MENTIONS = """SELECT l_partkey AS demand_id, o_custkey AS author,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'blocking' WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN 'need' ELSE 'should' END AS urgency,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'free' WHEN 'FURNITURE' THEN 'pro' WHEN 'MACHINERY' THEN 'team' ELSE 'enterprise' END AS segment,
  concat('s', CAST(l_suppkey % 3 AS VARCHAR)) AS channel, CASE WHEN l_suppkey % 3 = 0 THEN 'internal' ELSE 'external' END AS origin,
  l_returnflag AS flag, l_shipdate AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"""


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One demand per part with the inputs of the three axes."""
    key = F.col("p_partkey")
    fib = lambda i: F.element_at(F.array(*[F.lit(x) for x in (1, 2, 3, 5, 8, 13)]), (i + 1).cast("int"))
    pick = lambda i, *names: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        key.alias("demand_id"),
        F.col("p_name").alias("title"),
        F.lower("p_type").alias("track"),
        pick(F.col("p_size") % 5, "massive", "high", "medium", "low", "minimal").alias("impact_label"),
        F.when(F.col("p_size") % 7 != 0, (F.col("p_size") % 6).cast("double")).alias("effort_weeks"),
        F.least(F.lit(10), key % 11).cast("double").alias("importance"),
        ((key * 7) % 11).cast("double").alias("satisfaction"),
        fib(key % 6).cast("double").alias("ubv"),
        fib(F.floor(key / 6) % 6).cast("double").alias("tc"),
        F.lit(1.0).alias("rr"),
        fib(F.floor(key / 36) % 6).cast("double").alias("job_size"),
        F.when(key % 13 == 0, "rival shipped it").otherwise("").alias("competitor_status"),
        pick(key % 5, "must_be", "performance", "delighter", "indifferent", "reverse").alias("kano"),
        (key % 4 == 0).alias("kano_missing"),
    )


_FIB = "list_extract([1, 2, 3, 5, 8, 13], CAST({} AS INTEGER) + 1)"
PROPOSALS = f"""SELECT p_partkey AS demand_id, p_name AS title, lower(p_type) AS track,
  list_extract(['massive', 'high', 'medium', 'low', 'minimal'], CAST(p_size % 5 AS INTEGER) + 1) AS impact_label,
  CASE WHEN p_size % 7 <> 0 THEN CAST(p_size % 6 AS DOUBLE) END AS effort_weeks,
  CAST(least(10, p_partkey % 11) AS DOUBLE) AS importance, CAST((p_partkey * 7) % 11 AS DOUBLE) AS satisfaction,
  CAST({_FIB.format("p_partkey % 6")} AS DOUBLE) AS ubv, CAST({_FIB.format("(p_partkey // 6) % 6")} AS DOUBLE) AS tc, 1e0 AS rr,
  CAST({_FIB.format("(p_partkey // 36) % 6")} AS DOUBLE) AS job_size,
  CASE WHEN p_partkey % 13 = 0 THEN 'rival shipped it' ELSE '' END AS competitor_status,
  list_extract(['must_be', 'performance', 'delighter', 'indifferent', 'reverse'], CAST(p_partkey % 5 AS INTEGER) + 1) AS kano,
  p_partkey % 4 = 0 AS kano_missing FROM part"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: one channel, a turn replies to the one before."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("conv").alias("channel"),
        F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("author"),
        (F.col("role") != "user").alias("bot"),
        F.lit(None).cast("string").alias("webhook_id"),
        "text",
        F.col("conv_id").alias("thread"),
        F.col("turn").alias("seq"),
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("reply_to"),
    )


MESSAGES = """SELECT 'conv' AS channel, concat(CAST(conv_id AS VARCHAR), ':', role) AS author, role <> 'user' AS bot, CAST(NULL AS VARCHAR) AS webhook_id,
  text, conv_id AS thread, turn AS seq, CASE WHEN turn > 0 THEN turn - 1 END AS reply_to FROM conversations"""
