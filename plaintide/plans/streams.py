"""Queries over streams: tables are written as files that arrive one after the other, and worked off in bounded batches."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.functions import text
from plaintide.operators import messages
from plaintide.plans.registry import query, table
from plaintide.plans.texts import ALIAS_SQL
from plaintide.storage import new_path
from plaintide.streaming import keyed

FADE_HOURS, FILES = 12, 3

DEMANDS = """SELECT concat('k', CAST(user_id AS VARCHAR)) AS canonical_key, event_id AS ordinal, concat('t', CAST(event_id AS VARCHAR)) AS title, CASE WHEN event_id % 5 = 0 THEN concat('why ', CAST(event_id AS VARCHAR)) ELSE '' END AS why,
 event_id % 7 AS reach, concat('u', CAST(event_id % 61 AS VARCHAR)) AS author, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(event_type, ' ', CAST(event_id % 23 AS VARCHAR)) END AS snippet, ts FROM events"""
POOL = f"""WITH r AS ({DEMANDS}), f AS (SELECT canonical_key, arg_min(title, ordinal) AS title, arg_min(reach, ordinal) AS r0, coalesce(arg_min(why, ordinal) FILTER (WHERE why <> ''), '') AS why, count(*) AS n, count(DISTINCT author) AS authors, min(ts) AS first_seen, max(ts) AS last_seen FROM r GROUP BY 1),
e AS (SELECT canonical_key, string_agg(snippet, ',' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY o) AS p FROM (SELECT canonical_key, snippet, min(ordinal) AS o FROM r WHERE snippet <> '' GROUP BY 1, 2)) WHERE p <= 8 GROUP BY 1)
SELECT canonical_key, title, why, CAST(greatest(r0, authors) AS BIGINT) AS reach, authors, CAST(n - 1 AS BIGINT) AS merged, coalesce(evidence, '') AS evidence, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen,
CASE WHEN epoch_ms(last_seen) + {FADE_HOURS} * 3600000 <= (SELECT epoch_ms(max(ts)) FROM events) - 86400000 THEN 'faded' ELSE 'new' END AS status FROM f LEFT JOIN e USING (canonical_key)"""


def _arrive(spark: SparkSession, sf_dir: str) -> str:
    """The events as demands in files, the days in their order."""
    k, said, folder = F.col("event_id"), lambda x: x.cast("string"), new_path(spark, "arriving")
    snippet = F.when(k % 11 == 0, "").otherwise(F.concat("event_type", F.lit(" "), said(k % 23)))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), said(F.col("user_id"))).alias("canonical_key"), k.cast("long").alias("ordinal"), F.concat(F.lit("t"), said(k)).alias("title"), F.when(k % 5 == 0, F.concat(F.lit("why "), said(k))).otherwise("").alias("why"),
        (k % 7).cast("long").alias("reach"), F.concat(F.lit("u"), said(k % 61)).alias("author"), snippet.alias("snippet"), F.col("ts").cast("timestamp").alias("ts"),
    )
    for i in range(FILES):
        rows.where(F.floor(F.dayofmonth("ts") * FILES / 32) == i).coalesce(1).write.mode("append").parquet(folder)
    return folder


def _shown(pool: DataFrame) -> DataFrame:
    return pool.withColumns({x: F.col(x).cast("string") for x in ("first_seen", "last_seen")})


@query(POOL)
def stm_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live pool of a stream, a file a batch, as the merge of all its rows at once would give it."""
    root = new_path(spark, "live")
    keyed.follow(keyed.arriving(spark, _arrive(spark, sf_dir)), f"{root}/pool", f"{root}/checkpoint", timedelta(hours=FADE_HOURS)).awaitTermination()
    return _shown(keyed.pool_of(spark, f"{root}/pool"))


@query(f"SELECT canonical_key, merged + 1 AS rows, authors, evidence, last_seen FROM ({POOL})")
def stm_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog that is stopped after its first batch and worked off from the checkpoint later: no row is lost or counted twice."""
    root, folder, fade = new_path(spark, "live"), _arrive(spark, sf_dir), timedelta(hours=FADE_HOURS)
    begun = keyed.follow(keyed.arriving(spark, folder), f"{root}/pool", f"{root}/checkpoint", fade, every="0 seconds")
    while begun.isActive and not begun.recentProgress:
        time.sleep(0.1)
    begun.stop()
    keyed.follow(keyed.arriving(spark, folder), f"{root}/pool", f"{root}/checkpoint", fade).awaitTermination()
    return _shown(keyed.pool_of(spark, f"{root}/pool")).select("canonical_key", (F.col("merged") + 1).alias("rows"), "authors", "evidence", "last_seen")


_TALK = "SELECT conv_id * 100 + turn AS id, conv_id // 3 AS thread, concat(CAST(conv_id // 3 AS VARCHAR), ':', role) AS author, role, text, CASE WHEN turn > 0 AND (conv_id + turn) % 3 <> 0 THEN conv_id * 100 + turn - 1 WHEN conv_id % 50 = 7 AND turn = 0 THEN -5 END AS reply_to, TIMESTAMP '2024-01-01' + to_seconds((conv_id // 3) * 7200 + (conv_id % 3) * 900 + turn * (140 + 20 * (conv_id % 2))) AS ts FROM conversations"


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    at = F.floor(c / 3) * 7200 + (c % 3) * 900 + t * (140 + 20 * (c % 2))
    author = F.concat(F.floor(c / 3).cast("string"), F.lit(":"), "role")
    reply = F.when((t > 0) & ((c + t) % 3 != 0), c * 100 + t - 1).when((c % 50 == 7) & (t == 0), -5)
    return table(spark, sf_dir, "conversations").select((c * 100 + t).cast("long").alias("id"), F.lit("c").alias("channel"), author.alias("author"), "role", "text", reply.cast("long").alias("reply_to"), F.timestamp_seconds(F.lit(1704067200) + at).alias("ts"))


@query(f"""WITH RECURSIVE m AS ({_TALK}), l AS (SELECT id, lag(id) OVER w AS b, ts - lag(ts) OVER w AS gap FROM m WINDOW w AS (PARTITION BY author ORDER BY ts, id)),
e AS MATERIALIZED (SELECT id AS a, b FROM l WHERE gap < INTERVAL 5 MINUTE UNION SELECT b, id FROM l WHERE gap < INTERVAL 5 MINUTE UNION SELECT id, reply_to FROM m WHERE reply_to IN (SELECT id FROM m) UNION SELECT reply_to, id FROM m WHERE reply_to IN (SELECT id FROM m)),
r AS (SELECT id, id AS o FROM m UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a) SELECT id, min(o) AS session FROM r GROUP BY 1""")
def stm_session_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of messages by chains of replies and bursts of one author."""
    return messages.sessions(_talk(spark, sf_dir)).select("id", "session")


@query(f"""WITH m AS (SELECT *, trim(lower(text)) AS t FROM ({_TALK}) WHERE role = 'user' AND trim(coalesce(text, ''), ' ') <> '' AND regexp_matches(text, '(?i){text.SIGNAL.replace(chr(39), chr(39) * 2)}')),
k AS (SELECT *, list_transform(list_slice(regexp_extract_all(t, '[a-z][a-z0-9\\-]{{2,}}'), 1, 4), lambda t: {ALIAS_SQL}) AS w FROM m)
SELECT concat(array_to_string(list_sort(list_distinct(CASE WHEN len(w) > 0 THEN w ELSE list_filter([trim(substr(t, 1, 24))], lambda x: x <> '') END)), '|'), '::general') AS canonical_key, count(*) AS rows, count(DISTINCT author) AS authors, arg_min(text, id) AS title FROM k GROUP BY 1""")
def stm_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that arrive, to the pool: human ones with a signal, a demand for each, merged by key."""
    root, folder = new_path(spark, "live"), new_path(spark, "messages")
    told = _talk(spark, sf_dir).select("id", "channel", "author", (F.col("role") != "user").alias("bot"), F.lit(None).cast("string").alias("webhook_id"), "text", "ts")
    for i in range(2):
        told.where(F.floor(F.col("id") / 100) % 2 == i).coalesce(1).write.mode("append").parquet(folder)

    def classify(rows: DataFrame) -> DataFrame:
        judged = messages.demand_rows(rows.withColumns({"title": F.col("text"), "track": F.lit("")}))
        return judged.select("canonical_key", F.col("id").alias("ordinal"), "title", F.lit("").alias("why"), F.lit(0).cast("long").alias("reach"), "author", F.lit("").alias("snippet"), "ts")

    stream = keyed.arriving(spark, folder, told.schema.simpleString()[7:-1].replace(":", " "))
    keyed.flush(stream, classify, f"{root}/pool", f"{root}/checkpoint", timedelta(days=36500), late="36500 days").awaitTermination()
    pool = keyed.pool_of(spark, f"{root}/pool")
    return pool.select("canonical_key", (F.col("merged") + 1).alias("rows"), "authors", "title")
