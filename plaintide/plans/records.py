"""Queries over record operators: ledgers, renders, egress checks, repository rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.functions import text
from plaintide.operators import demand, pool, ranking, records
from plaintide.plans.adapters import MENTIONS, mentions
from plaintide.plans.registry import query, table
from plaintide.plans.scored import REWEIGHT, _ranked, over, scored
from plaintide.plans.texts import PAIRS_SQL, PATHS_SQL, _paths, documents
from plaintide.sources import ledger
from plaintide.storage import new_path


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'shipped' ELSE 'new' END AS status, CAST(CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2026-06-25' ELSE o_orderdate END AS VARCHAR) AS last_seen FROM orders")
def snk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("new").alias("status"), F.col("o_orderdate").cast("timestamp").alias("last_seen"))
    done = records.set_status(rows, rows.where("key % 4 = 0").select("key"), "shipped", F.lit("2026-06-25").cast("timestamp"))
    return done.withColumn("last_seen", F.col("last_seen").cast("string"))


@query("SELECT CAST(max(ts) AS VARCHAR) AS last_run_at FROM events")
def snk_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a ledger, each committed with the largest time it has seen, after its rows are written."""
    root, events = new_path(spark, "watermark"), table(spark, sf_dir, "events")
    for run, rows in (("half", events.where("event_id % 2 = 0")), ("whole", events)):
        last = records.watermark(rows, "ts").select(F.col("last_run_at").cast("string")).first()[0]
        ledger.upsert(rows.groupBy("user_id").agg(F.max("ts").alias("last")), "user_id", root, run, F.lit(last))
    return ledger.watermark(spark, root).select(F.col("last_run_at").cast("string").alias("last_run_at"))


@query("""SELECT id, substr(title, 1, 240) AS title, md5(substr(body, 1, 4000)) AS digest, CAST(1 AS INTEGER) AS n_fields, length(substr(title, 1, 240)) + length(substr(body, 1, 4000)) + length(substr(body, 1, 1024)) AS total,
 length(title) > 0 AND length(substr(title, 1, 240)) + length(substr(body, 1, 4000)) + length(substr(body, 1, 1024)) <= 6000 AS ok FROM (SELECT doc_id AS id, concat(source, ' ', lang) AS title, text AS body FROM documents)""")
def snk_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("body"), F.array("text").alias("fields"))
    return records.embed(cards).select("id", "title", F.md5("description").alias("digest"), "n_fields", F.col("total").cast("long").alias("total"), "ok")


@query()
def flt_dlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: the whole text is the title, its lines are the evidence."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("redacted_snippet"), F.lit("").alias("quote")))
    cards = documents(spark, sf_dir).select("doc_id", F.col("text").alias("title"), F.col("source").alias("summary"), lines.alias("evidence"))
    return records.leaks(cards, ["title", "summary"], "evidence").select("doc_id", F.array_join("leaked", ",").alias("leaked"))


@query()
def snk_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.leaks(table(spark, sf_dir, "conversations"), ["text"]).select("conv_id", "turn", (F.size("leaked") == 0).alias("sent"))


@query()
def prj_scrub_ents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(records.scrub(text.entities(F.col("text"))), ",").alias("entities"))


@query()
def prj_redact_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: the text is the title, its lines are the evidence. Nothing is cut before the redaction."""
    none = F.lit(None).cast("string")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(none.alias("redacted_snippet"), x.alias("quote")))
    d = documents(spark, sf_dir).withColumns({"title": F.col("text"), "summary": F.col("source"), "inferred_job": F.col("lang"), "evidence": lines})
    d = d.withColumns({"why": none, "recommendation": none, "action": none, "authors": F.array(F.struct(F.col("source").alias("user_id"), none.alias("author"), none.alias("author_hash")))})
    card = records.redact_card(d, "query-salt")
    return card.select("doc_id", "title", "summary", "inferred_job", F.array_join("evidence.redacted_snippet", "\n").alias("evidence"), F.col("authors")[0]["author_hash"].alias("author"))


@query(f"""WITH m AS ({MENTIONS}), r AS (SELECT demand_id, count(DISTINCT author) AS n FROM m GROUP BY 1), f AS (SELECT demand_id, n, round(n * 1e0 * 0.5e0 / 2e0, 6) AS rice_raw FROM r), g AS (SELECT *, round(100e0 * rice_raw / (rice_raw + 6e0), 4) AS final_score FROM f)
SELECT demand_id, n AS authors, rice_raw, final_score, CASE WHEN final_score >= 85 THEN 'A' WHEN final_score >= 75 THEN 'B+' WHEN final_score >= 65 THEN 'B' WHEN final_score >= 55 THEN 'C+' WHEN final_score >= 45 THEN 'C' ELSE 'D' END AS grade FROM g""")
def fn_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demand.author_weight(mentions(spark, sf_dir)).groupBy("demand_id").agg(F.count(F.lit(1)).alias("authors"))
    return records.rescored(rows)


@query("SELECT event_id FROM events WHERE hour(ts) >= 18 AND CAST(ts AS DATE) <> DATE '2024-01-05'")
def dt_hourgate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.hour_gate(table(spark, sf_dir, "events"), 18, F.lit("2024-01-05").cast("date")).select("event_id")


STATUS_OF = ("new", "triaged", "in_progress", "shipped", "wontfix", "duplicate")
_HEAD = "concat('\"', substr(title, 1, 70), '\" (', grade, ' ', CAST(final_score AS VARCHAR), ', reach ', CAST(CAST(reach AS BIGINT) AS VARCHAR)"
_DAY = "2001-10-20"


@query(over(f""", r AS (SELECT *, CAST(last_seen AS DATE) = DATE '{_DAY}' AS touched, list_extract({list(STATUS_OF)}, CAST(demand_id % 6 AS INTEGER) + 1) AS status FROM s),
td AS (SELECT string_agg(concat('- ', {_HEAD}, ')')), chr(10) ORDER BY n) AS x FROM (SELECT *, row_number() OVER (ORDER BY final_score DESC, demand_id) AS n FROM r WHERE touched) WHERE n <= 15),
bt AS (SELECT string_agg(concat(CAST(n AS VARCHAR), '. ', {_HEAD}, ', ', status, ')')), chr(10) ORDER BY n) AS x FROM (SELECT *, row_number() OVER (ORDER BY final_score DESC, demand_id) AS n FROM r) WHERE n <= 15),
ct AS (SELECT count(*) FILTER (WHERE touched) AS touched, count(*) AS backlog FROM r)
SELECT touched, backlog, substr(concat('Daily demand summary, {_DAY}', chr(10), 'Touched today: ', CAST(touched AS VARCHAR), ' | Total backlog: ', CAST(backlog AS VARCHAR), chr(10),
CASE WHEN touched > 0 THEN concat(chr(10), 'Today', chr(10), td.x, chr(10)) ELSE '' END, chr(10), 'All-time top ', CAST(least(15, backlog) AS VARCHAR), chr(10), bt.x), 1, 3900) AS message FROM ct, td, bt""").replace("s3) ,", "s3),"))
def rnd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, STATUS_OF)), (F.col("demand_id") % 6 + 1).cast("int"))
    rows = scored(spark, sf_dir).withColumns({"status": status, "first_seen": F.lit(None).cast("timestamp")})
    return ranking.summary(rows.withColumn("first_seen", F.coalesce("first_seen", "last_seen")), F.lit(_DAY).cast("date"))


@query(over("""SELECT concat('📊 **需求头条** · 2001-11-05', chr(10), '合格 ', CAST(good AS VARCHAR), ' · 精选 ', CAST(least(5, good) AS VARCHAR), ' · 剔噪 ', CAST(noise AS VARCHAR), ' · 候选 2000', chr(10), chr(10),
 (SELECT string_agg(concat('**', CAST(n AS VARCHAR), '.【', CASE tier WHEN 'tier0' THEN '立即' WHEN 'tier1' THEN '本周' WHEN 'tier2' THEN '本月' ELSE '储备' END, CASE kano WHEN 'must_be' THEN '·刚需' WHEN 'performance' THEN '·期望' WHEN 'delighter' THEN '·惊喜' ELSE '' END,
   '】', title, '**', chr(10), CASE demand_id % 4 WHEN 0 THEN 'needed daily。建议：build it' WHEN 1 THEN 'needed daily.' WHEN 2 THEN '建议：build it' ELSE 'the job' END, chr(10), grade, ' ', CAST(final_score AS VARCHAR), ' · RICE=', CAST(rice_raw AS VARCHAR), ' · 1证据', chr(10)), chr(10) ORDER BY n)
  FROM (SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'tier0' THEN 0 WHEN 'tier1' THEN 1 WHEN 'tier2' THEN 2 WHEN 'backlog' THEN 3 WHEN 'cut' THEN 9 ELSE 5 END, final_score DESC, canonical_key, demand_id) AS n FROM s WHERE tier <> 'cut') WHERE n <= 5),
 chr(10), CASE WHEN good > 5 THEN concat('另有 ', CAST(good - 5 AS VARCHAR), ' 条合格需求；完整卡片见当日私有归档。') ELSE '完整卡片见当日私有归档。' END) AS message FROM (SELECT count(*) FILTER (WHERE tier <> 'cut') AS good, count(*) FILTER (WHERE tier = 'cut') AS noise FROM s)"""))
def rnd_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("demand_id")
    why = F.when(k % 4 == 0, "needed daily").when(k % 4 == 1, "needed daily.").otherwise("")
    told = {"inferred_job": F.lit("the job"), "why": why, "recommendation": F.when(k % 2 == 0, "build it").otherwise(""), "evidence": F.array(F.lit("one"))}
    return ranking.message(scored(spark, sf_dir).withColumns(told), "2001-11-05", 2000)


FLAGS_SQL = f"""WITH {PAIRS_SQL}, e AS (SELECT doc_id, list(t ORDER BY n) AS l FROM o WHERE n <= 8 GROUP BY 1), x AS (SELECT left_id, right_id, a.l AS a, b.l AS b, d.lang = f.lang AS same, len(list_filter(a.l, lambda v: list_contains(b.l, v))) AS k
 FROM s JOIN e a ON a.doc_id = left_id JOIN e b ON b.doc_id = right_id JOIN documents d ON d.doc_id = left_id JOIN documents f ON f.doc_id = right_id WHERE similarity >= 0.45e0)"""


def _flagged(spark: SparkSession, sf_dir: str, **told: Column) -> DataFrame:
    """Similar pairs with what is ``told`` of each side, expressions on its tokens and lang; texts are parsed once."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), text.entities(F.col("text"), text.TOKENS_OF_SETS).alias("tokens"), "lang")
    return pool.similar(rows.select("id", "tokens", *[x.alias(k) for k, x in told.items()]), 0.45)


def _key() -> Column:
    return F.slice("tokens", 1, text.TOKENS_OF_ENTITIES)


@query(f"{FLAGS_SQL} SELECT left_id, right_id, k >= 2 OR (k >= 1 AND same) AS strong FROM x")
def join_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, key=_key(), lang=F.col("lang")).select("left_id", "right_id", pool.strong(F.col("left_key"), F.col("right_key"), F.col("left_lang") == F.col("right_lang")).alias("strong"))


@query(f"{FLAGS_SQL} SELECT left_id, right_id, k = len(a) OR k = len(b) OR a[1] = b[1] AS agree FROM x")
def join_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, key=_key()).select("left_id", "right_id", pool.subjects_agree(F.col("left_key"), F.col("right_key")).alias("agree"))


@query(f"{FLAGS_SQL.replace('n <= 8', f'n <= {text.TOKENS_OF_SETS}')} SELECT left_id, right_id, k = len(a) OR k = len(b) OR a[1] = b[1] AS agree FROM x")
def join_subject_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject guard over the whole token sets, as matching uses it; ``join_subject`` compares the key entities."""
    j = _flagged(spark, sf_dir, first=F.get("tokens", F.lit(0)), size=F.size("tokens"))
    n, m, s = F.col("left_size"), F.col("right_size"), F.col("similarity")
    common = F.round(s * (n + m) / (1 + s))  # similarity is common / (n + m - common)
    return j.select("left_id", "right_id", ((common == n) | (common == m) | (F.col("left_first") == F.col("right_first"))).alias("agree"))


@query(over(f", {REWEIGHT} SELECT demand_id, r1, r2, abs(r1 - r2) AS shift FROM k").replace("s3) ,", "s3),"))
def join_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return r.select("demand_id", F.col("r1").cast("long").alias("r1"), F.col("r2").cast("long").alias("r2"), F.abs(F.col("r1") - F.col("r2")).cast("long").alias("shift"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS owner, concat('repo-', c_custkey % 40, CASE c_custkey % 3 WHEN 0 THEN '-data' WHEN 1 THEN '' ELSE '-x' END) AS name FROM customer),
k AS (SELECT name, min(c_custkey) AS ordinal, arg_min(owner, c_custkey) AS owner FROM c WHERE name <> 'repo-1' AND name NOT IN ('repo-1-data', 'repo-1-private', 'repo-1-config', 'repo-1-internal') AND (suffix(name, '-data') OR suffix(name, '-x')) GROUP BY 1),
p AS (SELECT DISTINCT owner, name FROM c WHERE c_custkey % 3 = 1)
SELECT days, k.name, ordinal, CASE WHEN p.name IS NOT NULL AND days <= 30 THEN 'derived' ELSE 'linkage' END AS kind, CASE WHEN days <= 30 THEN p.name END AS witness
FROM k LEFT JOIN p ON p.owner = k.owner AND concat(p.name, '-data') = k.name, (SELECT unnest([1, 30, 31]) AS days)""")
def join_xrepo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories of their nation, a third of them public; guarded under maps of three ages."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("repo-"), (k % 40).cast("string"), F.when(k % 3 == 0, "-data").when(k % 3 == 1, "").otherwise("-x"))
    repos = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner"), name.alias("name"), k.alias("ordinal"))
    guarded = lambda days: records.cross_names(repos, "repo-1", repos.where("ordinal % 3 = 1"), F.lit(days * 86400)).withColumn("days", F.lit(days))
    return guarded(1).union(guarded(30)).union(guarded(31))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'DEBT' ELSE 'BLOCK' END WHEN 'view' THEN 'WARN' ELSE 'BLOCK' END AS severity FROM events")
def pg_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "error", "secret").when(t == "click", "linkage").when(t == "view", "derived").otherwise("structural")
    return table(spark, sf_dir, "events").select("event_id", records.severity(kind, F.when(F.col("event_id") % 2 == 0, "history").otherwise("tree")).alias("severity"))


@query(f"SELECT page_id, path, 'md' AS kind FROM ({PATHS_SQL}) WHERE suffix(path, '.md')")
def dg_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.eligible(_paths(spark, sf_dir))


@query(f"SELECT page_id, path FROM ({PATHS_SQL}) WHERE suffix(path, '.example.md')")
def lb_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.templates(_paths(spark, sf_dir))


@query("SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 7 = 0 THEN 'no generator' WHEN page_id % 5 = 0 THEN 'failed' WHEN page_id % 3 = 0 THEN 'not generated' WHEN page_id % 2 = 0 THEN 'hand-edited' ELSE 'ok' END AS outcome FROM pages")
def db_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, html = F.col("page_id"), F.col("html")
    p = table(spark, sf_dir, "pages")
    declared = p.select(i.cast("string").alias("path"), F.when(i % 7 == 0, "").otherwise("gen").alias("generator"), html.alias("content"))
    generated = p.select(i.cast("string").alias("path"), (i % 5 == 0).alias("failed"), F.when(i % 3 == 0, None).when(i % 2 == 0, F.concat(html, F.lit("x"))).otherwise(F.regexp_replace(html, "(?<!\r)\n", "\r\n")).alias("content"))
    return records.fixtures(declared, generated)


@query("SELECT p_partkey AS id, NOT (p_partkey % 2 = 0 AND p_partkey % 3 = 0) AS audited FROM part")
def db_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    note, data = F.when(k % 3 == 0, "  ").otherwise("checked"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    return table(spark, sf_dir, "part").select(k.alias("id"), ((F.size(data) > 0) | (F.trim(note) != "")).alias("audited"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AS bad FROM supplier")
def pg_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_suppkey").cast("string"), F.lit("@users.noreply.github.com"))).otherwise("someone@corp.org")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (~mail.rlike(r"(?i)(@users\.noreply\.github\.com|^noreply@github\.com)$")).alias("bad"))


@query("SELECT DISTINCT lower(p_name) AS value FROM part")
def pg_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.allow_lines(table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit("  # why")).alias("line")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'unknown scope' WHEN c_custkey % 3 = 0 THEN 'no reason' WHEN c_custkey % 4 = 1 THEN 'scope all needs its own reason' END AS reject,
 c_custkey % 2 <> 0 AS hand_written FROM customer""")
def pg_grants_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k, F.lit("repo").alias("repo"), F.col("c_name").alias("token"), F.when(k % 4 == 0, "odd").when(k % 4 == 1, "all").otherwise("tree").alias("scope"), F.when(k % 3 == 0, " ").otherwise("short").alias("reason"),
        F.when(k % 2 == 0, F.left(F.sha2(F.concat_ws("|", F.lit("repo"), "c_name"), 256), F.lit(8))).alias("nonce"),
    )
    return records.grants(rows).select("c_custkey", "reject", "hand_written")
