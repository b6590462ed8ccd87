"""Queries over single redaction rules, whole merges, and the checks and policies of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.functions import redaction
from plaintide.operators import demand, merging, policy
from plaintide.plans.adapters import CUTOFF, MENTIONS, mentions
from plaintide.plans.registry import query, table
from plaintide.plans.texts import PATHS_SQL, _paths, documents

NOW = "2024-01-30 00:00:00"


# single redaction rules: the place of each in the chain, and its pattern for SQL where that has no look-around and no further test
def _rule(name: str, rule: int, pattern: str | None, group: int = 0) -> None:
    sql = None
    if pattern:
        found = f"regexp_extract_all(text, '{pattern}', {group})"
        sql = f"SELECT doc_id, CAST(coalesce(len({found}), 0) AS BIGINT) AS found, CAST(coalesce(len(list_distinct({found})), 0) AS BIGINT) AS distinct_values FROM documents"

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = documents(spark, sf_dir).select("doc_id", redaction.by_rule(rule, F.col("text")).alias("r"))
        return done.select("doc_id", F.col("r.found").alias("found"), F.col("r.distinct").alias("distinct_values"))


_rule("rd_invite", 0, "(?i)" + redaction.INVITE)
_rule("rd_mention", 2, redaction.MENTION, 1)
_rule("rd_url", 3, "(?i)" + redaction.URL)
_rule("rd_card", 4, None)
_rule("rd_phone", 5, None)
_rule("rd_ipv6", 6, None)
_rule("rd_ipv4", 7, redaction.IPV4)
_rule("rd_handle", 8, None)
_rule("rd_id", 9, redaction.ID)
_rule("rd_secret", 10, None)


@query()
def rd_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of each text and their kinds, as the whole chain numbers them."""
    return documents(spark, sf_dir).select("doc_id", F.explode(redaction.redact(F.col("text"))["placeholders"]).alias("placeholder", "kind"))


# merges
DEMANDS = """SELECT concat('k', CAST(o_custkey % 97 AS VARCHAR)) AS canonical_key, o_orderkey AS ordinal, concat('t', CAST(o_orderkey AS VARCHAR)) AS title, o_orderkey % 7 AS reach, concat('u', CAST(o_custkey AS VARCHAR)) AS h,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(o_orderpriority, ' ', CAST(o_orderkey % 23 AS VARCHAR)) END AS snip, CASE WHEN o_orderkey % 5 = 0 THEN concat('why ', CAST(o_orderkey AS VARCHAR)) ELSE '' END AS why, o_orderdate AS first_seen FROM orders"""
POOL = f"""WITH r AS ({DEMANDS}),
f AS (SELECT canonical_key, arg_min(title, ordinal) AS title, arg_min(reach, ordinal) AS r0, arg_min(why, ordinal) FILTER (WHERE why <> '') AS why, count(*) AS n, arg_min(first_seen, ordinal) AS first_seen FROM r GROUP BY 1),
a AS (SELECT canonical_key, string_agg(h, ',' ORDER BY o) AS authors, count(*) AS k FROM (SELECT canonical_key, h, min(ordinal) AS o FROM r GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT canonical_key, string_agg(snip, ',' ORDER BY o) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY o) AS p FROM (SELECT canonical_key, arg_min(snip, ordinal) AS snip, min(ordinal) AS o FROM r WHERE snip <> '' GROUP BY canonical_key, substr(snip, 1, 120))) WHERE p <= 8 GROUP BY 1)
SELECT canonical_key, title, why, authors, coalesce(evidence, '') AS evidence, CASE WHEN n = 1 THEN 'new' ELSE 'merged' END AS action, CAST(n - 1 AS BIGINT) AS merged, CAST(greatest(r0, k) AS BIGINT) AS reach,
CAST(first_seen AS VARCHAR) AS first_seen, 'new' AS status FROM f JOIN a USING (canonical_key) LEFT JOIN e USING (canonical_key)"""


def demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as demands that arrive one by one."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    snippet = F.when(k % 11 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" "), text(k % 23)))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), text(cust % 97)).alias("canonical_key"), k.alias("ordinal"), F.concat(F.lit("t"), text(k)).alias("title"), (k % 7).cast("long").alias("reach"),
        F.when(k % 5 == 0, F.concat(F.lit("why "), text(k))).otherwise("").alias("why"), F.lit(None).cast("string").alias("status"), F.col("o_orderdate").cast("timestamp").alias("first_seen"),
        F.array(F.struct(F.concat(F.lit("u"), text(cust)).alias("author_hash"))).alias("authors"), F.array(F.struct(snippet.alias("redacted_snippet"))).alias("evidence"),
    )


@query(POOL)
def snk_pool_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = merging.merge_pool(demands(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return done.select(
        "canonical_key", "title", "why", F.array_join("authors.author_hash", ",").alias("authors"), F.array_join("evidence.redacted_snippet", ",").alias("evidence"), "action", "merged", "reach",
        F.col("first_seen").cast("string").alias("first_seen"), "status",
    )


@query(f"WITH pool AS ({POOL}) SELECT canonical_key, authors, evidence, reach, coalesce(why, '') AS why FROM pool WHERE action = 'merged'")
def agg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = snk_pool_upsert(spark, sf_dir).where("action = 'merged'")
    return done.select("canonical_key", "authors", "evidence", "reach", F.coalesce("why", F.lit("")).alias("why"))


EXT = f"""WITH m AS ({MENTIONS}), w AS (SELECT *, ts < TIMESTAMP '{CUTOFF}' AS old, CASE urgency WHEN 'blocking' THEN 3 WHEN 'need' THEN 2 ELSE 1 END + CASE segment WHEN 'enterprise' THEN 4 WHEN 'team' THEN 3 WHEN 'pro' THEN 2 ELSE 1 END AS weight FROM m),
c AS (SELECT demand_id, count(*) AS n, list(DISTINCT channel) AS src FROM w WHERE NOT old GROUP BY 1), p AS (SELECT demand_id, count(*) AS n, list(DISTINCT channel) AS src, min(ts) AS first_seen FROM w WHERE old GROUP BY 1),
a AS (SELECT demand_id, author, max(weight) AS weight FROM w WHERE demand_id IN (SELECT demand_id FROM c) GROUP BY 1, 2), i AS (SELECT demand_id, round(CAST(sum(weight) + count(*) AS DOUBLE), 4) AS intensity, count(*) AS distinct_authors FROM a GROUP BY 1)
SELECT demand_id, i.intensity, i.distinct_authors, greatest(coalesce(p.n, 0) + c.n, i.distinct_authors) AS mention_count, array_to_string(list_sort(list_distinct(list_concat(coalesce(p.src, []), c.src))), ',') AS source_set,
CASE WHEN p.n IS NULL THEN 0 ELSE demand_id % 4 END AS push_count, CAST(least(30, CASE WHEN p.n IS NULL THEN 0 ELSE demand_id % 35 END + 1) AS BIGINT) AS n_samples,
CASE WHEN p.n IS NULL OR demand_id % 35 = 0 THEN c.n * 1e0 ELSE greatest(1, demand_id % 35 - 28) * 1e0 END AS oldest_score, c.n * 1e0 AS newest_score,
CAST(coalesce(p.first_seen, TIMESTAMP '{NOW}') AS VARCHAR) AS first_seen, concat('demand ', CAST(demand_id AS VARCHAR), ' job ', repeat('long ', CAST(demand_id % 100 AS INTEGER)))[1:400] AS text,
array_to_string(list_transform(range(1, least(8, 1 + demand_id % 12) + 1), lambda x: concat('quote ', CAST(x AS VARCHAR))), ',') AS evidence FROM c JOIN i USING (demand_id) LEFT JOIN p USING (demand_id)"""


@query(EXT)
def agg_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, day, k, c = mentions(spark, sf_dir), F.lit(CUTOFF).cast("timestamp"), F.col("demand_id"), F.col

    def side(rows: DataFrame) -> DataFrame:
        people = demand.author_weight(rows).groupBy("demand_id").agg(F.collect_list(F.struct(c("author").cast("string").alias("author_hash"), "weight")).alias("authors"))
        return rows.groupBy("demand_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.array_sort(F.collect_set("channel")).alias("source_set")).join(people, "demand_id")

    ring = F.transform(F.sequence(F.lit(1), (k % 35).cast("int")), lambda i: F.struct(day.alias("ts"), i.cast("double").alias("final_score"), F.lit(0.0).alias("intensity"), F.lit(0).cast("long").alias("distinct_authors")))
    prior = side(m.where(c("ts") < day)).withColumns({"samples": F.when(k % 35 > 0, ring), "mention_count": c("n"), "push_count": k % 4})
    quotes = F.transform(F.sequence(F.lit(1), (1 + k % 12).cast("int")), lambda i: F.concat(F.lit("quote "), i.cast("string")))
    today = side(m.where(c("ts") >= day)).withColumns(
        {"title": F.concat(F.lit("demand "), k.cast("string")), "inferred_job": F.lit("job"), "summary": F.repeat(F.lit("long "), (k % 100).cast("int")), "final_score": c("n").cast("double"), "new_mentions": c("n"), "evidence": quotes}
    )
    done = merging.merge_snapshot(prior, today, F.lit(NOW).cast("timestamp"))
    return done.select(
        "demand_id", "intensity", "distinct_authors", "mention_count", F.array_join("source_set", ",").alias("source_set"), "push_count", F.size("samples").cast("long").alias("n_samples"),
        c("samples")[0]["final_score"].alias("oldest_score"), F.element_at("samples", -1)["final_score"].alias("newest_score"), c("first_seen").cast("string").alias("first_seen"), "text", F.array_join("evidence", ",").alias("evidence"),
    )


@query(f"""WITH m AS ({MENTIONS}), a AS (SELECT demand_id, list(DISTINCT channel) AS l FROM m WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1), b AS (SELECT demand_id, list(DISTINCT channel) AS l FROM m WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY 1)
SELECT demand_id, array_to_string(list_sort(list_filter(b.l, lambda x: NOT list_contains(coalesce(a.l, []), x))), ',') AS new_sources FROM b LEFT JOIN a USING (demand_id)""")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, day = mentions(spark, sf_dir), F.lit(CUTOFF).cast("timestamp")
    old, new = (F.collect_set(F.when(x, F.col("channel"))) for x in (F.col("ts") < day, F.col("ts") >= day))
    sets = m.groupBy("demand_id").agg(old.alias("a"), new.alias("b")).where(F.size("b") > 0)
    return sets.select("demand_id", F.array_join(F.array_sort(F.array_except("b", "a")), ",").alias("new_sources"))


# boundaries
@query(f"SELECT page_id, path FROM ({PATHS_SQL}) WHERE starts_with(path, 'runs/') OR starts_with(path, 'metrics/a/') OR path = 'docs/1.db'")
def db_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("runs/",), ("metrics/a",), ("docs/1.db",)], "path string")
    return policy.covered(_paths(spark, sf_dir), declared).select("page_id", "path")


@query(f"""WITH p AS (SELECT path FROM ({PATHS_SQL})), d AS (SELECT DISTINCT regexp_replace(path, '\\.example\\.md$', CASE WHEN length(path) % 2 = 0 THEN '.md' ELSE '.txt' END) AS path FROM p WHERE suffix(path, '.example.md') OR suffix(path, '.db'))
SELECT path FROM d WHERE concat(path, '.example') NOT IN (SELECT path FROM p) AND concat(regexp_replace(path, '\\.[a-z]+$', ''), '.example', regexp_extract(path, '\\.[a-z]+$')) NOT IN (SELECT path FROM p)""")
def db_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples without their ``example`` are what is declared, half of them with another ending, and databases."""
    paths = _paths(spark, sf_dir).select("path")
    bare = F.regexp_replace("path", r"\.example\.md$", "")
    name = F.when(F.col("path").endswith(".example.md"), F.concat(bare, F.when(F.length("path") % 2 == 0, ".md").otherwise(".txt"))).otherwise(F.col("path"))
    declared = paths.where(F.col("path").endswith(".example.md") | F.col("path").endswith(".db")).select(name.alias("path")).distinct()
    return policy.without_schema(declared, paths)


@query(f"SELECT page_id, path, path IN ('runs/0.jsonl', 'docs/6.jsonl') OR regexp_matches(path, '(^|/)(3|13)\\.jsonl$') AND page_id % 2 = 1 AS own FROM ({PATHS_SQL})")
def pg_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 2 == 1, "x MARK y").otherwise("nothing")
    own = policy.is_scanner(F.concat(F.lit("./"), "path"), text, ("runs/0.jsonl", "docs/6.jsonl"), ("3.jsonl", "13.jsonl"), ("MARK",))
    return _paths(spark, sf_dir).select("page_id", "path", own.alias("own"))


SKILLS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('skills/s', CAST(page_id AS VARCHAR), '/SKILL.md') WHEN 1 THEN 'SKILL.md' WHEN 2 THEN 'skills/a/b/SKILL.md' ELSE 'docs/SKILL.md' END AS path FROM pages"


@query(f"SELECT page_id, path FROM ({SKILLS}) WHERE page_id % 4 < 2")
def lb_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("skills/s"), i.cast("string"), F.lit("/SKILL.md"))).when(i % 4 == 1, "SKILL.md").when(i % 4 == 2, "skills/a/b/SKILL.md").otherwise("docs/SKILL.md")
    return policy.skills(table(spark, sf_dir, "pages").select(i, path.alias("path")))


@query("""WITH g AS (SELECT c_custkey AS id, lower(c_name) AS value, CASE c_custkey % 3 WHEN 0 THEN 'tree' WHEN 1 THEN 'history' ELSE 'all' END AS scope, c_custkey % 5 = 0 AS hand FROM customer WHERE c_custkey % 2 = 0),
h AS (SELECT lower(c_name) AS value, CASE o_orderkey % 2 WHEN 0 THEN 'tree' ELSE 'history' END AS domain, count(*) AS times FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
e AS (SELECT id, any_value(hand) AS hand, coalesce(bool_or(domain IS NOT NULL AND (scope = 'all' OR scope = domain)), false) AS used, coalesce(sum(CASE WHEN scope = 'history' AND domain <> 'history' THEN times ELSE 0 END), 0) AS live FROM g LEFT JOIN h USING (value) GROUP BY 1)
SELECT count(*) AS declared, count(*) FILTER (WHERE used) AS used, count(*) FILTER (WHERE NOT used) AS never_fired, count(*) FILTER (WHERE hand) AS hand_written, count(*) FILTER (WHERE live > 0) AS collided, CAST(coalesce(sum(live), 0) AS BIGINT) AS collisions FROM e""")
def agg_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(k, "c_name")
    grants = people.where(k % 2 == 0).select(F.upper("c_name").alias("token"), F.when(k % 3 == 0, "tree").when(k % 3 == 1, "history").otherwise("all").alias("scope"), (k % 5 == 0).alias("hand_written"))
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").join(people, F.col("o_custkey") == k)
    findings = o.select(F.col("c_name").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "tree").otherwise("history").alias("domain"))
    return policy.receipt(grants, findings)
