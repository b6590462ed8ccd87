"""Queries over texts and messages: filters, keys, fingerprints, redaction, scanners, dates, streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.config import TAXONOMY
from plaintide.functions import dates, redaction, text
from plaintide.operators import guard, messages, pool, versions
from plaintide.plans.adapters import MESSAGES
from plaintide.plans.adapters import messages as read_messages
from plaintide.plans.registry import query, table
from plaintide.storage import spread
from plaintide.streaming import pool as live

NOW = "2024-01-30 00:00:00"
STOP_SQL = ", ".join(f"'{x}'" for x in text.STOP)
_PAD = {b: bytes(x ^ b for x in b"query-salt".ljust(64, b"\0")).hex() for b in (0x36, 0x5C)}


def pseudonym_sql(value: str) -> str:
    """Hex digits of the pseudonym of a text under the salt of the queries."""
    return f"sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}') || encode({value}))))"


ALIAS_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ALIASES.items()) + " ELSE t END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


@query("SELECT channel, author, text, thread, seq, reply_to FROM (" + MESSAGES + ") WHERE NOT bot AND webhook_id IS NULL AND trim(coalesce(text, ''), ' ') <> ''")
def flt_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.human(read_messages(spark, sf_dir)).select("channel", "author", "text", "thread", "seq", "reply_to")


@query("SELECT channel, count(*) AS raw, count(*) FILTER (WHERE NOT bot AND trim(coalesce(text, ''), ' ') <> '') AS human_text FROM (" + MESSAGES + ") GROUP BY 1")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.channel_stats(read_messages(spark, sf_dir))


@query(f"SELECT doc_id, regexp_matches(text, '(?i){text.SIGNAL.replace(chr(39), chr(39) * 2)}') AS signal FROM documents")
def flt_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.has_signal(F.col("text")).alias("signal"))


@query(f"""SELECT event_id, event_type, user_id, ts::VARCHAR AS ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR) WHERE n <= 60000""")
def src_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("message_id"), "user_id", "ts")
    got = messages.recent(rows, F.lit(NOW).cast("timestamp"), 72.0)
    return got.select(F.col("message_id").alias("event_id"), F.col("channel").alias("event_type"), "user_id", F.col("ts").cast("string").alias("ts"))


INTENT = "CASE event_type WHEN 'error' THEN ['Bug-Complaint', 'praise'] WHEN 'click' THEN ['feature request', 'FEATURE_REQUEST'] WHEN 'signup' THEN ['how_to_question'] WHEN 'purchase' THEN ['praise', 'unknown'] ELSE ['nonsense'] END"
_LABELS = ", ".join(f"'{x}'" for x in messages.INTENTS)


def _labels() -> Column:
    e = F.col("event_type")
    arr = lambda *xs: F.array(*map(F.lit, xs))
    return F.when(e == "error", arr("Bug-Complaint", "praise")).when(e == "click", arr("feature request", "FEATURE_REQUEST")).when(e == "signup", arr("how_to_question")).when(e == "purchase", arr("praise", "unknown")).otherwise(arr("nonsense"))


INTENTS_SQL = f"SELECT event_id, CASE WHEN len(k) = 0 THEN ['chitchat'] ELSE list_sort(list_distinct(k)) END AS k FROM (SELECT event_id, list_filter(list_transform({INTENT}, lambda x: replace(replace(lower(trim(x)), '-', '_'), ' ', '_')), lambda x: list_contains([{_LABELS}], x)) AS k FROM events)"


@query(f"SELECT event_id, array_to_string(k, ',') AS intents FROM ({INTENTS_SQL})")
def prj_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(messages.normal_intents(_labels())), ",").alias("intents"))


@query(f"SELECT event_id FROM ({INTENTS_SQL}) WHERE list_contains(k, 'feature_request') OR list_contains(k, 'bug_complaint') OR list_contains(k, 'pain_workaround') OR list_contains(k, 'competitor_compare') OR list_contains(k, 'pricing_objection')")
def flt_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(messages.is_demand(messages.normal_intents(_labels()))).select("event_id")


NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'), ' ')"
QUOTED = "SELECT d.doc_id, d.text AS source, substr(CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE coalesce(e.text, '') END, 1, 60) AS quote FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1"


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    nxt = d.select((F.col("doc_id") - 1).alias("of"), F.left("text", F.lit(60)).alias("other"))
    j = d.join(nxt, d["doc_id"] == nxt["of"], "left")
    quote = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(60))).otherwise(F.coalesce("other", F.lit("")))
    return j.select("doc_id", F.col("text").alias("source"), quote.alias("quote"))


@query(f"WITH q AS ({QUOTED}), n AS (SELECT doc_id, {NORM.format('quote')} AS q, {NORM.format('source')} AS s FROM q) SELECT doc_id, length(replace(q, ' ', '')) >= 6 AND contains(s, q) AS grounded FROM n")
def flt_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quoted(spark, sf_dir).select("doc_id", text.grounded(F.col("quote"), F.col("source")).alias("grounded"))


@query("SELECT doc_id, length(replace(text, ' ', '')) + length(regexp_replace(replace(text, ' ', ''), '[^一-鿿぀-ヿ가-힯]', '', 'g')) AS meaning FROM documents")
def st_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.meaning_length(F.col("text")).cast("long").alias("meaning"))


@query(f"SELECT doc_id, sha256({NORM.format('text')}) AS digest FROM documents")
def st_norm_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.norm_match(F.col("text")), 256).alias("digest"))


FORCES_SQL = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS push, CASE WHEN turn % 3 = 0 THEN text END AS pull, CASE WHEN role = 'user' THEN ' ' ELSE text END AS anxiety, CASE WHEN turn > 3 THEN text END AS habit FROM conversations"


@query(f"""SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(push) <> '' THEN 'push' END, CASE WHEN trim(coalesce(pull, '')) <> '' THEN 'pull' END, CASE WHEN trim(anxiety) <> '' THEN 'anxiety' END, CASE WHEN trim(coalesce(habit, '')) <> '' THEN 'habit' END) AS present,
 trim(push) <> '' OR trim(coalesce(pull, '')) <> '' AS demand_force, trim(anxiety) <> '' OR trim(coalesce(habit, '')) <> '' AS implicit_force FROM ({FORCES_SQL})""")
def prj_jtbd(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.col("turn")
    jtbd = F.struct(F.when(n % 2 == 0, t).otherwise("").alias("push"), F.when(n % 3 == 0, t).alias("pull"), F.when(F.col("role") == "user", " ").otherwise(t).alias("anxiety"), F.when(n > 3, t).alias("habit"))
    rows = table(spark, sf_dir, "conversations").withColumn("jtbd", jtbd)
    f = messages.forces(F.col("jtbd"))
    return rows.select("conv_id", "turn", F.array_join(f["present"], ",").alias("present"), f["demand_force"].alias("demand_force"), f["implicit_force"].alias("implicit_force"))


@query(f"""WITH q AS ({QUOTED}), n AS (SELECT doc_id, {NORM.format('quote')} AS q, {NORM.format('source')} AS s FROM q)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not a demand' WHEN NOT (length(replace(q, ' ', '')) >= 6 AND contains(s, q)) THEN 'not grounded' END AS reject, CASE WHEN doc_id % 5 = 0 THEN 'implicit' ELSE 'explicit' END AS track FROM n""")
def prj_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = _quoted(spark, sf_dir).withColumns(
        {"intents": F.when(i % 3 == 0, F.array(F.lit("praise"))).otherwise(F.array(F.lit("Feature Request"))), "track": F.when(i % 5 == 0, "implicit").otherwise("whatever"), "inferred_job": F.lit(None).cast("string"), "aspect": F.lit("export")}
    )
    return messages.units(rows).select("doc_id", "reject", "track")


def _track_sql() -> str:
    hit = lambda k: f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){k}(s|es|ed|ing|d)?($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AS INTEGER)" if k.isascii() else f"CAST(contains(low, '{k}') AS INTEGER)"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name, {weight}e0 AS weight, {-i} AS place, {' + '.join(map(hit, words))} AS hits FROM d" for i, (name, weight, words) in enumerate(TAXONOMY) if words)
    return f"WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), h AS ({rows}), b AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, weight DESC, place DESC) AS n FROM h WHERE hits > 0) SELECT d.doc_id, coalesce(b.name, 'other') AS track FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND b.n = 1"


@query(_track_sql())
def prj_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.track_hint(F.col("text"), TAXONOMY).alias("track"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^\\p{L}\\p{M}\\p{N}_])in(s|es|ed|ing|d)?($|[^\\p{L}\\p{M}\\p{N}_])') AS hit FROM documents")
def prj_kwhit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.keyword_hit(F.lower("text"), "in").alias("hit"))


TOKENS_SQL = "list_transform(regexp_extract_all(lower({}), '" + text.TOKEN + "'), lambda t: " + ALIAS_SQL + ")"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{text.TOKEN}')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '{text.TOKEN}'), ' ')) AS digest FROM documents")
def st_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("digest"))


KEPT_SQL = f"""k AS (SELECT doc_id, {ALIAS_SQL} AS t, i FROM (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{text.TOKEN}') AS l FROM documents))
  WHERE t NOT IN ({STOP_SQL}) AND (length(t) >= 3 OR t IN ('ai', 'ui', 'ux', 'ml', 'vr', 'ar', 'qa') OR NOT regexp_full_match(t, '[\\x00-\\x7f]*'))),
o AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM k GROUP BY doc_id, t)"""


@query(f"WITH {KEPT_SQL} SELECT d.doc_id, coalesce(string_agg(o.t, ',' ORDER BY n), '') AS entities FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id AND n <= 8 GROUP BY d.doc_id")
def st_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.entities(F.col("text")), ",").alias("entities"))


@query(f"WITH {KEPT_SQL} SELECT d.doc_id, concat(coalesce(string_agg(o.t, '|' ORDER BY o.t), ''), '::', d.lang) AS canonical_key FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id AND n <= 8 GROUP BY d.doc_id, d.lang")
def st_ckey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.canonical_key(text.entities(F.col("text")), F.col("lang")).alias("canonical_key"))


@query("SELECT p_partkey AS id, CASE s WHEN 'gpt4' THEN 'gpt-4' WHEN 'llms' THEN 'llm' ELSE s END AS slug FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 3 WHEN 0 THEN ' GPT4 ' WHEN 1 THEN 'LLMs' ELSE p_type END)) AS s FROM part)")
def st_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), text.slug(F.when(k % 3 == 0, " GPT4 ").when(k % 3 == 1, "LLMs").otherwise(F.col("p_type"))).alias("slug"))


SIMHASH_SQL = f"""k AS (SELECT item_id, md5({ALIAS_SQL}) AS h FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{text.TOKEN}')) AS t FROM benchmark)
  WHERE t NOT IN ({STOP_SQL}) AND (length(t) >= 3 OR NOT regexp_full_match(t, '[\\x00-\\x7f]*'))),
b AS (SELECT item_id, bit, sum(CAST(substr(bin(CAST('0x' || substr(h, bit // 4 + 1, 1) AS INTEGER) + 16), 2 + bit % 4, 1) AS INTEGER)) AS ones, count(*) AS n FROM k, range(64) r(bit) GROUP BY 1, 2),
f AS (SELECT item_id, string_agg(CASE WHEN 2 * ones > n THEN '1' ELSE '0' END, '' ORDER BY bit) AS bits FROM b GROUP BY 1)"""


@query(f"WITH {SIMHASH_SQL} SELECT item_id, bits FROM f")
def st_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    return t.select("item_id", F.lpad(F.conv(F.hex(text.simhash(F.col("text"))), 16, 2), 64, "0").alias("bits"))


@query(f"WITH {SIMHASH_SQL.replace('item_id', 'doc_id').replace('FROM benchmark', 'FROM documents')} SELECT d.doc_id, coalesce(bits, repeat('0', 64)) AS bits FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id")
def st_simhash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.lpad(F.conv(F.hex(text.simhash(F.col("text"))), 16, 2), 64, "0").alias("bits"))


@query("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS distance FROM events")
def st_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.hamming(F.col("event_id"), F.col("user_id")).alias("distance"))


PAIRS_SQL = f"""{KEPT_SQL}, z AS (SELECT doc_id, t FROM o WHERE n <= 64), c AS (SELECT doc_id, count(*) AS n FROM z GROUP BY 1),
w AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS k FROM z a JOIN z b ON a.t = b.t AND a.doc_id > b.doc_id GROUP BY 1, 2),
s AS (SELECT left_id, right_id, k / CAST(x.n + y.n - k AS DOUBLE) AS similarity FROM w JOIN c x ON x.doc_id = left_id JOIN c y ON y.doc_id = right_id)"""
#: The same over all content words of a text.
WHOLE_SQL = PAIRS_SQL.replace(" WHERE n <= 64", "")


def _pairs(spark: SparkSession, sf_dir: str, threshold: float, limit: int | None = None) -> DataFrame:
    return pool.similar(pool.token_rows(documents(spark, sf_dir), "doc_id", "text", limit), threshold)


@query(f"WITH {WHOLE_SQL} SELECT left_id, right_id, similarity FROM s WHERE similarity >= 0.45e0")
def st_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 0.45)


MATCH_SQL = f"""WITH {PAIRS_SQL}, sh AS (WITH {SIMHASH_SQL.replace("item_id", "doc_id").replace("FROM benchmark", "FROM documents")} SELECT doc_id, bits FROM f),
ck AS (SELECT d.doc_id, min(d.doc_id) OVER (PARTITION BY coalesce(l, ''), d.lang) AS by_key FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, '|' ORDER BY t) AS l FROM o WHERE n <= 8 GROUP BY 1) e ON d.doc_id = e.doc_id),
l AS (SELECT z.doc_id, list(z.t ORDER BY o.n) AS toks, list(z.t ORDER BY o.n)[1:8] AS ents FROM z JOIN o ON z.doc_id = o.doc_id AND z.t = o.t GROUP BY 1),
x AS (SELECT s.*, d.lang = f.lang AS same, len(list_intersect(a.ents, b.ents)) AS shared, k = x.n OR k = y.n OR a.toks[1] = b.toks[1] AS agree, h.bits <> repeat('0', 64) AND hamming(g.bits, h.bits) <= 3 AS hit
  FROM s JOIN w USING (left_id, right_id) JOIN c x ON x.doc_id = left_id JOIN c y ON y.doc_id = right_id JOIN l a ON a.doc_id = left_id JOIN l b ON b.doc_id = right_id JOIN documents d ON d.doc_id = left_id JOIN documents f ON f.doc_id = right_id
  JOIN sh g ON g.doc_id = left_id JOIN sh h ON h.doc_id = right_id WHERE left_id IN (SELECT doc_id FROM ck WHERE by_key = doc_id)),
ok AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id DESC) AS p FROM x WHERE similarity >= 0.83e0
  OR (agree AND (shared >= 2 OR (shared >= 1 AND same)) AND ((hit AND NOT (similarity >= 0.78e0 AND similarity < 0.83e0)) OR (similarity >= 0.45e0 AND similarity < 0.78e0))))
SELECT doc_id AS left_id, by_key AS right_id, CAST(NULL AS DOUBLE) AS similarity, true AS exact FROM ck WHERE by_key < doc_id UNION ALL SELECT left_id, right_id, similarity, false FROM ok WHERE p = 1"""


@query(MATCH_SQL)
def join_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's match among the earlier ones, on the key and on all three rungs."""
    return pool.match_existing(documents(spark, sf_dir).withColumnRenamed("lang", "track"))


@query(f"WITH {WHOLE_SQL} SELECT left_id, min(right_id) AS right_id FROM s WHERE similarity >= 0.78e0 AND similarity < 0.83e0 GROUP BY 1")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.match_band(_pairs(spark, sf_dir, 0.78))


@query(r"SELECT doc_id, md5(translate(regexp_replace(trim(regexp_replace(text, '[\s\x0b\x85\x{a0}\x{2028}\x{2029}]+', ' ', 'g'), ' '), '\s*[–—―]+\s*', ', ', 'g'), '`|', '''/')) AS digest FROM documents")
def st_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(text.inline(F.col("text"))).alias("digest"))


_ENDS = ("。", "！", "？", "；", ". ", "! ", "? ")
_LAST = ", ".join(f"CASE WHEN contains(h, '{p}') THEN 160 - instr(reverse(h), '{p[::-1]}') + 1 ELSE 0 END" for p in _ENDS)


@query(f"""WITH x AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS w, substr(trim(coalesce(text, ''), ' '), 1, 160) AS h FROM documents), y AS (SELECT *, greatest({_LAST}) AS last FROM x)
SELECT doc_id, CASE WHEN length(w) <= 160 THEN w WHEN last >= 80 THEN trim(substr(h, 1, last), ' ') ELSE concat(rtrim(h, ' '), '…') END AS short FROM y""")
def st_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.truncate(F.col("text"), 160).alias("short"))


PROSE_SQL = r"""list_filter(regexp_split_to_array(lower(translate({t}, '`*_#>', '     ')), '\s+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{M}}]'))"""


def windows_sql(table_name: str, key: str) -> str:
    """Rows (place, s): the distinct eight-word windows of prose without fences, tables and links, which the test tables do not have."""
    words = PROSE_SQL.format(t="coalesce(text, '')")
    return f"SELECT place, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS s FROM (SELECT {key} AS place, {words} AS w FROM {table_name}) WHERE len(w) >= 8"


OVERLAP_SQL = f"""WITH a AS ({windows_sql('documents', 'doc_id')}), b AS (SELECT DISTINCT s FROM ({windows_sql('benchmark', 'item_id')})),
o AS (SELECT place, count(*) AS total, count(b.s) AS shared FROM a LEFT JOIN b ON a.s = b.s GROUP BY 1)"""


@query(f"SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS shingles FROM documents LEFT JOIN (SELECT place, count(*) AS n FROM ({windows_sql('documents', 'doc_id')}) GROUP BY 1) ON doc_id = place")
def st_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(text.shingles(F.col("text"))).alias("shingles"))


@query()
def rd_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", redaction.redact(F.col("text")).alias("r"))
    kinds = ("INVITE", "EMAIL", "DISCORD_ID", "URL", "CARD", "PHONE", "IP", "HANDLE", "SECRET")
    return d.select("doc_id", F.md5("r.redacted").alias("digest"), F.size("r.placeholders").alias("placeholders"), *[F.coalesce(F.col("r.found")[k], F.lit(0)).alias(k.lower()) for k in kinds])


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails FROM documents")
def rd_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The email rule alone, as a built-in expression behind a cheap guard."""
    n = F.when(F.contains("text", F.lit("@")), F.regexp_count("text", F.lit(redaction.EMAIL))).otherwise(0)
    return documents(spark, sf_dir).select("doc_id", n.cast("long").alias("emails"))


@query()
def rd_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(redaction.normalised(F.col("text"))).alias("digest"))


@query()
def flt_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", redaction.has_pii(F.col("text")).alias("pii"))


@query()
def agg_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select(F.explode(redaction.redact(F.col("text"))["found"]).alias("kind", "n"))
    return found.groupBy("kind").agg(F.sum("n").alias("found"), F.count(F.lit(1)).alias("texts"))


@query(f"SELECT c_custkey, concat('u_', substr({pseudonym_sql('CAST(c_custkey AS VARCHAR)')}, 1, 16)) AS pseudonym FROM customer")
def rd_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonyms under a salt of this query's own, so that runs agree."""
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.pseudonym(F.col("c_custkey"), salt="query-salt").alias("pseudonym"))


FINDINGS = """SELECT c_custkey AS place, CASE c_custkey % 8 WHEN 0 THEN 'PERSONAL-MAILBOX' ELSE 'EMAIL' END AS label,
 CASE c_custkey % 8 WHEN 1 THEN 'x@gmail.com' WHEN 0 THEN concat('Jane', CAST(c_custkey % 50 AS VARCHAR), '@gmail.com') WHEN 3 THEN concat('a.b+c@host', CAST(c_custkey % 50 AS VARCHAR), '.co.uk') ELSE concat('ops@corp', CAST(c_custkey % 50 AS VARCHAR), '.org') END AS value, 'BLOCK' AS severity
FROM customer WHERE c_custkey % 8 IN (0, 1, 3) OR (c_custkey % 8 = 5 AND c_custkey % 50 <> 13)"""
#: Values that the notes' owner allows, in any case; the last two are too vague to cover a longer path.
ALLOW = ("OPS@corp13.org", "646-867-0014", "00021", "jdoe6/x", ".secrets/key10", "home", "jdoe")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes with addresses in eight forms, of which four count: the rest are synthetic domains or no addresses."""
    k = F.col("c_custkey")
    forms = ("ask Jane{}@gmail.com, please", "ask x@gmail.com {}", "from dev{}@example.com", "cc <a.b+c@host{}.co.uk>", "x+@pytest.mark{}.skip", "to ops@corp{}.org.", "me{}@mail.acme.test", "user{}@users.noreply.github.com")
    parts = [F.concat(F.lit(f.split("{}")[0]), (k % 50).cast("string"), F.lit(f.split("{}")[1])) for f in forms]
    return table(spark, sf_dir, "customer").select(k.alias("place"), F.element_at(F.array(*parts), (k % 8 + 1).cast("int")).alias("text"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("place"), "text")


@query(FINDINGS)
def pg_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.emails(_notes(spark, sf_dir), ALLOW)


@query("""WITH c AS (SELECT c_custkey AS place, c_custkey % 8 AS v, lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS line FROM customer)
SELECT place, 'PHONE' AS label, concat(CASE v WHEN 0 THEN '212-867-' WHEN 1 THEN '415-867-' WHEN 5 THEN '312-867-' ELSE '646-867-' END, line) AS value, 'BLOCK' AS severity FROM c WHERE v IN (0, 1, 5, 6) AND NOT (v = 6 AND line = '0014')""")
def pg_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes with numbers in eight forms, four of them no one's number: a shape, fiction twice, part of a longer chain."""
    k = F.col("c_custkey")
    line = F.lpad(k.cast("string"), 4, "0")
    forms = ("call (212) 867-{} now", "at +1 415.867.{}", "a conv kernel 512-256-{} wide", "ask 555-867-{} or so", "the id 128-512-256-{}", "ring 312-867-{} today", "a batch of calls to (646) 867-{}", "or (212) 555-{}")
    parts = [F.concat(F.lit(f.split("{}")[0]), line, F.lit(f.split("{}")[1])) for f in forms]
    return guard.phones(table(spark, sf_dir, "customer").select(k.alias("place"), F.element_at(F.array(*parts), (k % 8 + 1).cast("int")).alias("text")), ALLOW)


@query("""WITH c AS (SELECT c_custkey AS place, c_custkey % 8 AS v, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS z FROM customer)
SELECT place, 'ZIP' AS label, z AS value, 'BLOCK' AS severity FROM c WHERE v IN (0, 1, 2, 4, 6) AND z NOT IN ('10001', '00000', '12345', '90210') AND z <> '00021'""")
def pg_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes with postal codes in five forms, and three numbers that are none: an order, and two archives."""
    k = F.col("c_custkey")
    z = F.lpad(k.cast("string"), 5, "0")
    forms = ("zip code: {}", "please Ship to NY {} soon", "邮编 {}", "order {}", "ZIP {}", "the zip archive is {} bytes", "twice: postal code {}", "a zip files list of {}")
    parts = [F.concat(F.lit(f.split("{}")[0]), z, F.lit(f.split("{}")[1])) for f in forms]
    parts[6] = F.concat(parts[6], F.lit(", zip "), z)
    return guard.zips(table(spark, sf_dir, "customer").select(k.alias("place"), F.element_at(F.array(*parts), (k % 8 + 1).cast("int")).alias("text")), ALLOW)


@query("""WITH c AS (SELECT c_custkey AS place, c_custkey % 12 AS v, CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT place, CASE WHEN v < 2 OR v = 11 THEN 'USER-PATH' ELSE 'PRIVATE-PATH' END AS label, CASE v WHEN 0 THEN concat('/home/jdoe', k) WHEN 1 THEN concat('C:\\Users\\Mary.', k) WHEN 11 THEN concat('D:\\\\Users\\\\x', k)
 WHEN 4 THEN concat('~/.secrets/key', k) WHEN 7 THEN concat('$HOME/.agent-center/', k) WHEN 8 THEN concat('%USERPROFILE%\\.pw-auth\\', k) WHEN 10 THEN concat('~/.claude/skills/s', k, '/run.py') END AS value, 'BLOCK' AS severity
FROM c WHERE v IN (0, 1, 4, 7, 8, 10, 11) AND NOT (v = 4 AND starts_with(k, '10'))""")
def pg_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' notes with paths in twelve forms; generic accounts, folders without a home and public folders are no one's."""
    k = F.col("c_custkey")
    forms = (
        "see /home/jdoe{}/x", "at C:\\Users\\Mary.{}\\y", "in /Users/runner/w{}", "on C:\\Users\\admin\\{}", "read ~/.secrets/key{} now", "a .secrets/key{}", "in ~/.claude/skills/s{} there",
        "or $HOME/.agent-center/{},", "and %USERPROFILE%\\.pw-auth\\{}", "the ~/.claude.json of {}", "but ~/.claude/skills/s{}/run.py", "D:\\\\Users\\\\x{}",
    )
    parts = [F.concat(F.lit(f.split("{}")[0]), k.cast("string"), F.lit(f.split("{}")[1])) for f in forms]
    return guard.paths(table(spark, sf_dir, "customer").select(k.alias("place"), F.element_at(F.array(*parts), (k % 12 + 1).cast("int")).alias("text")), ALLOW)


@query(f"SELECT label, lower(value) AS value, severity, min(place) AS place, count(*) AS times FROM ({FINDINGS}) GROUP BY 1, 2, 3")
def agg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.distinct_findings(guard.emails(_notes(spark, sf_dir), ALLOW))


#: Words, words of several parts, values with digits and signs; and what stands around them in the texts below.
DENY = ("theher", "jane doe", "555-", "tion", "mail3.example", "q7x", "café", "...")
_AROUND = ("my_{}_x", "日{}本", "x{}", "{}9", "({})", "{}ring", "é{}é", "{}")
_DENY_ROWS = "SELECT doc_id AS place, lower(concat(text, ' ', CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN replace('{a}', '{{}}', t.w)" for i, a in enumerate(_AROUND)) + f" END)) AS low FROM documents, (SELECT unnest({list(DENY)}) AS w, unnest(range({len(DENY)})) AS i) t WHERE t.i = doc_id // 8 % {len(DENY)}"
DENY_SQL = " UNION ALL ".join(
    f"SELECT place, 'DENIED' AS label, '{t}' AS value, 'BLOCK' AS severity FROM d WHERE " + (f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')" if guard.bounded(t) else f"contains(low, '{t}')") for t in DENY
)
DENY_SQL = f"WITH d AS ({_DENY_ROWS}) {DENY_SQL}"


def _near_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with a token of the list at its end in one of eight surroundings."""
    i = F.col("doc_id")
    token = F.element_at(F.array(*map(F.lit, DENY)), (F.floor(i / 8) % len(DENY) + 1).cast("int"))
    around = F.element_at(F.array(*map(F.lit, _AROUND)), (i % 8 + 1).cast("int"))
    return documents(spark, sf_dir).select(i.alias("place"), F.concat("text", F.lit(" "), F.replace(around, F.lit("{}"), token)).alias("text"))


@query(DENY_SQL)
def join_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.denied(_near_tokens(spark, sf_dir), list(DENY))


GRANTS = (("tion", "all", "ordinary word"), ("555-", "history", "fiction"), ("theher", "all", ""))


@query(f"SELECT * FROM ({DENY_SQL}) WHERE value <> 'tion'")
def join_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = spark.createDataFrame(list(GRANTS), "token string, scope string, reason string")
    return guard.granted(join_deny(spark, sf_dir), grants, "tree")


PATHS_SQL = "SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN 'runs/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'metrics/a/' WHEN 3 THEN 'logs/2024-01-0' ELSE 'src/' END, CAST(page_id AS VARCHAR), CASE page_id % 3 WHEN 0 THEN '.jsonl' WHEN 1 THEN '.db' ELSE '.example.md' END) AS path FROM pages"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    head = F.when(i % 5 == 0, "runs/").when(i % 5 == 1, "docs/").when(i % 5 == 2, "metrics/a/").when(i % 5 == 3, "logs/2024-01-0").otherwise("src/")
    tail = F.when(i % 3 == 0, ".jsonl").when(i % 3 == 1, ".db").otherwise(".example.md")
    return table(spark, sf_dir, "pages").select(i, F.concat(head, i.cast("string"), tail).alias("path"))


# RE2 has no look-ahead; after the month it takes a character that is no digit, or the end
_SHAPE_WHEN = " ".join("WHEN regexp_matches(path, '" + p.replace(r"(?!\d)", "([^0-9]|$)") + f"') THEN '{w}'" for w, p in guard.RUN_SHAPES)
SHAPES_SQL = f"SELECT page_id, path, CASE {_SHAPE_WHEN} END AS label FROM ({PATHS_SQL}) WHERE NOT regexp_matches(path, '{guard.SHAPE_EXEMPT}')"


@query(f"SELECT * FROM ({SHAPES_SQL}) WHERE label IS NOT NULL")
def db_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.shapes(_paths(spark, sf_dir))


@query(f"SELECT page_id, path FROM ({PATHS_SQL}) WHERE NOT (starts_with(path, 'runs/') OR starts_with(path, 'metrics/a/'))")
def join_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([("runs",), ("metrics/a",)], "path string")
    return guard.undeclared(_paths(spark, sf_dir), declared).select("page_id", "path")


@query(f"{OVERLAP_SQL} SELECT place, total, shared, round(shared * 100e0 / greatest(1, total), 2) AS pct, round(shared * 100e0 / greatest(1, total), 2) > {guard.DUP_PCT_MAX} AS over FROM o")
def join_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), "text")
    return guard.shingle_overlap(_places(spark, sf_dir), bench)


@query(f"""WITH a AS ({windows_sql('documents', 'doc_id')}), r AS (SELECT s, place, row_number() OVER (PARTITION BY s ORDER BY place) AS n FROM a),
p AS (SELECT s, min(place) AS a, max(place) AS b FROM r WHERE n <= 2 GROUP BY s HAVING count(*) = 2) SELECT a, b, count(*) AS shared FROM p GROUP BY 1, 2 HAVING count(*) >= {guard.PAIR_MIN}""")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.shared_pairs(_places(spark, sf_dir))


@query(f"{OVERLAP_SQL} SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(shared) AS BIGINT) AS shared, round(sum(shared) * 100e0 / greatest(1, sum(total)), 2) AS pct, round(sum(shared) * 100e0 / greatest(1, sum(total)), 2) > {guard.DUP_PCT_MAX} AS block FROM o")
def agg_dup_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = join_shingles(spark, sf_dir).agg(F.sum("total").alias("total"), F.sum("shared").alias("shared"))
    return got.withColumn("pct", F.round(F.col("shared") * 100.0 / F.greatest(F.lit(1), "total"), 2)).withColumn("block", F.col("pct") > guard.DUP_PCT_MAX)


@query("SELECT s_suppkey, s_name AS name, replace(s_name, '-data', '') AS witness FROM (SELECT s_suppkey, concat(s_name, CASE WHEN s_suppkey % 2 = 0 THEN '-data' ELSE '-x' END) AS s_name FROM supplier) WHERE suffix(s_name, '-data')")
def join_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("owner"), "s_suppkey", F.col("s_name").alias("base"))
    names = s.select("owner", "s_suppkey", F.concat("base", F.when(F.col("s_suppkey") % 2 == 0, "-data").otherwise("-x")).alias("name"))
    return guard.witnesses(names, s.select("owner", F.col("base").alias("name")), ("-data", "-private", "-config", "-internal")).select("s_suppkey", "name", "witness")


@query("SELECT c_custkey, substr(sha256(concat(c_mktsegment, '|', c_name)), 1, 8) AS nonce FROM customer")
def pg_nonce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", guard.nonce(F.col("c_mktsegment"), F.col("c_name")).alias("nonce"))


@query()
def st_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.fix_markdown(_places(spark, sf_dir)).select("place", "n", F.md5("fixed").alias("digest"))


_D = "[–—―]"
_PY_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents"
_PY_LINES = f"SELECT doc_id, n, concat('# ', replace(line, ', ', list_extract([' — ', '–', ' —', '— '], n % 4 + 1)), CASE WHEN n % 11 = 10 THEN ' dashes: allow' ELSE '' END) AS said FROM ({_PY_LINES})"
_FIXED = "said"
for _find, _put in ((rf"\s+{_D}+\s+", ", "), (f"([A-Za-z0-9]){_D}+([A-Za-z0-9])", r"\1 to \2"), (rf"[ \t]*{_D}+[ \t]*$", ","), (rf"^[ \t]*{_D}+[ \t]+", ""), (rf"[ \t]+{_D}+[ \t]*|{_D}+[ \t]+", ", "), (f"{_D}+", ",")):
    _FIXED = f"regexp_replace({_FIXED}, '{_find}', '{_put}', 'g')"


@query(f"SELECT doc_id AS place, n, md5(concat('s = \"–\"  ', CASE WHEN n % 11 = 10 THEN said ELSE {_FIXED} END)) AS digest FROM ({_PY_LINES})")
def st_dash_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Python source: each line a comment with dashes after a string that holds one."""
    said = lambda line, n: F.replace(line, F.lit(", "), F.element_at(F.array(*map(F.lit, (" — ", "–", " —", "— "))), n % 4 + 1))
    source = lambda line, n: F.concat(F.lit('s = "–"  # '), said(line, n), F.when(n % 11 == 10, " dashes: allow").otherwise(""))
    return guard.fix_python(_places(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), source), "\n"))).select("place", F.col("n").cast("long").alias("n"), F.md5("fixed").alias("digest"))


_VERSIONS = (
    (0, (), "{text}"),
    (1, (0,), "{text}\nwrite to user{id}@gmail.com"),
    (2, (0,), "edited {rest}"),
    (3, (1, 2), "edited {rest}\nwrite to user{id}@gmail.com\nresolved by hand"),
    (4, (3,), "{text}"),
)
_PLACES_OF = {"{text}": ("text", "text"), "{rest}": ("substr(text, 101)", "substr(text, 101)"), "{id}": ("CAST(doc_id AS VARCHAR)", "CAST(doc_id AS STRING)")}


def _version_text(pattern: str, dialect: int) -> str:
    """A version's text as an expression of the columns of documents."""
    parts = [p for p in re.split(r"(\{\w+\}|\n)", pattern) if p]
    return "concat(" + ", ".join(_PLACES_OF[p][dialect] if p in _PLACES_OF else ("chr(10)" if p == "\n" else f"'{p}'") for p in parts) + ")"


VERSIONS_SQL = " UNION ALL ".join(f"SELECT doc_id AS path, {v} AS version, {_version_text(t, 0)} AS text FROM documents WHERE text IS NOT NULL" for v, _, t in _VERSIONS)
EDGES_SQL = " UNION ALL ".join(f"SELECT {v} AS version, {p} AS parent" for v, parents, _ in _VERSIONS for p in parents)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five versions of each document: as it is, a line more, its head edited, both merged with a line more, as it was. And what each was made from."""
    d = documents(spark, sf_dir).where("text is not null")
    rows = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.expr(_version_text(t, 1)).alias("text")) for v, _, t in _VERSIONS])).alias("v"))
    links = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(p).alias("parent")) for v, parents, _ in _VERSIONS for p in parents]))
    return rows.select(F.col("doc_id").alias("path"), "v.version", "v.text"), d.select(F.col("doc_id").alias("path"), links.alias("e")).select("path", "e.*")


_ADDED = f"""WITH v AS ({VERSIONS_SQL}), l AS (SELECT path, version, line, count(*) AS c FROM (SELECT path, version, unnest(string_split(text, chr(10))) AS line FROM v) GROUP BY 1, 2, 3),
a AS (SELECT l.path, l.version, l.line, any_value(l.c) - coalesce(max(p.c), 0) AS times FROM l LEFT JOIN ({EDGES_SQL}) e ON e.version = l.version LEFT JOIN l p ON p.path = l.path AND p.version = e.parent AND p.line = l.line GROUP BY 1, 2, 3)"""


@query(f"{_ADDED} SELECT path, version, md5(line) AS digest, times FROM a WHERE times > 0")
def src_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.added_lines(*_versions(spark, sf_dir)).select("path", "version", F.lower(F.hex("digest")).alias("digest"), "times")


_MAILBOXES = rf"""SELECT path, version, value FROM (SELECT path, version, unnest(list_distinct(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2,}}\b'))) AS value FROM a WHERE times > 0 AND version > 0)
WHERE lower(split_part(value, '@', 2)) IN {guard.CONSUMER_DOMAINS} AND lower(split_part(value, '@', 1)) NOT IN {guard.PLACEHOLDER_LOCALS}"""


@query(f"{_ADDED} {_MAILBOXES}")
def src_git_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes in what versions after the first add; lines that were there, went, or came from a parent are nobody's new finding. All lines are scanned, and findings meet the added ones."""
    rows, edges = _versions(spark, sf_dir)
    found = guard.emails(versions.lines(rows).where("version > 0").select(F.struct("path", "version", "digest").alias("place"), F.col("line").alias("text")), domain_of_texts="range")
    return found.select("place.*", "value").distinct().join(versions.added_lines(rows, edges), ["path", "version", "digest"]).select("path", "version", "value")


@query(f"SELECT first.path AS path, first.version AS version, times FROM (SELECT min(struct_pack(version := version, path := path)) AS first, count(*) AS times FROM ({VERSIONS_SQL}) GROUP BY md5(text))")
def src_git_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content of all versions once, as scanners of a history read it."""
    return versions.contents(_versions(spark, sf_dir)[0], F.col("version")).select("path", "version", "times")


@query(f"""WITH m AS (SELECT conv_id AS thread, turn AS seq, role <> 'user' AS bot, concat(substr(text, 1, 150), ' [EMAIL_1] ', substr(text, 151)) AS said, CASE WHEN turn % 3 <> 0 THEN turn - 1 END AS reply_to,
 concat('u_', substr({pseudonym_sql("concat(CAST(conv_id AS VARCHAR), ':', role)")}, 1, 6)) AS who FROM conversations),
x AS (SELECT *, row_number() OVER w AS n, first_value(said) OVER w AS opener FROM m WINDOW w AS (PARTITION BY thread ORDER BY seq)),
r AS (SELECT a.thread, a.seq, string_agg(concat(b.who, ': ', substr(b.said, 1, 160)), ' | ' ORDER BY b.seq) AS recent FROM x a JOIN x b ON a.thread = b.thread AND b.n BETWEEN a.n - 6 AND a.n - 1 WHERE NOT b.bot GROUP BY 1, 2)
SELECT x.thread, x.seq, substr(concat_ws(chr(10), CASE WHEN x.thread % 2 = 1 THEN concat('[thread title] thread ', x.thread, ' of [EMAIL_1]') END, CASE WHEN x.n > 1 THEN '[opening post] ' || substr(opener, 1, 400) END,
 '[replying to ' || CASE WHEN a.bot THEN 'the bot' ELSE a.who END || '] ' || substr(a.said, 1, 300), '[recent] ' || recent), 1, 1500) AS context
FROM x LEFT JOIN m a ON a.thread = x.thread AND a.seq = x.reply_to LEFT JOIN r ON r.thread = x.thread AND r.seq = x.seq""")
def prj_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with an address across the cut of the recent ones; each third turn answers one that is not there, each second thread has a title with an address."""
    c = F.col
    rows = read_messages(spark, sf_dir).select(
        "thread", "seq", "author", "bot", F.when(c("seq") % 3 != 0, c("seq") - 1).otherwise(c("seq") + 1000).alias("reply_to"),
        F.concat(F.left("text", F.lit(150)), F.lit(" m"), c("seq").cast("string"), F.lit("@corp.org "), F.substr("text", F.lit(151))).alias("text"),
        F.when(c("thread") % 2 == 1, F.concat(F.lit("thread "), c("thread").cast("string"), F.lit(" of host@corp.org"))).alias("title"),
    )
    return messages.context(rows, salt="query-salt")


@query("SELECT event_id, coalesce(value / 100e0 >= 0.3e0 AND value / 100e0 <= 0.85e0, false) AS uncertain FROM events")
def flt_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", messages.uncertain(F.col("value") / 100.0).alias("uncertain"))


@query("SELECT event_id, value / 100e0 >= 0.7e0 AS reply FROM events WHERE value / 100e0 >= 0.4e0")
def flt_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("value") / 100.0
    return table(spark, sf_dir, "events").where(score >= 0.4).select("event_id", (score >= 0.7).alias("reply"))



VERDICTS = "SELECT conv_id * 100 + turn AS i, turn % 2 = 0 AS is_demand, (turn % 10) / 10e0 AS confidence, text AS title FROM conversations"


@query(f"SELECT m.conv_id, m.turn, v.confidence FROM conversations m JOIN ({VERDICTS}) v ON v.i = m.conv_id * 100 + m.turn WHERE v.is_demand")
def join_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("i", F.col("conv_id") * 100 + F.col("turn"))
    v = c.select("i", (F.col("turn") % 2 == 0).alias("is_demand"), ((F.col("turn") % 10) / 10.0).alias("confidence"), F.col("text").alias("title"), F.lit("").alias("track"), F.lit("").alias("kano"), F.col("turn").alias("ordinal"))
    return messages.join_verdicts(c.select("i", "conv_id", "turn"), v).select("conv_id", "turn", "confidence")


@query(r"""SELECT conv_id, turn, concat(array_to_string(list_sort(list_distinct(CASE WHEN len(w) > 0 THEN w ELSE list_filter([trim(substr(t, 1, 24))], lambda x: x <> '') END)), '|'), '::general') AS canonical_key
FROM (SELECT conv_id, turn, trim(lower(text)) AS t, list_transform(list_slice(regexp_extract_all(trim(lower(text)), '[a-z][a-z0-9\-]{2,}'), 1, 4), lambda t: """ + ALIAS_SQL + ") AS w FROM conversations)")
def prj_demand_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("title"), F.lit("").alias("track"))
    return messages.demand_rows(rows).select("conv_id", "turn", "canonical_key")


@query("SELECT user_id, event_type, min(event_id) AS first_event, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS BIGINT) AS place FROM events WHERE event_type <> '' GROUP BY 1, 2")
def agg_distinct_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of a key once, in the order of its first appearance: reduced before it is numbered."""
    firsts = table(spark, sf_dir, "events").where("event_type <> ''").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))
    return firsts.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("first_event")).cast("long"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def dt_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso(F.col("o_orderdate")).alias("iso"))


@query("SELECT o_orderkey, CAST(date_trunc('second', o_orderdate) AS VARCHAR) AS ts FROM orders")
def dt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse(dates.iso(F.col("o_orderdate"))).cast("string").alias("ts"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS last, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS today FROM orders)
SELECT o_orderkey, CAST(d AS VARCHAR) AS day FROM (SELECT o_orderkey, CAST(unnest(CASE WHEN last IS NULL THEN [CAST(today AS TIMESTAMP)] WHEN last >= today THEN [] ELSE generate_series(CAST(greatest(last + 1, today - 29) AS TIMESTAMP), CAST(today AS TIMESTAMP), INTERVAL 1 DAY) END) AS DATE) AS d FROM r)""")
def dt_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key, F.when(key % 10 != 0, F.col("o_orderdate")).alias("last"), F.date_add(F.to_date("o_orderdate"), (key % 45).cast("int")).alias("today"))
    return rows.select("o_orderkey", F.explode(dates.missed_days(F.col("last"), F.col("today"))).alias("day")).withColumn("day", F.col("day").cast("string"))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, count(*) AS n, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last FROM s GROUP BY user_id, k""")
def stm_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = live.sessions(table(spark, sf_dir, "events"))
    return got.select("user_id", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query("SELECT event_id, any_value(user_id) AS user_id FROM events GROUP BY 1")
def stm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return live.deduplicated(e.union(e)).select("event_id", "user_id")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE")
def stm_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 5 MINUTES")).select("event_id")


@query("SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') >= 5 AS faded FROM events GROUP BY 1")
def stm_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", (F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("last")) >= 5).alias("faded"))
