"""Queries over scored demands: axes, order, gates, pools, drift, evolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.config import CLOSED
from plaintide.functions import scoring, text
from plaintide.operators import batch, demand, drift, pool, ranking
from plaintide.plans.adapters import CUTOFF, MENTIONS, PROPOSALS, crowded, dealt, mentions, proposals, tasks
from plaintide.plans.registry import query
from plaintide.sources import ledger
from plaintide.storage import cut, new_path, shuffle_partitions

BASE = f"WITH m AS ({MENTIONS}), p AS ({PROPOSALS}), {demand.SCORED}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = mentions(spark, sf_dir), proposals(spark, sf_dir)
    if crowded(spark, sf_dir):
        return demand.score(p, m)
    return demand.rated(p.join(demand.side(_gathered(spark, sf_dir, all=F.lit(True)), "all").drop("people", "source_set"), "demand_id"))


def _gathered(spark: SparkSession, sf_dir: str, **sides: Column) -> DataFrame:
    return demand.gathered(mentions(spark, sf_dir), max(tasks(spark, sf_dir), shuffle_partitions(spark)), **sides)


def over(sql: str) -> str:
    return f"{BASE} {sql}"


@query(f"WITH m AS ({MENTIONS}), p AS ({PROPOSALS}), {demand.SCORED} SELECT demand_id, intensity, distinct_authors FROM i")
def agg_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.intensity(dealt(spark, sf_dir))


@query(over("SELECT demand_id, mention_count, sources, internal_mentions, external_mentions, explicit, CAST(last_seen AS VARCHAR) AS last_seen FROM e"))
def agg_isc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.evidence(dealt(spark, sf_dir)).withColumn("last_seen", F.col("last_seen").cast("string"))


@query(over("SELECT demand_id, confidence FROM s"))
def agg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demand.evidence(dealt(spark, sf_dir))
    return e.select("demand_id", scoring.confidence(F.col("explicit"), F.col("sources"), F.col("internal_mentions")).alias("confidence"))


def _columns(name: str, *columns: str) -> None:
    @query(over(f"SELECT demand_id, {', '.join(columns)} FROM s"), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scored(spark, sf_dir).select("demand_id", *columns)


for _name, _cols in {
    "fn_rice": ("reach", "impact", "confidence", "rice_raw"),
    "fn_final": ("final_score",),
    "fn_tier": ("tier", "reason"),
    "fn_score": ("rice_raw", "opportunity", "wsjf", "final_score", "grade", "tier", "intensity"),
}.items():
    _columns(_name, *_cols)


def _from_parts(name: str, column: str, make: Callable[[], Column]) -> None:
    """Axes that need no mentions read the part table alone."""

    @query(f"WITH m AS ({MENTIONS}), p AS ({PROPOSALS}), {demand.SCORED.replace('JOIN e USING (demand_id) JOIN i USING (demand_id)', 'LEFT JOIN e USING (demand_id) LEFT JOIN i USING (demand_id)')} SELECT demand_id, {column} FROM s", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return proposals(spark, sf_dir).select("demand_id", make().alias(column))


_from_parts("fn_impact", "impact", lambda: scoring.impact(F.col("impact_label")))
_from_parts("fn_opportunity", "opportunity", lambda: scoring.opportunity(F.col("importance"), F.col("satisfaction")))
_from_parts("fn_wsjf", "wsjf", lambda: scoring.wsjf(F.col("ubv"), scoring.time_criticality(F.col("tc"), F.col("competitor_status")), F.col("rr"), F.col("job_size")))


@query(f"SELECT demand_id, CASE WHEN lower(competitor_status) LIKE '%shipped%' THEN greatest(tc, 13e0) ELSE tc END AS tc FROM ({PROPOSALS})")
def fn_tcfloor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposals(spark, sf_dir).select("demand_id", scoring.time_criticality(F.col("tc"), F.col("competitor_status")).alias("tc"))


@query(over("SELECT demand_id, final_score, grade FROM s"))
def fn_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("demand_id", "final_score", "grade")


@query("SELECT o_orderkey AS id, CASE WHEN s >= 85 THEN 'A' WHEN s >= 75 THEN 'B+' WHEN s >= 65 THEN 'B' WHEN s >= 55 THEN 'C+' WHEN s >= 45 THEN 'C' ELSE 'D' END AS grade FROM (SELECT o_orderkey, o_orderkey % 101 AS s FROM orders)")
def fn_grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plaintide.plans.registry import table

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scoring.grade(F.col("o_orderkey") % 101).alias("grade"))


@query(over("SELECT demand_id, CASE WHEN tier = 'cut' OR kano IN ('indifferent', 'reverse') THEN 1 ELSE 0 END AS cut FROM s"))
def flt_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("demand_id", scoring.is_cut(F.col("tier"), F.col("kano")).cast("int").alias("cut"))


TIER_ORDER = "CASE tier WHEN 'tier0' THEN 0 WHEN 'tier1' THEN 1 WHEN 'tier2' THEN 2 WHEN 'backlog' THEN 3 WHEN 'cut' THEN 9 ELSE 5 END, final_score DESC, canonical_key, demand_id"


@query(over(f"SELECT row_number() OVER (ORDER BY {TIER_ORDER}) AS position, demand_id, title, canonical_key, tier, CASE tier WHEN 'tier0' THEN 'immediate' WHEN 'tier1' THEN 'this-week' WHEN 'tier2' THEN 'this-month' ELSE 'backlog' END AS horizon, rice_raw, final_score, opportunity, wsjf, intensity, distinct_authors FROM s WHERE tier <> 'cut' AND kano NOT IN ('indifferent', 'reverse')"))
def win_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ranking.iteration_queue(scored(spark, sf_dir))
    return q.select(F.col("position").cast("long").alias("position"), "demand_id", "title", "canonical_key", "tier", "horizon", "rice_raw", "final_score", "opportunity", "wsjf", "intensity", "distinct_authors")


@query(over(f"SELECT CAST(row_number() OVER (ORDER BY {TIER_ORDER}) AS INTEGER) AS position, demand_id, concat(CAST(row_number() OVER (ORDER BY {TIER_ORDER}) AS VARCHAR), '. [', CASE tier WHEN 'tier0' THEN 'immediate' WHEN 'tier1' THEN 'this-week' WHEN 'tier2' THEN 'this-month' ELSE 'backlog' END, ' / ', kano, '] ', title, ' | ', grade) AS line FROM s WHERE tier <> 'cut' ORDER BY position LIMIT 5"))
def win_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.headlines(scored(spark, sf_dir))


@query(over("SELECT demand_id, final_score, CASE WHEN opportunity >= 10e0 AND greatest(coalesce(effort_weeks, 2e0), 0.5e0) <= 3e0 AND kano IN ('must_be', 'performance', '') THEN 'quick_win' WHEN kano = 'delighter' OR (impact >= 2e0 AND confidence <= 0.5e0) THEN 'big_bet' ELSE 'other' END AS pool FROM s WHERE tier <> 'cut'"))
def srt_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split_pools(scored(spark, sf_dir)).select("demand_id", "final_score", "pool")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scored(spark, sf_dir))


def _shown(s: DataFrame) -> DataFrame:
    """Scored demands with texts to show: an address in some summaries, a number in some evidence."""
    k = F.col("demand_id")
    summary = F.when(k % 17 == 0, F.concat(F.lit("write to user"), k.cast("string"), F.lit("@mail.org"))).otherwise("plain words")
    snippet = F.when(k % 19 == 0, "").otherwise("a quote")
    quote = F.when(k % 19 == 0, "call +1 415 867 5309 now").otherwise("")
    return s.withColumn("summary", summary).withColumn("evidence", F.array(F.struct(snippet.alias("redacted_snippet"), quote.alias("quote"))))


ERRS = """e2 AS (SELECT *, list_filter([CASE WHEN coalesce(canonical_key, '') = '' THEN 'no key' END, CASE WHEN coalesce(track, '') = '' THEN 'no track' END,
  CASE WHEN rice_raw IS NULL THEN 'no rice' END, CASE WHEN opportunity IS NULL THEN 'no opportunity' END, CASE WHEN wsjf IS NULL THEN 'no urgency' END,
  CASE WHEN NOT coalesce(final_score BETWEEN 0 AND 100, false) THEN 'score out of range' END, CASE WHEN NOT coalesce(tier IN ('tier0', 'tier1', 'tier2', 'backlog', 'cut'), false) THEN 'unknown tier' END,
  CASE WHEN coalesce(internal_mentions, 0) < 1 THEN 'no internal evidence' END, CASE WHEN final_score >= 70e0 AND sources < 2 THEN 'one source' END,
  CASE WHEN demand_id % 17 = 0 THEN 'personal data in summary' END, CASE WHEN demand_id % 19 = 0 THEN 'personal data in evidence[0].redacted_snippet' END], lambda x: x IS NOT NULL) AS errs FROM s),
g AS (SELECT *, len(errs) = 0 AS passed, tier = 'tier0' AS first FROM e2),
t AS (SELECT demand_id FROM g WHERE passed AND (first OR final_score >= 70e0) ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN demand_id END NULLS FIRST, final_score DESC, demand_id LIMIT 5)"""


@query(over(f", {ERRS} SELECT demand_id, array_to_string(errs, ',') AS errs, passed FROM g").replace("s3) ,", "s3),"))
def flt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gate(_cards(spark, sf_dir)).select("demand_id", F.array_join("errs", ",").alias("errs"), "passed")


@query(over(f", {ERRS} SELECT demand_id, passed, demand_id IN (SELECT demand_id FROM t) AS pushable, passed AND (first OR final_score >= 40e0) AS archivable, passed AND (first OR final_score >= 40e0) AND demand_id NOT IN (SELECT demand_id FROM t) AS digest_only FROM g").replace("s3) ,", "s3),"))
def evo_gate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gate(_cards(spark, sf_dir)).select("demand_id", "passed", "pushable", "archivable", "digest_only")


@query(over(f", {ERRS} SELECT demand_id, tier, final_score FROM g WHERE demand_id IN (SELECT demand_id FROM t)").replace("s3) ,", "s3),"))
def top_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gate(_cards(spark, sf_dir)).where("pushable").select("demand_id", "tier", "final_score")


@query(over(f", {ERRS} SELECT demand_id, final_score FROM g WHERE passed AND (first OR final_score >= 40e0)").replace("s3) ,", "s3),"))
def top_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gate(_cards(spark, sf_dir)).where("archivable").select("demand_id", "final_score")


@query(over(f", {ERRS} SELECT CAST(sum(internal_mentions) AS BIGINT) AS internal, CAST(sum(external_mentions) AS BIGINT) AS external, count(*) AS candidates, count(*) FILTER (WHERE demand_id IN (SELECT demand_id FROM t)) AS pushed, count(*) FILTER (WHERE passed) AS passed FROM g").replace("s3) ,", "s3),"))
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of one set of cards; that of a day, with those in the review band, is among the counts of :func:`evo_process`."""
    g = ranking.gate(_cards(spark, sf_dir))
    return g.agg(F.sum("internal_mentions").alias("internal"), F.sum("external_mentions").alias("external"), F.count(F.lit(1)).alias("candidates"), F.count_if("pushable").alias("pushed"), F.count_if("passed").alias("passed"))


@query(over("SELECT demand_id, CAST(CASE WHEN tier = 'tier0' THEN 1 ELSE greatest(1, least(9, 10 - CAST(round_even(final_score / 11.2e0, 0) AS INTEGER))) END AS INTEGER) AS priority FROM s"))
def snk_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("demand_id", scoring.priority(F.col("tier"), F.col("final_score")).alias("priority"))


STATUS = "CASE demand_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'triaged' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'shipped' WHEN 4 THEN 'wontfix' ELSE 'duplicate' END"


@query(over(f"SELECT demand_id, status, final_score FROM (SELECT *, {STATUS} AS status FROM s) WHERE status NOT IN ('shipped', 'wontfix', 'duplicate')"))
def srt_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("new", "triaged", "in_progress", "shipped", "wontfix", "duplicate"))), (F.col("demand_id") % 6 + 1).cast("int"))
    return scored(spark, sf_dir).withColumn("status", status).where(~F.col("status").isin(*CLOSED)).select("demand_id", "status", "final_score")


@query(over("SELECT row_number() OVER (ORDER BY final_score DESC, CAST(demand_id AS VARCHAR)) AS place, demand_id, final_score FROM s"))
def srt_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.global_rank(scored(spark, sf_dir), [F.desc("final_score"), F.col("demand_id").cast("string")], "place")
    return ranked.select(F.col("place").cast("long").alias("place"), "demand_id", "final_score")


@query(over("SELECT demand_id, final_score, touched FROM (SELECT demand_id, final_score, CAST(last_seen AS DATE) >= DATE '2001-09-01' AS touched, row_number() OVER (PARTITION BY CAST(last_seen AS DATE) >= DATE '2001-09-01' ORDER BY final_score DESC, demand_id) AS n FROM s) WHERE n <= 15"))
def top_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("touched", F.to_date("last_seen") >= F.lit("2001-09-01").cast("date"))
    order = [F.desc("final_score"), F.col("demand_id")]
    tops = [rows.where(F.col("touched") == flag).orderBy(*order).limit(15) for flag in (True, False)]
    return tops[0].union(tops[1]).select("demand_id", "final_score", "touched")


@query(over("SELECT count(*) FILTER (WHERE CAST(last_seen AS DATE) >= DATE '2001-09-01') AS touched, count(*) AS backlog FROM s"))
def agg_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.evidence(mentions(spark, sf_dir)).agg(F.count_if(F.to_date("last_seen") >= F.lit("2001-09-01").cast("date")).alias("touched"), F.count(F.lit(1)).alias("backlog"))


W1, W2 = {}, {"reach": 1.0, "impact": 2.0, "confidence": 1.0, "effort": 1.5}
REWEIGHT = """r AS (SELECT demand_id, impact_label, effort_weeks, distinct_authors,
  round(100e0 * raw1 / (raw1 + 6e0), 4) AS s1, round(100e0 * raw2 / (raw2 + 6e0), 4) AS s2 FROM (SELECT *,
  round(reach * impact * confidence / greatest(eff, 0.5e0), 6) AS raw1, round(reach * (impact * 2e0) * confidence / greatest(eff * 1.5e0, 0.5e0), 6) AS raw2
  FROM (SELECT *, CASE WHEN effort_weeks IS NULL OR effort_weeks = 0 THEN 2e0 ELSE effort_weeks END AS eff FROM s))),
k AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, CAST(demand_id AS VARCHAR)) AS r1, row_number() OVER (ORDER BY s2 DESC, CAST(demand_id AS VARCHAR)) AS r2 FROM r)"""


def _reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    a = drift.rescored(s, W1).withColumnRenamed("score", "s1")
    b = drift.rescored(s, W2).withColumnRenamed("score", "s2")
    return a.join(b, "demand_id")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _reweighted(spark, sf_dir)
    one = ranking.global_rank(both, [F.desc("s1"), F.col("demand_id").cast("string")], "r1")
    return ranking.global_rank(one, [F.desc("s2"), F.col("demand_id").cast("string")], "r2")


@query(over(f", {REWEIGHT} SELECT demand_id, s1, s2 FROM r").replace("s3) ,", "s3),"))
def fn_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reweighted(spark, sf_dir)


TAU = "(SELECT CAST(count(*) AS BIGINT) FROM k a JOIN k b ON a.r1 < b.r1 AND a.r2 > b.r2)"


@query(over(f", {REWEIGHT} SELECT (SELECT count(*) FROM k) AS n, {TAU} AS discordant, round(CAST({TAU} AS DOUBLE) / ((SELECT count(*) FROM k) * ((SELECT count(*) FROM k) - 1) / 2e0), 6) AS tau").replace("s3) ,", "s3),"))
def agg_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tau(_ranked(spark, sf_dir))


def _tau(ranked: DataFrame) -> DataFrame:
    ranks = ranked.select("r1", "r2")
    n = F.col("n")
    tau = F.when(n < 2, 0.0).otherwise(F.round(F.col("discordant").cast("double") / (n * (n - 1) / F.lit(2.0)), 6))
    return drift.inversions(ranks).withColumn("tau", tau)


DRIFT = "SELECT max(abs(r1 - r2)) AS max_shift, round(count(*) FILTER (WHERE (s1 >= 70e0) <> (s2 >= 70e0)) / CAST(greatest(1, count(*) FILTER (WHERE s1 >= 70e0 OR s2 >= 70e0)) AS DOUBLE), 6) AS push_churn, round(count(*) FILTER (WHERE r1 <= top AND r2 > top) / CAST(max(top) AS DOUBLE), 6) AS top_churn FROM (SELECT *, greatest(1, (SELECT count(*) FROM k) // 2) AS top FROM k)"


def _drift(k: DataFrame) -> DataFrame:
    n = k.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias("top"))
    a, b = F.col("s1") >= 70, F.col("s2") >= 70
    return k.join(F.broadcast(n)).agg(
        F.max(F.abs(F.col("r1") - F.col("r2"))).cast("long").alias("max_shift"),
        F.round(F.count_if(a != b) / F.greatest(F.lit(1), F.count_if(a | b)).cast("double"), 6).alias("push_churn"),
        F.round(F.count_if((F.col("r1") <= F.col("top")) & (F.col("r2") > F.col("top"))) / F.max("top").cast("double"), 6).alias("top_churn"),
    )


@query(over(f", {REWEIGHT} {DRIFT}").replace("s3) ,", "s3),"))
def agg_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(cut(_ranked(spark, sf_dir), "reweighted"))


@query(over(f", {REWEIGHT}, d AS ({DRIFT}), t AS (SELECT round(CAST({TAU} AS DOUBLE) / ((SELECT count(*) FROM k) * ((SELECT count(*) FROM k) - 1) / 2e0), 6) AS tau) SELECT tau, push_churn, CASE WHEN tau >= 0.6e0 OR push_churn >= 0.5e0 THEN 'block' WHEN tau > 0.25e0 OR push_churn > 0.2e0 THEN 'needs_review' ELSE 'auto_pass' END AS decision FROM d, t").replace("s3) ,", "s3),"))
def agg_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = cut(_ranked(spark, sf_dir), "reweighted")
    both = _tau(k).select("tau").join(F.broadcast(_drift(k).select("push_churn")))
    return both.withColumn("decision", drift.decision(F.col("tau"), F.col("push_churn")))


def _side(spark: SparkSession, sf_dir: str, before: str | None) -> DataFrame:
    """Scored demands with what evolution compares; ``before`` limits their mentions."""
    m = mentions(spark, sf_dir)
    m = m.where(F.col("ts") < F.lit(before).cast("timestamp")) if before else m
    extra = m.groupBy("demand_id").agg(F.array_sort(F.collect_set("channel")).alias("source_set"), F.max("ts").alias("_"))
    return _compared(demand.score(proposals(spark, sf_dir), m).join(extra.drop("_"), "demand_id"), before)


def _compared(s: DataFrame, before: str | None) -> DataFrame:
    status = F.when(F.lit(before is not None) & (F.col("demand_id") % 2 == 0), "").otherwise(F.col("competitor_status"))
    velocity = F.when(F.col("demand_id") % 3 != 0, (F.col("mention_count") / 4.0))
    return s.withColumn("competitor_status", status).withColumn("velocity", velocity)


def _sides(where: str, suffix: str, prior: bool) -> str:
    names = {x: f"{x}{suffix}" for x in ("a", "i", "e", "s1", "s2", "s3", "s")}
    sql = demand.SCORED
    for old in ("s1", "s2", "s3"):
        sql = sql.replace(f"FROM {old})", f"FROM {names[old]})").replace(f"{old} AS (", f"{names[old]} AS (")
    sql = sql.replace("FROM s3)", f"FROM {names['s3']})").replace("FROM m GROUP", f"FROM m{suffix} GROUP").replace("FROM a GROUP", f"FROM a{suffix} GROUP")
    sql = sql.replace("JOIN e USING", f"JOIN e{suffix} e USING").replace("JOIN i USING", f"JOIN i{suffix} i USING")
    for old in ("a", "i", "e"):
        sql = sql.replace(f"\n{old} AS (", f"\n{names[old]} AS (")
    sql = f"a{suffix}" + sql[1:] if sql.startswith("a AS") else sql
    sql = sql.replace("\ns AS (", f"\ns{suffix} AS (")
    status = "CASE WHEN demand_id % 2 = 0 THEN '' ELSE competitor_status END" if prior else "competitor_status"
    return f"""m{suffix} AS (SELECT * FROM m {where}), {sql},
v{suffix} AS (SELECT s{suffix}.* REPLACE ({status} AS competitor_status), src.source_set, CASE WHEN demand_id % 3 <> 0 THEN mention_count / 4e0 END AS velocity
  FROM s{suffix} JOIN (SELECT demand_id, list_sort(list(DISTINCT channel)) AS source_set FROM m{suffix} GROUP BY 1) src USING (demand_id))"""


EVO = f"""WITH m AS ({MENTIONS}), p AS ({PROPOSALS}), {_sides('', '_c', False)}, {_sides(f"WHERE ts < TIMESTAMP '{CUTOFF}'", '_p', True)},
j AS (SELECT c.demand_id, c.final_score, c.final_score - coalesce(q.final_score, 0e0) AS rise, q.demand_id IS NULL AS fresh,
  list_sort(list_filter(c.source_set, lambda x: NOT list_contains(coalesce(q.source_set, []), x))) AS new_sources,
  len(coalesce(q.source_set, [])) < 2 AND len(c.source_set) >= 2 AS crossed_two,
  c.competitor_status <> '' AND c.competitor_status <> coalesce(q.competitor_status, '') AND lower(c.competitor_status) LIKE '%shipped%' AS competitor_shipped,
  coalesce(abs(c.velocity - q.velocity) >= 5e0, false) AS velocity_jumped, coalesce(q.external_mentions, 0) = 0 AND c.external_mentions >= 1 AS external_new,
  c.tier = 'tier0' AND coalesce(q.tier, '') <> 'tier0' AS escalated FROM v_c c LEFT JOIN v_p q USING (demand_id))
SELECT demand_id, CASE WHEN fresh THEN 'NEW' WHEN rise >= 15e0 OR (len(new_sources) >= 1 AND crossed_two) OR competitor_shipped OR velocity_jumped OR external_new OR escalated THEN 'RESURFACE' ELSE 'SUPPRESS' END AS branch,
  round(rise, 4) AS score_delta, array_to_string(new_sources, ',') AS new_sources, crossed_two, competitor_shipped, velocity_jumped, external_new, escalated FROM j"""


#: Sides of a day: all mentions, and those before it.
SIDES = {"now": None, "prior": CUTOFF}


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with both sides of their mentions, from one pass over these."""
    sides = {s: F.lit(True) if before is None else F.coalesce(F.col("ts") < F.lit(before).cast("timestamp"), F.lit(False)) for s, before in SIDES.items()}
    return cut(proposals(spark, sf_dir).join(_gathered(spark, sf_dir, **sides), "demand_id"), "both")


@query(EVO)
def evo_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    if crowded(spark, sf_dir):
        now, prior = _side(spark, sf_dir, None), _side(spark, sf_dir, CUTOFF)
    else:
        both = _both(spark, sf_dir)
        now, prior = (_compared(demand.rated(demand.side(both, s).drop("people")), before) for s, before in SIDES.items())
    e = pool.evolve(now, prior)
    return e.select("demand_id", "branch", "score_delta", F.array_join("new_sources", ",").alias("new_sources"), "crossed_two", "competitor_shipped", "velocity_jumped", "external_new", "escalated")


def _day(spark: SparkSession, sf_dir: str, before: str | None, both: DataFrame | None = None) -> DataFrame:
    """A day's cards: scored demands with texts to show, their authors and mentions. ``both`` is what days share (:func:`_both`)."""
    name = next(s for s, x in SIDES.items() if x == before)
    s = demand.rated(demand.side(both if both is not None else _both(spark, sf_dir), name))
    people = F.transform("people", lambda x: F.struct(x["author"].cast("string").alias("author_hash"), x["weight"].alias("weight")))
    cards = _shown(_compared(s, before)).withColumn("authors", people).drop("people")
    summary = F.when(F.col("demand_id") % 4 == 1, F.concat("summary", F.lit(" anew"))).otherwise(F.col("summary"))
    return cards.withColumns({"summary": summary, "inferred_job": F.lit(""), "new_mentions": F.col("mention_count")})


_SUMMARY = "concat(CASE WHEN demand_id % 17 = 0 THEN concat('write to user', CAST(demand_id AS VARCHAR), '@mail.org') ELSE 'plain words' END, CASE WHEN demand_id % 4 = 1 THEN ' anew' ELSE '' END)"
_TOKENS = f"list_filter(regexp_extract_all(lower(concat(title, ' ', {_SUMMARY})), '[a-z0-9][a-z0-9+.#-]*'), lambda t: length(t) >= 3 AND NOT list_contains({list(text.STOP)}, t))"
#: Day 1 has the prior cards of two demands in three; what it left in the ledger, and what each card of day 2 finds there.
_DAYS = f"""WITH m AS ({MENTIONS}), p AS ({PROPOSALS}), {_sides('', '_c', False)}, {_sides(f"WHERE ts < TIMESTAMP '{CUTOFF}'", '_p', True)},
led AS (SELECT *, min(demand_id) OVER (PARTITION BY canonical_key) AS ordinal, {_TOKENS} AS toks FROM v_p WHERE demand_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY demand_id DESC) = 1),
card AS (SELECT *, {_TOKENS} AS toks FROM v_c),
near AS (SELECT c.demand_id, l.ordinal, len(list_intersect(c.toks, l.toks)) / CAST(len(list_distinct(list_concat(c.toks, l.toks))) AS DOUBLE) AS sim,
  len(list_intersect(string_split(split_part(c.canonical_key, '::', 1), '|'), string_split(split_part(l.canonical_key, '::', 1), '|'))) AS shared, split_part(c.canonical_key, '::', 2) = split_part(l.canonical_key, '::', 2) AS same,
  len(list_filter(c.toks, lambda t: NOT list_contains(l.toks, t))) = 0 OR len(list_filter(l.toks, lambda t: NOT list_contains(c.toks, t))) = 0 OR c.toks[1] = l.toks[1] AS agree FROM card c, led l),
fuzzy AS (SELECT demand_id, arg_max(ordinal, (sim, ordinal)) AS ordinal FROM near WHERE sim >= 0.83e0 OR ((shared >= 2 OR (shared >= 1 AND same)) AND agree AND sim >= 0.45e0 AND sim < 0.78e0) GROUP BY 1),
mt AS (SELECT c.demand_id, coalesce(l.ordinal, f.ordinal) AS ordinal FROM card c LEFT JOIN led l USING (canonical_key) LEFT JOIN fuzzy f ON f.demand_id = c.demand_id),
q AS (SELECT mt.demand_id AS card_id, led.* FROM mt JOIN led USING (ordinal)),
x AS (SELECT c.demand_id, q.card_id IS NULL AS fresh, c.final_score - coalesce(q.final_score, 0e0) >= 15e0 OR (len(list_filter(c.source_set, lambda x: NOT list_contains(coalesce(q.source_set, []), x))) >= 1 AND len(coalesce(q.source_set, [])) < 2 AND len(c.source_set) >= 2)
  OR (c.competitor_status <> '' AND c.competitor_status <> coalesce(q.competitor_status, '') AND lower(c.competitor_status) LIKE '%shipped%') OR coalesce(abs(c.velocity - q.velocity) >= 5e0, false)
  OR (coalesce(q.external_mentions, 0) = 0 AND c.external_mentions >= 1) OR (c.tier = 'tier0' AND coalesce(q.tier, '') <> 'tier0') AS material FROM card c LEFT JOIN q ON q.card_id = c.demand_id),
act AS (SELECT v_c.* FROM v_c JOIN x USING (demand_id) WHERE fresh OR material), {ERRS.replace("AS errs FROM s)", "AS errs FROM act)")},
gq AS (SELECT *, passed AND (first OR final_score >= 40e0) AS archivable, demand_id IN (SELECT demand_id FROM t) AS pushable FROM g)"""


@query(f"""{_DAYS} SELECT (SELECT count(*) FROM x) AS candidates, (SELECT count(*) FROM x WHERE fresh) AS fresh, (SELECT count(*) FROM x WHERE NOT fresh AND material) AS resurfaced, (SELECT count(*) FROM x WHERE NOT fresh AND NOT material) AS suppressed,
(SELECT count(DISTINCT demand_id) FROM near WHERE sim >= 0.78e0 AND sim < 0.83e0) AS candidate_merge, count(*) FILTER (WHERE NOT passed) AS blocked, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE pushable) AS pushed,
count(*) FILTER (WHERE archivable) AS archived, count(*) FILTER (WHERE archivable AND NOT pushable) AS digest_only, (SELECT CAST(sum(internal_mentions) AS BIGINT) FROM card) AS internal, (SELECT CAST(sum(external_mentions) AS BIGINT) FROM card) AS external,
count(*) FILTER (WHERE archivable) = 0 AS empty_day FROM gq""")
def evo_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days over a new ledger; what the second tells."""
    root, both = new_path(spark, "days"), _both(spark, sf_dir)
    batch.run_day(_day(spark, sf_dir, CUTOFF, both).where("demand_id % 3 <> 0"), root, "day-1", F.lit("2000-01-01").cast("timestamp"))
    return batch.run_day(_day(spark, sf_dir, None, both), root, "day-2", F.lit("2000-01-02").cast("timestamp"))


@query(over("SELECT s.demand_id AS candidate_id, s.canonical_key, f.match FROM s LEFT JOIN (SELECT canonical_key, min(demand_id) AS match FROM s WHERE demand_id % 2 = 0 GROUP BY 1) f USING (canonical_key)"))
def join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = proposals(spark, sf_dir).select("demand_id", text.canonical_key(text.entities(F.col("title")), F.col("track")).alias("canonical_key"))
    live = scored(spark, sf_dir).select(F.col("demand_id").alias("candidate_id"))
    cand = p.withColumnRenamed("demand_id", "candidate_id").join(live, "candidate_id")
    known = p.join(live, F.col("demand_id") == F.col("candidate_id"), "left_semi").where("demand_id % 2 = 0").withColumnRenamed("demand_id", "ordinal")
    return pool.match_exact(cand, known)


MERGE = f"""WITH m AS ({MENTIONS}), w AS (SELECT *, CASE urgency WHEN 'blocking' THEN 3 WHEN 'need' THEN 2 ELSE 1 END + CASE segment WHEN 'enterprise' THEN 4 WHEN 'team' THEN 3 WHEN 'pro' THEN 2 ELSE 1 END AS weight FROM m),
a AS (SELECT demand_id, author, max(weight) AS weight FROM w WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1, 2), b AS (SELECT demand_id, author, max(weight) AS weight FROM w WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2)
SELECT demand_id, author, greatest(coalesce(a.weight, 0), coalesce(b.weight, 0)) AS weight, CASE WHEN a.weight IS NOT NULL AND a.weight >= coalesce(b.weight, 0) THEN 'prior' ELSE 'new' END AS origin FROM a FULL JOIN b USING (demand_id, author)"""


@query(MERGE)
def join_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    day = F.lit(CUTOFF).cast("timestamp")
    return pool.merge_authors(demand.author_weight(m.where(F.col("ts") < day)), demand.author_weight(m.where(F.col("ts") >= day)))


@query(f"""WITH m AS ({MENTIONS}), d AS (SELECT demand_id, CAST(date_trunc('month', ts) AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM m GROUP BY 1, 2),
x AS (SELECT *, round(value - lag(value) OVER (PARTITION BY demand_id ORDER BY day), 4) AS delta, row_number() OVER (PARTITION BY demand_id ORDER BY day DESC) AS age FROM d)
SELECT demand_id, CAST(day AS VARCHAR) AS day, value, delta FROM x WHERE age <= 30""")
def lag_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date(F.date_trunc("month", "ts"))
    samples = mentions(spark, sf_dir).groupBy("demand_id", day.alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return pool.ring(samples, "demand_id", "day").select("demand_id", F.col("day").cast("string").alias("day"), "value", "delta")


@query(f"""WITH m AS ({MENTIONS}), a AS (SELECT demand_id, list(DISTINCT channel) AS l FROM m WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1), b AS (SELECT demand_id, list(DISTINCT channel) AS l FROM m WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY 1)
SELECT demand_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.l, []), coalesce(b.l, [])))), ',') AS both_sets,
array_to_string(list_sort(list_filter(coalesce(b.l, []), lambda x: NOT list_contains(coalesce(a.l, []), x))), ',') AS only_new FROM a FULL JOIN b USING (demand_id)""")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    old = F.collect_set(F.when(F.col("ts") < F.lit(CUTOFF).cast("timestamp"), F.col("channel")))
    new = F.collect_set(F.when(F.col("ts") >= F.lit(CUTOFF).cast("timestamp"), F.col("channel")))
    sets = m.groupBy("demand_id").agg(old.alias("a"), new.alias("b"))
    join = lambda x: F.array_join(F.array_sort(x), ",")
    return sets.select("demand_id", join(F.array_union("a", "b")).alias("both_sets"), join(F.array_except("b", "a")).alias("only_new"))


@query(over(f", {REWEIGHT} SELECT demand_id, s1 >= 70e0 AS before, s2 >= 70e0 AS after FROM r WHERE (s1 >= 70e0) <> (s2 >= 70e0)").replace("s3) ,", "s3),"))
def set_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("s1") >= 70, F.col("s2") >= 70
    return _reweighted(spark, sf_dir).where(a != b).select("demand_id", a.alias("before"), b.alias("after"))


@query(over("SELECT demand_id, concat('demand:', canonical_key) AS idempotency_key, concat('dm-', substr(sha1(canonical_key), 1, 16)) AS id FROM s"))
def st_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("canonical_key")
    return scored(spark, sf_dir).select("demand_id", text.idempotency_key(k).alias("idempotency_key"), text.demand_id(k).alias("id"))


@query(f"""{BASE}, o AS (SELECT demand_id, final_score, tier FROM s WHERE demand_id % 3 <> 0), n AS (SELECT demand_id, final_score - 1e0 AS final_score, 'backlog' AS tier FROM s WHERE demand_id % 5 = 0)
SELECT demand_id, CASE WHEN n.demand_id IS NULL THEN o.final_score ELSE n.final_score END AS final_score, CASE WHEN n.demand_id IS NULL THEN o.tier ELSE n.tier END AS tier FROM o FULL JOIN n USING (demand_id)""")
def snk_upsert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in buckets, its rows laid down by one run and a part of them by the next."""
    root, s = new_path(spark, "ledger"), cut(scored(spark, sf_dir).select("demand_id", "final_score", "tier"), "scored")
    delta = s.where("demand_id % 5 = 0").select("demand_id", (F.col("final_score") - 1.0).alias("final_score"), F.lit("backlog").alias("tier"))
    for run, rows in (("one", s.where("demand_id % 3 <> 0")), ("two", delta), ("two", delta)):
        ledger.upsert(rows, "demand_id", root, run, F.lit("2000-01-01"))
    return ledger.current(spark, root)


_QUEUE = over(f"""SELECT *, row_number() OVER (ORDER BY {TIER_ORDER}) AS position, CASE tier WHEN 'tier0' THEN 'immediate' WHEN 'tier1' THEN 'this-week' WHEN 'tier2' THEN 'this-month' ELSE 'backlog' END AS horizon,
 CASE WHEN opportunity >= 10e0 AND greatest(coalesce(effort_weeks, 2e0), 0.5e0) <= 3e0 AND kano IN ('must_be', 'performance', '') THEN 'quick_win' WHEN kano = 'delighter' OR (impact >= 2e0 AND confidence <= 0.5e0) THEN 'big_bet' ELSE 'other' END AS pool
 FROM s WHERE tier <> 'cut' AND kano NOT IN ('indifferent', 'reverse')""")
_TALLY = over("SELECT count(*) AS n, count(*) FILTER (WHERE tier = 'cut' OR kano IN ('indifferent', 'reverse')) AS noise, CAST(sum(internal_mentions) AS BIGINT) AS internal, CAST(sum(external_mentions) AS BIGINT) AS external FROM s")


@query(f"""WITH k AS ({_QUEUE}), h AS ({_TALLY})
SELECT CAST(i AS BIGINT) AS n, list_extract(['# Demand digest 2001-11-05', '', concat('> candidates ', h.n, ', actionable ', h.n - noise, ', noise ', noise), concat('> evidence internal ', internal, ', external ', external), CASE WHEN h.n = noise THEN '**No demand cleared the floor today.**' ELSE '' END], CAST(i AS INTEGER) + 1) AS line FROM h, range(5) r(i)
UNION ALL SELECT 5 + 3 * (position - 1) + i, CASE i WHEN 0 THEN concat(position, '. [', tier, '/', horizon, '/', pool, '] ', title, ', final ', final_score, ' (', grade, ')')
 WHEN 1 THEN concat('   RICE ', rice_raw, ' = reach ', reach, ', impact ', impact, ', confidence ', confidence, '; WSJF ', wsjf, '; opportunity ', opportunity)
 ELSE concat('   evidence ', internal_mentions, ' internal, ', external_mentions, ' external, ', distinct_authors, ' authors') END FROM k, range(3) r(i)""")
def rnd_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.digest_lines(cut(scored(spark, sf_dir), "cards"), "2001-11-05")


CARDS = """x AS (SELECT demand_id, list(DISTINCT concat(origin, ':', channel)) AS origins, list(DISTINCT channel) AS src FROM m GROUP BY 1)"""


@query(over(f""", {CARDS} SELECT demand_id, title, track, canonical_key, intensity, final_score, mention_count, CASE WHEN demand_id % 17 = 0 THEN 'write to [EMAIL_1]' ELSE 'plain words' END AS summary,
 CASE WHEN demand_id % 19 = 0 THEN 'call [PHONE_1] now' ELSE 'a quote' END AS snippet, array_to_string(list_sort(origins), ',') AS origins, array_to_string(list_sort(src), ',') AS source_set, CAST(len(src) AS INTEGER) AS independent_source_count FROM s JOIN x USING (demand_id)""").replace("s3) ,", "s3),"))
def prj_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands as cards; their evidence is a mention of each origin and channel, reduced before it is listed."""
    k = F.col("demand_id")
    quote = F.when(k % 19 == 0, "call +1 415 867 5309 now").otherwise("a quote")
    unit = F.struct("channel", F.lit("").alias("source"), F.col("origin").alias("origin_type"), F.lit("").alias("redacted_snippet"), quote.alias("quote"))
    evidence = mentions(spark, sf_dir).select("demand_id", "channel", "origin").distinct().groupBy("demand_id").agg(F.sort_array(F.collect_list(unit)).alias("evidence"))
    none = F.lit("")
    cards = _cards(spark, sf_dir).drop("evidence").join(evidence, "demand_id").withColumns({"inferred_job": none, "why": none, "recommendation": none, "action": none})
    done = ranking.build_cards(cards)
    return done.select(
        "demand_id", "title", "track", "canonical_key", "intensity", "final_score", "mention_count", "summary", F.col("evidence")[0]["redacted_snippet"].alias("snippet"), F.array_join("origins", ",").alias("origins"),
        F.array_join("source_set", ",").alias("source_set"), "independent_source_count",
    )
