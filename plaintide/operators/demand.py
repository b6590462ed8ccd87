"""From mentions to scored demands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions import scoring, text


#: Mentions of one demand that may meet in one task.
FREQUENT = 1 << 16
#: What :func:`gathered` says of a demand, for each side.
GATHERED = ("mention_count", "internal_mentions", "external_mentions", "explicit", "last_seen", "source_set", "people")


def author_weight(mentions: DataFrame) -> DataFrame:
    """Each author once per demand, with the largest weight: map-side maxima, one shuffle."""
    return mentions.where(F.col("author").isNotNull()).groupBy("demand_id", "author").agg(F.max(scoring.need_weight(F.col("urgency"), F.col("segment"))).alias("weight"))


def intensity(mentions: DataFrame) -> DataFrame:
    """Sum of the authors' weights plus their number; repeating a mention does not raise it."""
    per = author_weight(mentions).groupBy("demand_id")
    return per.agg(F.round((F.sum("weight") + F.count(F.lit(1))).cast("double"), 4).alias("intensity"), F.count(F.lit(1)).alias("distinct_authors"))


def evidence(mentions: DataFrame) -> DataFrame:
    """Mentions, sources and origins of each demand."""
    internal = F.col("origin") == "internal"
    return mentions.groupBy("demand_id").agg(
        F.count(F.lit(1)).alias("mention_count"),
        F.count_distinct(F.when(F.col("channel") != "", F.col("channel"))).alias("sources"),
        F.count_if(internal).alias("internal_mentions"),
        F.count_if(~internal).alias("external_mentions"),
        F.bool_or(internal & (F.col("flag") == "R")).alias("explicit"),
        F.max("ts").alias("last_seen"),
    )


def gathered(mentions: DataFrame, tasks: int, **sides: Column) -> DataFrame:
    """A row for each demand with :data:`GATHERED` of each of ``sides``, conditions on mentions, as ``<side>_<name>``; ``people`` is a list (author, weight), each author once.

    Mentions are sent once, to ``tasks`` by demand, and all is reduced where they arrive: no demand may have more than :data:`FREQUENT`.
    """
    c, internal = F.col, F.col("origin") == "internal"
    rows = mentions.select("demand_id", "author", "channel", scoring.need_weight(c("urgency"), c("segment")).alias("weight"), internal.alias("internal"), (internal & (c("flag") == "R")).alias("explicit"), "ts", *[x.alias(s) for s, x in sides.items()])
    of = lambda s, x: F.when(c(s), x)
    each = rows.repartition(tasks, "demand_id").groupBy("demand_id", "author", "channel").agg(*[
        x.alias(f"{s}_{name}") for s in sides for name, x in (
            ("n", F.count_if(c(s))), ("in", F.count_if(c(s) & c("internal"))), ("out", F.count_if(c(s) & ~c("internal"))), ("explicit", F.bool_or(of(s, c("explicit")))), ("last", F.max(of(s, c("ts")))), ("weight", F.max(of(s, c("weight")))),
        )
    ])
    there = lambda s, x: F.when(c(f"{s}_n") > 0, x)
    listed = each.groupBy("demand_id").agg(*[
        x.alias(f"{s}_{name}") for s in sides for name, x in zip(GATHERED, (
            F.sum(f"{s}_n"), F.sum(f"{s}_in"), F.sum(f"{s}_out"), F.bool_or(f"{s}_explicit"), F.max(f"{s}_last"), F.collect_set(there(s, c("channel"))), F.collect_list(F.when((c(f"{s}_n") > 0) & c("author").isNotNull(), F.struct("author", c(f"{s}_weight").alias("weight")))),
        ), strict=True)
    ])
    return listed.withColumns({f"{s}_source_set": F.array_sort(f"{s}_source_set") for s in sides} | {f"{s}_people": heaviest(c(f"{s}_people"), "author") for s in sides})


def heaviest(people: Column, name: str) -> Column:
    """A list of (``name``, weight) with each name once, in the order of names, and its largest weight."""
    return text.once(F.sort_array(people), lambda p: F.filter(p, lambda x, i: ~F.coalesce(x[name].eqNullSafe(F.get(p, i + 1)[name]) & (i + 1 < F.size(p)), F.lit(False))))


def side(found: DataFrame, name: str) -> DataFrame:
    """One side of :func:`gathered`, as :func:`evidence` and :func:`intensity` give it, with source_set and people; demands without authors there are none."""
    c, people = F.col, F.col("people")
    others = [x for x in found.columns if not any(x.endswith(f"_{y}") for y in GATHERED)]
    rows = found.where(F.size(f"{name}_people") > 0).select(*others, *[c(f"{name}_{x}").alias(x) for x in GATHERED])
    weight = F.aggregate(people, F.lit(0).cast("long"), lambda out, x: out + x["weight"])
    return rows.withColumns(
        {"sources": F.size(F.filter("source_set", lambda x: x != "")).cast("long"), "intensity": F.round((weight + F.size(people)).cast("double"), 4), "distinct_authors": F.size(people).cast("long")}
    )


def score(proposals: DataFrame, mentions: DataFrame) -> DataFrame:
    """Scored demands: RICE, opportunity, WSJF, final score, grade and tier beside their inputs."""
    return rated(proposals.join(evidence(mentions), "demand_id").join(intensity(mentions), "demand_id"))


def rated(joined: DataFrame) -> DataFrame:
    """:func:`score` of proposals that have their evidence and intensity beside them."""
    c = F.col
    return (
        joined.withColumn("reach", c("distinct_authors").cast("double"))
        .withColumn("impact", scoring.impact(c("impact_label")))
        .withColumn("confidence", scoring.confidence(c("explicit"), c("sources"), c("internal_mentions")))
        .withColumn("rice_raw", scoring.rice(c("reach"), c("impact"), c("confidence"), c("effort_weeks")))
        .withColumn("opportunity", scoring.opportunity(c("importance"), c("satisfaction")))
        .withColumn("wsjf", scoring.wsjf(c("ubv"), scoring.time_criticality(c("tc"), c("competitor_status")), c("rr"), c("job_size")))
        .withColumn("final_score", scoring.final_score(c("rice_raw")))
        .withColumn("grade", scoring.grade(c("final_score")))
        .withColumn("tier", scoring.tier(c("opportunity"), c("wsjf"), c("kano"), c("kano_missing")))
        .withColumn("reason", scoring.tier_reason(c("opportunity"), c("wsjf"), c("kano"), c("kano_missing")))
        .withColumn("canonical_key", text.canonical_key(text.entities(c("title")), c("track")))
    )


#: The same in SQL, over CTEs m (mentions) and p (proposals); the key's entities are the title's words.
SCORED = """a AS (SELECT demand_id, author, max(CASE urgency WHEN 'blocking' THEN 3 WHEN 'need' THEN 2 ELSE 1 END
    + CASE segment WHEN 'enterprise' THEN 4 WHEN 'team' THEN 3 WHEN 'pro' THEN 2 ELSE 1 END) AS weight FROM m GROUP BY 1, 2),
i AS (SELECT demand_id, round(CAST(sum(weight) + count(*) AS DOUBLE), 4) AS intensity, count(*) AS distinct_authors FROM a GROUP BY 1),
e AS (SELECT demand_id, count(*) AS mention_count, count(DISTINCT channel) AS sources, count(*) FILTER (WHERE origin = 'internal') AS internal_mentions,
    count(*) FILTER (WHERE origin <> 'internal') AS external_mentions, bool_or(origin = 'internal' AND flag = 'R') AS explicit, max(ts) AS last_seen FROM m GROUP BY 1),
s1 AS (SELECT p.*, e.mention_count, e.sources, e.internal_mentions, e.external_mentions, e.explicit, e.last_seen, i.intensity, i.distinct_authors,
    CAST(i.distinct_authors AS DOUBLE) AS reach,
    CASE impact_label WHEN 'massive' THEN 3e0 WHEN 'high' THEN 2e0 WHEN 'medium' THEN 1e0 WHEN 'low' THEN 0.5e0 WHEN 'minimal' THEN 0.25e0 ELSE 1e0 END AS impact,
    CASE WHEN explicit AND sources >= 2 THEN 1e0 WHEN internal_mentions >= 3 THEN 0.8e0 WHEN sources >= 2 THEN 0.8e0 WHEN sources >= 1 THEN 0.5e0 ELSE 0.3e0 END AS confidence
  FROM p JOIN e USING (demand_id) JOIN i USING (demand_id)),
s2 AS (SELECT *, round(reach * impact * confidence / greatest(coalesce(effort_weeks, 2e0), 0.5e0), 6) AS rice_raw,
    round(least(greatest(importance, 0e0), 10e0) + greatest(least(greatest(importance, 0e0), 10e0) - least(greatest(satisfaction, 0e0), 10e0), 0e0), 4) AS opportunity,
    round((ubv + CASE WHEN lower(competitor_status) LIKE '%shipped%' THEN greatest(tc, 13e0) ELSE tc END + rr) / greatest(CASE WHEN job_size = 0 THEN 1e0 ELSE job_size END, 1e0), 4) AS wsjf FROM s1),
s3 AS (SELECT *, round(100e0 * rice_raw / (rice_raw + 6e0), 4) AS final_score,
    CASE WHEN kano IN ('indifferent', 'reverse') THEN 'cut' WHEN kano = 'must_be' AND kano_missing THEN 'tier0' WHEN opportunity >= 10e0 AND wsjf >= 3e0 THEN 'tier1'
      WHEN opportunity >= 10e0 OR wsjf >= 3e0 THEN 'tier2' ELSE 'backlog' END AS tier,
    CASE WHEN kano IN ('indifferent', 'reverse') THEN concat('need kind ', kano) WHEN kano = 'must_be' AND kano_missing THEN 'must-be missing'
      WHEN opportunity >= 10e0 AND wsjf >= 3e0 THEN 'high demand, high urgency' WHEN opportunity >= 10e0 THEN 'high demand, low urgency'
      WHEN wsjf >= 3e0 THEN 'low demand, high urgency' ELSE 'low demand, low urgency' END AS reason,
    concat(array_to_string(list_sort(list_distinct(string_split(title, ' '))), '|'), '::', track) AS canonical_key FROM s2),
s AS (SELECT *, CASE WHEN final_score >= 85 THEN 'A' WHEN final_score >= 75 THEN 'B+' WHEN final_score >= 65 THEN 'B' WHEN final_score >= 55 THEN 'C+'
    WHEN final_score >= 45 THEN 'C' ELSE 'D' END AS grade FROM s3)"""
