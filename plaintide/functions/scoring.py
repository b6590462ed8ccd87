"""The three axes and what is made of them, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.config import IMPACT, SCORING, SEGMENT, URGENCY


def lookup(key: Column, table: dict, default: object) -> Column:
    """``table[key]``, else the default: a branch per entry, which stays in generated code."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float, high: float | None = None) -> Column:
    out = F.greatest(x, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def impact(label: Column) -> Column:
    return lookup(F.lower(label), IMPACT, 1.0)


def confidence(explicit: Column, sources: Column, internal_mentions: Column) -> Column:
    """Ladder of evidence; the order of its rungs matters."""
    return (
        F.when(explicit & (sources >= 2), 1.0).when(internal_mentions >= 3, 0.8).when(sources >= 2, 0.8).when(sources >= 1, 0.5).otherwise(0.3)
    )


def rice(reach: Column, impact_value: Column, confidence_value: Column, effort: Column) -> Column:
    """Unknown effort (null) counts as the neutral one; 0 is an effort and is raised to the floor."""
    over = F.greatest(F.coalesce(effort.cast("double"), F.lit(SCORING["effort_unknown"])), F.lit(SCORING["effort_min"]))
    return F.round(clamp(reach.cast("double"), 0.0) * clamp(impact_value, 0.0) * clamp(confidence_value, 0.0) / over, 6)


def opportunity(importance: Column, satisfaction: Column) -> Column:
    i, s = clamp(importance.cast("double"), 0.0, 10.0), clamp(satisfaction.cast("double"), 0.0, 10.0)
    return F.round(i + F.greatest(i - s, F.lit(0.0)), 4)


def time_criticality(given: Column, competitor: Column) -> Column:
    """At least 13 once a competitor shipped it."""
    shipped = F.contains(F.lower(F.coalesce(competitor, F.lit(""))), F.lit("shipped"))
    return F.when(shipped, F.greatest(given.cast("double"), F.lit(13.0))).otherwise(given.cast("double"))


def wsjf(value: Column, criticality: Column, risk: Column, job_size: Column) -> Column:
    """A job size of 0 or null counts as 1."""
    size = F.when(job_size.isNull() | (job_size == 0), 1.0).otherwise(job_size.cast("double"))
    return F.round((value.cast("double") + criticality.cast("double") + risk.cast("double")) / F.greatest(size, F.lit(1.0)), 4)


def final_score(rice_raw: Column) -> Column:
    return F.round(F.lit(100.0) * rice_raw / (rice_raw + F.lit(SCORING["half_score"])), 4)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 75, "B+").when(score >= 65, "B").when(score >= 55, "C+").when(score >= 45, "C").otherwise("D")


def tier(opp: Column, urgency: Column, kano: Column, missing: Column) -> Column:
    """Need kind first, then the two-by-two of demand and urgency."""
    k = F.lower(F.coalesce(kano, F.lit("")))
    high, soon = opp >= SCORING["opportunity_high"], urgency >= SCORING["wsjf_high"]
    return (
        F.when(k.isin("indifferent", "reverse"), "cut")
        .when((k == "must_be") & missing, "tier0")
        .when(high & soon, "tier1")
        .when(high | soon, "tier2")
        .otherwise("backlog")
    )


def tier_reason(opp: Column, urgency: Column, kano: Column, missing: Column) -> Column:
    k = F.lower(F.coalesce(kano, F.lit("")))
    high, soon = opp >= SCORING["opportunity_high"], urgency >= SCORING["wsjf_high"]
    return (
        F.when(k.isin("indifferent", "reverse"), F.concat(F.lit("need kind "), k))
        .when((k == "must_be") & missing, "must-be missing")
        .when(high & soon, "high demand, high urgency")
        .when(high, "high demand, low urgency")
        .when(soon, "low demand, high urgency")
        .otherwise("low demand, low urgency")
    )


def need_weight(urgency: Column, segment: Column) -> Column:
    """Urgency and segment points of one mention; unknown labels count least."""
    return lookup(urgency, URGENCY, 1) + lookup(segment, SEGMENT, 1)


def is_cut(tier_value: Column, kano: Column) -> Column:
    return (F.coalesce(tier_value, F.lit("")) == "cut") | F.lower(F.coalesce(kano, F.lit(""))).isin("indifferent", "reverse")


def priority(tier_value: Column, score: Column) -> Column:
    """1 for tier0, else 1 to 9 by score, halves to even."""
    return F.when(tier_value == "tier0", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(9), F.lit(10) - F.bround(score / 11.2).cast("int")))).cast("int")
