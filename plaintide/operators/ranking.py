"""Gate, order, cut and render scored demands.

A total order over all rows is asked for, so ranks are made in two steps: positions inside range
partitions, plus the sizes of the partitions before. No task sees more than one range.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.config import HORIZON, SCORING, TIER_RANK
from plaintide.functions import scoring, text
from plaintide.operators import pool, records
from plaintide.storage import cut, shuffle_partitions


def tier_rank(tier: Column) -> Column:
    return scoring.lookup(F.coalesce(tier, F.lit("backlog")), TIER_RANK, 5)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name`` from 1 in ``order``: range partitions, ranks inside them, and offsets from their sizes.

    Range bounds are sampled, so two evaluations of one plan need not agree on them. The rows are therefore written once with their
    range and their place in it, and both the sizes and the result come from that table. The sizes, one row per
    range, are the only thing that is gathered and broadcast.
    """
    rows = cut(df, "unranked")  # the sampling reads a table, not the plan behind it
    ranged = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    local = cut(ranged.withColumn("_local", F.row_number().over(W.partitionBy("_part").orderBy(*order))), "ranked")
    sizes = local.groupBy("_part").agg(F.max("_local").alias("_size"))
    before = F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    joined = local.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_of", "_before")


def queue_order() -> list[Column]:
    return [tier_rank(F.col("tier")).asc(), F.col("final_score").desc(), F.col("canonical_key").asc(), F.col("demand_id").asc()]


def iteration_queue(cards: DataFrame) -> DataFrame:
    """Demands that are not cut, in order of tier, score, key; ``position`` from 1."""
    kept = cards.where(~scoring.is_cut(F.col("tier"), F.col("kano")))
    ranked = global_rank(kept, queue_order(), "position")
    return ranked.withColumn("horizon", scoring.lookup(F.col("tier"), HORIZON, "backlog"))


def split_pools(cards: DataFrame) -> DataFrame:
    """``pool`` of each demand that is not cut: quick_win, big_bet or other."""
    k = F.lower(F.coalesce(F.col("kano"), F.lit("")))
    effort = F.coalesce(F.col("effort_weeks"), F.lit(SCORING["effort_unknown"]))
    effort = F.greatest(effort, F.lit(SCORING["effort_min"]))
    quick = (F.col("opportunity") >= SCORING["opportunity_high"]) & (effort <= SCORING["quick_win_effort"]) & k.isin("must_be", "performance", "")
    big = (k == "delighter") | ((F.col("impact") >= 2.0) & (F.col("confidence") <= 0.5))
    return cards.where(~scoring.is_cut(F.col("tier"), F.col("kano"))).withColumn("pool", F.when(quick, "quick_win").when(big, "big_bet").otherwise("other"))


def errors(cards: DataFrame) -> DataFrame:
    """``errs``: what keeps a card from passing; empty if it may pass. Texts that would be shown, and evidence, must have no personal data."""
    c = F.col
    checks = [
        (F.coalesce(c("canonical_key"), F.lit("")) == "", "no key"),
        (F.coalesce(c("track"), F.lit("")) == "", "no track"),
        (c("rice_raw").isNull(), "no rice"),
        (c("opportunity").isNull(), "no opportunity"),
        (c("wsjf").isNull(), "no urgency"),
        (~F.coalesce(c("final_score").between(0, 100), F.lit(False)), "score out of range"),
        (~F.coalesce(c("tier").isin(*TIER_RANK), F.lit(False)), "unknown tier"),
        (F.coalesce(c("internal_mentions"), F.lit(0)) < 1, "no internal evidence"),
        ((F.coalesce(c("final_score"), F.lit(0.0)) >= SCORING["push"]) & (F.coalesce(c("sources"), F.lit(0)) < SCORING["min_sources"]), "one source"),
    ]
    told = cards.withColumn("errs", F.array_compact(F.array(*[F.when(bad, why) for bad, why in checks])))
    fields = [f for f in records.CARD_TEXTS if f in cards.columns]
    evidence = "evidence" if "evidence" in cards.columns else None
    if not fields:
        return told
    names = F.filter("leaked", lambda x: ~x.startswith("evidence["))
    shown = F.filter("leaked", lambda x: x.startswith("evidence["))
    personal = [F.when(F.size(x) > 0, F.concat(F.lit("personal data in "), F.array_join(x, " "))) for x in (names, shown)]
    return records.leaks(told, fields, evidence).withColumn("errs", F.concat("errs", F.array_compact(F.array(*personal)))).drop("leaked")


def gate(cards: DataFrame) -> DataFrame:
    """Flags passed, pushable, archivable, digest_only. Tier0 comes first in input order, then scores over the push floor."""
    checked = cut(errors(cards).withColumn("passed", F.size("errs") == 0), "checked")  # read twice: the cards are made, and their texts judged, once
    first = F.col("tier") == "tier0"
    eligible = F.col("passed") & (first | (F.col("final_score") >= SCORING["push"]))
    order = [F.when(first, 0).otherwise(1), F.when(first, F.col("demand_id")), F.desc("final_score"), F.col("demand_id")]
    top = checked.where(eligible).orderBy(*order).limit(SCORING["push_cap"]).select(F.col("demand_id").alias("_top"))
    marked = checked.join(F.broadcast(top), F.col("demand_id") == F.col("_top"), "left")
    archivable = F.col("passed") & (first | (F.col("final_score") >= SCORING["archive"]))
    return marked.withColumn("pushable", F.col("_top").isNotNull()).withColumn("archivable", archivable).withColumn("digest_only", archivable & F.col("_top").isNull()).drop("_top")


def headlines(cards: DataFrame, cap: int = 5) -> DataFrame:
    """The first ``cap`` demands of the queue as one line each: a top-k, never a full sort."""
    kept = cards.where(~scoring.is_cut(F.col("tier"), F.col("kano")))
    top = kept.orderBy(*queue_order()).limit(max(1, cap))
    ranked = top.withColumn("position", F.row_number().over(W.orderBy(*queue_order())))
    tag = F.concat_ws(" / ", scoring.lookup(F.col("tier"), HORIZON, "backlog"), F.lower("kano"))
    line = F.concat(F.col("position").cast("string"), F.lit(". ["), tag, F.lit("] "), text.inline(F.col("title")), F.lit(" | "), F.col("grade"))
    return ranked.select("position", "demand_id", line.alias("line"))


# Labels of the daily message.
HORIZON_LABEL = {"tier0": "立即", "tier1": "本周", "tier2": "本月", "backlog": "储备"}
KANO_LABEL = {"must_be": "刚需", "performance": "期望", "delighter": "惊喜"}
PROSE = 280


def message(cards: DataFrame, date: str, candidates: int, cap: int = 5) -> DataFrame:
    """One row with the day's message: a head with counts, the first ``cap`` demands with why and what to do, and how many more there are.

    Cards have title, inferred_job, why, recommendation, grade, final_score, rice_raw, evidence besides the queue's columns. Only the first
    ``cap`` rows are gathered; an empty day says so.
    """
    c = F.col
    given = lambda x: F.when(x != "", x)
    flat = lambda x: text.inline(F.coalesce(c(x), F.lit("")))
    cut_ = scoring.is_cut(c("tier"), c("kano"))
    cards = cut(cards.select("demand_id", "canonical_key", "title", "inferred_job", "why", "recommendation", "grade", "final_score", "rice_raw", "tier", "kano", "evidence"), "cards")  # read twice
    counts = cards.agg(F.count_if(~cut_).alias("good"), F.count_if(cut_).alias("noise"))
    top = cards.where(~cut_).orderBy(*queue_order()).limit(max(1, cap)).withColumn("position", F.row_number().over(W.orderBy(*queue_order())))
    kano = scoring.lookup(F.lower(F.coalesce(c("kano"), F.lit(""))), KANO_LABEL, "")
    horizon = scoring.lookup(F.coalesce(c("tier"), F.lit("backlog")), HORIZON_LABEL, "储备")
    tag = F.when(kano != "", F.concat(horizon, F.lit("·"), kano)).otherwise(horizon)
    why, rec = flat("why"), flat("recommendation")
    stop = F.when(F.right(why, F.lit(1)).isin(*"。！？.!?；;，, "), "").otherwise("。")
    advice = F.concat(F.lit("建议："), rec)
    prose = text.truncate(F.when((why != "") & (rec != ""), F.concat(why, stop, advice)).when(why != "", why).when(rec != "", advice).otherwise(flat("inferred_job")), PROSE)
    title = F.coalesce(given(flat("title")), given(flat("inferred_job")), F.lit("?"))
    shown = lambda x: F.coalesce(c(x).cast("string"), F.lit("?"))
    meta = F.concat(shown("grade"), F.lit(" "), shown("final_score"), F.lit(" · RICE="), shown("rice_raw"), F.lit(" · "), F.size(F.coalesce("evidence", F.array())).cast("string"), F.lit("证据"))
    item = F.concat(F.lit("**"), c("position").cast("string"), F.lit(".【"), tag, F.lit("】"), title, F.lit("**\n"), F.when(prose != "", F.concat(prose, F.lit("\n"))).otherwise(""), meta, F.lit("\n"))
    body = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"]), "\n").alias("body"), F.count(F.lit(1)).alias("top"))
    extra = c("good") - c("top")
    head = F.concat(F.lit(f"📊 **需求头条** · {date}\n合格 "), c("good").cast("string"), F.lit(" · 精选 "), c("top").cast("string"), F.lit(" · 剔噪 "), c("noise").cast("string"), F.lit(f" · 候选 {candidates}"))
    foot = F.when(extra > 0, F.concat(F.lit("另有 "), extra.cast("string"), F.lit(" 条合格需求；完整卡片见当日私有归档。"))).otherwise("完整卡片见当日私有归档。")
    whole = F.when(c("good") == 0, F.concat(head, F.lit("\n\n今日无合格新需求（诚实空日，非灌水；完整记录见私有归档）。"))).otherwise(F.concat(head, F.lit("\n\n"), "body", F.lit("\n"), foot))
    return counts.join(F.broadcast(body)).select(whole.alias("message"))


def build_cards(cards: DataFrame) -> DataFrame:
    """Redacted cards with ``origins`` (origin:channel, sorted), ``source_set`` and ``independent_source_count`` from their evidence.

    Evidence has channel, source, origin_type, redacted_snippet and quote.
    """
    given = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    place = lambda e: F.coalesce(given(e["channel"]), given(e["source"]), F.lit(""))
    done = records.redact_texts(cards)
    shown = F.coalesce("evidence", F.array())
    origins = F.array_sort(F.array_distinct(F.transform(shown, lambda e: F.concat(F.coalesce(given(e["origin_type"]), F.lit("internal")), F.lit(":"), place(e)))))
    sources = F.array_sort(F.array_distinct(F.filter(F.transform(shown, lambda e: F.coalesce(given(e["source"]), given(e["channel"]))), lambda x: x.isNotNull())))
    isc = F.size(F.array_distinct(F.filter(F.transform(shown, place), lambda x: x != "")))
    return done.withColumns({"origins": origins, "source_set": sources, "independent_source_count": isc})


def digest_lines(cards: DataFrame, date: str) -> DataFrame:
    """The day's digest as numbered lines (n, line): a head with coverage that adds up, and three lines for each demand of the queue in order, or an honest empty day.

    A demand shows its place, tier and pool; the parts of its RICE, its WSJF and opportunity; its evidence by origin. Lines are made where the ranked rows are, by their place:
    no list of the queue is gathered, and :meth:`write.text` after ``orderBy("n")`` gives the file's parts in order.
    """
    c, shown = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit("?"))
    cut_ = scoring.is_cut(c("tier"), c("kano"))
    counts = cards.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cut_).alias("cut"), F.coalesce(F.sum("internal_mentions"), F.lit(0)).alias("internal"), F.coalesce(F.sum("external_mentions"), F.lit(0)).alias("external")
    )
    text_of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    told = [
        F.lit(f"# Demand digest {date}"), F.lit(""), text_of("> candidates ", c("n"), ", actionable ", c("n") - c("cut"), ", noise ", c("cut")), text_of("> evidence internal ", c("internal"), ", external ", c("external")),
        F.when(c("n") == c("cut"), F.lit("**No demand cleared the floor today.**")).otherwise(F.lit("")),
    ]
    head = counts.select(F.posexplode(F.array(*told)).alias("n", "line")).select(c("n").cast("long").alias("n"), "line")
    queue = split_pools(iteration_queue(cards))
    body = [
        text_of(c("position"), ". [", c("tier"), "/", c("horizon"), "/", c("pool"), "] ", text.inline(c("title")), ", final ", shown("final_score"), " (", shown("grade"), ")"),
        text_of("   RICE ", shown("rice_raw"), " = reach ", shown("reach"), ", impact ", shown("impact"), ", confidence ", shown("confidence"), "; WSJF ", shown("wsjf"), "; opportunity ", shown("opportunity")),
        text_of("   evidence ", c("internal_mentions"), " internal, ", c("external_mentions"), " external, ", c("distinct_authors"), " authors"),
    ]
    lines = queue.select("position", F.posexplode(F.array(*body)).alias("k", "line"))
    return head.unionByName(lines.select((F.lit(len(told)) + 3 * (c("position") - 1) + c("k")).cast("long").alias("n"), "line"))


def digest_file(markdown: str, folder: str, date: str) -> str:
    """Write a day's digest to ``digests/YYYY/YYYY-MM-DD.md`` below ``folder``; a second run of the day replaces it."""
    path = Path(folder) / "digests" / date[:4] / f"{date}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(markdown, encoding="utf-8", newline="\n")
    return str(path)


def digest_items(items: DataFrame, days: DataFrame) -> DataFrame:
    """``items`` (key, title, date, summary) with one for each of ``days`` (date, summary), keyed by its day: a day that is told again replaces its item."""
    new = days.groupBy("date").agg(F.max_by("summary", "summary").alias("summary"))
    key = F.concat(F.lit("demand:digest:"), "date")
    rows = new.select(key.alias("key"), F.concat(F.lit("demand digest "), "date").alias("title"), "date", F.left("summary", F.lit(200)).alias("summary"))
    return pool.upsert(items.select(*rows.columns), rows, "key")


def summary(rows: DataFrame, day: Column, top: int = 15, limit: int = 3900) -> DataFrame:
    """One row with the day's text: what was touched, the backlog, the best of today and of all. Only ``2 * top`` rows are gathered."""
    seen = rows.withColumn("touched", (F.to_date("last_seen") == day) | (F.to_date("first_seen") == day))
    seen = cut(seen.select("demand_id", "title", "grade", "final_score", "reach", "status", "touched"), "seen")  # read three times
    counts = seen.agg(F.count_if("touched").alias("touched"), F.count(F.lit(1)).alias("backlog"))
    order = [F.desc("final_score"), F.col("demand_id")]
    head = F.concat(F.lit('"'), F.left("title", F.lit(70)), F.lit('" ('), "grade", F.lit(" "), F.col("final_score").cast("string"), F.lit(", reach "), F.col("reach").cast("long").cast("string"))
    text_of = lambda df, line, name: df.orderBy(*order).limit(top).withColumn("n", F.row_number().over(W.orderBy(*order))).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias(name))
    today = text_of(seen.where("touched"), F.concat(F.lit("- "), head, F.lit(")")), "today")
    best = text_of(seen, F.concat(F.col("n").cast("string"), F.lit(". "), head, F.lit(", "), "status", F.lit(")")), "best")
    whole = F.concat(
        F.lit("Daily demand summary, "), day.cast("string"), F.lit("\nTouched today: "), F.col("touched").cast("string"), F.lit(" | Total backlog: "), F.col("backlog").cast("string"), F.lit("\n"),
        F.when(F.col("touched") > 0, F.concat(F.lit("\nToday\n"), "today", F.lit("\n"))).otherwise(""), F.lit("\nAll-time top "), F.least(F.lit(top), "backlog").cast("string"), F.lit("\n"), "best",
    )
    return counts.join(F.broadcast(today)).join(F.broadcast(best)).select("touched", "backlog", F.left(whole, F.lit(limit)).alias("message"))
