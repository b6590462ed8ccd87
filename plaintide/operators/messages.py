"""Messages: human ones, context, proposals, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.config import DEMAND_INTENTS, INTENTS
from plaintide.functions import redaction, text
from plaintide.operators import ranking
from plaintide.storage import cut

FORCES = ("push", "pull", "anxiety", "habit")


def human(messages: DataFrame) -> DataFrame:
    """Without bots, webhooks and empty texts."""
    return messages.where(~F.col("bot") & F.col("webhook_id").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def recent(messages: DataFrame, now: Column, hours: float, cap: int = 60000) -> DataFrame:
    """Messages of the last ``hours``, the newest ``cap`` of each channel; the time filter reaches the scan."""
    window = messages.where(F.col("ts") >= now - F.make_interval(secs=F.lit(hours * 3600.0)))
    return window.withColumn("_n", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("ts"), F.desc("message_id")))).where(F.col("_n") <= cap).drop("_n")


def channel_stats(messages: DataFrame) -> DataFrame:
    ok = ~F.col("bot") & F.col("webhook_id").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return messages.groupBy("channel").agg(F.count(F.lit(1)).alias("raw"), F.count_if(ok).alias("human_text"))


def normal_intents(labels: Column) -> Column:
    """Known labels in normal form, each once, in order; chitchat if none is left."""
    clean = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.regexp_replace(text.slug(x), "[- ]", "_"))
    known = F.array_distinct(F.filter(clean, lambda x: x.isin(*INTENTS)))
    return F.when(F.size(known) == 0, F.array(F.lit("chitchat"))).otherwise(known)


def is_demand(intents: Column) -> Column:
    return F.arrays_overlap(intents, F.array(*map(F.lit, DEMAND_INTENTS)))


def forces(jtbd: Column) -> dict[str, Column]:
    """Forces present in fixed order; a demand needs push or pull, anxiety and habit are implicit."""
    there = {f: F.trim(F.coalesce(jtbd[f], F.lit(""))) != "" for f in FORCES}
    return {
        "present": F.array_compact(F.array(*[F.when(there[f], F.lit(f)) for f in FORCES])),
        "demand_force": there["push"] | there["pull"],
        "implicit_force": there["anxiety"] | there["habit"],
    }


def units(rows: DataFrame) -> DataFrame:
    """Validate proposals (intents, quote, source, track, inferred_job, aspect): ``reject`` is null for units that stand."""
    intents = normal_intents(F.col("intents"))
    job = F.coalesce(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col(c)) for c in ("inferred_job", "aspect", "quote")])
    reject = F.when(~is_demand(intents), "not a demand").when(~text.grounded(F.col("quote"), F.col("source")), "not grounded")
    track = F.when(F.col("track").isin("explicit", "implicit"), F.col("track")).otherwise("explicit")
    return (
        rows.withColumn("intents", intents).withColumn("reject", reject).withColumn("track", track).withColumn("job", job)
        .withColumn("entities", text.entities(F.concat_ws(" ", F.col("job"), F.coalesce("aspect", F.lit("")))))
    )


def context(messages: DataFrame, salt: str | None = None, size: int = 6, cap: int = 1500, block: int = 1024) -> DataFrame:
    """What surrounds each message (thread, seq, title, author, bot, text, reply_to): ``context``, empty if there is nothing.

    Lines, in this order: the thread's title, its first message (not for that message itself), the message replied to, and the human ones among the ``size`` before it.
    Every piece is redacted whole and cut afterwards; authors are the first 8 characters of their pseudonym. ``(thread, seq)`` is a message; blank pieces and
    answers to messages that are not there are left out, a bot is called "the bot".

    Messages are cut into blocks of ``block`` places in the order of threads, each with the ``size`` places before it, so no task sees a whole long thread. What messages
    refer to is asked for once a block.
    """
    said = F.coalesce(redaction.redact(F.col("text"))["redacted"], F.lit(""))
    slim = messages.select("thread", "seq", "title", "reply_to", F.coalesce("bot", F.lit(False)).alias("bot"), F.left(redaction.pseudonym(F.col("author"), salt), F.lit(8)).alias("who"), F.left(said, F.lit(400)).alias("said"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    placed = cut(ranking.global_rank(slim, [F.col("thread"), F.col("seq")], "place").withColumn("block", F.floor(F.col("place") / block)), "placed")

    # the last places of a block are context of the next one too
    near = placed.withColumn("block", F.explode(F.sequence("block", F.floor((F.col("place") + size) / block))))
    line = F.when(~F.col("bot") & ~F.col("blank"), F.concat_ws(": ", "who", F.left("said", F.lit(160))))
    before = F.collect_list(F.struct("thread", line.alias("line"))).over(W.partitionBy("block").orderBy("place").rowsBetween(-size, -1))
    recent = F.array_compact(F.transform(F.filter(before, lambda m: m["thread"].eqNullSafe(F.col("thread"))), lambda m: m["line"]))
    rows = near.withColumn("recent", recent).where(F.col("block") == F.floor(F.col("place") / block))

    # first messages and answered ones, asked for once by each block
    threads = placed.groupBy("thread").agg(F.min("seq").alias("seq"))
    first = placed.select("block", "thread").distinct().join(threads, "thread").select("block", "thread", "seq")
    asked = first.union(placed.where("reply_to is not null").select("block", "thread", F.col("reply_to").alias("seq"))).distinct()
    told = placed.where(~F.col("blank")).select("thread", "seq", F.struct("seq", "said", F.when(F.col("bot"), "the bot").otherwise(F.col("who")).alias("who")).alias("told"))
    found = cut(asked.join(told, ["thread", "seq"]), "referred")
    opener = first.join(found, ["block", "thread", "seq"]).select("block", "thread", F.col("told").alias("opener"))
    answered = found.select("block", "thread", F.col("seq").alias("reply_to"), F.col("told").alias("answered"))
    rows = rows.join(opener, ["block", "thread"], "left").join(answered, ["block", "thread", "reply_to"], "left")

    parts = F.array(
        F.when(F.trim("title") != "", F.concat(F.lit("[thread title] "), F.left(redaction.redact(F.col("title"))["redacted"], F.lit(150)))),
        F.when(F.col("opener.seq") != F.col("seq"), F.concat(F.lit("[opening post] "), F.col("opener.said"))),
        F.concat(F.lit("[replying to "), F.col("answered.who"), F.lit("] "), F.left("answered.said", F.lit(300))),
        F.when(F.size("recent") > 0, F.concat(F.lit("[recent] "), F.array_join("recent", " | "))),
    )
    return rows.select("thread", "seq", F.left(F.array_join(F.array_compact(parts), "\n"), F.lit(cap)).alias("context"))


def session_edges(messages: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """Links a > b of messages (id, channel, author, ts, reply_to) of one session: a reply and what it answers, and an author's message and their one before, less than the gap ago."""
    replies = messages.where("reply_to is not null and reply_to <> id").select(F.greatest("id", "reply_to").alias("a"), F.least("id", "reply_to").alias("b"))
    w = W.partitionBy("channel", "author").orderBy("ts", "id")
    last = messages.select("id", "ts", F.lag("id").over(w).alias("before"), F.lag("ts").over(w).alias("then"))
    near = last.where(F.unix_micros("ts") - F.unix_micros("then") < gap_seconds * 1_000_000).select(F.greatest("id", "before").alias("a"), F.least("id", "before").alias("b"))
    # an answer to a message that is not there begins a session of its own
    return replies.join(messages.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b").union(near).distinct()


def sessions(messages: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """``session`` of each message, its smallest id: what is connected by replies and by bursts of one author, however long the chain.

    Each round points every message at its least neighbour, follows the pointers to their ends by doubling, and contracts; a chain takes as many jumps as its length has
    digits. Only the question whether anything is left reaches the driver.
    """
    links = cut(session_edges(messages, gap_seconds), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "step")
        moving = True
        while moving:
            ends = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(step.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "step")
            step, moving = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        to = step.select(F.col("node").alias("of"), F.col("root").alias("to"))
        labels = step if labels is None else cut(labels.join(to, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = lambda df, x: df.join(to, F.col(x) == F.col("of")).drop(x, "of").withColumnRenamed("to", x)  # noqa: E731, B023
        links = cut(ends(ends(links, "a"), "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if labels is None:
        return messages.withColumn("session", F.col("id"))
    return messages.join(labels.select(F.col("node").alias("_of"), F.col("root").alias("_to")), F.col("id") == F.col("_of"), "left").withColumn("session", F.coalesce("_to", "id")).drop("_of", "_to")


def uncertain(confidence: Column, low: float = 0.3, high: float = 0.85) -> Column:
    """Between the bounds; what is no number is not uncertain."""
    value = confidence.try_cast("double")
    return F.coalesce((value >= low) & (value <= high) & ~F.isnan(value), F.lit(False))


def join_verdicts(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Messages with the last verdict on their index, demands only."""
    last = verdicts.groupBy("i").agg(F.max_by(F.struct("is_demand", "confidence", "title", "track", "kano"), F.col("ordinal")).alias("v")).select("i", "v.*")
    return messages.join(last.where("is_demand"), "i")


def demand_rows(judged: DataFrame) -> DataFrame:
    """Demands from judged messages: key from up to four words of the title."""
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    words = F.slice(F.regexp_extract_all(title, F.lit(r"[a-z][a-z0-9\-]{2,}"), F.lit(0)), 1, 4)
    names = F.when(F.size(words) > 0, words).otherwise(F.array(F.left(title, F.lit(24))))
    track = F.lower(F.trim(F.coalesce(F.when(F.col("track") != "", F.col("track")), F.lit("general"))))
    return judged.withColumn("canonical_key", text.canonical_key(names, track)).withColumn("track", track)


def modes() -> dict[str, tuple[bool, bool, bool]]:
    """Outputs by mode: direct replies, community notes, display."""
    return {"dry": (False, False, True), "shadow": (True, False, True), "live": (True, True, True)}
