"""Small record operators: ledgers, renders, egress checks, repository rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.config import STATUSES
from plaintide.functions import redaction, scoring

# Lengths a card may have, file kinds, suffixes of companion repositories.
TITLE, TITLE_MAX, DESCRIPTION, FIELD, FIELDS, TOTAL = 240, 256, 4000, 1024, 25, 6000
CARD_TEXTS = ("title", "summary", "inferred_job", "why", "recommendation", "action")
FILE_KINDS = {"md": "md", "markdown": "md", "txt": "prose", "rst": "prose", "py": "py"}
SUFFIXES = ("-data", "-private", "-config", "-internal")


def set_status(pool: DataFrame, keys: DataFrame, status: str, now: Column) -> DataFrame:
    """Rows of ``keys`` get the status and are touched; an unknown status is an error."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    hit = keys.select(F.col("key").alias("_hit")).distinct()
    j = pool.join(hit, F.col("key") == F.col("_hit"), "left")
    return j.withColumn("status", F.when(F.col("_hit").isNotNull(), status).otherwise(F.col("status"))).withColumn("last_seen", F.when(F.col("_hit").isNotNull(), now).otherwise(F.col("last_seen"))).drop("_hit")


def watermark(rows: DataFrame, ts: str) -> DataFrame:
    """One row: the largest time seen."""
    return rows.agg(F.max(ts).alias("last_run_at"))


def embed(cards: DataFrame) -> DataFrame:
    """Title, description and fields cut to their limits, total length and whether the card may be sent."""
    title, text = F.left("title", F.lit(TITLE)), F.left(F.coalesce("body", F.lit("")), F.lit(DESCRIPTION))
    fields = F.slice(F.transform("fields", lambda x: F.left(x, F.lit(FIELD))), 1, FIELDS)
    total = F.length(title) + F.length(text) + F.aggregate(fields, F.lit(0), lambda n, x: n + F.length(x))
    return cards.select("id", title.alias("title"), text.alias("description"), F.size(fields).alias("n_fields"), total.alias("total"), ((total <= TOTAL) & (F.length(title) <= TITLE_MAX) & (F.length(title) > 0)).alias("ok"))


def leaks(rows: DataFrame, fields: list[str], evidence: str | None = None) -> DataFrame:
    """``leaked``: fields whose text still has personal data, ``evidence[i].redacted_snippet`` among them; nothing goes out unless it is empty.

    ``evidence`` is an array of (redacted_snippet, quote); an empty snippet is judged by its quote. All texts of a row go through the rules at once.
    """
    texts, names = F.array(*[F.col(f).cast("string") for f in fields]), F.array(*map(F.lit, fields))
    if evidence:
        given = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
        shown = F.coalesce(evidence, F.array())
        texts = F.concat(texts, F.transform(shown, lambda e: F.coalesce(given(e["redacted_snippet"]), given(e["quote"]))))
        names = F.concat(names, F.transform(shown, lambda e, i: F.concat(F.lit("evidence["), i.cast("string"), F.lit("].redacted_snippet"))))
    flagged = rows.withColumn("_flags", redaction.pii_each(texts))
    return flagged.withColumn("leaked", F.filter(names, lambda x, i: F.get("_flags", i))).drop("_flags")


def scrub(entities: Column) -> Column:
    """Entities with personal data become the words of their redacted form, or ``redacted``; clean ones stay as they are."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        def one(e: str) -> list[str]:
            text, _, found = redaction.redact_text(e)
            return [e] if not found else (text.replace("[", " ").replace("]", " ").split() or ["redacted"])

        return lists.map(lambda xs: [y for x in (xs if xs is not None else []) for y in one(x)])

    return run(entities)


def redact_texts(cards: DataFrame) -> DataFrame:
    """Cards with every text field and evidence snippet redacted whole. An empty snippet is taken from its quote, which goes."""
    n = len(CARD_TEXTS)
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    snippets = F.transform(F.coalesce("evidence", F.array()), lambda e: F.when(given(e["redacted_snippet"]), e["redacted_snippet"]).when(given(e["quote"]), e["quote"]).otherwise(e["redacted_snippet"]))
    done = cards.withColumn("_done", redaction.redact_each(F.concat(F.array(*CARD_TEXTS), snippets)))
    evidence = F.transform(F.coalesce("evidence", F.array()), lambda e, i: e.withField("redacted_snippet", F.get(F.col("_done"), i + n)).dropFields("quote"))
    done = done.withColumns({c: F.get("_done", F.lit(i)) for i, c in enumerate(CARD_TEXTS)})
    return done.withColumn("evidence", evidence).drop("_done")


def redact_card(cards: DataFrame, salt: str | None = None) -> DataFrame:
    """:func:`redact_texts`, and the authors pseudonymised.

    ``authors`` has user_id, author and author_hash: a user_id becomes the hash and goes; else an author without a hash does.
    """
    given = lambda x: F.coalesce(x, F.lit("")) != ""

    def author(a: Column) -> Column:
        by_id, by_name = given(a["user_id"].cast("string")), given(a["author"]) & ~given(a["author_hash"])
        named = F.when(by_id, redaction.pseudonym(a["user_id"], salt)).when(by_name, redaction.pseudonym(a["author"], salt)).otherwise(a["author_hash"])
        return a.withField("author_hash", named).withField("author", F.when(~by_id & by_name, None).otherwise(a["author"])).dropFields("user_id")

    return redact_texts(cards).withColumn("authors", F.transform(F.coalesce("authors", F.array()), author))


def rescored(rows: DataFrame) -> DataFrame:
    """Pool rows after a merge: reach from the authors, the live defaults for the rest."""
    raw = scoring.rice(F.col("authors"), F.lit(1.0), F.lit(0.5), F.lit(None).cast("double"))
    return rows.withColumn("rice_raw", raw).withColumn("final_score", scoring.final_score(raw)).withColumn("grade", scoring.grade(F.col("final_score")))


def hour_gate(rows: DataFrame, hour: int, marker: Column) -> DataFrame:
    """Rows at which a daily summary is due: the hour has come and today's is not written."""
    return rows.where((F.hour("ts") >= hour) & ~marker.eqNullSafe(F.to_date("ts")))


def severity(kind: Column, domain: Column) -> Column:
    return F.when(kind == "secret", "BLOCK").when(kind == "linkage", F.when(domain == "history", "DEBT").otherwise("BLOCK")).when(kind == "derived", "WARN").otherwise("BLOCK")


def eligible(paths: DataFrame) -> DataFrame:
    """Rule kind by file extension; other files are left alone."""
    kind = scoring.lookup(F.lower(F.substring_index("path", ".", -1)), FILE_KINDS, None)
    return paths.withColumn("kind", kind).where("kind is not null")


def templates(paths: DataFrame) -> DataFrame:
    name = F.lower(F.substring_index("path", "/", -1))
    return paths.where(F.contains(name, F.lit("template")) | F.contains(name, F.lit("fixture")) | F.contains(name, F.lit("_example")) | name.endswith(".example.md"))


def fixtures(declared: DataFrame, generated: DataFrame) -> DataFrame:
    """Declared fixtures against freshly generated bytes, line ends folded: an outcome per path."""
    mark = lambda c: F.sha2(F.regexp_replace(c, "\r\n", "\n"), 256)
    j = declared.alias("d").join(generated.alias("g"), "path", "left")
    bad = F.when(F.col("d.generator") == "", "no generator").when(F.col("g.failed"), "failed").when(F.col("g.content").isNull(), "not generated").when(F.col("d.content").isNull(), "missing")
    return j.select("path", bad.when(mark("d.content") != mark("g.content"), "hand-edited").otherwise("ok").alias("outcome"))


def cross_names(names: DataFrame, own: str, public: DataFrame, map_age_seconds: Column, oldest: int = 30 * 86400) -> DataFrame:
    """Private names of other repositories worth guarding: name, ordinal, kind, witness.

    ``names`` (owner, name, ordinal) count with five characters or more and a companion suffix or two separators, unless they are ``own`` or a companion of it. A name that
    several owners have is that of the first ``ordinal``. It is ``derived`` if its owner has a ``public`` name (owner, name) from which it follows by a suffix, which is then its
    witness, and the map of public names is not older than ``oldest``; else it is ``linkage``, as with a map of unknown age.
    """
    name = F.lower("name")
    known = F.lit(False)
    for s in SUFFIXES:
        known = known | name.endswith(s)
    separators = F.length(name) - F.length(F.regexp_replace(name, "[-_]", ""))
    kept = names.where((F.length(name) >= 5) & (name != own) & ~name.isin(*[own + s for s in SUFFIXES]) & (known | (separators >= 2)))
    first = kept.groupBy(name.alias("name")).agg(F.min(F.struct("ordinal", "owner")).alias("at")).select("name", "at.*")
    stem = F.coalesce(*[F.when(F.col("name").endswith(s), F.expr(f"left(name, length(name) - {len(s)})")) for s in SUFFIXES])
    shown = public.select("owner", F.lower("name").alias("witness")).distinct()
    found = first.withColumn("_stem", stem).join(shown, (first["owner"] == shown["owner"]) & (F.col("_stem") == F.col("witness")), "left").drop(shown["owner"])
    fresh = F.coalesce(map_age_seconds <= oldest, F.lit(False))
    witness = F.when(fresh, F.col("witness"))
    return found.select("name", "ordinal", F.when(witness.isNotNull(), "derived").otherwise("linkage").alias("kind"), witness.alias("witness"))


def allow_lines(lines: DataFrame) -> DataFrame:
    """Allow-list lines: what stands before a hash, lower case."""
    value = F.lower(F.trim(F.substring_index("line", "#", 1)))
    return lines.select(value.alias("value")).where("value <> ''").distinct()


def grants(rows: DataFrame) -> DataFrame:
    """Grants with why they are not valid, null if they are; a grant without a nonce that fits is hand-written."""
    reject = F.when(~F.col("scope").isin("tree", "staged", "range", "history", "all"), "unknown scope").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason").when((F.col("scope") == "all") & (F.length("reason") < 8), "scope all needs its own reason")
    return rows.withColumn("reject", reject).withColumn("hand_written", ~F.coalesce(F.col("nonce") == F.left(F.sha2(F.concat_ws("|", "repo", "token"), 256), F.lit(8)), F.lit(False)))
