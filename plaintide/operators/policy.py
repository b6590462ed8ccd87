"""Policies and files that operators load: deny lists, visibility maps, grants, manifests, data folders.

Small, driver-side, and closed: what cannot be read whole is an error, never an empty policy.
"""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of tokens, newest format of a token file.
KINDS = ("secret", "linkage", "derived")
FORMAT = 2


class PolicyError(ValueError):
    """A policy that is damaged, too new, or empty."""


def read_json(path: str) -> object:
    try:
        return json.loads(Path(path).read_bytes().decode("utf-8"))
    except (OSError, ValueError) as e:
        raise PolicyError(f"{path}: {e}") from None


def deny_tokens(path: str, canary: str | None = None) -> list[tuple[str, str]]:
    """(value, kind) of a token file: a list, an object with ``tokens``, or format 2 with a canary and a count. The canary is checked and left out;
    ``canary`` is that of files of format 2 that do not name theirs."""
    data = read_json(path)
    told = data if isinstance(data, dict) else {"tokens": data, "format": 1}
    if not isinstance(told.get("format", 1), int) or told.get("format", 1) > FORMAT:
        raise PolicyError(f"{path}: format {told.get('format')} is not known")
    if not isinstance(told.get("tokens"), list):
        raise PolicyError(f"{path}: no list of tokens")
    found = []
    for i, item in enumerate(told["tokens"]):
        item = {"value": item} if isinstance(item, str) else item
        if not isinstance(item, dict) or not isinstance(item.get("value"), str):
            raise PolicyError(f"{path}: token {i} has no value")
        if item.get("kind", KINDS[0]) not in KINDS:
            raise PolicyError(f"{path}: token {i} is of unknown kind {item['kind']}")
        if item["value"].strip():
            found.append((item["value"].strip().lower(), item.get("kind", KINDS[0])))
    canary = told.get("canary") or (canary if told.get("format", 1) >= 2 else None)
    if not canary and told.get("format", 1) >= 2:
        raise PolicyError(f"{path}: no canary")
    if canary and canary.lower() not in {v for v, _ in found}:
        raise PolicyError(f"{path}: its canary is missing")
    if told.get("count") is not None and told["count"] != len(found):
        raise PolicyError(f"{path}: {told['count']} tokens declared, {len(found)} loaded")
    kept = [x for x in found if not canary or x[0] != canary.lower()]
    if not kept:
        raise PolicyError(f"{path}: no token to enforce")
    return kept


@dataclass
class Visibility:
    """Public names by owner, private (owner, name), states that are not known, and the age of the map in seconds, if it tells."""

    public: dict[str, set[str]] = field(default_factory=dict)
    private: list[tuple[str, str]] = field(default_factory=list)
    unknown: set[str] = field(default_factory=set)
    age: float | None = None


def visibility(path: str, now: datetime.datetime) -> Visibility | None:
    """A map of owner/name to a state; None without a file. Its age comes from its own stamp, never from the file's time."""
    if not os.path.exists(path):
        return None
    told = read_json(path)
    if not isinstance(told, dict):
        raise PolicyError(f"{path}: not a map")
    out = Visibility()
    for key, value in told.items():
        if "/" not in key:
            continue
        state = str(value.get("v") if isinstance(value, dict) else value).upper()
        owner, _, name = (x.strip().lower() for x in key.rpartition("/"))
        if state == "PUBLIC":
            out.public.setdefault(owner, set()).add(name)
        elif state == "PRIVATE":
            out.private.append((owner, name))
        else:
            out.unknown.add(state)
    try:
        stamp = datetime.datetime.fromisoformat(str(told.get("_refreshed", "")).strip().replace("Z", "+00:00"))
        stamp = stamp if stamp.tzinfo else stamp.replace(tzinfo=datetime.UTC)
        out.age = (now - stamp).total_seconds()
    except ValueError:
        out.age = None
    return out


def is_scanner(path: Column, text: Column, own: tuple[str, ...], names: tuple[str, ...], marks: tuple[str, ...]) -> Column:
    """A scanner's own file: at one of its ``own`` paths, or of one of its ``names`` with one of its ``marks`` in the text."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.coalesce(text, F.lit("")), F.lit(mark))
    return bare.isin(*own) | (F.substring_index(bare, "/", -1).isin(*names) & marked)


def add_grant(grants: DataFrame, request: dict, nonce: str, tokens: DataFrame, findings: DataFrame) -> DataFrame:
    """``grants`` and ``request`` (repo, token, scope, reason, nonce), if its nonce fits, its token is loaded and a scan found it; else PolicyError."""
    if request["nonce"] != nonce:
        raise PolicyError("the nonce does not fit")
    value = request["token"].lower()
    for table, why in ((tokens.select(F.lower("token").alias("v")), "the token is not loaded"), (findings.select(F.lower("value").alias("v")), "no scan finds the token")):
        if table.where(F.col("v") == value).isEmpty():
            raise PolicyError(why)
    row = grants.sparkSession.createDataFrame([tuple(request[c] for c in grants.columns)], grants.schema)
    return grants.unionByName(row)


def receipt(grants: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: grants declared, used by a finding of their scope, never fired, hand-written, and hits of history grants elsewhere.

    ``grants`` has token, scope, hand_written; ``findings`` value, domain. Findings are counted by value and domain before they meet the grants.
    """
    hits = findings.groupBy(F.lower("value").alias("value"), "domain").agg(F.count(F.lit(1)).alias("times"))
    g = grants.select(F.monotonically_increasing_id().alias("id"), F.lower("token").alias("value"), "scope", "hand_written")
    j = g.join(hits, "value", "left")
    fits = F.col("domain").isNotNull() & ((F.col("scope") == "all") | (F.col("scope") == F.col("domain")))
    live = (F.col("scope") == "history") & (F.col("domain") != "history")
    each = j.groupBy("id").agg(F.bool_or(fits).alias("used"), F.first("hand_written").alias("hand"), F.sum(F.when(live, F.col("times")).otherwise(0)).alias("live"))
    return each.agg(
        F.count(F.lit(1)).alias("declared"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("never_fired"), F.count_if("hand").alias("hand_written"),
        F.count_if(F.col("live") > 0).alias("collided"), F.coalesce(F.sum("live"), F.lit(0)).cast("long").alias("collisions"),
    )


def manifest(path: str) -> dict[str, list[str]] | None:
    """What a repository declares as data, sealed data and fixtures; None without a manifest: then nothing is enforced."""
    if not os.path.exists(path):
        return None
    told = read_json(path)
    if not isinstance(told, dict):
        raise PolicyError(f"{path}: not a manifest")
    return {k: list(v) for k, v in told.items() if isinstance(v, list)}


def covered(paths: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows of ``paths`` that are a declared path or lie below one: every prefix is looked up, so the join is an equality."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    names = declared.select(F.regexp_replace("path", "/+$", "").alias("prefix")).distinct()
    hit = paths.select("path", F.explode(prefixes).alias("prefix")).join(names, "prefix", "left_semi").select("path").distinct()
    return paths.join(hit, "path", "left_semi")


def without_schema(declared: DataFrame, paths: DataFrame) -> DataFrame:
    """Declared data files (not folders) for which no example is there: ``path.example``, or ``stem.example.ext``."""
    files = declared.where(~F.col("path").endswith("/"))
    ext = F.regexp_extract("path", r"(?<=[^/])(\.[^./]*)$", 1)
    stem = F.expr("left(path, length(path) - length(ext))")
    wanted = files.withColumn("ext", ext).select("path", F.explode(F.array(F.concat("path", F.lit(".example")), F.concat(stem, F.lit(".example"), F.col("ext")))).alias("example"))
    there = wanted.join(paths.select(F.col("path").alias("example")).distinct(), "example", "left_semi").select("path").distinct()
    return files.join(there, "path", "left_anti")


def skills(paths: DataFrame) -> DataFrame:
    """The skill files of both layouts: one at the top, or one in each folder below ``skills``."""
    return paths.where(F.col("path").rlike(r"^(skills/[^/]+/)?SKILL\.md$"))


def data_dir(candidates: list[str], repo: str, create: bool = False) -> Path | None:
    """The first candidate that is a folder; with ``create`` the first of all is made. A folder inside ``repo`` is refused."""
    found = next((Path(c) for c in candidates if Path(c).is_dir()), Path(candidates[0]) if create and candidates else None)
    if found is None:
        return None
    if found.resolve().is_relative_to(Path(repo).resolve()):
        raise PolicyError(f"{found} is inside the repository")
    if create:
        found.mkdir(parents=True, exist_ok=True)
    return found
