"""Defaults and their overrides. Plain Python on the driver; values enter plans as literals."""

from __future__ import annotations

import json
import os
from copy import deepcopy
from pathlib import Path

# Labels, anchors and thresholds that results depend on.
INTENTS = ("feature_request", "bug_complaint", "pain_workaround", "competitor_compare", "pricing_objection", "how_to_question", "praise", "chitchat")
DEMAND_INTENTS = ("feature_request", "bug_complaint", "pain_workaround", "competitor_compare", "pricing_objection")
IMPACT = {"massive": 3.0, "high": 2.0, "medium": 1.0, "low": 0.5, "minimal": 0.25}
URGENCY = {"should": 1, "need": 2, "blocking": 3}
SEGMENT = {"free": 1, "pro": 2, "team": 3, "enterprise": 4}
TIER_RANK = {"tier0": 0, "tier1": 1, "tier2": 2, "backlog": 3, "cut": 9}
HORIZON = {"tier0": "immediate", "tier1": "this-week", "tier2": "this-month", "backlog": "backlog"}
STATUSES = ("new", "triaged", "in_progress", "shipped", "wontfix", "duplicate")
CLOSED = ("shipped", "wontfix", "duplicate")
TAXONOMY = (
    ("onboarding", 1.0, ("onboard", "setup", "getting started", "first time", "signup", "tutorial", "新手", "上手", "注册")),
    ("core-workflow", 1.1, ("workflow", "flow", "step", "process", "main", "core", "流程")),
    ("integrations", 1.0, ("integration", "api", "webhook", "connect", "import", "export", "sync", "zapier", "集成", "对接")),
    ("performance", 1.1, ("slow", "lag", "crash", "error", "timeout", "down", "fail", "bug", "卡", "崩", "报错")),
    ("pricing-plans", 1.0, ("price", "pricing", "plan", "cost", "expensive", "free tier", "quota", "limit", "贵", "收费", "套餐")),
    ("ui-ux", 0.9, ("ui", "ux", "design", "confusing", "hard to find", "layout", "dark mode", "界面", "难用")),
    ("mobile", 0.9, ("mobile", "ios", "android", "app", "tablet", "手机")),
    ("other", 0.8, ()),
)
SCORING = {
    "effort_min": 0.5,
    "effort_unknown": 2.0,
    "half_score": 6.0,
    "opportunity_high": 10.0,
    "wsjf_high": 3.0,
    "quick_win_effort": 3.0,
    "archive": 40.0,
    "push": 70.0,
    "push_cap": 5,
    "min_sources": 2,
    "jaccard": 0.83,
    "hamming": 3,
    "band": (0.78, 0.83),
    "floor": 0.45,
    "score_jump": 15.0,
    "velocity_jump": 5.0,
    "samples": 30,
    "max_tau": 0.25,
    "max_churn": 0.20,
    "block_tau": 0.6,
    "block_churn": 0.5,
}
DEFAULTS = {"scoring": SCORING, "push": {"max_per_day": 5}}
#: Names under which a config file may give a value of ``SCORING``, or of a group of its own.
NAMES = {
    "min_score_to_archive": "archive", "min_score_to_push": "push", "min_independent_sources": "min_sources", "samples_cap": "samples",
    "dedup_cosine_threshold": "jaccard", "dedup_simhash_hamming": "hamming", "candidate_merge_band": "band", "resurface_score_jump": "score_jump",
    "resurface_velocity_jump": "velocity_jump", "effort_tbd_default": "effort_unknown", "max_push_churn_frac": "max_churn", "catastrophic_tau": "block_tau", "catastrophic_churn_frac": "block_churn",
}
TABLES = {"impact_anchors": IMPACT, "urgency_score": URGENCY, "segment_score": SEGMENT}


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, nested dictionaries key by key."""
    out = deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def load(path: str | None = None, product: str | None = None) -> dict:
    """Defaults under the first config file found: argument, ``PLAINTIDE_CONFIG``, or ``./plaintide.json``.

    A directory holds ``config.json``, or one per product in ``<product>/config.json``. A malformed file is ignored.
    """
    for place in (path, os.environ.get("PLAINTIDE_CONFIG"), "plaintide.json"):
        if not place:
            continue
        at = Path(place)
        if at.is_dir():
            at = at / (product or "") / "config.json" if product else at / "config.json"
        try:
            return merged(DEFAULTS, json.loads(at.read_text(encoding="utf-8")))
        except (OSError, ValueError):
            continue
    return deepcopy(DEFAULTS)


def resolved(config: dict) -> dict:
    """The values of ``SCORING`` under a loaded configuration. What is unknown, or of another type, is left out; a long name wins over a short one."""
    given = dict(config.get("scoring", {}))
    given |= given.pop("weight_regression", None) or {}
    out = dict(SCORING)
    for name, value in sorted(given.items(), key=lambda x: x[0] in NAMES):
        name = NAMES.get(name, name)
        if name in SCORING and isinstance(value, (int, float, list, tuple)) and not isinstance(value, bool):
            out[name] = tuple(value) if isinstance(value, (list, tuple)) else type(SCORING[name])(value)
    cap = (config.get("push") or {}).get("max_per_day")
    return out | ({"push_cap": cap} if isinstance(cap, int) else {})


def use(config: dict) -> None:
    """Lay a loaded configuration over the values that plans are built with."""
    SCORING.update(resolved(config))
    for name, table in TABLES.items():
        given = config.get("scoring", {}).get(name)
        table.update(given if isinstance(given, dict) else {})


def doctor(folder: str) -> list[tuple[str, bool, str]]:
    """Checks of a configuration folder: name, passed, detail. A registry of products, or a flat layout."""
    at = Path(folder)
    out = [("folder exists", at.is_dir(), folder)]
    registry = at / "registry.json"
    if registry.is_file():
        try:
            told = json.loads(registry.read_text(encoding="utf-8-sig"))
            items = told.get("products", told.get("tools", told.get("entries")))
            out += [("registry is JSON", True, ""), ("schema version is 1", told.get("schema_version") == 1, repr(told.get("schema_version"))), ("registry lists products", isinstance(items, list), type(items).__name__)]
            slugs = [x["slug"] for x in items if isinstance(x, dict) and x.get("slug")] if isinstance(items, list) else []
            out += [(f"product {x} has a folder", (at / "products" / x).is_dir(), f"products/{x}") for x in slugs]
        except (ValueError, AttributeError) as e:
            out.append(("registry is JSON", False, str(e)))
    else:
        out.append(("a layout is there", any((at / x).is_file() for x in ("priority.json", "watchlist.json")), "registry.json, priority.json or watchlist.json"))
    ignore = (at / ".gitignore").read_text(errors="replace") if (at / ".gitignore").is_file() else None
    out += [("secrets folder exists", (at / "secrets").is_dir(), "secrets"), ("ignore file exists", ignore is not None, ".gitignore")]
    if ignore is not None:
        out.append(("ignore file covers secrets", "secrets/" in ignore and "*.env" in ignore, "secrets/ and *.env"))
    tied = [x for x in ("registry.json", ".gitignore", "secrets/README.md", "priority.json", "taxonomy.json") if (at / x).is_file() and any(p in (at / x).read_text(errors="replace") for p in ("C:\\", "C:/", "/home/", "/Users/", "/root/"))]
    return [*out, ("no absolute paths", not tied, ", ".join(tied))]


def check(config: dict) -> list[tuple[str, bool, str]]:
    """Checks of a configuration: name, passed, detail."""
    s = config.get("scoring", {})
    low, high = s.get("band", (0, 0))
    return [
        ("effort floor is positive", s.get("effort_min", 0) > 0, str(s.get("effort_min"))),
        ("archive is below push", s.get("archive", 0) <= s.get("push", 0), f"{s.get('archive')} and {s.get('push')}"),
        ("band ends at the match threshold", low < high <= s.get("jaccard", 0), f"{low} to {high}"),
        ("push cap is positive", config.get("push", {}).get("max_per_day", 0) > 0, str(config.get("push"))),
    ]


if os.environ.get("PLAINTIDE_CONFIG"):
    use(load())
