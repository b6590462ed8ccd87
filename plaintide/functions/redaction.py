"""Redaction of personal data, rule by rule, each on what the one before left.

Normalising needs NFKC, which has no built-in, so the whole chain runs in one Arrow batch function; a guard per rule skips
texts that cannot match it. A batch stays in Arrow, and Python holds the texts of a few rows at a time. Pseudonyms are built-in functions.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the rules, in their order.
DOTS = {"。": ".", "｡": ".", "︒": ".", "﹒": ".", "･": ".", "‧": "."}
INVITE = r"\b(?:https?://)?(?:discord\.gg|discord(?:app)?\.com/invite)/\S+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
MENTION = r"<@!?(\d{15,21})>"
URL = r"\bhttps?://\S+"
CARD = r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)"
PHONE = r"(?<!\w)(\+?\d[\d\s().-]{7,}\d)(?!\w)"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4})(?![\w:.])"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HANDLE = r"(?<![\w/])@([A-Za-z0-9_]{2,32})\b"
ID = r"\b\d{17,20}\b"
SECRET = r"\b[A-Za-z0-9_\-]{24,}\b"

RESULT = T.StructType(
    [
        T.StructField("redacted", T.StringType()),
        T.StructField("placeholders", T.MapType(T.StringType(), T.StringType())),
        T.StructField("found", T.MapType(T.StringType(), T.IntegerType())),
    ]
)


def digits_of(text: str) -> str:
    return re.sub(r"\D", "", text)


def luhn_ok(text: str) -> bool:
    d = [int(c) for c in digits_of(text)]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


def phone_ok(text: str) -> bool:
    """Eight digits or more, and neither an ISO date nor a run of years."""
    d = digits_of(text)
    if len(d) < 8 or re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        return False
    parts = re.findall(r"\d+", text)
    return not all(len(p) == 4 and 1900 <= int(p) <= 2099 for p in parts)


def secret_ok(text: str) -> bool:
    if not re.search(r"\d", text) or not re.search(r"[A-Za-z]", text):
        return False
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) >= 3.5


#: A digit of any script; the least digits of a text in which a rule can be accepted, by the rule's place; characters of a secret.
DIGIT = re.compile(r"\d")
LEAST_DIGITS = {2: 15, 4: 13, 5: 8, 7: 4, 9: 17, 10: 1}
SECRET_CHARS = 24
#: Rows whose texts are Python objects at one time.
PIECE = 64

#: kind, pattern, the characters one of which must be there, acceptance of a match, and the value that identifies it
RULES = (
    ("INVITE", re.compile(INVITE, re.I), "/", None, lambda m: m.group()),
    ("EMAIL", re.compile(EMAIL), "@", None, lambda m: m.group()),
    ("DISCORD_ID", re.compile(MENTION), "<", None, lambda m: m.group(1)),
    ("URL", re.compile(URL, re.I), "://", None, lambda m: m.group()),
    ("CARD", re.compile(CARD), "", luhn_ok, lambda m: digits_of(m.group())),
    ("PHONE", re.compile(PHONE), "", phone_ok, lambda m: digits_of(m.group())),
    ("IP", re.compile(IPV6), ":", lambda x: bool(re.search("[0-9A-Fa-f]", x)), lambda m: m.group()),
    ("IP", re.compile(IPV4), ".", None, lambda m: m.group()),
    ("HANDLE", re.compile(HANDLE), "@", None, lambda m: m.group(1)),
    ("DISCORD_ID", re.compile(ID), "", None, lambda m: m.group()),
    ("SECRET", re.compile(SECRET), "", secret_ok, lambda m: m.group()),
)


def normalise(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", text.translate(_DOTS) if any(x in text for x in DOTS) else text)


_DOTS = str.maketrans(DOTS)


def _possible(rule: int, text: str, digits: int) -> bool:
    """Whether a rule may fire on a text of so many digits; a cheap test that never says no wrongly."""
    return RULES[rule][2] in text and digits >= LEAST_DIGITS.get(rule, 0) and (rule != len(RULES) - 1 or max(map(len, text.split()), default=0) >= SECRET_CHARS)


def redact_text(text: str | None, first: bool = False) -> tuple[str, dict[str, str], dict[str, int]]:
    """Redacted text, kind of each placeholder, matches of each kind. Kinds number their distinct values from 1. With ``first``, the rules after the first that fires are left out."""
    out = normalise(text or "")
    seen: dict[str, dict[str, int]] = {}
    found: Counter[str] = Counter()
    digits = len(DIGIT.findall(out))
    for rule, (kind, pattern, _, accept, value) in enumerate(RULES):
        if not _possible(rule, out, digits):
            continue
        numbers = seen.setdefault(kind, {})

        def put(m: re.Match, kind=kind, accept=accept, value=value, numbers=numbers) -> str:
            if accept and not accept(m.group()):
                return m.group()
            found[kind] += 1
            return f"[{kind}_{numbers.setdefault(value(m), len(numbers) + 1)}]"

        before, out = out, pattern.sub(put, out)
        if out is not before:
            if first and found:
                break
            digits = len(DIGIT.findall(out))
    return out, {f"[{k}_{i}]": k for k, v in seen.items() for i in v.values()}, dict(found)


def in_pieces(values: pa.Array, of: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """``of`` each value, as an array of ``kind``; a piece of :data:`PIECE` values is in Python at a time."""
    return pa.concat_arrays([pa.array([], kind), *[pa.array([of(x) for x in values.slice(i, PIECE).to_pylist()], kind) for i in range(0, len(values), PIECE)]])


_RESULT = pa.struct([("redacted", pa.string()), ("placeholders", pa.map_(pa.string(), pa.string())), ("found", pa.map_(pa.string(), pa.int32()))])


@F.arrow_udf(RESULT)
def redact(texts: pa.Array) -> pa.Array:
    def one(x: str | None) -> dict:
        text, placeholders, found = redact_text(x)
        return {"redacted": text, "placeholders": list(placeholders.items()), "found": list(found.items())}

    return in_pieces(texts, one, _RESULT)


@F.arrow_udf(T.ArrayType(T.StringType()))
def redact_each(lists: pa.Array) -> pa.Array:
    """Each text of a list redacted for itself; empty and null ones stay."""
    return in_pieces(lists, lambda xs: None if xs is None else [redact_text(x)[0] if x else x for x in xs], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def pii_each(lists: pa.Array) -> pa.Array:
    """Which texts of a list have personal data; empty and null ones have none."""
    return in_pieces(lists, lambda xs: None if xs is None else [bool(x) and bool(redact_text(x, first=True)[2]) for x in xs], pa.list_(pa.bool_()))


def one_rule(rule: int, text: str | None) -> tuple[str, int, int]:
    """A rule of ``RULES`` by itself, on the text as it is: redacted text, matches, distinct values."""
    kind, pattern, must, accept, value = RULES[rule]
    numbers: dict[str, int] = {}
    found = 0

    def put(m: re.Match) -> str:
        nonlocal found
        if accept and not accept(m.group()):
            return m.group()
        found += 1
        return f"[{kind}_{numbers.setdefault(value(m), len(numbers) + 1)}]"

    out = pattern.sub(put, text or "") if not must or must in (text or "") else text or ""
    return out, found, len(numbers)


def by_rule(rule: int, text: Column) -> Column:
    """:func:`one_rule` as a column: redacted, found, distinct."""
    kind = pa.struct([("redacted", pa.string()), ("found", pa.int64()), ("distinct", pa.int64())])

    @F.arrow_udf("redacted string, found long, distinct long")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, lambda x: dict(zip(("redacted", "found", "distinct"), one_rule(rule, x), strict=True)), kind)

    return run(text)


@F.arrow_udf(T.StringType())
def normalised(texts: pa.Array) -> pa.Array:
    return in_pieces(texts, lambda x: normalise(x or ""), pa.string())


def has_pii(text: Column) -> Column:
    """Any rule fires; the chain itself decides, since a rule may only fire on what another left."""
    return F.size(redact(text)["found"]) > 0


def pseudonym(value: Column, salt: str | None = None) -> Column:
    """``u_`` and 16 digits of HMAC-SHA256; the salt comes from the argument or ``PLAINTIDE_SALT``, never from code."""
    salt = salt or os.environ.get("PLAINTIDE_SALT")
    if not salt:
        raise ValueError("set PLAINTIDE_SALT: pseudonyms need a stable secret salt")
    import hashlib

    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda b: F.unhex(F.lit(bytes(x ^ b for x in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(value.cast("string"), "UTF-8")), 256))
    return F.when(value.isNotNull(), F.concat(F.lit("u_"), F.left(F.sha2(F.concat(pad(0x5C), inner), 256), F.lit(16))))
