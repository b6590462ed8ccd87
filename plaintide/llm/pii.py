"""PII by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes and identifier cues in one pass over the text; runs of digits and
phone punctuation are the anchors of numbers. From each anchor a deterministic parser expands to the left and right and
validates. Base kinds are email, ip, card and phone; the method adds login (user information in a URL), account (IBANs
and cued account numbers) and secret (cued or well-known keys).

Null texts count as empty: no spans. Offsets are code points, ends exclusive. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
BASE = KINDS[:4]
#: Cues, in lower case, by what is parsed behind them.
CUES = {
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "akia"),
    "account": ("iban", "account", "acct", "konto", "cuenta", "compte"),
}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_RUN = re.compile(r"\+?[0-9][0-9 ().\-]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ \-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9\-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_VALUE = re.compile(r"[ ]?[:=][ ]?[\"']?([A-Za-z0-9_/+.\-]{8,})")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?: ?(?:no\.?|number|nr\.?|#))?[ ]?[:#=]?[ ]?([0-9](?:[ \-]?[0-9]){5,17})(?![0-9])", re.I)

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _numbers(text: str) -> Iterator[Span]:
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        part = run.group()
        if part.count(".") >= 3:
            for m in _IP.finditer(part):
                # parts may be of any length: leading zeros go before a part becomes a number
                if all(len(x := y.lstrip("0")) <= 3 and int(x or "0") <= 255 for y in m.group().split(".")):
                    yield "ip", a + m.start(), a + m.end()
        if b - a >= 13:
            for m in _CARD.finditer(part):
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    yield "card", a + m.start(), a + m.end()
        if part[0] == "+":
            for m in _PHONE.finditer(part):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    yield "phone", a + m.start(), a + m.end()


def _email(text: str, at: int, free: int) -> Span | None:
    """Expand an at-sign; nothing before ``free`` may be taken."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return ("email", start, domain.end()) if domain else None


def _login(text: str, after: int) -> Span | None:
    """User information between a scheme and the at-sign of its authority."""
    end = after
    while end < len(text) and not text[end].isspace() and text[end] not in "/?#<>\"'":
        end += 1
    at = text.rfind("@", after, end)
    return ("login", after, at) if at > after and ":" in text[after:at] else None


def _secret(text: str, start: int, after: int) -> Span | None:
    if m := _ACCESS.match(text, start):
        return "secret", m.start(), m.end()
    m = _VALUE.match(text, after)
    return ("secret", m.start(1), m.end(1)) if m and any("0" <= c <= "9" for c in m.group(1)) else None


#: Characters after a cue in which an account's number begins.
NEAR = 48


def iban(value: str) -> bool:
    bare = value.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _account(text: str, after: int) -> Span | None:
    # a value begins near its cue and runs to its own end: a cut one could pass for a shorter
    m = _IBAN.search(text, after, min(len(text), after + NEAR + 128))
    if m and m.start() < after + NEAR and iban(m.group()):
        return "account", m.start(), m.end()
    m = _NUMBER.match(text, after)
    return ("account", m.start(1), m.end(1)) if m else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by kind in the order of ``KINDS``, then start."""
    lowered = text.lower()
    if len(lowered) != len(text):  # some letters are longer in lower case; cues are ASCII
        lowered = text.translate(_LOWER)
    found: set[Span] = set(_numbers(text))
    free = 0
    for last, (kind, size) in anchors.iter(lowered):
        got = None
        if kind == "email":
            got = _email(text, last, free)
            free = got[2] if got else free
        elif kind == "login":
            got = _login(text, last + 1)
        elif kind == "secret":
            got = _secret(text, last + 1 - size, last + 1)
        else:
            got = _account(text, last + 1)
        if got:
            found.add(got)
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """Counts by base kind, base digest, all spans and their number, the method's kinds included, of every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for part in parts:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, all_spans, sizes = [], [], []
            for text in part.column(1).to_pylist():
                found = spans(text or "", anchors)
                base = [x for x in found if x[0] in BASE]
                for kind, into in zip(BASE, counts, strict=True):
                    into.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                all_spans.append(written(found))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(sizes, pa.int64())], names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(text: str, anchors: ahocorasick.Automaton) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans give one."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text, anchors), key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])
