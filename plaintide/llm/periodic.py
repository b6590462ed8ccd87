"""Periodic run detection: maximal repetitions of words, from Lyndon roots under both orders of the alphabet.

A run of smallest period p has a Lyndon word of length p among its factors, and, under one of the two orders, it is the longest Lyndon
word that begins where it does. For each order the words are scanned from right to left with a stack of the Lyndon words to the right: a word
joins the one after it while it is the smaller, which compares two suffixes. Every position thus names one period to try. Where the root
stands twice, the run is extended to both sides.

Common extensions are found by binary search over rolling hashes, and what the hash says is verified word by word; where it
lies, words are compared one by one. What was verified for a distance is not verified again, so a text of one repeated word takes linear
time for each distance. No suffix array is built.

A text is held whole by its worker: its words, their numbers, two hash columns and a stack. Null, empty and blank texts have no words and no runs; equal
texts have equal runs; other columns are not read, and a null doc_id is a doc_id of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.textarrays import mix

#: A run counts from so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared one by one before the hashes are asked.
_PLAIN = 8
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
RUN = "start long, length long, period long"


class Extensions:
    """Common extensions to the right and left of two positions of a text of word numbers."""

    def __init__(self, ids: list[int]) -> None:
        self.ids = ids
        self._hash: list[int] | None = None
        self._verified: dict[int, tuple[int, int]] = {}

    def _build(self) -> None:
        n = len(self.ids)
        value = mix(np.array(self.ids, np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * power[:n], out=total[1:])
        self._hash, self._power = total.tolist(), power.tolist()

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of the ``k`` words from i and from j > i agree."""
        h = self._hash
        return ((h[i + k] - h[i]) * self._power[j - i] - h[j + k] + h[j]) & _MASK == 0

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` > ``i`` on."""
        ids, most = self.ids, len(self.ids) - j
        for k in range(_PLAIN):
            if k == most or ids[i + k] != ids[j + k]:
                return k
        if most == _PLAIN:
            return most
        at, known = self._verified.get(j - i, (0, 0))
        if at <= i < at + known:
            return known - (i - at)
        if self._hash is None:
            self._build()
        # as far as the next stretch that was verified for this distance, if it lies ahead
        ahead = at - i if known and at > i else most
        if ahead <= _PLAIN:
            return ahead + known
        low, high = _PLAIN, min(ahead, most)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._same(i, j, mid) else (low, mid - 1)
        if ids[i : i + low] != ids[j : j + low] or (low < min(ahead, most) and ids[i + low] == ids[j + low]):
            low = next((k for k in range(min(ahead, most)) if ids[i + k] != ids[j + k]), min(ahead, most))
        if low == ahead and ahead < most:
            low += known
        self._verified[j - i] = (i, low)
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` > ``i``."""
        ids = self.ids
        for k in range(min(_PLAIN, i)):
            if ids[i - 1 - k] != ids[j - 1 - k]:
                return k
        if i <= _PLAIN:
            return i
        if self._hash is None:
            self._build()
        low, high = _PLAIN, i
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._same(i - mid, j - mid, mid) else (low, mid - 1)
        if ids[i - low : i] != ids[j - low : j] or (low < i and ids[i - low - 1] == ids[j - low - 1]):
            low = next((k for k in range(i) if ids[i - 1 - k] != ids[j - 1 - k]), i)
        return low


def lyndon_roots(order: list[int], ext: Extensions) -> list[tuple[int, int]]:
    """(position, length) of the longest Lyndon words, words compared by ``order``, that the word they begin with follows; by position.

    A text's end is smaller than any word. Only a root that is followed by its first word can be repeated.
    """
    n = len(order)
    after = [n] * n  # where the longest Lyndon word from a position ends: the next smaller suffix
    found = []
    right = ext.right
    for i in range(n - 2, -1, -1):
        word, j = order[i], i + 1
        while j < n:
            other = order[j]
            if word > other:
                break
            if word == other:
                k = right(i, j)
                if j + k >= n or order[i + k] > order[j + k]:
                    found.append((i, j - i))
                    break
            j = after[j]
        after[i] = j
    found.reverse()
    return found


def find_runs(ids: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least_words`` words and ``least_periods`` periods (2 or more), by start, then period."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    n = len(ids)
    if n < max(least_words, least_periods):
        return []
    ext = Extensions(ids)
    found = set()
    for order in (ids, [-x for x in ids]):
        end: dict[int, int] = {}
        for i, p in lyndon_roots(order, ext):
            if least_periods * p > n or i + p <= end.get(p, 0):
                continue  # too long, or within the run that this period had last
            k = ext.right(i, i + p)
            begin, stop = i - ext.left(i, i + p), i + p + k
            if stop - begin >= 2 * p:
                end[p] = stop
                if stop - begin >= max(least_words, least_periods * p):
                    found.add((begin, stop - begin, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Equal words get equal numbers, in the order of their first appearance."""
    number: dict[bytes, int] = {}
    return [number.setdefault(w, len(number)) for w in words]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where the contract of the query puts one."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``runs`` of its text's runs, and the text without their repetitions: the operator as a corpus filter uses it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            runs, texts = [], []
            for text in part.column(1):
                words = _words(text.as_py())
                found = find_runs(numbered(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return _slim(docs).mapInArrow(run, f"doc_id long, runs array<struct<{RUN.replace(' ', ':').replace(',:', ',')}>>, collapsed string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest_planted(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the runs of its planted words, the longest one, and digests of all runs and of the collapsed text."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    fields = pa.schema([(x, pa.string() if x.endswith("sha256") else pa.int64()) for x in names])

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = planted(_words(text), doc_id)
        runs = find_runs(numbered(words))
        best = longest(runs)
        said = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        return doc_id, len(runs), *shown, hashlib.sha256(said).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [row(i.as_py(), t.as_py()) for i, t in zip(part.column(0), part.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), fields, strict=True)], schema=fields) if done else pa.RecordBatch.from_pylist([], fields)

    return _slim(docs).mapInArrow(run, SCHEMA)
