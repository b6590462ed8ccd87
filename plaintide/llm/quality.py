"""Quality rules: repetition found with a suffix array over words.

Suffixes of every text are sorted by prefix doubling; the longest common prefix of neighbours in the
sorted order gives, for every position, the longest substring starting there that occurs again in the
same text. The union of those spans over all maximal repeated substrings of at least ``min_words``
words is the covered part. A text is rejected when the covered fraction or the longest repeat is too large.

Null, empty and blank texts have no words: every count is 0 and the base rule rejects them. Repeated
rows are judged one by one; extra columns do not matter and are kept by :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.textarrays import Words, batches, mix

#: Shortest repeat that counts, in words; largest covered fraction; longest repeat, in words.
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 8, 0.40, 100
_BLANK = " \t\n\v\f\r"
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


def longest_repeats(words: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each word position, how many words starting there occur again, in that order, in the same text.

    ``words`` are word hashes, ``doc`` the text of each, ``offset`` where each text's words begin (and the end).
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = mix(words + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    # rank of a group of equal prefixes: the place of its first member in the sorted order, plus 1
    rank = np.zeros(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1] + 1
    stop = offset[1:][doc]
    levels = [rank]
    suffix, step = order.copy(), 1
    tied = np.concatenate((~head[1:], [False])) | ~head
    while tied.any():
        at = np.flatnonzero(tied)
        suf = suffix[at]
        nxt = suf + step
        follow = np.where(nxt < stop[suf], rank[np.minimum(nxt, n - 1)], 0)
        group = rank[suf]
        again = np.lexsort((follow, group))
        suffix[at] = suf = suf[again]
        group, follow = group[again], follow[again]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        rank = rank.copy()
        rank[suf] = at[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        levels.append(rank)
        tied = np.zeros(n, bool)
        tied[at] = np.concatenate((~new[1:], [False])) | ~new
        step *= 2
    # common prefix of neighbours in the suffix array, by descending powers of two
    left, right = suffix[:-1], suffix[1:]
    same = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[same], right[same]
    common = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        pa_, pb_ = a + common, b + common
        ok = (pa_ < stop[a]) & (pb_ < stop[b])
        ranks = levels[level]
        hit = ok & (ranks[np.minimum(pa_, n - 1)] == ranks[np.minimum(pb_, n - 1)])
        common[hit] += 1 << level
        # equal ranks at a level mean equal prefixes of that length, or of all that is left of both
    common = np.minimum(common, np.minimum(stop[a] - a, stop[b] - b))
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(best: np.ndarray, at_least: int) -> np.ndarray:
    """Words in the union of the repeated spans of ``at_least`` words or more."""
    n = len(best)
    at = np.flatnonzero(best >= at_least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + best[at], n), -1)
    return np.cumsum(change[:-1]) > 0


def _windows(best: np.ndarray, size: int) -> np.ndarray:
    """Words in windows of ``size`` words that occur twice or more."""
    at = np.flatnonzero(best >= size)
    hit = np.zeros(len(best), bool)
    for k in range(size):
        hit[at + k] = True
    return hit


def judge(texts: list[str], min_words: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    w = Words(texts)
    best = longest_repeats(w.hashes(), w.doc, w.offset)
    n_docs = len(texts)
    count = np.diff(w.offset)
    tally = lambda flags: np.bincount(w.doc[flags], minlength=n_docs).astype(np.int64)
    cover = tally(covered(best, min_words))
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc, best)
    repeat = tally(_windows(best, 3))
    lines = np.zeros(n_docs, np.int64)
    for i, text in enumerate(texts):
        if "\n" in text:
            worded = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[i] = len(worded) - len(set(worded))
    symbols = _SYMBOLS[np.minimum(w.cp, 127)] & (w.cp < 127)
    failed = (count < 50) | (100 * repeat > 50 * count)
    good = (cover <= max_covered * count) & (longest <= max_repeat)
    return {
        "n_words": count.astype(np.int64),
        "word_chars": w.per_text(w.inside),
        "n_symbols": w.per_text(symbols),
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": ~failed & good,
        "covered_words": cover,
        "longest_repeat": longest,
    }


def assess(
    docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """One row of counts and verdicts per row of ``docs`` (columns doc_id, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            for at, some in batches(texts):
                found = judge(some, min_words, max_covered, max_repeat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(some)), *(pa.array(v) for v in found.values())], ["doc_id", *found]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def filter_documents(
    docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """The rows of ``docs`` whose text passes, unchanged, in one pass without a join."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            kept = [judge(some, min_words, max_covered, max_repeat)["kept"] for _, some in batches(texts)]
            if kept:
                yield part.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
