"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics come from the text alone. Per class, counts, sums and cross products are summed over all labelled rows on the
executors; the driver gets two small matrices. Each class covariance is shrunk towards a diagonal of the pooled
variances, its Cholesky factor is taken once, and a score is the logistic of the difference of the two log
densities plus the log prior odds, tempered.

Null and empty texts get the statistics of an empty text. Labels that are null are not used; a document labelled twice
counts once per label. With fewer than two rows of a class every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.llm.textarrays import Words, batches
from plaintide.llm.work import cut

#: Weight of the diagonal target in each covariance; variance added to every statistic; divisor of the log odds.
SHRINK, FLOOR, TEMPER = 0.10, 1e-3, 4.0
THRESHOLD, FOLDS = 0.3, 5
#: Characters of a word that count in its length.
LONGEST = 16
NAMES = ("words", "word_length", "length_spread", "upper", "symbols", "other_marks", "shouted", "ends_marked", "distinct", "repeated_next", "line_words", "bars")


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics per text."""
    w = Words(texts)
    n = len(texts)
    count = np.diff(w.offset).astype(np.float64)
    some = np.maximum(count, 1)
    # a key or number of many characters says little about the prose around it
    size = np.minimum(w.end - w.start, LONGEST).astype(np.float64)
    by_word = lambda x: np.bincount(w.doc, x, n)
    mean = by_word(size) / some
    spread = np.sqrt(np.maximum(by_word(size * size) / some - mean * mean, 0))
    chars = np.maximum(w.per_text(w.inside), 1)
    cp = w.cp
    upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE))
    lower = ((cp >= 97) & (cp <= 122)) | (cp >= 0xDF)
    digit = (cp >= 48) & (cp <= 57)
    plain = (cp == 44) | (cp == 46)
    bar = cp == 124
    symbol = np.isin(cp, [ord(c) for c in "#*$%&<>"])
    other = w.inside & ~(upper | lower | digit | plain | bar | symbol)
    share = lambda flags: np.sqrt(w.per_text(flags) / chars)
    total = np.concatenate(([0], np.cumsum(upper)))
    last = cp[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint32)
    letters = np.concatenate(([0], np.cumsum(lower)))
    shouted = ((total[w.end] - total[w.start]) > 1) & ((letters[w.end] - letters[w.start]) == 0)
    marked = ~((last >= 48) & (last <= 57) | (last >= 65) & (last <= 90) | (last >= 97) & (last <= 122) | (last >= 0xC0) | (last == 44) | (last == 46))
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1]))) if len(h) else np.zeros(0, bool)
    distinct = np.bincount(w.doc[order][fresh], minlength=n) / some
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    rows = w.per_text(cp == 10) + 1
    return np.column_stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(spread), share(upper), share(symbol), share(other),
            np.sqrt(by_word(shouted.astype(float)) / some), np.sqrt(by_word(marked.astype(float)) / some),
            distinct * np.log1p(count), np.sqrt(by_word(again.astype(float)) / some), np.log1p(count / rows), share(bar),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics ``x``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            for at, some in batches(texts):
                x = statistics(some)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(some)), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve ``factor z = b`` for a lower triangular factor, row by row over all columns of ``b``."""
    z = np.empty_like(b)
    for i in range(len(b)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Means, Cholesky factors of the class covariances, their log determinants, and the log prior odds."""

    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_det: list[float]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factor:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        density = []
        for mean, factor, log_det in zip(self.mean, self.factor, self.log_det, strict=True):
            z = _forward(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(0) - 0.5 * log_det)
        odds = (density[1] - density[0]) / TEMPER + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(labelled: DataFrame, shrink: float = SHRINK, floor: float = FLOOR) -> Discriminant:
    """``labelled`` has statistics ``x`` and ``label`` 0 or 1. All rows count; sums are made where the rows are."""
    d = len(NAMES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for part in parts:
            if part.num_rows:
                x = np.array(part.column(0).to_pylist(), np.float64).reshape(-1, d)
                label = part.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[label == c]
                    sums[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        n = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(sums.ravel())], ["label", "i", "v"])

    parts = labelled.select("x", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, i int, v double")
    sums = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) rows
        sums[r["label"], r["i"]] = r["v"]
    n = sums[:, 0]
    odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if n.min() < 2:
        return Discriminant([], [], [], odds)
    mean = [sums[c, 1 : 1 + d] / n[c] for c in (0, 1)]
    spread = [sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = np.diag(sum(n[c] * np.diag(spread[c]) for c in (0, 1)) / n.sum())
    shrunk = [(1 - shrink) * spread[c] + shrink * pooled + floor * np.eye(d) for c in (0, 1)]
    factor = [np.linalg.cholesky(s) for s in shrunk]
    return Discriminant(mean, factor, [2 * float(np.log(np.diag(f)).sum()) for f in factor], odds)


def score(measured: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array(part.column(1).to_pylist(), np.float64).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, score every document."""
    measured = cut(with_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(~held_out("of"))
    model = fit(measured.join(known, F.col("doc_id") == F.col("of")).select("x", "label"))
    return score(measured, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
