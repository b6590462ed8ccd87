"""Document fingerprints: SimHash over weighted word shingles, searched with permuted block tables.

Terms are shingles of ``SHINGLE`` words (A-Z folded; a shorter text is one term). A term that occurs t times
weighs 1 + log2(t), and votes with that weight, signed, on each of 64 bits of its hash.

Null texts count as empty; a text without words has fingerprint 0. Rows with equal doc_id are ordered by a hash of
their text, so that "the next document" is defined; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.llm import cells
from plaintide.llm.textarrays import Words, batches, mix
from plaintide.llm.work import cut, join_groups, shuffle_partitions

SHINGLE = 3
#: Search radius in bits. Of the 48 pairs of different texts of sf0.1 with 5-word Jaccard of 0.8 or more, 5 lie within 3 bits,
#: 27 within 7 and all within 12, where the tables' keys would be too short.
RADIUS = 3
_TERM = np.uint64((1 << 48) - 1)

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def simhash(texts: list[str]) -> np.ndarray:
    """Fingerprints of a bounded list of texts."""
    w = Words(texts, fold_case=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(w.start):
        return out
    h = w.hashes()
    n = len(h)
    last = w.offset[1:][w.doc]
    at = np.arange(n)
    with np.errstate(over="ignore"):
        term = h.copy()
        for k in range(1, SHINGLE):
            there = at + k < last
            term[there] = mix(term[there] * np.uint64(0x9FB21C651E98DF25) + h[at[there] + k])
    starts = (at == w.offset[:-1][w.doc]) | (at + SHINGLE <= last)
    # the text in the high bits, the term in the low: one sort counts the terms of every text
    key = np.sort((w.doc[starts].astype(np.uint64) << np.uint64(48)) | (term[starts] & _TERM))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.concatenate((head, [len(key)])))
    key = key[head]
    weight = (1 + np.log2(times)).astype(np.float32)
    bits = np.unpackbits(mix(key & _TERM).astype(">u8").view(np.uint8)).reshape(-1, 64)
    doc = (key >> np.uint64(48)).astype(np.int64)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.unique(doc):
        a, b = edge[d], edge[d + 1]
        votes = weight[a:b] @ bits[a:b].astype(np.float32)
        out[d] = np.packbits(2 * votes > weight[a:b].sum()).view(">u8")[0]
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    found = [simhash(part) for _, some in batches(texts) for part in (some[i : i + 60000] for i in range(0, len(some), 60000))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal fingerprints, 0 for complements."""
    return 1.0 - np.bitwise_count(a ^ b) / 64.0


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and its signed 64-bit ``code``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            codes = fingerprints(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, code long")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (see module queries), with their likeness.

    Texts are shuffled once, into doc_id ranges in ascending order, so that the next document is the row before. Only the first row of each
    range has its next one elsewhere: it is set aside with the last row of its range, and those few rows meet afterwards. As many ranges
    as shuffle partitions; no bounds and no rows reach the driver.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    ranges = slim.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = ranges.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[str, int] | None = None  # text and fingerprint of the row below
        last = None
        for batch in parts:
            number, ids = batch.column(0), batch.column(1)
            for at, texts in batches(batch.column(2).to_pylist()):
                codes = fingerprints(texts)
                last = [number[at].as_py(), ids[at + len(texts) - 1].as_py(), texts[-1], int(codes[-1])]
                skip = 0
                if before is None:
                    yield _edge(FIRST, last[0], ids[at].as_py(), texts[0], codes[0])
                    skip = 1
                    before = (texts[0], codes[0])
                nexts = [before[0], *texts[skip:-1]] if len(texts) > skip else []
                next_codes = np.array([before[1], *codes[skip:-1]], np.uint64) if nexts else codes[:0]
                before = (texts[-1], codes[-1])
                if nexts:
                    made = _compared(texts[skip:], codes[skip:], nexts, next_codes)
                    none = pa.nulls(len(nexts), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.zeros(len(nexts), np.int32)), number.slice(at + skip, len(nexts)), ids.slice(at + skip, len(nexts)), none, pa.nulls(len(nexts), pa.int64()), *made], _EDGED
                    )
        if last:
            yield _edge(LAST, *last)

    done = cut(rows.mapInArrow(run, f"kind int, part int, doc_id long, text string, code long, {_MADE}"), "compared")
    # the range before, by number; the lowest gets the highest
    lasts = done.where(F.col("kind") == LAST)
    numbers = lasts.select(F.col("part").alias("at"))
    before = F.coalesce(F.lag("at").over(W.orderBy("at")), F.max("at").over(W.partitionBy()))
    firsts = done.where(F.col("kind") == FIRST).join(numbers.select("at", before.alias("below")), F.col("part") == F.col("at"))
    pairs = firsts.select("doc_id", "text", "code", "below").join(lasts.select(F.col("part").alias("below"), F.col("text").alias("next_text"), F.col("code").alias("next_code")), "below")

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            codes = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 4)]
            made = _compared([x or "" for x in batch.column(1).to_pylist()], codes[0], [x or "" for x in batch.column(3).to_pylist()], codes[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], _NAMES)

    edges = pairs.select("doc_id", "text", "code", "next_text", "next_code").mapInArrow(meet, SCHEMA)
    return done.where(F.col("kind") == ROW).select(*_NAMES).unionByName(edges)


ROW, FIRST, LAST = 0, 1, 2
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_MADE = SCHEMA.split(", ", 1)[1]
_EDGED = ["kind", "part", "doc_id", "text", "code", *_NAMES[1:]]


def _edge(kind: int, part: int, doc_id: int | None, text: str, code: int) -> pa.RecordBatch:
    """A row of a range's end, with its text and without a result."""
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    code = int(code) - (int(code) >> 63 << 64)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([text], pa.string()), pa.array([code], pa.int64()), *(pa.nulls(1, x) for x in kinds)], _EDGED
    )


def _compared(texts: list[str], codes: np.ndarray, nexts: list[str], next_codes: np.ndarray) -> list[pa.Array]:
    """The columns of ``SCHEMA`` after doc_id, for texts and the texts that come next."""
    edited = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for text, after in zip(texts, nexts, strict=True)]
    changed = fingerprints(edited)
    return [
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
        pa.array([f"{x:016x}" for x in codes], pa.string()),
        pa.array([f"{x:016x}" for x in changed], pa.string()),
        pa.array(likeness(codes, changed)),
        pa.array(likeness(codes, next_codes)),
    ]


def blocks_for(codes: int, radius: int) -> int:
    """The least number of blocks whose leading bits can number so many fingerprints: a cell then holds few by chance.

    Any number above ``radius`` finds the same pairs.
    """
    bits = max(codes, 2).bit_length()
    return next((b for b in range(radius + 2, 3 * radius + 3) if 64 * (b - radius) // b >= bits), 3 * radius + 3)


def block_entries(codes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows of ``codes`` under every permuted block table: table number and the leading blocks as key.

    Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of the blocks, so the
    tables, one for each choice of so many blocks to lead, find every such pair.
    """
    edge = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edge[b + 1]) - (1 << edge[b])) for b in lead) for lead in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.posexplode(F.transform(F.array(*map(F.lit, signed)), lambda m: m.bitwiseAND(F.col("code"))))
    return codes.select("*", table.alias("table", "lead"))


def search(docs: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Pairs (code, near): for each distinct ``code`` of ``queries`` every other code of ``docs`` within ``radius``, once.

    Cells without a query's code are dropped as soon as they are counted. In the others queries meet codes, in chunks of both, so
    a hot cell is shared by many units of work. A pair that meets in several tables is kept in the first of them only.
    """
    codes = docs.select("code", F.lit(0).alias("asks")).union(queries.select("code", F.lit(1).alias("asks")))
    marked = cut(codes.groupBy("code").agg(F.max("asks").alias("asks")), "marked")
    blocks = blocks or blocks_for(marked.count(), radius)
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [np.uint64((1 << edge[b + 1]) - (1 << edge[b])) for b in range(blocks)]
    leads = list(combinations(range(blocks), blocks - radius))
    # by the set of blocks that agree, the first table that finds the pair
    first = np.array([next((t for t, lead in enumerate(leads) if all(agree >> b & 1 for b in lead)), -1) for agree in range(1 << blocks)])
    keys = ["table", "lead"]

    def work(columns: dict[str, np.ndarray], start: np.ndarray) -> list[np.ndarray]:
        code, asks, table = columns["code"].view(np.uint64), columns["asks"], columns["table"]
        sizes = np.diff(start)
        known = np.add.reduceat(1 - asks, start[:-1]).astype(np.int64)  # they stand before those that ask
        begin, many = np.repeat(start[:-1], sizes), np.repeat(known, sizes)
        i = np.flatnonzero(asks == 1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = 0
        while len(i := i[many[i] > step]):
            j = begin[i] + step
            x = code[i] ^ code[j]
            near = np.flatnonzero((x != 0) & (np.bitwise_count(x) <= radius))
            a, b, x = i[near], j[near], x[near]
            agree = sum((((x & m) == 0).astype(np.int64) << k for k, m in enumerate(block)), np.zeros(len(x), np.int64))
            own = first[agree] == table[a]
            left.append(a[own])
            right.append(b[own])
            step += 1
        return [code[np.concatenate(x)].view(np.int64) for x in (left, right)]

    return cells.run_units(cells.asked_units(block_entries(marked, radius, blocks), keys), keys, work, "code long, near long", ("asks",))


def neighbours(docs: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """For each row of ``queries`` the fingerprints of ``docs`` within ``radius``, its own among them; both have doc_id and code.

    A fingerprint comes with ``near_doc_id``, the smallest doc_id that has it, and ``near_rows``, how many rows do; so copies of a
    neighbour, or of the query itself, are one row.
    """
    classes = docs.groupBy("code").agg(F.min("doc_id").alias("near_doc_id"), F.count(F.lit(1)).alias("near_rows"))
    others = search(docs, queries, radius, blocks)
    pairs = cut(others.union(queries.select("code", F.col("code").alias("near")).distinct()), "pairs")
    named = pairs.join(classes.withColumnRenamed("code", "near"), "near")
    found = queries.select("doc_id", "code").join(named, "code")
    as_text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return found.select("doc_id", as_text("code").alias("fingerprint"), as_text("near").alias("near_fingerprint"), "near_doc_id", "near_rows", F.bit_count(F.col("code").bitwiseXOR(F.col("near"))).alias("distance"))


def compare_and_search(docs: DataFrame, every: int = 20, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """:func:`compare_edited`, and for rows whose doc_id is divisible by ``every`` what all rows hold near them; null for the rest.

    ``n_near`` counts the other fingerprints within ``radius``, ``near_ids`` names each by the smallest doc_id that has it (ascending, null
    first), and ``n_same`` counts the rows with the row's own fingerprint, itself included.
    """
    done = cut(compare_edited(docs).withColumn("code", F.conv("fingerprint", 16, -10).cast("long")), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    asking = done.where(asks)
    found = cut(search(done, asking, radius, blocks), "near")
    # classes of those that ask or were found; the rest need no name. Copies are counted before they are shuffled
    wanted = asking.select("code").union(found.select("near")).distinct()
    classes = done.groupBy("code").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    classes = cut(classes.join(wanted, "code", "left_semi"), "classes")
    near = found.join(classes.select(F.col("code").alias("near"), "first_id"), "near").groupBy("code").agg(F.sort_array(F.collect_list(F.struct("first_id"))).alias("list"))
    asked = asking.groupBy("code").agg(F.count(F.lit(1)).alias("asking"))
    told = asked.join(classes, "code").join(near, "code", "left").select(F.col("code").alias("of"), F.col("rows").alias("n_same"), F.coalesce(F.col("list")["first_id"], F.array().cast("array<long>")).alias("near_ids"), "asking")
    told = cut(told, "told")
    values = told.agg(F.coalesce(F.sum(F.size("near_ids") + 2), F.lit(0)).alias("n")).first()["n"]
    joined = join_groups(asking, F.col("code"), F.col("doc_id"), told.drop("asking"), "of", values, told.select("of", F.col("asking").alias("rows")))
    rest = done.where(~asks).select(*_NAMES, *(F.lit(None).cast(t).alias(c) for c, t in (("n_near", "long"), ("n_same", "long"), ("near_ids", "array<long>"))))
    return joined.select(*_NAMES, F.size("near_ids").cast("long").alias("n_near"), "n_same", "near_ids").unionByName(rest)
