"""SimHash near-dedup: fingerprints linked within a Hamming radius, and their components.

Fingerprints: words of the text with A-Z folded, 4-word shingles with repeats (a shorter text is one shingle), XXH64
seed 42 of each; a bit is set if it is set in over half of the hashes. Texts without words have fingerprint 0.

Linking: each fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors never
exceeds the fingerprints' own distance. The segments are cut into three parts; of a distance of at most 4, two parts together have at most
2. For each choice of two parts, the grid's cells are the vectors over them, and cells up to distance 2 apart are range-joined: every
fingerprint stands in its own cell and in all cells at distance 1, so that two meet where one lies between them. That is about 100 cells a
fingerprint, of 32 bits of information. A pair is taken in one cell only, held against the Manhattan bound over all segments,
then verified exactly.

Null texts count as empty. Repeated rows and equal texts share a fingerprint and are linked. Null doc_ids are ignored
as component names unless a component has no other, and then it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.llm import cells
from plaintide.llm.work import cut, join_groups, shuffle_partitions

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Segments of two bits where the parts begin, and the end; pairs of parts that lead; most distance within the parts that lead.
PARTS, LEADS, REACH = (0, 11, 22, 32), ((0, 1), (0, 2), (1, 2)), 2
_ODD = 0x5555555555555555


def fingerprint(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass").lower().split()
    raw = [x for x in raw if x]
    if not raw:
        return 0
    joined = b" ".join(raw)
    digest = xxhash.xxh64_intdigest
    if len(raw) <= SHINGLE:
        return digest(joined, SEED)
    end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    stops = end[SHINGLE - 1 :].tolist()
    begins = [0, *(end[: len(end) - SHINGLE] + 1).tolist()]
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h)).view(">u8")[0])


def with_codes(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit ``code``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            codes = np.fromiter((fingerprint(x or "") for x in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, code long")


def code_of(text: Column) -> Column:
    """The signed fingerprint of each text, for the few rows that are placed one by one."""
    return F.udf(lambda x: (c := fingerprint(x or "")) - (c >> 63 << 64), "long")(text.cast("string"))


def embed(code: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments in unary: 0, 1 and 2 as 00, 01 and 11."""
    odd, one = np.uint64(_ODD), np.uint64(1)
    high = code >> one
    return ((code | high) & odd) | (((code & high) & odd) << one)


def lead_masks() -> list[int]:
    """The bits of the parts that lead, by choice."""
    part = [(1 << 2 * PARTS[i + 1]) - (1 << 2 * PARTS[i]) for i in range(len(PARTS) - 1)]
    return [part[a] | part[b] for a, b in LEADS]


def grid(codes: DataFrame) -> DataFrame:
    """Every code in its cell of each choice of parts, and in the cells next to it: columns choice, cell, code.

    A cell is a vector of counts in unary. One bit of a segment turns into a count one up or down where the result is unary again: the low bit while
    the high one is 0, the high bit while the low one is 1.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in lead_masks()]
    high = F.shiftrightunsigned("code", 1)
    unary = F.col("code").bitwiseOR(high).bitwiseAND(F.lit(_ODD)).bitwiseOR(F.shiftleft(F.col("code").bitwiseAND(high).bitwiseAND(F.lit(_ODD)), 1))
    lead = F.posexplode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.struct(m.alias("mask"), m.bitwiseAND(F.col("counts")).alias("own"))))
    led = codes.select("code", unary.alias("counts")).select("code", lead.alias("choice", "led")).select("code", "choice", "led.mask", "led.own")
    turns = F.expr("filter(sequence(0, 63), j -> (shiftright(mask, j) & 1) = 1 AND IF(j % 2 = 0, (shiftright(own, j + 1) & 1) = 0, (shiftright(own, j - 1) & 1) = 1))")
    near = F.transform(turns, lambda j: F.col("own").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))
    return led.select("choice", F.explode(F.concat(F.array("own"), near)).alias("cell"), "code")


def meet(radius: int = RADIUS) -> Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    """Whether two rows of a unit are linked, and theirs is the one cell that tells: of the first choice within reach, the cell of the smaller code
    if they are at most 1 apart, else the cell one step from it towards the other, in the lowest segment that differs."""
    masks = np.array(lead_masks(), np.uint64)
    one = np.uint64(1)

    def accept(columns: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        code = columns["code"]
        a, b = np.minimum(code[i], code[j]).view(np.uint64), np.maximum(code[i], code[j]).view(np.uint64)
        low, other = embed(a), embed(b)
        x = low ^ other
        ok = np.flatnonzero(np.bitwise_count(x) <= radius)  # the Manhattan bound
        out = np.zeros(len(i), bool)
        a, b, low, x, choice = a[ok], b[ok], low[ok], x[ok], columns["choice"][i[ok]]
        reach = np.stack([np.bitwise_count(x & m) <= REACH for m in masks])
        told = reach.argmax(0) == choice
        x &= masks[choice]
        step = x & (~x + one)  # the lowest bit that differs
        both = (x & (step << one) != 0) & (step & np.uint64(_ODD) != 0) & (low & step != 0)  # from 2 down to 0: the high bit goes first
        cell = (low & masks[choice]) ^ np.where(np.bitwise_count(x) == 2, np.where(both, step << one, step), np.uint64(0))
        out[ok] = told & (cell == columns["cell"][i[ok]].view(np.uint64)) & (np.bitwise_count(a ^ b) <= radius)
        return out

    return accept


def linked_codes(codes: DataFrame, radius: int = RADIUS, chunk: int = cells.CHUNK) -> DataFrame:
    """Links ``a < b`` that connect the distinct ``codes`` as all pairs within ``radius`` do."""
    if 2 * radius // 3 > REACH:
        raise ValueError(f"a radius of {radius} bits is beyond the range join")
    keys = ["choice", "cell"]
    # a code becomes about 100 rows: few and small as the codes are, every task gets its share of that
    dealt = codes.repartition(shuffle_partitions(codes.sparkSession), "code")
    return cells.links(cells.units(grid(dealt), keys, chunk=chunk), keys, meet(radius))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component, for nodes with an edge: columns node, root.

    Each round points every node at its least neighbour, doubles the pointers until they end at nodes that point at themselves, and contracts;
    so at least half of the nodes go, and a chain takes as many jumps as its length has digits. Only sizes reach the driver. A
    root with many nodes is a hot key of the joins by root, which are broadcast or salted (:func:`plaintide.llm.work.join_groups`).
    """
    links = cut(edges.where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        step = cut(step, "step")
        n = step.count()
        moving = True
        while moving:
            jumped = cut(_through(step, "root", step, "step", n).select("node", F.col("step").alias("root"), (F.col("step") != F.col("root")).alias("moved")), "step")
            step, moving = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        labels = step if labels is None else cut(_through(labels, "root", step, "step", n).select("node", F.coalesce("step", "root").alias("root")), "labels")
        moved = _through(_through(links, "a", step, "x", n), "b", step, "y", n)
        links = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _through(rows: DataFrame, column: str, step: DataFrame, name: str, nodes: int) -> DataFrame:
    """``rows`` with ``name``: where ``step`` (node, root), of so many ``nodes``, leads from ``column``."""
    to = step.select(F.col("node").alias("__pt_node"), F.col("root").alias(name))
    sizes = rows.groupBy(F.col(column).alias("__pt_node")).agg(F.count(F.lit(1)).alias("rows"))
    by = next(c for c in rows.columns if c != column)
    return join_groups(rows, F.col(column), F.col(by), to, "__pt_node", 2 * nodes, sizes).drop("__pt_node")


def link_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, code, component_id: the smallest doc_id reachable over links, its own included."""
    return _linked(docs, radius).select("doc_id", "code", "component_id")


def _linked(docs: DataFrame, radius: int) -> DataFrame:
    """:func:`link_documents` with ``root``, a code that names the component whether or not it has a doc_id."""
    coded = cut(with_codes(docs), "codes")
    known = cut(coded.groupBy("code").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "known")
    roots = components(linked_codes(known.select("code"), radius))
    placed = cut(known.join(roots, F.col("code") == F.col("node"), "left").select("code", "first_id", "rows", F.coalesce("root", "code").alias("root")), "placed")
    least = placed.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("codes"))
    # a component of one code is its own answer; the others have a row each
    many = cut(least.where("codes > 1"), "least")
    named = join_groups(placed, F.col("root"), F.col("code"), many.select("of_root", "component_id"), "of_root", 2 * many.count(), many.select("of_root", F.col("codes").alias("rows")))
    names = cut(named.select(F.col("code").alias("of"), "root", F.when(F.col("of_root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"), "rows"), "names")
    to_rows = join_groups(coded, F.col("code"), F.col("doc_id"), names.drop("rows"), "of", 3 * known.count(), names.select("of", "rows"))
    return cut(to_rows.select("doc_id", "code", "root", "component_id"), "linked")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, equal rows once.

    The rows that go are fewer than those that stay, so ``docs`` is joined against them. Rows that share a doc_id but not their text
    count as one document each, and are told apart by their fingerprints. Rows without a doc_id
    give one row a component, besides the row that has its doc_id.
    """
    linked = _linked(docs, radius)
    repeated = linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    repeated = cut(repeated.select(F.col("doc_id").alias("__pt_id")), "repeated")
    gone = cut(linked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__pt_gone")).distinct(), "gone")
    once = docs.join(gone, F.col("doc_id") == F.col("__pt_gone"), "left_anti")
    if repeated.isEmpty():
        return once
    same = F.col("doc_id").eqNullSafe(F.col("__pt_id"))
    placed = linked.join(repeated, same, "left_semi").select(F.col("doc_id").alias("__pt_id"), F.col("code").alias("__pt_of"), F.col("root").alias("__pt_root"), F.col("component_id").alias("__pt_component")).distinct()
    odd = docs.join(repeated, same, "left_semi").withColumn("__pt_code", code_of(F.col("text"))).join(placed, same & (F.col("__pt_code") == F.col("__pt_of")))
    named = odd.where(F.col("doc_id") == F.col("__pt_component")).select(docs.columns).dropDuplicates(["doc_id", "text"])
    unnamed = odd.where(F.col("doc_id").isNull()).groupBy("__pt_root").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row")).select("row.*")
    return once.join(repeated, same, "left_anti").unionByName(named).unionByName(unnamed)
