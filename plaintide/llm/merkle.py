"""Merkle manifest of a dataset: a 16-ary tree per source, a tree over the sources, and every row's authentication path.

A leaf is the SHA-256 of a row's fields. Leaves stand by doc_id within their source; while there are several nodes, every run of 16 (the last may be
shorter, even a single one) becomes the hash of its hex digests. The subroots, by source, are joined in the same way.

Leaves are numbered within their source by range partitions and the sizes of the ranges before, and cut into aligned blocks of 16**3. Blocks are the
units of work: first treehash turns each into its root, and the small trees above the blocks and the sources are built
level by level as grouped hashes of up to 16 rows. Then each block is walked leaf by leaf: a level keeps the run of siblings that holds for
the present leaf, and a treehash stack that takes one leaf a step and so has the next run ready when the walk crosses into it; a walk holds 32 digests a level.
To the siblings inside the block the path above it is appended, which all of a block's leaves share.
Only paths of blocks are ever tables; those of leaves are hashed where they arise.

Null fields are ``-``; rows without a source are a source of their own, the first; rows without a doc_id stand first in their source and are never tampered
with. Rows that share a doc_id stand by their leaf's digest; equal rows have equal leaves, each with a place and a proof of its own.
An empty table has no rows and no root. Other columns are not hashed and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaintide.llm.work import cut, shuffle_partitions

ARITY, BLOCK_LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BITS = ARITY.bit_length() - 1


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def depth_of(leaves: int) -> int:
    """Levels of hashing over so many leaves: none over one."""
    depth = 0
    while ARITY**depth < leaves:
        depth += 1
    return depth


class Treehash:
    """Nodes of one height from leaves given one by one: a stack with up to a run of nodes a height."""

    def __init__(self, height: int) -> None:
        self.stack: list[list[str]] = [[] for _ in range(height + 1)]

    def update(self, leaf: str) -> None:
        level, digest = 0, leaf
        while True:
            held = self.stack[level]
            held.append(digest)
            if level + 1 == len(self.stack) or len(held) < ARITY:
                return
            digest, level = node(held), level + 1
            held.clear()

    def finish(self) -> list[str]:
        """The nodes of the height, a shorter run at the end of the leaves included."""
        for level, held in enumerate(self.stack[:-1]):
            if held:
                self.stack[level + 1].append(node(held))
                held.clear()
        return self.stack[-1]


def block_root(leaves: list[str], levels: int) -> str:
    """The node that ``levels`` levels over a block's leaves lead to."""
    tree = Treehash(levels)
    for leaf in leaves:
        tree.update(leaf)
    return tree.finish()[0]


class Traversal:
    """Runs of siblings of a block's leaves, one leaf after the other.

    ``leaf(i)`` gives the digest of leaf ``i`` of ``count``. Before leaf i, ``runs[h]`` is the run of 16 nodes of height h that holds i's ancestor; the next
    run's treehash has been given one leaf of that run for each leaf passed of the present one.
    """

    def __init__(self, leaf: Callable[[int], str], count: int, levels: int) -> None:
        self.leaf, self.count, self.levels, self.at = leaf, count, levels, 0
        self.runs = [self._first(h) for h in range(levels)]
        self._next = [Treehash(h) for h in range(levels)]

    def _first(self, height: int) -> list[str]:
        tree = Treehash(height)
        for i in range(min(self.count, ARITY ** (height + 1))):
            tree.update(self.leaf(i))
        return tree.finish()

    def place(self, height: int) -> int:
        """Place of the present leaf's ancestor in its run."""
        return (self.at >> _BITS * height) % ARITY

    def advance(self) -> None:
        self.at += 1
        for height in range(self.levels):
            span = ARITY ** (height + 1)
            ahead = self.at - 1 + span
            if ahead < self.count:
                self._next[height].update(self.leaf(ahead))
            if self.at % span == 0:
                self.runs[height] = self._next[height].finish()
                self._next[height] = Treehash(height)


class Step(NamedTuple):
    """Siblings to the left and right of a node, as concatenated digests."""

    left: str
    right: str


def fold(digest: str, steps: list[Step]) -> str:
    for left, right in steps:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def proof(steps: list[Step]) -> str:
    return hashlib.sha256("".join(left + right for left, right in steps).encode()).hexdigest()


def leaf_digest(columns: dict[str, Column], fields: tuple[str, ...] = FIELDS) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value, or ``-``."""
    said = [columns[f].cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in said)), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (site, doc_id, leaf, ...) with ``place`` from 0 within their site.

    The rows are written once with their range and their place in it, so that the sizes of the ranges, of which there
    is a row for each range and site in it, agree with the rows.
    """
    order = ["site", "doc_id", "leaf"]
    ranged = leaves.repartitionByRange(shuffle_partitions(leaves.sparkSession), *order).withColumn("range", F.spark_partition_id())
    local = cut(ranged.withColumn("local", F.row_number().over(W.partitionBy("range", "site").orderBy("doc_id", "leaf")) - 1), "leaves")
    sizes = local.groupBy("site", "range").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("site").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(W.partitionBy("site"))
    ranges = cut(sizes.select(F.col("site").alias("of"), F.col("range").alias("in_range"), before.alias("before"), total.alias("leaves")), "ranges")
    joined = local.join(ranges, (F.col("site") == F.col("of")) & (F.col("range") == F.col("in_range")))
    return joined.withColumn("place", F.col("local") + F.col("before")).drop("range", "local", "of", "in_range", "before")


class Upper(NamedTuple):
    """A forest of small trees: its roots (tree, root) and every first node's path (tree, place, path)."""

    roots: DataFrame
    paths: DataFrame


def _upper(nodes: DataFrame) -> Upper:
    """Trees over ``nodes`` (tree, place from 0, digest, whole: nodes of the tree), level by level.

    A group is a run of up to 16 nodes; a tree is done when it has one. A level has a sixteenth of the rows of the one below.
    """
    nodes = cut(nodes, "nodes")
    paths = nodes.select("tree", "place", F.col("place").alias("at"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    roots = nodes.where("whole = 1").select("tree", F.col("digest").alias("root"))
    level = nodes.where("whole > 1")
    while not level.isEmpty():
        run = F.shiftright("place", _BITS)
        digests = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
        runs = cut(level.groupBy("tree", run.alias("run"), F.ceil(F.col("whole") / ARITY).cast("long").alias("whole")).agg(digests.alias("digests")), "runs")
        of = runs.select(F.col("tree").alias("of"), "run", "digests")
        there = F.pmod("at", F.lit(ARITY)).cast("int")
        left = F.array_join(F.slice("digests", F.lit(1), there), "")
        right = F.array_join(F.slice("digests", there + 2, F.lit(ARITY)), "")
        step = F.when(F.col("digests").isNotNull(), F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array())
        joined = paths.join(of, (F.col("tree") == F.col("of")) & (F.shiftright("at", _BITS) == F.col("run")), "left")
        paths = cut(joined.select("tree", "place", F.shiftright("at", _BITS).alias("at"), F.concat("path", step).alias("path")), "paths")
        above = runs.select("tree", F.col("run").alias("place"), F.sha2(F.array_join("digests", ""), 256).alias("digest"), "whole")
        roots = roots.union(above.where("whole = 1").select("tree", F.col("digest").alias("root")))
        level = above.where("whole > 1")
    return Upper(cut(roots, "roots"), paths.select("tree", "place", "path"))


def site_of(source: Column) -> Column:
    """A name that orders sources by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _strings(names: list[str]) -> pa.Schema:
    return pa.schema([(x, pa.string()) for x in names])


def manifest(docs: DataFrame, other: Column | None = None, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """The tree of ``docs``: its leaves, and the path of every block.

    Leaves have doc_id, site, leaf, place, block, levels and ``shown`` (the digest that is checked: ``leaf``, or that of the row with its
    text replaced by ``other`` where this is not null). Blocks have site, block, subroot, root and ``path`` (left, right), from the block to the root.
    """
    columns = {f: F.col(f) for f in fields}
    leaf = leaf_digest(columns, fields)
    shown = leaf if other is None else F.coalesce(F.when(other.isNotNull(), leaf_digest(columns | {"text": other}, fields)), leaf)
    slim = docs.select(site_of(F.col("source")).alias("site"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), shown.alias("shown"))
    placed = _numbered(cut(slim, "digests"))
    span = ARITY**BLOCK_LEVELS
    levels = F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK_LEVELS - 1)), F.lit(0), lambda n, h: n + (F.pow(F.lit(float(ARITY)), h) < F.col("leaves")).cast("int"))
    leaves = cut(placed.withColumn("levels", levels).withColumn("block", F.floor(F.col("place") / span).cast("long")), "placed")

    def root_of(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        digest = block_root(table["leaf"].to_pylist(), table["levels"][0].as_py())
        return pa.table({"site": [key[0].as_py()], "block": [key[1].as_py()], "digest": [digest], "leaves": table["leaves"].slice(0, 1)})

    found = leaves.select("site", "block", "place", "leaf", "levels", "leaves").groupBy("site", "block").applyInArrow(root_of, "site string, block long, digest string, leaves long")
    blocks = cut(found, "blocks")
    within = _upper(blocks.select(F.col("site").alias("tree"), F.col("block").alias("place"), "digest", F.ceil(F.col("leaves") / span).cast("long").alias("whole")))
    # sources are numbered like leaves: all of them are one tree
    sites = _numbered(within.roots.select(F.lit("").alias("site"), F.lit(None).cast("long").alias("doc_id"), F.col("tree").alias("leaf"), F.col("root").alias("subroot")))
    sites = cut(sites.select(F.col("leaf").alias("of"), "subroot", "place", F.col("leaves").alias("sites")), "sites")
    over = _upper(sites.select(F.lit("all").alias("tree"), "place", F.col("subroot").alias("digest"), F.col("sites").alias("whole")))
    above = over.paths.select(F.col("place").alias("there"), F.col("path").alias("above"))
    top = over.roots.select(F.col("tree").alias("all"), "root")  # one row
    named = sites.join(above, F.col("place") == F.col("there")).drop("place", "there").join(F.broadcast(top), F.col("all") == F.lit("all"))
    paths = within.paths.join(named, F.col("tree") == F.col("of"))
    return leaves, cut(paths.select(F.col("tree").alias("site"), F.col("place").alias("block"), "subroot", "root", F.concat("path", "above").alias("path")), "block-paths")


def prove(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root of what is shown, verified."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = pa.schema([("doc_id", pa.int64()), *_strings(names), ("verified", pa.bool_())])

    def walk(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        top = above.slice(0, 1).to_pylist()[0]
        upper = [Step(x["left"], x["right"]) for x in top["path"]]
        leaf, shown = own["leaf"].to_pylist(), own["shown"].to_pylist()
        walker = Traversal(leaf.__getitem__, len(leaf), own["levels"][0].as_py())
        proofs, folded = [], []
        for i in range(len(leaf)):
            steps = []
            for height, run in enumerate(walker.runs):
                at = walker.place(height)
                steps.append(Step("".join(run[:at]), "".join(run[at + 1 :])))
            steps += upper
            proofs.append(proof(steps))
            folded.append(fold(shown[i], steps))
            walker.advance()
        n = len(leaf)
        return pa.Table.from_arrays([own["doc_id"].combine_chunks(), *map(pa.array, (leaf, [top["subroot"]] * n, [top["root"]] * n, proofs, folded, [x == top["root"] for x in folded]))], schema=fields)

    schema = "doc_id long, " + ", ".join(f"{x} string" for x in names) + ", verified boolean"
    key = ["site", "block"]
    return leaves.select(*key, "place", "doc_id", "leaf", "shown", "levels").groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(walk, schema)


def lowered(every: int = 5) -> Column:
    """The text with A-Z folded in the rows that are tampered with, null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def check_tampered(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, held against a copy of the table in which some texts were changed."""
    return prove(*manifest(docs, lowered()))
