"""Embedding near-dedup: links of cosine ``least`` or more by a subspace pigeonhole join, with their counts and components.

Vectors are scaled to length 1, so a cosine of at least c is a squared distance of at most 2 - 2c. They are centred and rotated onto the principal axes of
all vectors; the axes are dealt to ``BLOCKS`` blocks in turn, so that each has directions of large and small variance. Each block has the share of the squared
distance that its variance has of the whole. Of two linked vectors at least one block is within its share.

Each block is joined by range on a grid over its leading axes, with cells of twice the block's radius: a vector stands in its own cell and visits
the cells that its ball reaches and that come after its own, so two vectors within reach meet in one cell of the block. Cells are cut into chunks, and two
chunks are a unit of work. A first pass sends the block's coordinates alone and keeps the vectors that have another within the block's share; only these, once for
each such unit, are sent whole. The second pass verifies all their pairs in double precision and counts a link in the first block that is
within its share. A unit gives for each vector how many it is linked with, and as many links as hold its components together, so neither pass gives a row for each pair.

Equal vectors are one class with its size as weight, so copies are counted and not paired. Null vectors, those with null, NaN or infinite components, and
zero and empty ones link with nothing. Vectors of different lengths are not compared. Rows that share a vec_id are rows of their own; rows without one are linked and counted,
are never kept, and name a component only if no other row of it has an id (then it is null). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.neardup import components
from plaintide.llm.work import cut, join_groups, shuffle_partitions

LEAST, BLOCKS, GRID = 0.95, 4, 6
#: Vectors of a chunk in the first pass, where 16 to 200 coordinates each are held, and in the second; rows of a tile of pairs.
CHUNK, EXACT_CHUNK, TILE = 16384, 2048, 1024
#: Room for rounding in the filters that come before the exact check.
_SLACK = 1e-5


def _unit(values: np.ndarray) -> np.ndarray | None:
    """The vector scaled to length 1, or None if it links with nothing."""
    if not len(values) or not np.isfinite(values).all():
        return None
    top = np.abs(values).max()
    if top == 0:
        return None
    scaled = values / top  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum())


def _doubles(part: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's values as doubles; None for null rows and those with null components."""
    for row in part:
        if not row.is_valid:
            yield None
            continue
        values = row.values
        yield None if values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0


def classes_of(vectors: DataFrame, vector: str = "embedding", name: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest; null digest: links with nothing) and classes of equal vectors (node, digest, first_id, size, vector)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests, raw = [], []
            for values in _doubles(part.column(1)):
                good = values is not None and _unit(values) is not None
                data = values.tobytes() if good else None
                raw.append(data)
                digests.append(blake2b(data, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "raw"])

    read = vectors.select(F.col(name).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "id long, digest binary, raw binary")
    rows = cut(read, "vectors")
    alike = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"), F.first("raw").alias("raw"))
    return rows.drop("raw"), cut(alike.withColumn("node", F.monotonically_increasing_id()), "classes")


class Rotation:
    """Principal axes of unit vectors of one length, dealt to blocks, with the blocks' shares of a squared distance."""

    def __init__(self, rows: int, total: np.ndarray, moments: np.ndarray, blocks: int) -> None:
        d = len(total)
        self.mean = total / max(rows, 1)
        variance, axes = np.linalg.eigh(moments / max(rows, 1) - np.outer(self.mean, self.mean))
        falling = np.argsort(-variance, kind="stable")
        blocks = min(blocks, d)
        order = np.concatenate([falling[b::blocks] for b in range(blocks)])
        self.axes = axes[:, order]
        self.edges = np.cumsum([0, *(len(range(b, d, blocks)) for b in range(blocks))])
        energy = np.add.reduceat(np.maximum(variance[order], 0.0) + 1e-12, self.edges[:-1])
        self.shares = energy / energy.sum()

    def place(self, units: np.ndarray) -> np.ndarray:
        return (units - self.mean) @ self.axes


def rotations(classes: DataFrame, blocks: int) -> dict[int, Rotation]:
    """By length, from the sums and second moments of all classes: a row a task and component, added up by component."""

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            by_length: dict[int, list[np.ndarray]] = {}
            for raw in part.column(0).to_pylist():
                values = _unit(np.frombuffer(raw))
                by_length.setdefault(len(values), []).append(values)
            for d, some in by_length.items():
                x = np.array(some)
                one = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                held[d] = held.get(d, 0) + one
        for d, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), d)), pa.array(np.arange(len(total))), pa.array(total)], ["length", "at", "value"])

    added = classes.select("raw").mapInArrow(sums, "length long, at long, value double").groupBy("length", "at").agg(F.sum("value").alias("value"))
    out = {}
    for d, group in added.toPandas().groupby("length"):
        flat = group.sort_values("at").value.to_numpy()
        d = int(d)
        out[d] = Rotation(int(round(flat[0])), flat[1 : d + 1], flat[d + 1 :].reshape(d, d), blocks)
    return out


def cells_of(coordinates: np.ndarray, radius: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell of each row, and (row, cell) of the later cells its ball reaches, on a grid over the leading ``grid`` axes."""
    x = coordinates[:, :grid]
    width = 2 * radius * (1 + 1e-6)  # so that a ball reaches one neighbour along an axis, the nearer
    own = np.floor(x / width).astype(np.int64)
    inside = x - own * width
    step = np.where(inside < width / 2, -1, 1)
    cost = np.minimum(inside, width - inside) ** 2
    spread = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 7 % (1 << 63) for k in range(x.shape[1])], np.int64)
    with np.errstate(over="ignore"):
        home = (own * spread).sum(1)
        subset = (np.arange(1, 1 << x.shape[1])[:, None] >> np.arange(x.shape[1])) & 1
        reached = cost @ subset.T <= radius * radius * (1 + 1e-6) + 1e-12
        row, turn = np.nonzero(reached)
        cell = home[row] + (step[row] * subset[turn] * spread).sum(1)
    later = cell > home[row]
    return home, row[later], cell[later]


def _blocks_table(row: np.ndarray, block: int, length: np.ndarray, cell: np.ndarray, visits: int, node: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    width = data.shape[1] * 4
    raw = np.ascontiguousarray(data[row], np.float32).tobytes()
    blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, (len(row) + 1) * width, width, dtype=np.int32)[: len(row) + 1].tobytes()), pa.py_buffer(raw)])
    fill = lambda x: pa.array(np.full(len(row), x, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(length), fill(block), pa.array(cell), fill(visits), pa.array(node[row]), blobs], ["length", "block", "cell", "visits", "node", "at"])


def entries(classes: DataFrame, turned: dict[int, Rotation], reach: float, grid: int) -> DataFrame:
    """A row for each cell that a class stands in or visits: length, block, cell, visits, node, at (the block's coordinates)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw, nodes = part.column(1).to_pylist(), part.column(0).to_numpy()
            sizes = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                for some in np.array_split(mine, len(mine) // TILE + 1):
                    if not len(some):
                        continue
                    turn, node = turned[d], nodes[some]
                    placed = turn.place(np.array([_unit(np.frombuffer(raw[i])) for i in some]))
                    for b, (lo, hi) in enumerate(zip(turn.edges, turn.edges[1:], strict=False)):
                        x = placed[:, lo:hi]
                        home, row, cell = cells_of(x, max(float(np.sqrt(reach * turn.shares[b])), 1e-6), grid)
                        yield _blocks_table(np.arange(len(some)), b, np.full(len(some), d), home, 0, node, x)
                        yield _blocks_table(row, b, np.full(len(row), d), cell, 1, node, x)

    dealt = classes.select("node", "raw").repartition(shuffle_partitions(classes.sparkSession), "node")
    return dealt.mapInArrow(run, "length long, block int, cell long, visits int, node long, at binary")


KEY = ["length", "block", "cell"]


def _chunked(rows: DataFrame, chunk: int, key: list[str]) -> DataFrame:
    """``rows`` dealt to units of two chunks of a cell: those that stand there meet each other and the visitors, visitors do not meet.

    Members are counted by grouped sums; the list of cells of more than a chunk is joined, so that a hot cell is cut before it is shuffled.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.when(F.col("visits") == 0, 1)).alias("stand"), F.count(F.lit(1)).alias("all"))
    large = cut(sizes.where(F.col("all") > chunk).select(*(F.col(k).alias(f"of_{k}") for k in key), "stand", "all"), "large")
    on = [F.col(k) == F.col(f"of_{k}") for k in key]
    counted = rows.join(large, on, "left").drop(*(f"of_{k}" for k in key))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(float(chunk)))).cast("int")
    stands = F.when(F.col("all").isNull(), 1).otherwise(parts("stand"))
    visiting = F.when(F.col("all").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("stand")) / F.lit(float(chunk)))).cast("int"))
    here = F.pmod(F.xxhash64("node"), stands).cast("int")
    there = F.pmod(F.xxhash64("node"), visiting).cast("int")
    # a pair of standing chunks is (smaller, larger); a standing chunk and a visiting one (standing, -1 - visiting); of small cells there is one unit
    met = F.transform(F.sequence(F.lit(0), stands - 1), lambda k: F.struct(F.least(k, here).alias("lo"), F.greatest(k, here).alias("hi")))
    guests = F.transform(F.sequence(F.lit(0), visiting - 1), lambda k: F.struct(here.alias("lo"), (-1 - k).cast("int").alias("hi")))
    hosts = F.transform(F.sequence(F.lit(0), stands - 1), lambda k: F.struct(k.alias("lo"), (-1 - there).cast("int").alias("hi")))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    units = F.when(F.col("all").isNull(), alone).when(F.col("visits") == 1, hosts).otherwise(F.concat(met, guests))
    return counted.withColumn("own", F.when(F.col("visits") == 1, -1 - there).otherwise(here).cast("int")).withColumn("unit", F.explode(units)).select(*rows.columns, "own", "unit.lo", "unit.hi")


def _pairs(own: np.ndarray, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The groups of rows that meet in a unit: one group with itself, or two with each other."""
    stand, visit = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
    if lo == hi == 0:
        return [(stand, stand), (stand, visit)]
    if hi < 0:
        return [(stand, visit)]
    if lo == hi:
        return [(stand, stand)]
    return [(np.flatnonzero(own == lo), np.flatnonzero(own == hi))]


def _tiles(groups: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Tiles of at most TILE by TILE rows; of a group with itself those on and above the diagonal."""
    for left, right in groups:
        same = left is right
        for a in range(0, len(left), TILE):
            for b in range(a if same else 0, len(right), TILE):
                yield left[a : a + TILE], right[b : b + TILE], same and a == b


def _whole_units(rows: DataFrame, work, schema: str, values: list[str]) -> DataFrame:
    """``work(unit, columns)`` over whole units (length, block, cell, lo, hi), which arrive sorted; one that spans two batches is carried over."""
    by = [*KEY, "lo", "hi"]
    names = [*by, *values]
    sorted_rows = rows.select(*names).repartition(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for part in parts:
            if not part.num_rows:
                continue
            keys = np.stack([part.column(i).to_numpy().astype(np.int64) for i in range(len(by))])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [part.num_rows]))
            for a, b in zip(starts, starts[1:], strict=False):
                unit = tuple(keys[:, a].tolist())
                if unit != last and held:
                    yield from work(last, pa.concat_tables(held))
                    held = []
                last = unit
                held.append(pa.Table.from_batches([part.slice(a, b - a)]))
        if held:
            yield from work(last, pa.concat_tables(held))

    return sorted_rows.mapInArrow(run, schema)


def _matrix(blobs: pa.ChunkedArray, kind: type) -> np.ndarray:
    data = blobs.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def near_in_block(dealt: DataFrame, turned: dict[int, Rotation], reach: float) -> DataFrame:
    """The rows of a unit that have another within the block's share: length, block, cell, visits, node."""
    shares = {d: turn.shares for d, turn in turned.items()}

    def work(unit: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        d, block, cell, lo, hi = unit
        x, own = _matrix(table["at"], np.float32), table["own"].to_numpy()
        square = (x * x).sum(1)
        most = np.float32(reach * shares[d][block] * (1 + 1e-4) + _SLACK)
        near = np.zeros(len(x), bool)
        for i, j, diagonal in _tiles(_pairs(own, lo, hi)):
            hit = square[i][:, None] + square[j] - 2 * (x[i] @ x[j].T) <= most
            if diagonal:
                np.fill_diagonal(hit, False)
            near[i] |= hit.any(1)
            near[j] |= hit.any(0)
        if near.any():
            kept = table.filter(pa.array(near)).select([*KEY, "visits", "node"]).combine_chunks()
            yield from kept.to_batches()

    return _whole_units(dealt, work, "length long, block int, cell long, visits int, node long", ["visits", "node", "own", "at"])


def linked_in_block(dealt: DataFrame, turned: dict[int, Rotation], reach: float, least: float) -> DataFrame:
    """Rows (a, b, links): how many a is linked with in a unit (b null), and links that hold the unit's components together (links 0)."""

    def work(unit: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        d, block, cell, lo, hi = unit
        turn = turned[d]
        units = np.array([_unit(np.frombuffer(x)) for x in table["raw"].to_pylist()])
        placed = np.stack([turn.place(u[None])[0] for u in units])  # row by row: the same for a vector in every unit
        node, size, own = table["node"].to_numpy(), table["size"].to_numpy(), table["own"].to_numpy()
        n = len(node)
        counts, label, left, right = np.zeros(n, np.int64), np.arange(n), [], []
        for i, j, diagonal in _tiles(_pairs(own, lo, hi)):
            p, q = np.nonzero(units[i] @ units[j].T >= least - 1e-9)
            p, q = i[p], j[q]
            if diagonal:
                p, q = p[p < q], q[p < q]
            for at in range(0, len(p), 1 << 14):
                a, b = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
                gap = np.add.reduceat((placed[a] - placed[b]) ** 2, turn.edges[:-1], axis=1) <= reach * turn.shares * (1 + 1e-9)
                told = (gap.argmax(1) == block) & ((units[a] * units[b]).sum(1) >= least)
                a, b = a[told], b[told]
                np.add.at(counts, a, size[b])
                np.add.at(counts, b, size[a])
                apart = label[a] != label[b]
                for s, t in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                    if label[s] != label[t]:
                        left.append(node[s])
                        right.append(node[t])
                        label[label == label[t]] = label[s]
        some = np.flatnonzero(counts)
        none = pa.nulls(len(some), pa.int64())
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), none, pa.array(counts[some])], ["a", "b", "links"])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(np.zeros(len(left), np.int64))], ["a", "b", "links"])

    return _whole_units(dealt, work, "a long, b long, links long", ["node", "own", "size", "raw"])


def link_vectors(vectors: DataFrame, least: float = LEAST, blocks: int = BLOCKS, grid: int = GRID, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """One row a vector: ``name``, n_links, component_id, kept."""
    if not -1 < least <= 1:
        raise ValueError(f"no cosine above {least}")
    rows, classes = classes_of(vectors, vector, name)
    reach = 2 - 2 * least
    turned = rotations(classes, blocks)
    near = near_in_block(_chunked(entries(classes, turned, reach, grid), CHUNK, KEY), turned, reach)
    # a unit of the first pass that is one of several of its cell names a vector again
    near = cut(near.distinct(), "near")
    whole = near.join(classes.select(F.col("node").alias("of"), "size", "raw"), F.col("node") == F.col("of")).drop("of")
    links = cut(linked_in_block(_chunked(whole, EXACT_CHUNK, KEY), turned, reach, least), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("others"))
    roots = components(links.where("b is not null").select("a", "b"))
    named = classes.select("node", "digest", "first_id", "size").join(counts, F.col("node") == F.col("of"), "left").drop("of")
    named = cut(named.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("digest", "first_id", "size", F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "named")
    many = cut(named.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("classes")).where("classes > 1"), "many")
    told = join_groups(named, F.col("root"), F.col("digest"), many.drop("classes"), "of_root", 2 * many.count(), many.select("of_root", F.col("classes").alias("rows")))
    told = cut(told.select(F.col("digest").alias("of"), "n_links", F.when(F.col("of_root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id"), F.col("size").alias("rows")), "told")
    out = join_groups(rows.withColumn("known", F.col("digest").isNotNull()), F.col("digest"), F.col("id"), told.drop("rows"), "of", 3 * classes.count(), told.select("of", "rows"))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(name), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
