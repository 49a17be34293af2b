"""Embedding near-duplicates by dual traversal of cover trees.

Distances are those of unit vectors (chords), for which the triangle inequality
holds: a cosine of t is a distance of sqrt(2 - 2t). The vectors of a label make a
tree. Its upper part is made by Spark: a node of more than LEAF vectors picks
centres from a sample, a net of the widest of the halving radii that has enough
of them, and its vectors go to the nearest, until nodes are small. A small node
is a cell, whose own levels are nets of radii 2, 1, 1/2 and so on. Each node has
the measured distance of its furthest vector as covering radius.

Two nodes further apart than their covering radii and the limit hold no pair.
Pairs of nodes that this does not rule out are followed down, first in the upper
part by joins, then within pairs of cells; what remains are the exact pairs. The
choice of centres decides how much is ruled out, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import comparable, connected_components, cut, set_aside

THRESHOLD = 0.98
#: Vectors of a cell at most, and the bytes of their coordinates.
LEAF, LEAF_BYTES = 2048, 8 << 20
#: Vectors of a node from which centres are picked; centres at least (unless the
#: node needs fewer cells) and at most.
SAMPLE, CENTRES = 512, 64
#: Rounds of cutting; a node that is still large then is dealt by hash.
ROUNDS = 12
#: Levels of a cell: radii 2, 1, ... 2 / 2**(LEVELS - 1).
LEVELS = 7
#: Node pairs that are measured at once; partners of a cell in one block.
CHUNK, PARTNERS = 1 << 19, 32
#: Room for rounding in bounds: a chord near zero is known to about 1e-8.
SLACK = 1e-6


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``n_links`` (other rows with equal label and cosine of ``threshold`` or
    more), ``component_id`` (least id reachable by links) and ``kept`` (whether it
    is the row's own).

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do those of a null label or of different lengths; their
    component is themselves. Equal vectors are one class: its rows are counted,
    not paired. Rows are told apart by place, so repeated rows are links of each
    other. A null id takes part; it is a component's id only where no other row
    has one, and such a row is not kept. Columns of the new names are replaced,
    all others stay, whatever their names. An empty table stays empty.
    """
    new = ("n_links", "component_id", "kept")
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    inner, names, back = set_aside(df, *new)
    v, y = names[vector], names[label]
    fine = F.expr(f"not exists({v}, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists({v}, x -> x <> 0)")
    # A class is told by two hashes of 64 bits of label and vector.
    key = [comparable(inner.select(y))[0], F.transform(v, lambda x: x + F.lit(0).cast(_element(inner, v)))]
    usable = F.coalesce(fine, F.lit(False)) & F.col(y).isNotNull()
    marked = inner.withColumns({"__h": F.when(usable, F.xxhash64(*key)), "__g": F.when(usable, F.xxhash64(F.lit(1), *key))})
    # The root of a tree is named by a hash of label and length.
    root = marked.where("__h is not null").withColumn("__cell", F.xxhash64(key[0], F.size(v)))
    classes = root.groupBy("__h", "__g", "__cell").agg(F.first(v).alias("vector"), F.count("*").alias("rows"), F.min(names[id_col]).alias("least"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "__h", "__g", F.col("__cell").alias("cell"), "vector", "rows", "least")
    classes = cut(classes, "classes")

    links = cut(_links(classes.select("node", "cell", "vector", "rows"), threshold), "links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("node", "__h", "__g", "rows", "least").join(counts, "node", "left").join(components, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = cut(known.join(least, "component").select("__h", "__g", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id"), "vector-links")
    out = marked.join(known, ["__h", "__g"], "left")
    out = out.withColumn("component_id", F.when(F.col("__h").isNull(), F.col(names[id_col])).otherwise(F.col("component_id")))
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "kept": F.coalesce(F.col(names[id_col]) == F.col("component_id"), F.lit(False))})
    return back(out, *new)


def _element(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    if not isinstance(kind, ArrayType):
        raise ValueError("vectors must be arrays")
    return kind.elementType


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """``node, n, other``: rows linked with a class, in parts to be summed, and a
    class of the same component (maybe itself)."""
    cells, tops = _cells(classes)
    pairs = cut(_cell_pairs(tops, float(np.sqrt(max(2 - 2 * threshold, 0.0)))), "cell-pairs")
    trees = cut(_trees(cells), "trees")
    found = _compared(pairs, trees, threshold)
    return found


# -- the upper part: cells and their pairs ---------------------------------


def _cells(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The vectors by cell, and the tables of nodes (``parent, cell, centre,
    radius``), one a level; a node without children is a cell."""
    left, done, tops = cut(classes, "nodes"), [], []
    tops.append(left.groupBy("cell").agg(F.first("vector").alias("centre"), F.lit(2.0).alias("radius")).withColumn("parent", F.lit(None).cast("long")))
    room = F.least(F.lit(LEAF), F.greatest(F.lit(64), (F.lit(LEAF_BYTES) / (8 * F.col("dim"))).cast("int")))
    for turn in range(ROUNDS + 1):
        sizes = left.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).withColumn("room", room)
        big = cut(sizes.where("n > room"), "big")
        small = left.join(big, "cell", "left_anti")
        done.append(small)
        if big.isEmpty():
            break
        rest = left.join(big.select("cell", "n", "room"), "cell")
        if turn < ROUNDS:
            by = Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(turn)), "node")
            sample = rest.select("cell", "node", "vector", "n", "room").withColumn("k", F.row_number().over(by)).where(F.col("k") <= SAMPLE)
            centres = cut(sample.groupBy("cell").applyInPandas(_net, "cell bigint, child bigint, centre array<double>"), "centres")
            moved = cut(_assigned(rest, centres), "nodes")
        else:
            # Many rounds without an end: what is left is cut anywhere.
            parts = rest.withColumn("child", F.xxhash64("cell", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(2 * F.col("n") / F.col("room")))))
            centres = cut(parts.groupBy("cell", "child").agg(F.first(F.col("vector").cast("array<double>")).alias("centre")), "centres")
            moved = cut(_assigned(parts, centres, keep=True), "nodes")
        radii = moved.groupBy(F.col("child").alias("cell"), F.col("cell").alias("parent")).agg(F.max("distance").alias("radius"))
        tops.append(cut(radii.join(centres.select(F.col("child").alias("cell"), "centre"), "cell"), "tops"))
        left = moved.select("node", F.col("child").alias("cell"), "vector", "rows")
        if turn == ROUNDS:
            done.append(left)
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return cut(out, "cells"), tops


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _chords(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _net(sample):
    """Centres of one node from at most SAMPLE of its vectors: a greedy net of
    the first of the radii 1, 1/2, ... that has as many as the node's cells
    need, at most CENTRES."""
    import pandas as pd

    unit = _unit(np.stack(sample["vector"].to_numpy()).astype(np.float64))
    distances = _chords(unit @ unit.T)
    n, room = int(sample["n"].iloc[0]), int(sample["room"].iloc[0])
    wanted = int(min(CENTRES, max(2, -(-2 * n // room))))
    for level in range(1, 40):
        radius, far, picked = 2.0 / 2**level, np.full(len(unit), np.inf), []
        while len(picked) < wanted and (far > radius).any():
            picked.append(int(far.argmax()))
            far = np.minimum(far, distances[picked[-1]])
        if len(picked) >= wanted or level == 39:
            break
    cell = int(sample["cell"].iloc[0])
    nodes = sample["node"].to_numpy()[picked]
    # A child is named by its node and its first vector.
    named = (np.array([cell], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (nodes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    return pd.DataFrame({"cell": cell, "child": named.view(np.int64), "centre": list(unit[picked])})


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _stretches(batch: pa.RecordBatch, *columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of a batch that agree in the given columns (no nulls)."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    edge = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b > a:
            yield tuple(k[a].item() for k in keys), batch.slice(a, b - a)


def _assigned(rows: DataFrame, centres: DataFrame, keep: bool = False) -> DataFrame:
    """Each vector's nearest centre of its node (``child``) and the ``distance``;
    with ``keep`` the distance to the child that it has.

    A node's centres lead its vectors in each of the blocks that it is dealt to.
    """
    none = F.lit(None)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / 8192))
    own = F.col("child") if keep else F.lit(0).cast("long")
    follow = rows.select("cell", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.lit(1).alias("side"), own.alias("child"), "node", "vector", "rows", none.cast("array<double>").alias("centre"))
    spread = rows.select("cell", F.explode(F.expr("sequence(0L, greatest(1L, cast(ceil(n / 8192) as bigint)) - 1)")).alias("block")).distinct()
    lead = centres.join(spread, "cell").select("cell", "block", F.lit(0).alias("side"), "child", F.lit(0).cast("long").alias("node"), none.cast(rows.schema["vector"].dataType).alias("vector"), F.lit(0).cast("long").alias("rows"), "centre")
    dealt = lead.unionByName(follow).repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "child", "node")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, points = None, [], []
        for batch in batches:
            for (cell, block, side), part in _stretches(batch, 0, 1, 2):
                if (cell, block) != key:
                    key, names, points = (cell, block), [], []
                if side == 0:
                    names.append(part.column(3).to_numpy())
                    points.append(_matrix(part.column(7)))
                    continue
                centre, name = _unit(np.concatenate(points)), np.concatenate(names)
                cosines = _unit(_matrix(part.column(5))) @ centre.T
                if keep:
                    order = np.argsort(name)
                    best = order[np.searchsorted(name, part.column(3).to_numpy(), sorter=order)]
                else:
                    best = cosines.argmax(axis=1)
                distance = _chords(cosines[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays([part.column(4), part.column(0), pa.array(name[best]), part.column(5), part.column(6), pa.array(distance)], ["node", "cell", "child", "vector", "rows", "distance"])

    kind = rows.schema["vector"].dataType.simpleString()
    return dealt.mapInArrow(assign, f"node bigint, cell bigint, child bigint, vector {kind}, rows bigint, distance double")


def _cell_pairs(tops: list[DataFrame], limit: float) -> DataFrame:
    """Pairs of cells (``a``, ``b``), each once, that their covering radii do not rule out:
    from each tree's root with itself, a level of children at a time."""
    pairs = tops[0].select(F.col("cell").alias("a"), F.col("cell").alias("b"), *[F.col(c).alias(f"{s}_{c}") for s in "ab" for c in ("centre", "radius")])
    pairs = pairs.withColumns({f"{s}_centre": F.col(f"{s}_centre").cast("array<double>") for s in "ab"})
    for nodes in tops[1:]:
        # Children of one node meet in both orders, those of two nodes in one.
        pairs = pairs.withColumn("own", F.col("a") == F.col("b"))
        for s in "ab":
            child = nodes.select(F.col("parent").alias(s), F.col("cell").alias("c"), F.col("centre").alias("c_centre"), F.col("radius").alias("c_radius"))
            pairs = pairs.join(child, s, "left").withColumns({s: F.coalesce("c", s), f"{s}_centre": F.coalesce("c_centre", f"{s}_centre"), f"{s}_radius": F.coalesce("c_radius", f"{s}_radius")}).drop("c", "c_centre", "c_radius")
        apart = F.expr("sqrt(aggregate(zip_with(a_centre, b_centre, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
        near = (~F.col("own") | (F.col("a") < F.col("b"))) & (apart <= F.col("a_radius") + F.col("b_radius") + F.lit(limit + SLACK))
        pairs = cut(pairs.where((F.col("a") == F.col("b")) | near).drop("own"), "node-pairs")
    return pairs.select("a", "b")


# -- the lower part: trees of cells ----------------------------------------


def _trees(cells: DataFrame) -> DataFrame:
    """The vectors of each cell in the order of its tree: ``pos`` and ``path``, the
    positions of the centres that cover the vector, a level each."""
    dealt = cells.select("cell", "node", "rows", "vector").repartition("cell").sortWithinPartitions("cell", "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 0):
            cell = pa.concat_batches(parts)
            order, path = tree(_unit(_matrix(cell.column(3))))
            cell = cell.take(pa.array(order))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(path.ravel(), pa.int32()), LEVELS).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*cell.columns, pa.array(np.arange(len(order)), pa.int32()), flat], ["cell", "node", "rows", "vector", "pos", "path"])

    kind = cells.schema["vector"].dataType.simpleString()
    return dealt.mapInArrow(build, f"cell bigint, node bigint, rows bigint, vector {kind}, pos int, path array<int>")


def _groups(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Sorted rows by key, each with the parts of its bounded group."""
    key, parts = None, []
    for batch in batches:
        for now, part in _stretches(batch, *columns):
            if now != key and parts:
                yield key, parts
                parts = []
            key = now
            parts.append(part)
    if parts:
        yield key, parts


def tree(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a cell's vectors in its cover tree and, in that order, the
    positions of their centres at each level.

    A level's centres are further apart than its radius, cover all vectors
    within it, and stay centres of all finer levels.
    """
    n = len(unit)
    distances = _chords(unit @ unit.T)
    path = np.zeros((n, LEVELS), np.int64)
    groups = [np.arange(n)]
    for level in range(1, LEVELS):
        radius, finer = 2.0 / 2**level, []
        for members in groups:
            own = path[members[0], level - 1]
            if len(members) == 1:
                path[members, level] = members
                continue
            # The coarser centre comes first, so that it stays one.
            best, centre = distances[own, members].copy(), np.full(len(members), own)
            while best.max() > radius:
                new = members[int(best.argmax())]
                nearer = distances[new, members] < best
                best[nearer], centre[nearer] = distances[new, members][nearer], new
                # A centre covers itself, whatever copies round to.
                at = np.flatnonzero(members == new)
                best[at], centre[at] = -1.0, new
            path[members, level] = centre
            order = np.argsort(centre, kind="stable")
            edge = np.flatnonzero(np.diff(centre[order])) + 1
            finer += [members[o] for o in np.split(order, edge)]
        groups = finer + [m for m in groups if len(m) == 1]
    order = np.lexsort([np.arange(n), *path.T[::-1]])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[path[order]]


class Cell:
    """A cell's tree in numbers: for each level the centres, their measured
    radii, the range of rows below and the range of children."""

    def __init__(self, parts: list[pa.RecordBatch], node: int, rows: int, vector: int, path: int):
        cell = pa.concat_batches(parts)
        self.node = cell.column(node).to_numpy()
        self.rows = cell.column(rows).to_numpy()
        self.raw = _matrix(cell.column(vector))
        self.unit = _unit(self.raw)
        own = cell.column(path).flatten().to_numpy().reshape(-1, LEVELS).astype(np.int64)
        n = len(own)
        self.centre, self.radius, self.start = [], [], []
        for level in range(LEVELS):
            start = np.flatnonzero(np.concatenate([[True], own[1:, level] != own[:-1, level]]))
            centre = own[start, level]
            away = _chords(np.einsum("ij,ij->i", self.unit, self.unit[own[:, level]]))
            self.centre.append(centre)
            radius = np.maximum.reduceat(away, start)
            # A node of one vector has no radius at all.
            self.radius.append(np.where(np.diff(np.append(start, n)) == 1, 0.0, radius))
            self.start.append(start)
        self.centre.append(np.arange(n))
        self.radius.append(np.zeros(n))
        self.start.append(np.arange(n))
        #: Children of a level's nodes: a range of the next level's nodes.
        self.child = [np.append(np.searchsorted(fine, coarse), len(fine)) for coarse, fine in zip(self.start[:-1], self.start[1:], strict=True)]
        self.end = [np.append(s[1:], n) for s in self.start]


def dual(a: Cell, b: Cell, threshold: float, measured: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (of a, of b) with a cosine of ``threshold`` or more.

    Node pairs go down one side at a time, depth first, so few stand in memory.
    """
    limit = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK
    stack = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    found = []
    while stack:
        i, j, x, y = stack.pop()
        ca, cb = a.centre[i][x], b.centre[j][y]
        cosines = _cosines(a.unit, b.unit, ca, cb)
        if measured is not None:
            measured.append(len(x))
        last = i == j == LEVELS
        if last:
            close = np.flatnonzero(np.abs(cosines - threshold) < 1e-9)
            if len(close):
                # At the limit itself the vectors as they are decide.
                p, q = a.raw[ca[close]], b.raw[cb[close]]
                exact = np.einsum("ij,ij->i", p, q) / (np.sqrt(np.einsum("ij,ij->i", p, p)) * np.sqrt(np.einsum("ij,ij->i", q, q)))
                cosines[close] = np.where(np.isfinite(exact), exact, cosines[close])
            hit = cosines >= threshold
            found.append((x[hit], y[hit]))
            continue
        keep = _chords(cosines) <= a.radius[i][x] + b.radius[j][y] + limit
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        side, nodes = (a.child[i], x) if i <= j else (b.child[j], y)
        first, many = side[nodes], side[nodes + 1] - side[nodes]
        upto = np.cumsum(many)
        begin = 0
        while begin < len(x):
            done = int(upto[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
            part = many[begin:stop]
            at = np.repeat(np.arange(begin, stop), part)
            child = np.arange(len(at)) - np.repeat(np.cumsum(part) - part, part) + first[at]
            stack.append((i + 1, j, child, y[at]) if i <= j else (i, j + 1, x[at], child))
            begin = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _cosines(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; many pairs of few rows as one product."""
    ux, ix = np.unique(x, return_inverse=True)
    uy, iy = np.unique(y, return_inverse=True)
    if len(ux) * len(uy) <= 4 * len(x):
        return (a[ux] @ b[uy].T)[ix, iy]
    out = np.empty(len(x))
    for k in range(0, len(x), 1 << 14):
        out[k : k + (1 << 14)] = np.einsum("ij,ij->i", a[x[k : k + (1 << 14)]], b[y[k : k + (1 << 14)]])
    return out


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each node's component by the links x - y."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _compared(pairs: DataFrame, trees: DataFrame, threshold: float) -> DataFrame:
    """``node, n, other`` of all pairs of cells. A cell leads the cells that it
    meets, one after another; a cell that meets many has several blocks."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), "b")
    columns = ["node", "rows", "vector", "pos", "path"]
    follow = dealt.join(trees.withColumnRenamed("cell", "b"), "b").select("a", "block", F.lit(1).alias("side"), "b", *columns)
    lead = dealt.select("a", "block").distinct().join(trees.withColumnRenamed("cell", "a"), "a").select("a", "block", F.lit(0).alias("side"), F.col("a").alias("b"), *columns)
    rows = lead.unionByName(follow).repartition("a", "block").sortWithinPartitions("a", "block", "side", "b", "pos")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for (a, _, side, b), parts in _groups(batches, 0, 1, 2, 3):
            two = Cell(parts, 4, 5, 6, 8)
            if side == 0:
                one = two
                continue
            x, y = dual(one, two, threshold)
            n = len(one.node)
            if a == b:
                keep = x != y
                x, y = x[keep], y[keep]
                counts, label = np.bincount(x, one.rows[y], n), _forest(n, x, y)
                node = one.node
            else:
                counts = np.concatenate([np.bincount(x, two.rows[y], n), np.bincount(y, one.rows[x], len(two.node))])
                label, node = _forest(n + len(two.node), x, y + n), np.concatenate([one.node, two.node])
            some = np.flatnonzero(counts)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(counts[some].astype(np.int64)), pa.array(node[label[some]])], ["node", "n", "other"])

    return rows.mapInArrow(compare, "node bigint, n bigint, other bigint")


ORACLE = """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as x from embeddings),
ok as (select * from v where label is not null and len(x) > 0 and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
l as (select a.r as a, b.r as b from ok a join ok b on a.label = b.label and a.r <> b.r and len(a.x) = len(b.x)
      where case when len(a.x) = len(b.x) then list_cosine_similarity(a.x, b.x) end >= 0.98),
reach(r, c) as (select r, r from v union select reach.r, l.b from reach join l on reach.c = l.a),
n as (select a, count(*) as n from l group by a),
c as (select reach.r, min(v.vec_id) as component_id from reach join v on reach.c = v.r group by reach.r)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.r = v.r left join n on n.a = v.r
"""
