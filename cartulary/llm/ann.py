"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of nearest neighbours is cut into balanced parts,
and a small network learns which part a vector belongs to. Every row is then
put into its most probable part. A query goes to its most probable parts, as
many as held-out rows of the sample need for the wanted recall, and is compared
there exactly.

The parts grow with the square root of the rows. A part's rows come in blocks
of a bounded size, so a vector that a third of the rows share fills more
blocks, not a larger one; the queries that are sent to a part come in chunks.
Each block meets each chunk of its own part once, so a row is copied only as
often as its own part has chunks, and not at all where no query goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held, share

#: Rows that the graph, the network and the calibration are made from, at most;
#: the index holds every row.
SAMPLE_ROWS = 16384
#: Sampled rows of a part on average at least: more parts could not be learned.
PART_SAMPLE = 16
#: Rows, and queries, of a block at most on average.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Recall at k of the held-out rows that decides how many parts are searched.
RECALL = 0.95
#: One of so many sampled rows is held out for the calibration.
HELD_OUT = 8


@dataclass
class Router:
    """Weights of the network, and how many parts a query is sent to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    parts: int
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row its k nearest others by inner product, in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 1024):
        g = x[at : at + 1024] @ x.T
        g[np.arange(len(g)), at + np.arange(len(g))] = -np.inf
        out[at : at + 1024] = np.argpartition(-g, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size (within 5 %) that cut few edges.

    Halving along main directions gives a balanced start; then each row moves
    to the part that most of its neighbours are in while there is room, the
    largest gain first.
    """
    label = np.zeros(len(x), np.int64)
    width = 1
    while width < parts:
        for part in range(width):
            own = np.flatnonzero(label == part)
            if len(own) > 1:
                c = x[own] - x[own].mean(axis=0)
                axis = np.linalg.eigh(c.T @ c)[1][:, -1]
                label[own[np.argsort(c @ axis, kind="stable")[len(own) // 2 :]]] = part + width
        width *= 2
    links = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    most, least = int(np.ceil(len(x) / parts * 1.05)), int(len(x) / parts * 0.95)
    for _ in range(rounds):
        near = np.zeros((len(x), parts), np.int32)
        np.add.at(near, (links[:, 0], label[links[:, 1]]), 1)
        gain = near.max(axis=1) - near[np.arange(len(x)), label]
        target = near.argmax(axis=1)
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[target[i]] < most and size[label[i]] > least:
                size[target[i]] += 1
                size[label[i]] -= 1
                label[i] = target[i]
                moved += 1
        if not moved:
            break
    return label


def part_count(rows: int, sampled: int) -> int:
    """A power of two near a quarter of the square root of the rows; two parts
    from 64 rows on, one for fewer."""
    wanted = max(2, 1 << max(0, int(np.log2(max(1.0, rows**0.5 / 4)))))
    learned = 1 << max(0, int(np.log2(max(1, sampled // PART_SAMPLE))))
    return 1 if rows < 64 else min(wanted, learned)


def train_router(sample: np.ndarray, parts: int, k: int, seed: int = 5, hidden: int = 128, epochs: int = 40) -> Router:
    """Fit the network to the parts of a sample's graph and choose probes.

    The network sees directions only, but neighbours are by inner product of
    the vectors as they are. Held-out rows take no part in the fit.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    router = Router(rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts), parts, parts)
    if parts == 1:
        return router
    held_out = np.zeros(len(sample), bool)
    held_out[rng.permutation(len(sample))[: max(1, len(sample) // HELD_OUT)]] = True
    x = sample[~held_out]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = balanced_parts(x, neighbour_graph(x, 10), parts)
    weights = [router.w1, router.b1, router.w2, router.b2]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            own = order[at : at + 256]
            h = np.maximum(x[own] @ router.w1 + router.b1, 0)
            z = h @ router.w2 + router.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label[own]] -= 1
            p /= len(own)
            back = (p @ router.w2.T) * (h > 0)
            step += 1
            for w, m, s, g in zip(weights, mean, square, (x[own].T @ back, back.sum(0), h.T @ p, p.sum(0)), strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    # How far down a held-out row's list are its neighbours' parts?
    queries = np.flatnonzero(held_out)[:2048]
    near = neighbour_graph(sample, k)[queries]
    order = np.argsort(np.argsort(-router.logits(sample[queries]), axis=1, kind="stable"), axis=1)
    depth = order[np.arange(len(queries))[:, None], router.part(sample)[near]]
    reached = np.cumsum(np.bincount(depth.ravel(), minlength=parts)) / max(1, depth.size)
    router.probes = min(parts, int(np.searchsorted(reached, RECALL)) + 1)
    return router


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, query: str | None = None, seed: int = 5) -> DataFrame:
    """The k nearest rows of each query by inner product.

    ``query`` is a SQL condition on ``id`` that tells the queries, by default all
    rows. Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``,
    computed in double precision on the vectors as they are; ties go to the
    smaller id. A query's own id is no candidate. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components,
    take no part; nor do vectors of another length than most have (of equally
    frequent lengths, the smaller). Of rows with one id the smallest vector
    stands. No rows for an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    valid = "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.where(valid).groupBy("id").agg(F.min("v").alias("v"))
    rows = cut(rows, "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width, total = lengths[0]["n"], lengths[0]["count"]
    rows = rows.where(F.size("v") == width)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    sample = np.asarray(sample.flatten()).reshape(-1, width)
    parts = part_count(total, len(sample))
    router_ = share(spark, train_router(sample, parts, k, seed))

    def vectors_of(column: pa.Array) -> np.ndarray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return np.asarray(column.flatten()).reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = held(router_)
        for batch in batches:
            part = router.part(vectors_of(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["id", "v", "part"])

    indexed = cut(rows.mapInArrow(assign, "id long, v array<double>, part int"), "indexed")
    asked = indexed.where(query) if query else indexed

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = held(router_)
        for batch in batches:
            to = router.routes(vectors_of(batch.column(1))) if batch.num_rows else np.zeros((0, 1))
            row = np.repeat(np.arange(len(to)), to.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(to.ravel().astype(np.int32))], ["id", "part"])

    routed = cut(asked.select("id", "v").mapInArrow(route, "id long, part int"), "routed")
    # A part's blocks of rows and chunks of queries; there are as many as parts.
    sizes = indexed.groupBy("part").agg(F.count("*").alias("rows")).join(routed.groupBy("part").agg(F.count("*").alias("queries")), "part")
    sizes = sizes.select("part", F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"), F.ceil(F.col("queries") / BLOCK_QUERIES).alias("chunks"))
    tiles = ["part", "block", "chunk"]
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lots = routed.join(F.broadcast(sizes), "part").select("id", "part", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), up_to("blocks").alias("block"))
    lots = lots.join(asked.select("id", "v"), "id").select(*tiles, "id", "v")
    lots_of_rows = indexed.join(F.broadcast(sizes), "part").select("id", "v", "part", F.pmod(F.xxhash64(F.lit(1), "id"), "blocks").alias("block"), up_to("chunks").alias("chunk"))
    lots_of_rows = lots_of_rows.select(*tiles, "id", "v")

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and rows.num_rows:
            r, ids = vectors_of(rows.column("v")), rows.column("id").to_numpy()
            every, own = vectors_of(queries.column("v")), queries.column("id").to_numpy()
            for at in range(0, len(own), 256):
                q = every[at : at + 256]
                g = q @ r.T
                g[own[at : at + 256, None] == ids[None, :]] = -np.inf
                m = min(k, len(r))
                least = np.partition(g, len(r) - m, axis=1)[:, len(r) - m]
                for i in range(len(q)):
                    # The product's last bits depend on its blocking, so what is
                    # close to the least is computed again, one row like another.
                    near = np.flatnonzero(g[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) if np.isfinite(least[i]) else np.flatnonzero(np.isfinite(g[i]))
                    score = (r[near] * q[i]).sum(axis=1)
                    by = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(by), own[at + i]), ids[near][by], score[by]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    found = lots.groupBy(*tiles).cogroup(lots_of_rows.groupBy(*tiles)).applyInArrow(compare, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
