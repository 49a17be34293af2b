"""Small helpers that the operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..scratch import cleanup, cut, cut_counted, discard, made, shared_dir

__all__ = ["bounded_batches", "cleanup", "comparable", "connected_components", "cut", "cut_counted", "discard", "documents", "held", "made", "set_aside", "share", "shared_dir", "size_in_bytes"]


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast whose value carries the classes it needs, so executors need
    no copy of this package; :func:`held` gives the value."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def held(broadcast: Broadcast) -> object:
    """The value of a broadcast made by :func:`share`, unpacked once in each
    worker process."""
    box = broadcast.value
    if "value" not in box:
        box["value"] = pickle.loads(box["packed"])
        box["packed"] = None
    return box["value"]


def set_aside(df: DataFrame, *replaced: str, consumed: str | None = None) -> tuple[DataFrame, dict[str, str], Callable[..., DataFrame]]:
    """``df`` under names of its own that no operator uses, and the way back.

    Columns named like ``replaced`` (in any case) go. Returns the table, the new
    name of each column, and a function that takes a table with those columns
    (but the one ``consumed``) and the names of new ones and gives both under the
    proper names.
    """
    gone = {name.lower() for name in replaced}
    every = [f"carried_{i}" for i in range(len(df.columns))]
    kept = [(own, name) for own, name in zip(every, df.columns, strict=True) if name.lower() not in gone]

    def back(out: DataFrame, *new: str) -> DataFrame:
        left = [(own, name) for own, name in kept if name != consumed]
        return out.select(*[own for own, _ in left], *new).toDF(*[name for _, name in left], *new)

    inner = df.toDF(*every).select(*[own for own, _ in kept])
    return inner, {name: own for own, name in reversed(kept)}, back


def comparable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in a form that can be hashed and ordered: those
    that hold maps or variants as JSON."""

    def plain(kind: DataType) -> bool:
        if isinstance(kind, ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return not isinstance(kind, (MapType, VariantType))

    return [F.col(f"`{f.name}`") if plain(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields]


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a file scan, the files' bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bounded_batches(df: DataFrame, rows: int = 1000) -> SparkSession:
    """Send Python workers at most ``rows`` rows at once: rows are long texts
    here, and a batch stands in memory twice on both sides. The session keeps
    the setting, for plans read it only as they run."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Edges that a task joins up at once.
CHUNK = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: forests of parts of the edges, then
    alternating large and small stars.

    ``edges``: columns ``a`` and ``b`` (long). Returns ``node`` and
    ``component`` (its least node) for every node of an edge. Every task first
    replaces its edges, up to CHUNK at a time, by an edge from each node to the least
    one that they lead to. If that was one chunk, it is the result. Otherwise each round
    writes a table; the number of rounds is logarithmic in the longest path. Hubs are
    joined, not grouped into one row, so adaptive execution can split them.
    """
    own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars, seen = cut_counted(own.mapInArrow(_forests, "u bigint, v bigint, chunk bigint"), "star", first=F.min("chunk"), last=F.max("chunk"))
    # A task that ran twice shows as two chunks, which only costs rounds.
    whole, mark = seen["first"] == seen["last"], None
    while not whole:
        both = stars.select("u", "v").union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        old, stars = stars, cut(small, "star")
        now = _mark(stars)
        discard(old)
        whole, mark = now == mark, now
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    out._cartulary_path = stars._cartulary_path
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of edges, one from every node to the least one of its component."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            at = x
            while (up := root.setdefault(at, at)) != at:
                at = up
            while x != at:
                root[x], x = at, root[x]
            return at

        for batch in held:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(u), top(v)
                root[max(x, y)] = min(x, y)
        pairs = [(x, y) for x in list(root) if (y := top(x)) != x]
        chunk = uuid.uuid4().int >> 65
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64()), pa.array([chunk] * len(pairs), pa.int64())], ["u", "v", "chunk"])

    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield joined()
            held.clear()
            n = 0
    if n:
        yield joined()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(20, 0)))")).first())
