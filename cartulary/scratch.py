"""Scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session leaves it unset, a local master (one process, as in
    tests) gets a folder of this process, deleted at its end; any other master
    is an error, for its executors see no folder of the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="cartulary-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
        context.setCheckpointDir(_OWN[app])
    return _OWN[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted by :func:`cleanup` like a table."""
    path = f"{shared_dir(spark)}/cartulary-{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The lineage ends there, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cartulary-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    # The session's codec: zstd's buffers lie outside the heap, for each column
    # of each file that is open.
    df.write.parquet(path)
    _MADE.add(path)
    out = spark.read.schema(schema).parquet(path)
    out._cartulary_path = path
    return out


def cut_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, and aggregates of the rows (``n`` is always their number), taken
    as they are written. A task that ran twice may count twice, so only whether
    a count is 0, or which of two is about larger, may depend on them."""
    seen = Observation()
    counts["n"] = F.count(F.lit(1))
    out = cut(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    found = seen.get
    if set(found) != set(counts):  # the optimizer found the rows to be none
        found = out.agg(*[c.alias(k) for k, c in counts.items()]).first().asDict()
    return out, {k: v or 0 for k, v in found.items()}


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no pending plan reads."""
    for table in tables:
        path = getattr(table, "_cartulary_path", None)
        if path in _MADE:
            _delete(table.sparkSession, path)


def made() -> frozenset[str]:
    """The scratch tables there are now: a mark for :func:`cleanup`."""
    return frozenset(_MADE)


def cleanup(spark: SparkSession, since: frozenset[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the scratch tables made after the mark ``since`` but ``keep``,
    once what reads them is written; by default all of this process."""
    kept = getattr(keep, "_cartulary_path", None)
    for path in _MADE - since - {kept}:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)
