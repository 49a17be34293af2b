"""A code graph on disk that follows its files.

Each import writes a segment with the units and edges of new and changed files
only. A manifest lists, for each file, its content's hash and the segment that
holds it; a file that is gone is no longer listed. Rows of unchanged files stay
where they are. A manifest counts once it is whole, so an import that dies
changes nothing and is made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import CodeGraph

CHANGES = ("added", "changed", "removed", "same")


def content_hashes(files: DataFrame) -> DataFrame:
    """``file_path, hash`` of ``files`` (``file_path, text``); a null text is an empty one.
    A path that comes twice has the hash of all its texts."""
    own = files.where("file_path is not null").select("file_path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return own.groupBy("file_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("hash"))


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file_path, change`` between two tables of hashes: added, changed, removed or same."""
    a, b = old.select("file_path", F.col("hash").alias("__old")), new.select("file_path", F.col("hash").alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    return a.join(b, "file_path", "full").select("file_path", change.alias("change"))


class GraphStore:
    """Units and edges below ``path``, by segment, and the manifests.

    ``extract`` gives the units and edges of files: each unit has ``file_path``, each
    edge the ``file_path`` that it was read from. What it gives for a file may depend on
    that file only; edges to units of other files name them by id and count
    where both ends are there.
    """

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]]):
        self.spark, self.path, self.extract = spark, path.rstrip("/"), extract

    def _versions(self) -> list[int]:
        """Whole manifests, by number; a folder a version, so few names."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """``file_path, hash, segment``; None before the first import."""
        versions = self._versions()
        if not versions:
            return None
        return self.spark.read.parquet(f"{self.path}/manifest/v={versions[-1] if version is None else version}")

    def refresh(self, files: DataFrame) -> DataFrame:
        """Bring the graph up to ``files`` (all there are now: ``file_path, text``). Returns
        ``change, files``: how many were added, changed, removed and left alone."""
        new, old = content_hashes(files), self.manifest()
        known = old if old is not None else new.select("file_path", "hash", F.lit("").alias("segment")).where("false")
        diff = diff_files(known, new).join(known.select("file_path", F.col("segment").alias("old_segment")), "file_path", "left")
        segment = f"s{uuid.uuid4().hex}"
        fresh = diff.where("change in ('added', 'changed')").select("file_path")
        units, edges = self.extract(files.join(fresh, "file_path", "left_semi"))
        units.write.parquet(f"{self.path}/units/segment={segment}")
        edges.write.parquet(f"{self.path}/edges/segment={segment}")
        listed = diff.where("change <> 'removed'").join(new, "file_path").select("file_path", "hash", F.when(F.col("change") == "same", F.col("old_segment")).otherwise(segment).alias("segment"))
        version = self._versions()[-1] + 1 if old is not None else 0
        listed.write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        # Counted from what is written: both manifests stay as they are.
        done = diff_files(known, self.manifest(version))
        kinds = self.spark.createDataFrame([(c,) for c in CHANGES], "change string")
        return kinds.join(done.groupBy("change").agg(F.count("*").alias("files")), "change", "left").na.fill(0, ["files"])

    def open(self, version: int | None = None) -> CodeGraph:
        """The graph as of the last import, or of an earlier one."""
        listed = self.manifest(version)
        if listed is None:
            raise ValueError(f"no graph below {self.path}")
        current = listed.select("file_path", "segment")
        units, edges = (self.spark.read.option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}").join(current, ["file_path", "segment"], "left_semi").drop("segment") for what in ("units", "edges"))
        ends = units.select("id").distinct()
        for end in ("src", "dst"):
            edges = edges.join(ends.withColumnRenamed("id", end), end, "left_semi")
        return CodeGraph(units, edges)

    def import_or_open(self, files: DataFrame) -> CodeGraph:
        """The graph there is, else one of ``files``."""
        if self.manifest() is None:
            self.refresh(files)
        return self.open()
