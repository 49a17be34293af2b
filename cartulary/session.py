"""Session settings that suit the engine's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a shuffle that one task takes: rows of code and findings grow many times
#: over when they are read, so the default of 64 MB is gigabytes of memory.
TASK_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
#: Rows of findings (some 25 bytes each, once compressed) for each part of a shuffle.
PART_ROWS = 250_000
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Adaptive execution coalesces small shuffles and splits skewed joins; the
#: zone makes timestamps comparable; recursion is bounded by its callers.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    TASK_BYTES[0]: TASK_BYTES[1],
}


def parts_for(spark: SparkSession, rows: int) -> None:
    """Deal shuffles to a part for each PART_ROWS rows. Adaptive execution puts small
    parts together but splits none, so with a fixed number a task grows with the
    tables. More parts that the session asks for stay."""
    asked = max(int(spark.conf.get(PARTS, "1")), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows // PART_ROWS > asked:
        spark.conf.set(PARTS, str(rows // PART_ROWS))


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()
