"""Incremental results: a stream of finished cases into running scores.

The batch operators apply to each micro-batch; a case that comes again
replaces nothing, as in the batch sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def result_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON-lines files below ``path``, as they come."""
    return spark.readStream.schema(schema).json(path)


def running_totals(rows: DataFrame) -> DataFrame:
    """``tp, fp, fn`` by k over all that has come."""
    return rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def start_totals(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return running_totals(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what comes to a table; a restart resumes after the last batch."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
