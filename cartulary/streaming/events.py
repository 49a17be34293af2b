"""Results by the time they happened: windows, repeats, and state of cases.

Late rows count as long as the watermark allows, and never after. Each operator
takes and gives a DataFrame; over a stream it goes on, over a table it is the
batch query with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """Files as they come below ``path``, or one file."""
    reader = spark.readStream.schema(schema)
    if not any(c in path for c in "*?[{"):
        # As a pattern, a path may be that of a file.
        path = f"{path[:-1]}[{path[-1]}]"
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.format(kind).load(path)


def windowed(rows: DataFrame, time: str, late: str, keys: list[str], *aggregates: Column, length: str = "1 day", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """``keys, start, end`` and the aggregates by tumbling windows of ``length``, sliding
    ones (each ``slide``), or sessions that end after ``gap`` without a row.

    Rows that come more than ``late`` after later ones may be left out.
    """
    window = F.session_window(time, gap) if gap else F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.withWatermark(time, late).groupBy(*keys, window.alias("__w")).agg(*aggregates)
    return out.select(*keys, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "__w")])


def first_of_each(rows: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """One row of each key; a repeat within ``late`` of the first is dropped, state
    for older keys goes."""
    marked = rows.withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def write_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All there is now into a Parquet table; started again with the same
    checkpoint it goes on where it was."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows that tell of a case: ``what`` is iteration (with ``candidates``) or verdict.
CASE_EVENTS = "case_id STRING, at TIMESTAMP, what STRING, k INT, candidates BIGINT, finding_index INT, verdict STRING"
CASE_STATE = "case_id STRING, k INT, candidates BIGINT, true_positive BIGINT, false_positive BIGINT, uncertain BIGINT, closed BOOLEAN"
VERDICTS = ("true_positive", "false_positive", "uncertain")


def last_iterations(events: DataFrame, late: str, idle_ms: int = 86_400_000) -> DataFrame:
    """Each case's last iteration with the verdicts on its findings, as a stream of
    states (``CASE_STATE``) from one of ``CASE_EVENTS``.

    Verdicts may come before their iteration and are kept until a later one
    takes over; those of earlier iterations are late and left out. An iteration
    comes once (repeats agree). Of several
    verdicts on a finding the latest by time counts (of equal times the greatest).
    A case without events for ``idle_ms`` behind the watermark is closed and forgotten:
    its last state comes once more, ``closed``. Update mode.
    """
    marked = events.withWatermark("at", late)
    state = "k INT, candidates BIGINT, verdicts MAP<STRING, STRING>"
    return marked.groupBy("case_id").applyInPandasWithState(_case_step(idle_ms), CASE_STATE, state, "update", GroupStateTimeout.EventTimeTimeout)


def _case_step(idle_ms: int):
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, candidates, verdicts = state.get if state.exists else (None, None, {})
        verdicts = dict(verdicts or {})

        def row(closed: bool) -> pd.DataFrame:
            own = [v.split("|", 1)[1] for name, v in verdicts.items() if k is not None and name.startswith(f"{k}|")]
            return pd.DataFrame([(key[0], k, candidates, *[own.count(v) for v in VERDICTS], closed)], columns=[c.split()[0] for c in CASE_STATE.split(", ")])

        if state.hasTimedOut:
            state.remove()
            if k is not None:
                yield row(True)
            return
        latest = 0
        for part in parts:
            for e in part.itertuples():
                at = int(e.at.value // 1_000)  # microseconds
                latest = max(latest, at // 1_000)
                if e.what == "iteration" and (k is None or e.k >= k):
                    k, candidates = int(e.k), None if pd.isna(e.candidates) else int(e.candidates)
                elif e.what == "verdict" and (k is None or e.k >= k):
                    name, told = f"{int(e.k)}|{int(e.finding_index)}", f"{at:020d}|{e.verdict}"
                    verdicts[name] = max(verdicts.get(name, ""), told)
        # What belongs to earlier iterations is of no use any more.
        verdicts = {n: v for n, v in verdicts.items() if k is None or int(n.split("|")[0]) >= k}
        state.update((k, candidates, verdicts))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        if k is not None:
            yield row(False)

    return step


def last_iterations_batch(events: DataFrame) -> DataFrame:
    """The states that :func:`last_iterations` ends with, from a table of all events."""
    own = events.where("what = 'iteration'")
    last = own.groupBy("case_id").agg(F.max("k").alias("k"))
    size = own.join(last, ["case_id", "k"]).groupBy("case_id", "k").agg(F.max_by("candidates", "at").alias("candidates"))
    told = events.where("what = 'verdict'").groupBy("case_id", "k", "finding_index").agg(F.max(F.struct("at", "verdict"))["verdict"].alias("verdict"))
    counts = told.groupBy("case_id", "k").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return size.join(counts, ["case_id", "k"], "left").na.fill(0, list(VERDICTS)).select("case_id", "k", "candidates", *VERDICTS)


def settled(states: DataFrame) -> DataFrame:
    """The last state of each case from a table of states with ``batch``."""
    fields: list[Any] = [c for c in states.columns if c not in ("batch", "closed")]
    return states.groupBy("case_id").agg(F.max_by(F.struct(*fields), F.struct("batch", "closed")).alias("s")).select("s.*")


def write_states(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's states as a folder of its own, written over if it runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
