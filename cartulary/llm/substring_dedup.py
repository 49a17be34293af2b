"""Substring de-duplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash of the
last bytes is small. Only those bytes decide, so a passage that stands in two
texts is cut alike in both from its first boundary on, whatever was inserted
before it. Chunks with equal digests are occurrences of one chunk: the first,
by document and place, stays. Later occurrences that touch merge into spans.

Digests are counted first, as bitmaps; only chunks that may repeat become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, cut, held, set_aside, share
from .frequency import frequency_maps
from .vectext import portions, run_hashes, text_bytes

#: Of 256 values of the hash, those that end a chunk: about 21 bytes each.
ENDING = 12
#: No boundary follows another this closely, and none is further away.
LEAST, MOST = 8, 512
#: The gear: a fixed random number for each byte.
GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(1024), dtype="<u4")


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks end, over all rows' bytes; rows end a chunk as well."""
    # Rows stand apart, so that a text is cut alike after whatever row.
    apart = np.arange(len(data)) + 16 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    h = np.zeros(len(data) + 16 * len(offsets), np.uint32)
    h[apart] = GEAR[data]
    for step in (1, 2, 4, 8):
        before = np.zeros_like(h)
        before[step:] = h[:-step]
        h = h + (before << np.uint32(step))
    ends = ((h[apart] >> np.uint32(8)) & np.uint32(255)) < ENDING
    # Bytes of one character stay together.
    ends[:-1] &= (data[1:] & 0xC0) != 0x80
    # Of boundaries close together the first counts.
    wide = np.zeros(len(h), np.int32)
    wide[apart] = ends
    seen = np.cumsum(wide)
    floor = np.zeros_like(seen)
    floor[LEAST:] = seen[:-LEAST]
    ends &= (seen - wide == floor)[apart]
    at = np.union1d(np.flatnonzero(ends) + 1, offsets[1:])
    at = at[at > 0]
    # Overlong chunks are cut at steps from their start, between characters.
    starts = np.concatenate([[0], at[:-1]])
    more = []
    for k in np.flatnonzero(at - starts > MOST):
        steps = np.arange(starts[k] + MOST, at[k], MOST)
        for _ in range(3):
            steps = steps - ((data[steps] & 0xC0) == 0x80)
        more.append(steps)
    return np.union1d(at, np.concatenate(more)) if more else at


def chunks_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rows' bytes, their offsets, and the chunks' starts and lengths."""
    data, offsets = text_bytes(column)
    if not len(data):
        return data, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = chunk_ends(data, offsets)
    starts = np.concatenate([[0], at[:-1]]).astype(np.int64)
    return data, offsets, starts, at - starts


def _digests(column) -> Iterator[np.ndarray]:
    data, offsets, starts, lengths = chunks_of(column)
    h = run_hashes(data, starts, lengths)
    edge = np.searchsorted(starts, offsets)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield h[a:b]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 0) -> DataFrame:
    """Later occurrences of repeated text, one row per merged span.

    Returns ``id_col``, ``text_key`` (a hash of the text, so that rows with one
    id and several texts differ), ``start`` and ``end`` (code points, end
    exclusive), ``n_words`` (words that start inside) and ``first_doc_ids``
    (documents of the first occurrences, null ids left out). Order is by id,
    null first, then text, then place. Rows equal in id and text are one
    occurrence. Every repeated chunk is in a span; a caller who looks for
    passages only leaves out spans of fewer words than ``min_words``. A passage is
    longer than its span, by a part of a chunk at both ends. Null and empty texts
    have none; texts may be of any length.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("t"))
    maps = share(bounded_batches(docs), frequency_maps(source.select("t"), _digests, (1,)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b, 1)):
            data, offsets, starts, lengths = chunks_of(batch.column(1))
            one = run_hashes(data, starts, lengths)
            keep = np.flatnonzero(held(maps).levels(one) > 0)
            if not len(keep):
                continue
            two = run_hashes(data, starts[keep], lengths[keep], 1)
            row = np.searchsorted(offsets, starts[keep], side="right") - 1
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            gap = (data == 32) | ((data >= 9) & (data <= 13))
            begins = ~gap
            begins[1:] &= gap[:-1]
            words = np.concatenate([[0], np.cumsum(begins)])
            texts = batch.column(1).to_pylist()
            keys = {r: int.from_bytes(hashlib.blake2b(texts[r].encode(), digest_size=8).digest(), "little", signed=True) for r in np.unique(row).tolist()}
            key = np.array([keys[r] for r in row.tolist()], np.int64)
            a, b = starts[keep], starts[keep] + lengths[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(key),
                    pa.array((points[a] - points[offsets[row]]).astype(np.int32)),
                    pa.array((points[b] - points[offsets[row]]).astype(np.int32)),
                    pa.array((words[b] - words[a]).astype(np.int32)),
                    pa.array(one[keep].view(np.int64)),
                    pa.array(two.view(np.int64)),
                ],
                ["id", "text_key", "start", "end", "words", "d1", "d2"],
            )

    kind = dict(source.dtypes)["id"]
    rows = cut(source.mapInArrow(chunks, f"id {kind}, text_key bigint, start int, end int, words int, d1 bigint, d2 bigint"), "chunks")
    place = F.struct("id", "text_key", "start")
    firsts = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    later = rows.join(firsts, ["d1", "d2"]).where(place != F.col("first"))
    later = later.select("id", "text_key", "start", "end", "words", F.col("first.id").alias("first_id")).dropDuplicates(["id", "text_key", "start"])
    by_text = Window.partitionBy("id", "text_key").orderBy("start")
    begins = F.when(F.lag("end").over(by_text) == F.col("start"), 0).otherwise(1)
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_text))
    spans = runs.groupBy("id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.array_sort(F.collect_set("first_id")).alias("first_doc_ids")
    )
    return spans.where(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), "text_key", "start", "end", "n_words", "first_doc_ids")


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text of ``spans`` that :func:`repeated_spans` found
    in them; null texts stay null."""

    inner, names, back = set_aside(docs)
    at = inner.columns.index(names[text])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "__key"])

    keyed = inner.mapInArrow(key, StructType([*inner.schema.fields, StructField("__key", LongType())]))
    cover = spans.groupBy(F.col(id_col).alias("__id"), F.col("text_key").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cover"))
    joined = keyed.join(cover, F.col(names[id_col]).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    # What stands between the spans: from an end, or 0, to the next start.
    ends = "concat(array(0), transform(__cover, c -> c.end))"
    starts = "concat(transform(__cover, c -> c.start), array(length({t})))"
    t = names[text]
    rest = f"array_join(zip_with({ends}, {starts.format(t=t)}, (a, b) -> substr({t}, a + 1, b - a)), '')"
    return back(joined.withColumn(t, F.expr(f"if(__cover is null, {t}, {rest})")))
