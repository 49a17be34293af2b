"""Vectorised words and word shingles over Arrow text columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

_LOW = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def portions(batch: pa.RecordBatch, at: int, limit: int = 2 << 20):
    """Slices of a batch of up to ``limit`` bytes of text in column ``at``; a
    longer text is a slice of its own. They bound a worker's memory."""
    ends = pa.compute.binary_length(batch.column(at).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < batch.num_rows:
        done = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of runs of bytes, eight bytes at a time for all runs."""
    h = mix(lengths.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64))
    if not len(starts):
        return h
    eight = np.ndarray((len(data),), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(h ^ (eight[starts] & _LOW[np.minimum(lengths, 8)]))
    left, at = np.flatnonzero(lengths > 8), 8
    while len(left):
        h[left] = mix(h[left] * np.uint64(3) ^ (eight[starts[left] + at] & _LOW[np.minimum(lengths[left] - at, 8)]))
        at += 8
        left = left[lengths[left] > at]
    return h


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each row's first word.

    Words are runs of bytes other than the space and 0x09 to 0x0D.
    """
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    lengths = np.flatnonzero(~gap & after) + 1 - starts
    h = run_hashes(data, starts, lengths)
    return h, np.searchsorted(starts, offsets)


def shingle_sets(column, words: int):
    """For each row its distinct shingle hashes, sorted.

    A row with fewer words has its whole sequence as its one shingle; a row
    without words has none.
    """
    h, first = word_hashes(column)
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 3, 1 << 64)) for j in range(words)]
    n = len(h) - words + 1
    if n > 0:
        s = h[:n] * factors[0]
        for j in range(1, words):
            s = (s ^ (s >> np.uint64(29))) + h[j : j + n] * factors[j]
        s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(s[a : b - words + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=8, person=b"short").digest()
            yield np.frombuffer(digest, dtype="<u8")
        else:
            yield h[:0]
