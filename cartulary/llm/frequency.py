"""Token frequencies over all texts, as bitmaps of a bounded size.

The maps have about two bits for each token of the texts, up to MOST_BITS each.
Beyond, more and more rare tokens fall on marked bits and count as frequent
ones: callers then make more rows, in proportion to the texts, and no other
results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import portions

#: Bits of each map, as powers of two: 16 MB each at most.
LEAST_BITS, MOST_BITS = 20, 27
_FLUSH = 2_000_000
#: Lowest bytes of a run's differences that are sent as they are.
NOISE = 2


def frequency_maps(texts: DataFrame, tokens_of: Callable, above: tuple[int, ...]) -> TokenMaps:
    """Bitmaps of the tokens that occur over ``above[k]`` times, one for each k; these rise.

    ``tokens_of`` gives an array of 64-bit hashes for each row of an Arrow
    column; ``texts`` has one column. A map's bit at the hash's upper bits is set
    for every frequent token, and for few others.

    Tokens are counted by 40 bits of their hash. Each task sends sorted,
    delta-coded runs of distinct tokens with their counts, as far as counts
    matter, one for each range of hashes, and each range is counted on its own: a
    token that stands in a third of all texts is one entry a run. The driver gets
    the bitmaps, however many rows there are.
    """
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // 4).bit_length()))
    # About 8 MB of text for each range; a range fills whole bytes of the maps.
    ranges = 1 << min(bits - 6, max(4, (size >> 23).bit_length()))
    enough = max(above) + 1  # a count of more is no other answer
    if list(above) != sorted(above):
        raise ValueError("numbers above which tokens are marked must rise")
    if enough >= 1 << 16:
        raise ValueError("counts go by two bytes")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            all_ = np.sort(np.concatenate(held) >> np.uint64(24))
            edge = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1], [True]]))
            all_, many = all_[edge[:-1]], np.minimum(np.diff(edge), enough).astype("<u2")
            bounds = np.searchsorted(all_, (np.arange(ranges + 1, dtype=np.uint64)) << np.uint64(40 - (ranges.bit_length() - 1)))
            delta, first = np.diff(all_, prepend=np.uint64(0)), bounds[:-1][np.diff(bounds) > 0]
            delta[first] = all_[first]
            planes = np.empty((7, len(all_)), np.uint8)
            planes[:5], planes[5:] = delta.view(np.uint8).reshape(-1, 8).T[:5], many.view(np.uint8).reshape(-1, 2).T
            out = []
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                own = planes[:, bounds[r] : bounds[r + 1]]
                # The lowest bytes are as good as random: not worth packing.
                out.append((r, own[:NOISE].tobytes() + zlib.compress(own[NOISE:].tobytes(), 1), own.shape[1]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int32()))], ["r", "run", "n"])

        for part in (p for batch in batches for p in portions(batch, 0)):
            for own in tokens_of(part.column(0)):
                held.append(own)
                n += len(own)
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    cells = (1 << bits) // ranges

    def count(group: pd.DataFrame) -> pd.DataFrame:
        parts, counts = [], []
        for run, n in zip(group["run"], group["n"], strict=True):
            low, rest = (np.frombuffer(x, np.uint8).reshape(-1, n) for x in (run[: NOISE * n], zlib.decompress(run[NOISE * n :])))
            delta = np.zeros((n, 8), np.uint8)
            delta[:, :NOISE], delta[:, NOISE:5] = low.T, rest[: 5 - NOISE].T
            parts.append(np.cumsum(delta.view(np.uint64).ravel(), dtype=np.uint64))
            counts.append(np.ascontiguousarray(rest[5 - NOISE :].T).view("<u2").ravel())
        # Token and count in one number: 40 and 16 bits.
        own = np.sort((np.concatenate(parts) << np.uint64(16)) | np.concatenate(counts).astype(np.uint64))
        token, many = own >> np.uint64(16), (own & np.uint64(0xFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        token, many = token[edge], np.add.reduceat(many, edge)
        packed = []
        for least in above:
            at = (token[many > least] >> np.uint64(40 - bits)).astype(np.int64) % cells
            marks = np.zeros(cells, np.uint8)
            marks[at] = 1
            packed.append(zlib.compress(np.packbits(marks).tobytes(), 1))
        return pd.DataFrame({"r": [int(group["r"].iloc[0])], "maps": [packed]})

    rows = texts.mapInArrow(runs, "r int, run binary, n int").groupBy("r").applyInPandas(count, "r int, maps array<binary>").collect()
    return TokenMaps({r.r: [bytes(x) for x in r.maps] for r in rows}, len(above), ranges, bits)


class TokenMaps:
    """Bitmaps in compressed parts; a worker unpacks them once."""

    def __init__(self, parts: dict[int, list[bytes]], maps: int, ranges: int, bits: int):
        self.parts, self.maps, self.ranges, self.bits, self.unpacked = parts, maps, ranges, bits, None

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        """In how many of the maps each token's bit is set."""
        if self.unpacked is None:
            cells = np.zeros((self.maps, self.ranges, (1 << self.bits) // self.ranges // 8), np.uint8)
            for r, packed in self.parts.items():
                for k, part in enumerate(packed):
                    cells[k, r] = np.frombuffer(zlib.decompress(part), np.uint8)
            self.unpacked = cells.reshape(self.maps, -1)
        cell = (tokens >> np.uint64(64 - self.bits)).astype(np.int64)
        found, at = np.zeros(len(cell), np.int8), None
        # What a map marks, those before it mark as well: each is asked about the rest only.
        for bitmap in self.unpacked:
            marked = np.flatnonzero((bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & np.uint8(1))
            if not len(marked):
                break
            cell, at = cell[marked], marked if at is None else at[marked]
            found[at] += 1
        return found
