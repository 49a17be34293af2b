"""Best-fit packing of tokenised documents into sequences.

Pieces over a third of the capacity ("large") go at most two to a sequence and
are matched greedily, the largest first with the largest partner that fits.
The others fill the gaps that remain, the largest first, each into the
smallest gap that holds it.

Equal lengths are interchangeable, so both steps run on the counts by length:
the driver gets at most ``capacity`` numbers however many pieces there are,
and a group of equal gaps takes a whole run of pieces at once. The plan says,
for ranks of pieces of one length, in which sequences they go. Ranks come from
counts by length and hash bucket, so no task ranks all pieces of a length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, comparable, cut, set_aside
from .vectext import portions, run_hashes, text_bytes

#: Bytes of pieces of text and their ids that a Python worker keeps, twice, and
#: what one of them takes beside its own bytes.
CACHE, ENTRY = 32 << 20, 200
#: Bytes of texts that a Python worker encodes at once, and one longer text.
PORTION = 2 << 20
#: Pieces that one rank bucket holds on average at most.
BUCKET_ROWS = 20_000

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


class Kept:
    """What was asked for lately, in two generations of bounded bytes: as the
    younger fills, the older is forgotten."""

    def __init__(self, most: int):
        self.most, self.used, self.young, self.old = most, 0, {}, {}

    def keep(self, key: bytes, value: bytes) -> None:
        self.young[key] = value
        self.used += len(key) + len(value) + ENTRY

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Those of ``keys`` not known; the others are in ``young`` from now on."""
        if self.used > self.most:
            self.old, self.young, self.used = self.young, {}, 0
        out = []
        for k in keys - self.young.keys():
            if (v := self.old.get(k)) is None:
                out.append(k)
            else:
                self.keep(k, v)
        return out


# The parts of a vocabulary file that the cuts below rely on.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def may_cut(vocabulary: dict) -> bool:
    """Whether texts may be cut into pieces for the vocabulary of this JSON: it
    has the parts above and word ends, no random merges, and no added token
    but special ones."""
    model = vocabulary["model"]
    return (
        vocabulary["normalizer"] == NORMALIZER
        and vocabulary["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}
        and (model["type"], model["end_of_word_suffix"], model["dropout"] or 0) == ("BPE", "</w>", 0)
        and not model["continuing_subword_prefix"]
        and vocabulary["post_processor"] is None
        and vocabulary["truncation"] is None
        and vocabulary["padding"] is None
        and all(t["special"] for t in vocabulary["added_tokens"])
    )


class PieceEncoder:
    """Ids of texts as little-endian bytes, encoding each distinct piece once.

    Where the vocabulary allows it (:func:`may_cut`), texts are cut where a
    pre-token surely ends: at spaces and line feeds, and between a letter or
    digit and a sign of SIGNS; any other vocabulary gets whole texts.
    A-Z are lower-cased, as the vocabulary does. Words of letters go to the
    tokenizer together and are told apart by their end-of-word tokens, other
    pieces one by one. The strings of special tokens are ordinary text.
    """

    SIGNS = b".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cuts = may_cut(json.loads(self.tokenizer.to_str()))
        self.known = Kept(CACHE)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self.is_sign = np.zeros(256, bool)
        self.is_sign[list(self.SIGNS)] = True
        self.is_plain = np.array([bytes([b]).isalnum() for b in range(256)])

    def __call__(self, column: pa.Array) -> list[bytes]:
        """The ids of each row of an Arrow column of texts; null is empty."""
        if not self.cuts:
            return self._whole([t or "" for t in column.to_pylist()])
        data, offsets = text_bytes(column)
        if not len(data):
            return [b""] * (len(offsets) - 1)
        data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        starts, lengths = self._pieces(data, offsets)
        # Each distinct piece is looked up once; its ids then go where it stands.
        one, two = run_hashes(data, starts, lengths), run_hashes(data, starts, lengths, 1)
        order = np.argsort(one)
        edge = np.ones(len(order), bool)
        edge[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(edge) - 1
        at = order[edge]
        raw = data.tobytes()
        ids = self._ids([raw[a : a + n] for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        firsts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        own = sizes[which]
        ends = np.cumsum(own)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts[which] - ends + own, own)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[place].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]).tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap, sign, plain = (data == 32) | (data == 10), self.is_sign[data], self.is_plain[data]
        # Letters of two bytes that begin with 0xC3, all but two signs.
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        first, last = plain | lead, plain.copy()
        last[1:] |= lead[:-1]
        new = ~gap
        new[1:] &= gap[:-1] | (last[:-1] & sign[1:]) | (sign[:-1] & first[1:])
        bounds = offsets[:-1][offsets[:-1] < len(data)]
        new[bounds] = ~gap[bounds]
        starts = np.flatnonzero(new)
        # A piece ends before the next one, or before a gap or its text's end.
        stop = np.append(gap, True)
        stop[offsets[1:]] = True
        stop[starts] = True
        stops = np.flatnonzero(stop)
        return starts, stops[np.searchsorted(stops, starts, side="right")] - starts

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        new = known.missing(set(pieces))
        if new:
            texts = [x.decode() for x in new]
            words = [k for k, t in enumerate(texts) if t.isalpha()]
            others = [k for k, t in enumerate(texts) if not t.isalpha()]
            for k, ids in zip(others, self._whole([texts[k] for k in others]), strict=True):
                known.keep(new[k], ids)
            for at in range(0, len(words), 2048):
                part = words[at : at + 2048]
                for k, ids in zip(part, self._words([texts[k] for k in part]), strict=True):
                    known.keep(new[k], ids)
        return [known.young[x] for x in pieces]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(last) != len(words):  # lower case made more pre-tokens of a word than one
            return self._whole(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]


def encoder(path: str) -> PieceEncoder:
    """This process's encoder, kept from task to task with what it knows.

    Functions come to workers by value, with their module's names; what shall
    outlive a task is kept at a module that stays.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_cartulary_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, ``end_id`` at their end, into pieces.

    Returns the columns of ``docs`` but the text, and ``piece`` (from 0),
    ``start`` (ids before it), ``length``, ``ids_crc32`` (of little-endian
    32-bit ids) and, if asked for, ``ids`` (those bytes). A null text counts as
    empty. Columns of those names in ``docs``, and of the names ``sequence_id`` and
    ``offset``, are replaced; all others stay, whatever they are called. A text
    stands in memory with some tens of bytes for each of its own.
    """
    bounded_batches(docs)
    made = ["piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    inner, names, back = set_aside(docs, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", consumed=text)
    kept = [c for c in inner.columns if c != names[text]]
    schema = inner.select(*kept).schema
    for name, kind in zip(made, ("integer", "long", "long", "long", "binary"), strict=False):
        schema = schema.add(name, kind)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1, PORTION):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(encode(part.column(part.num_columns - 1))):
                    raw += end
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        row.append(i)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        ids.append(own)
                columns = [c.take(pa.array(row, pa.int64())) for c in part.columns[:-1]]
                columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=schema.names)

    return back(inner.select(*kept, names[text]).mapInArrow(pieces, schema), *made)


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit packing of ``counts[length]`` pieces of each length.

    Returns rows ``(length, first rank, pieces per sequence, first sequence,
    first offset)`` and the number of sequences: the piece of rank r, counted
    from the row's first rank as d, goes to sequence first + d // per, at
    offset + d % per * length. Rows of a length have rising first ranks.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number)
    sizes: list[int] = []  # the gaps there are, rising
    made = 0

    def put(n: int, number: int, per: int, sequence: int, offset: int) -> None:
        rows.append((n, rank[n], per, sequence, offset))
        rank[n] += number * per
        left[n] -= number * per

    def free(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((sequence, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            number = left[n]
            put(n, number, 1, made, 0)
            free(capacity - n, made, number)
        elif large[at] == n:
            number = left[n] // 2
            if number:
                put(n, number, 2, made, 0)
                free(capacity - 2 * n, made, number)
            else:
                number = 1
                lower = next((m for m in reversed(large[:at]) if left[m]), None)
                put(n, 1, 1, made, 0)
                if lower is not None:
                    put(lower, 1, 1, made, n)
                free(capacity - n - (lower or 0), made, 1)
        else:
            m = large[at]
            number = min(left[n], left[m])
            put(n, number, 1, made, 0)
            put(m, number, 1, made, n)
            free(capacity - n - m, made, number)
        made += number

    for n in sorted((n for n in left if 3 * n <= capacity and left[n]), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                per = min(capacity // n, left[n])
                number = left[n] // per
                put(n, number, per, made, 0)
                free(capacity - per * n, made, number)
                made += number
                continue
            gap = sizes[at]
            sequence, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            per = min(gap // n, left[n])
            full = min(number, left[n] // per)
            put(n, full, per, sequence, capacity - gap)
            free(gap - per * n, sequence, full)
            free(gap, sequence + full, number - full)
    return rows, made


def pack(pieces: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most
    ``capacity``.

    ``key`` orders rows of equal length; rows with equal keys are told apart by
    their other columns, and fully equal rows are interchangeable. Rows of
    length 0 or null, or over the capacity, get nulls; an empty table stays
    empty. Columns named ``sequence_id`` or ``offset`` are replaced. ``pieces`` should be a written table, for it is read twice.
    """
    inner, names, back = set_aside(pieces, "sequence_id", "offset")
    length = names["length"]
    ok = F.col(length).between(1, capacity)
    counts = inner.where(ok).groupBy(length).count()
    counts = {int(r[length]): r["count"] for r in counts.toLocalIterator()}  # at most `capacity` rows
    plan, _ = plan_packing(counts, capacity)
    plan.sort()
    lengths, firsts, pers, sequences, offsets = (np.array(x, dtype=np.int64) for x in (zip(*plan, strict=True) if plan else ((),) * 5))
    plan_ = pieces.sparkSession.sparkContext.broadcast((lengths, firsts, pers, sequences, offsets))

    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS))
    own = inner.columns
    rows = inner.withColumn("order", F.xxhash64(*comparable(inner))).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sizes = rows.groupBy(length, "bucket").count()
    before = sizes.select(length, "bucket", (F.sum("count").over(Window.partitionBy(length).orderBy("bucket")) - F.col("count")).alias("before"))
    in_bucket = Window.partitionBy(length, "bucket").orderBy("order", *[names[k] for k in key if k in names])
    ranked = rows.withColumn("rank", F.row_number().over(in_bucket) - 1).join(before, [length, "bucket"], "left")
    ranked = ranked.select(*own, F.when(ok, F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"))
    schema = inner.schema.add("sequence_id", "long").add("offset", "long")
    at_length = own.index(length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, pers, sequences, offsets = plan_.value
        # A row of the plan by (length, rank): lengths' first rows, then ranks.
        wide = int(firsts.max(initial=0)) + max(counts.values(), default=0) + 1
        keys = lengths * wide + firsts
        for batch in batches:
            n = batch.column(at_length).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column(batch.num_columns - 1)
            none = r.is_null().to_numpy(zero_copy_only=False)
            r = r.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.maximum(np.searchsorted(keys, n * wide + r, side="right") - 1, 0)
            if len(keys):
                d = r - firsts[at]
                sequence, offset = sequences[at] + d // pers[at], offsets[at] + d % pers[at] * lengths[at]
            else:
                sequence = offset = np.zeros(len(r), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64(), mask=none), pa.array(offset, pa.int64(), mask=none)], names=schema.names)

    return back(ranked.mapInArrow(place, schema), "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; one row per piece, with its place.

    With ``with_ids`` each row also carries its ids' bytes, which
    :func:`sequences` concatenates.
    """
    return pack(cut(tokenised_pieces(docs, tokenizer_path, text, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id`` and ``ids``, an array of ints.

    Needs the ``ids`` column; a sequence has at most ``capacity`` pieces.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b"".join(x), dtype="<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    grouped = packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return grouped.select("sequence_id", F.col("x.ids").alias("ids")).mapInArrow(whole, "sequence_id bigint, ids array<int>")
