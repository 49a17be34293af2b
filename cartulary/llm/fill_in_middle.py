"""Fill-in-middle transformation by rank and select over token boundaries.

A token is a run of blanks (the space and 0x09 to 0x0D) with the run of other
characters behind it, or the blanks at a text's end. The bytes of a batch of texts
get two packed bitvectors: where tokens end and where characters start. The
popcount of a text's part of the first is its number of tokens n, select on two
seeded ranks gives the two byte cuts, and ranks in the second turn them into
characters. Spark cuts, joins and restores the texts by built-in functions; only
texts go to Python and only numbers come back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, set_aside
from .rank_select import Bits
from .vectext import portions, text_bytes

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are transformed, and of a hundred of those so many
#: have the suffix first.
RATE, SPM_RATE = 50, 80
CUTS = "n bigint, first bigint, second bigint, prefix_chars bigint, middle_chars bigint"


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def token_ends(data: np.ndarray, offsets: np.ndarray) -> Bits:
    """Bits at the last byte of each token; a text's last byte ends one."""

    def flags(a: int, b: int) -> np.ndarray:
        blank = _blank(data[a : b + 1])
        out = np.zeros(b - a, bool)
        inner = len(blank) - 1 if b < len(data) else b - a - 1
        out[:inner] = ~blank[:inner] & blank[1 : inner + 1]
        lo, hi = np.searchsorted(last, [a, b])
        out[last[lo:hi] - a] = True
        return out

    last = offsets[1:][np.diff(offsets) > 0] - 1
    return Bits(flags, len(data))


def char_starts(data: np.ndarray) -> Bits:
    """Bits at the first byte of each UTF-8 character."""
    return Bits(lambda a, b: (data[a:b] & 0xC0) != 0x80, len(data))


def cuts(column: pa.Array, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """For each text its number of tokens n, the bytes before its two cuts, and
    the characters of prefix and middle; the cuts are after as many tokens as
    the smaller and the larger of the two numbers modulo n + 1."""
    data, offsets = text_bytes(column)
    ends, chars = token_ends(data, offsets), char_starts(data)
    before = ends.rank(offsets)
    n = np.diff(before)
    units = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    at = []
    for k in units:
        # The cut after no token is the start.
        place = np.zeros(len(n), np.int64)
        some = np.flatnonzero(k)
        place[some] = ends.select(before[:-1][some] + k[some]) + 1 - offsets[:-1][some]
        at.append(place)
    marks = [chars.rank(offsets[:-1] + p) for p in (0, *at)]
    return [n, *at, marks[1] - marks[0], marks[2] - marks[1]]


def _numbers(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text, one, two], ["text", "one", "two"])
    parts = [cuts(b.column(0), *[b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]) for b in portions(batch, 0)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "first", "second", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add ``n`` (tokens), ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars``,
    ``middle_chars`` (null for plain) and ``output``, the transformed text.

    psm is prefix, suffix, middle and spm suffix, prefix, middle, each behind its
    mark. All chance comes from the SHA-256 of the seed and the id, so repeated
    rows and reruns agree; a null id counts as an empty one. Empty texts and
    texts that hold a mark stay plain; a null text is an empty one. Texts of
    any length are taken whole: flags are made a megabyte at a time and kept as
    bits. Columns of the new names are replaced, all others stay, whatever
    their names. An empty table stays empty.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    bounded_batches(docs)
    inner, names, back = set_aside(docs, *new)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names[id_col]).cast("string"), F.lit(""))), 256)
    inner = inner.withColumns({"__text": F.coalesce(F.col(names[text]), F.lit("")), "__key": key})
    h = [F.conv(F.substring("__key", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = inner.withColumn("__cut", F.arrow_udf(_numbers, CUTS)("__text", h[0], h[1]))
    held = F.col("__text") == ""
    for mark in marks:
        held = held | F.col("__text").contains(mark)
    form = F.when(held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    raw = F.col("__text").cast("binary")

    def part(start: Column | int, end: Column | None) -> Column:
        begin = F.lit(start) if isinstance(start, int) else start
        stop = F.octet_length("__text") if end is None else end
        return F.substring(raw, (begin + 1).cast("int"), (stop - begin).cast("int")).cast("string")

    first, second = F.col("__cut.first"), F.col("__cut.second")
    prefix, middle, suffix = part(0, first), part(first, second), part(second, None)
    p, s, m = (F.lit(x) for x in marks)
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("__text"))
    moved = F.col("form") != "plain"
    rows = rows.withColumns({"n": F.col("__cut.n"), "prefix_chars": F.when(moved, F.col("__cut.prefix_chars")), "middle_chars": F.when(moved, F.col("__cut.middle_chars")), "output": output})
    return back(rows, *new)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before :func:`fill_in_middle`, from its output and form alone."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    one, two, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(F.col(form) == "psm", F.concat(one, middle, two)).when(F.col(form) == "spm", F.concat(two, middle, one)).otherwise(F.col(output))


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """The transformed texts of ``docs`` and the texts restored from them, as SHA-256."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


BLANKS = r"\x20\x09-\x0D"
TOKEN = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")

ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
t as (select *, regexp_extract_all(text, '{TOKEN.pattern}') as w, ('0x' || substr(key, 1, 8))::bigint as h1, ('0x' || substr(key, 9, 8))::bigint as h2,
        ('0x' || substr(key, 17, 8))::bigint as h3, ('0x' || substr(key, 25, 8))::bigint as h4 from d),
u as (select *, len(w)::bigint as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b from t),
c as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
             when h4 % 100 < 80 then 'spm' else 'psm' end as form from u)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256,
       sha256(p || m || s) as restored_sha256
from c
"""
