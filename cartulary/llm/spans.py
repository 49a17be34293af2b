"""Spans of regular expressions in texts, by built-in functions only.

Splitting a text at a pattern gives the parts between its matches, in order,
so the lengths of parts and matches give every match's place. Running sums go
by blocks, so they stay linear in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


def with_matches(df: DataFrame, text: str, name: str, pattern: str, guard: Column, group: int | None = None, words: int | None = None) -> DataFrame:
    """Add ``name``: an array of ``start``, ``end`` (code points, end
    exclusive), ``value``, ``group``'s text, and the text just ahead (``lhs``) and
    behind (``rhs``).

    ``guard`` is a cheap condition that any text with a match meets.
    ``pattern`` is in Java's syntax, must not match the empty string and must
    not depend on where a search starts. A null text has no matches. With
    ``words`` the texts ahead and behind hold so many whole words at least, where
    there are so many, and reach back to the match before and on to the next.
    """
    empty = F.array().cast("array<string>")
    p, seg, m, g, n = (f"__{name}_{x}" for x in ("p", "seg", "m", "g", "n"))
    has = guard & F.col(text).rlike(pattern)
    df = df.withColumn(p, F.coalesce(has, F.lit(False)))
    df = df.withColumn(seg, F.when(F.col(p), F.split(text, pattern, -1)).otherwise(empty))
    df = df.withColumn(m, F.when(F.col(p), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(empty))
    df = df.withColumn(g, F.when(F.col(p), F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(empty) if group else F.col(m))
    # Lengths of each part and the match after it, summed before each match. What
    # is read once an element is bound to a variable first: the optimizer would
    # put the expression of a column in its place, to be made anew each time.
    df = df.withColumn(n, F.expr(f"transform({m}, (x, i) -> length({seg}[i]) + length(x))"))
    sums = f"transform(sequence(0, cast(greatest(size({n}) - 1, 0) div {_BLOCK} as int)), b -> aggregate(slice({n}, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"
    before = f"aggregate({sums}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    start = f"q.b[cast(i div {_BLOCK} as int)] + aggregate(slice(q.n, i - i % {_BLOCK} + 1, i % {_BLOCK}), 0, (a, y) -> a + y) + length(q.seg[i])"
    ahead, behind = "right(q.seg[i], 96)", "left(q.seg[i + 1], 48)"
    if words:
        ahead = f"substring_index(concat(if(i > 0, q.m[i - 1], ''), q.seg[i]), ' ', -{words + 1})"
        behind = f"substring_index(concat(q.seg[i + 1], coalesce(get(q.m, i + 1), '')), ' ', {words + 1})"
    made = f"named_struct('start', {start}, 'end', {start} + length(x), 'value', x, 'group', q.g[i], 'lhs', {ahead}, 'rhs', {behind})"
    df = df.withColumn(name, F.expr(f"transform(array(named_struct('b', {before}, 'n', {n}, 'seg', {seg}, 'g', {g}{', ' + repr('m') + ', ' + m if words else ''})), q -> transform({m}, (x, i) -> {made}))[0]"))
    return df.drop(p, seg, m, g, n)


def joined(spans: str, kinds: list[str]) -> str:
    """SQL for ``kind:start:end``, comma-joined, of an array of structs
    (start, kind number, end)."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def tagged(name: str, kind: int, keep: str = "true") -> str:
    """SQL for the spans of ``name`` that pass ``keep`` (of x), as structs."""
    return f"transform(filter({name}, x -> {keep}), x -> named_struct('start', x.start, 'kind', {kind}, 'end', x.end))"
