"""Intervals in nested bins: which of them contain another, without meeting all.

Bins of width 16, 256, 4096 and so on are nested. An interval sits in the smallest
bin that holds it whole; whatever contains it sits in that bin or one around it. So
a place asks one bin a level, by an equi-join, and few levels mean few copies of it.
The intervals of one bin all span one of 15 borders in it, or lie in the 16 numbers of a
least one: where they are nested, as code units are, a bin holds no more of them than
some 16 times their depth, however many a file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The level of the one bin that holds negative and other numbers alike.
TOP = 64
#: Levels are multiples of this.
STEP = 4


def bin_level(start: Column, end: Column) -> Column:
    """The level (log2 of the width) of the smallest bin that holds both."""
    apart = start.cast("long").bitwiseXOR(end.cast("long"))
    return F.when(apart == 0, STEP).otherwise(F.ceil(F.length(F.bin(apart)) / STEP) * STEP).cast("int")


def bin_number(point: Column, level: Column) -> Column:
    """The bin of a point at a level; shifts are by less than 64 bits."""
    return F.when(level < TOP, F.call_function("shiftright", point.cast("long"), F.least(level, F.lit(TOP - 1)))).otherwise(F.lit(0).cast("long"))


def containment_join(outer: DataFrame, inner: DataFrame, keys: list[str], outer_range: tuple[str, str], inner_range: tuple[str, str], spans: DataFrame | None = None) -> DataFrame:
    """Rows of ``inner`` with each row of ``outer`` of equal ``keys`` whose range holds
    theirs (both ends inclusive, whole numbers).

    Ranges with a null end, or an end before the start, contain nothing and are
    in nothing. Keys come once; other columns must differ in name. Levels are asked only
    if an outer range has them: at most 16 numbers. These are found from ``spans``, which
    has the outer ranges as well, where shuffles lie between the two.
    """
    (s, e), (ps, pe) = outer_range, inner_range
    clash = (set(outer.columns) & set(inner.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    # Never null, or else each side would be asked for that, differently, below a shuffle
    # that the two could share.
    sure = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    wide, known = (t.where(F.col(s) <= F.col(e)).withColumn("__level", sure(bin_level(F.col(s), F.col(e)), "int")) for t in (outer, outer if spans is None else spans))
    wide = wide.withColumn("__bin", sure(bin_number(F.col(s), F.col("__level")), "long"))
    # One small row; it is part of the plan, so that shuffles of the outer side are shared.
    levels = known.agg(F.collect_set("__level").alias("__levels"))
    asked = inner.where(F.col(ps) <= F.col(pe)).crossJoin(F.broadcast(levels))
    asked = asked.withColumn("__level", F.explode(F.filter("__levels", lambda k: k >= bin_level(F.col(ps), F.col(pe))))).drop("__levels")
    asked = asked.withColumn("__bin", sure(bin_number(F.col(ps), F.col("__level")), "long"))
    return asked.join(wide, [*keys, "__level", "__bin"]).where((F.col(s) <= F.col(ps)) & (F.col(e) >= F.col(pe))).drop("__level", "__bin")
