"""As-of join: for each row the last, next or nearest row of another table.

Both sides stand in one order of key and point, cut into ranges. Within a range
the last and the next row of the right side are running values; what reaches over
a range's border is one row a range, carried over between the ranges. So a key of
any number of rows costs what its rows cost, and no row meets more than two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..scratch import cut

#: Rows of a range, about: there are more ranges for more rows, so a task sorts as many.
RANGE_ROWS = 200_000
DIRECTIONS = ("backward", "forward", "nearest")


def _number(df: DataFrame, point: str) -> Column:
    """A point as a number: microseconds of a timestamp, days of a date."""
    kind = df.schema[point].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(point).cast("timestamp"))
    return F.unix_date(point) if isinstance(kind, DateType) else F.col(point)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_point: str, right_point: str, direction: str = "backward", tie: str | None = None, tolerance: float | None = None, how: str = "left") -> DataFrame:
    """``left`` with the columns of the row of ``right`` of equal ``keys`` whose point
    is the last not after (``backward``), the first not before (``forward``) or the
    closest (``nearest``), at most ``tolerance`` away (microseconds of timestamps, days
    of dates).

    Of right rows at one point, and of an earlier and a later one equally close,
    the one of the least ``tie`` counts (by default the least row, and the earlier
    one). Rows of ``left`` without a match, or with a null key or point, keep nulls
    (``how="left"``) or go (``how="inner"``). Right rows with a null key or point match
    nothing. Repeated left rows all stay.
    """
    if direction not in DIRECTIONS or how not in ("left", "inner"):
        raise ValueError("direction is backward, forward or nearest; how is left or inner")
    own = [c for c in right.columns if c not in keys]
    clash = set(own) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(f"`{k}`").isNotNull()
    r = right.where(known).select(key.alias("k"), _number(right, right_point).alias("p"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("r")).where("p is not null")
    first = F.col("r") if tie is None else F.struct(F.col(f"r.`{tie}`"), "r")
    r = r.groupBy("k", "p").agg(F.min_by("r", first).alias("r"))
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l")
    lrows = left.select(key.alias("k"), _number(left, left_point).alias("p"), whole, known.alias("known"))
    r_type, l_type = r.schema["r"].dataType, lrows.schema["l"].dataType
    asked = lrows.where("known and p is not null").select("k", "p", F.lit(1).alias("side"), F.lit(None).cast(r_type).alias("r"), "l", F.monotonically_increasing_id().alias("n"))
    rows = r.select("k", "p", F.lit(0).alias("side"), "r", F.lit(None).cast(l_type).alias("l"), F.lit(-1).cast("long").alias("n")).union(asked)
    # The number spreads left rows of one key and point over several ranges.
    ranges_n = max(left.sparkSession.sparkContext.defaultParallelism, (left.count() + right.count()) // RANGE_ROWS)
    blocks = cut(rows.repartitionByRange(ranges_n, "k", "p", "side", "n").withColumn("block", F.spark_partition_id()), "asof")
    here = F.when(F.col("side") == 0, F.struct("k", "p", "r"))
    # Both orders have the right row of a point ahead of its left rows.
    up = Window.partitionBy("block").orderBy("k", "p", "side")
    down = Window.partitionBy("block").orderBy(F.desc("k"), F.desc("p"), "side")
    so_far = (Window.unboundedPreceding, 0)
    seen = blocks.repartitionByRange(ranges_n, "block")
    edges = blocks.where("side = 0").groupBy("block").agg(F.max_by(F.struct("k", "p", "r"), F.struct("k", "p")).alias("last"), F.min_by(F.struct("k", "p", "r"), F.struct("k", "p")).alias("first"))  # a row a range
    before, after = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.select("block").distinct().join(edges, "block", "left")
    ranges = ranges.select("block", F.last("last", ignorenulls=True).over(before).alias("carried_last"), F.last("first", ignorenulls=True).over(after).alias("carried_next"))
    if direction != "forward":
        seen = seen.withColumn("last", F.last(here, ignorenulls=True).over(up.rowsBetween(*so_far)))
    if direction != "backward":
        seen = seen.withColumn("next", F.last(here, ignorenulls=True).over(down.rowsBetween(*so_far)))
    out = seen.where("side = 1").join(F.broadcast(ranges), "block")

    def candidate(found: str, carried: str) -> Column:
        c = F.coalesce(found, carried)
        same = c["k"] == F.col("k")
        close = F.lit(True) if tolerance is None else F.abs(c["p"] - F.col("p")) <= tolerance
        return F.when(same & close, c)

    if direction == "backward":
        best = candidate("last", "carried_last")["r"]
    elif direction == "forward":
        best = candidate("next", "carried_next")["r"]
    else:
        out = out.withColumns({"a": candidate("last", "carried_last"), "b": candidate("next", "carried_next")})
        da, db = F.col("p") - F.col("a.p"), F.col("b.p") - F.col("p")
        later = (db < da) if tie is None else (db < da) | ((db == da) & (F.col(f"b.r.`{tie}`") < F.col(f"a.r.`{tie}`")))
        best = F.when(F.col("a").isNull() | later, F.col("b.r")).otherwise(F.col("a.r"))
    out = out.select("l", best.alias("r"))
    if how == "inner":
        out = out.where("r is not null")
    else:
        out = out.union(lrows.where("not known or p is null").select("l", F.lit(None).cast(r_type).alias("r")))
    return out.select(*[F.col(f"l.`{c}`").alias(c) for c in left.columns], *[F.col(f"r.`{c}`").alias(c) for c in own])
