"""Join shapes that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .asof import asof_join


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, start: str, end: str, tolerance: int = 0, how: str = "inner", bin_width: int | None = None) -> DataFrame:
    """Rows of ``left`` whose ``point`` lies in a range of ``right``, widened by
    ``tolerance``, where ``keys`` agree.

    The keys make it an equi-join. With ``bin_width`` ranges are also dealt
    to bins, for keys with very many rows and ranges; other than inner joins are
    an error then, for a row unmatched in one bin may match in another.
    """
    if bin_width and how != "inner":
        raise ValueError("bin_width is for inner joins")
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    inside = F.col(point).between(F.col(start) - tolerance, F.col(end) + tolerance)
    on = inside
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}")) if how == "inner" else on & (F.col(k) == F.col(f"__{k}"))
    if bin_width:
        left = left.withColumn("__bin", F.floor(F.col(point) / bin_width))
        bins = F.sequence(F.floor((F.col(start) - tolerance) / bin_width), F.floor((F.col(end) + tolerance) / bin_width))
        r = r.withColumn("__bins", F.explode(bins))
        on = on & (F.col("__bin") == F.col("__bins"))
    out = left.join(r, on, how)
    return out.drop("__bin", "__bins", *[f"__{k}" for k in keys])


def ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Add each row's place (from 0) by ``order``, which has no ties.

    Rows are dealt by ranges and written; places are ranks within a range and the
    sizes of the ranges before, so no task sees all rows.
    """
    parts = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ordinal")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a range
    sizes = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.withColumn("__rank", rank).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__rank")).drop("__part", "__rank", "__before")


def running(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Add the sum of ``n`` over all rows of a lesser ``key``, which has no ties.

    Sums go within ranges of keys and over the ranges, of which there are as many
    as tasks, so no task sees all keys.
    """
    placed = cut(counts.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "running")
    ranges = placed.groupBy("__part").agg(F.sum(n).alias("__m"))
    ranges = ranges.select("__part", (F.sum("__m").over(Window.orderBy("__part")) - F.col("__m")).alias("__ahead"))
    within = F.sum(n).over(Window.partitionBy("__part").orderBy(key)) - F.col(n)
    return placed.withColumn("__within", within).join(F.broadcast(ranges), "__part").withColumn(name, F.col("__ahead") + F.col("__within")).drop("__part", "__within", "__ahead")


def ordered_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def nearest_row(left: DataFrame, right: DataFrame, keys: list[str], left_point: str, right_point: str, tie: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` with the closest point;
    ties go to the least ``tie`` (J04). Unmatched rows keep nulls.

    An as-of join, so a key with very many rows on both sides stays linear.
    """
    return asof_join(left, right, keys, left_point, right_point, "nearest", tie)


def overlay(prior: DataFrame, rerun: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """A rerun's rows replace those of equal key, in place; new keys follow in
    the rerun's order (J10). Returns the rows with their new ``pos``."""
    cols = [c for c in prior.columns if c != pos]
    a = prior.select(F.col(key).alias("__k"), F.col(pos).alias("__p"), F.struct(*cols).alias("__a"))
    b = rerun.select(F.col(key).alias("__k2"), F.col(pos).alias("__q"), F.struct(*cols).alias("__b"))
    both = a.join(b, F.col("__k") == F.col("__k2"), "full").withColumn("__row", F.coalesce("__b", "__a"))
    out = both.select("__row.*", F.struct(F.col("__p").isNull().alias("new"), F.coalesce("__p", "__q").alias("at")).alias("__order"), F.when(F.col("__b").isNull(), "prior").when(F.col("__p").isNull(), "appended").otherwise("replaced").alias("origin"))
    return out.select(*cols, "origin", "__order.new", "__order.at").withColumnRenamed("new", "is_new").withColumnRenamed("at", "at_pos")
