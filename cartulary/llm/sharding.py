"""Sharding by proportional stratified interleaving, native.

Rows of each source are ranked in a seeded shuffled order; a row's fractional
rank is (rank - 1/2) / rows of its source. All rows sorted by it hold every
source evenly spread, so cutting the order into equal runs gives shards that
match the mixture, with sizes at most one row apart.

Neither rank is made in one task: rows are counted by source and slice of the
shuffled order, then by slice of the fractional rank; the running sums of
those counts are added to ranks within a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import comparable, set_aside

#: Rows that a slice holds on average.
SLICE_ROWS = 4096


def interleave(df: DataFrame, strata: str = "source", shards: int = 16, seed: int = 17, rows: int | None = None) -> DataFrame:
    """Add ``shard`` (int, 0 to ``shards`` - 1) and ``slot`` (long, gapless from 0).

    Law: shards differ by one row at most, and each holds any source's share
    to within two rows. A null source is a source of its own. Rows are ordered
    by a seeded hash of all their columns, then by the columns (maps and
    variants as JSON); fully equal rows are interchangeable. Columns of ``df``
    with the names of the results are replaced, all others stay, whatever their
    names. An empty table stays empty.

    ``rows`` saves counting the table where its size is known.
    """
    inner, names, back = set_aside(df, "shard", "slot")
    columns = comparable(inner)
    total = df.count() if rows is None else rows
    slices = max(1, min(1 << 30, total // SLICE_ROWS))
    h = F.xxhash64(F.lit(seed), *columns)
    base = inner.select("*", h.alias("__h"), F.col(names[strata]).alias("__s"))
    # In slices of 2**64 / slices hashes each, in the order of the hashes.
    base = base.withColumn("__a", _slice(F.col("__h"), slices))
    counts = base.groupBy("__s", "__a").agg(F.count("*").alias("__n"))
    by_source = Window.partitionBy("__s")
    counts = counts.select(
        F.col("__s").alias("__s1"), F.col("__a").alias("__a1"), (F.sum("__n").over(by_source.orderBy("__a")) - F.col("__n")).alias("__before"), F.sum("__n").over(by_source).alias("__of")
    )
    ranked = base.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__a").orderBy("__h", *columns)))
    ranked = ranked.join(counts, F.col("__s").eqNullSafe(F.col("__s1")) & (F.col("__a") == F.col("__a1")))
    # Twice the rank less one, over twice the rows: exact in whole numbers.
    ranked = ranked.withColumn("__top", 2 * (F.col("__before") + F.col("__r")) - 1)
    ranked = ranked.withColumn("__f", F.col("__top") / (2 * F.col("__of")))
    ranked = ranked.withColumn("__b", F.least(F.floor(F.col("__f") * slices), F.lit(slices - 1)).cast("long"))
    ranked = ranked.drop("__s1", "__a1", "__a", "__top", "__before", "__of", "__r")
    places = ranked.groupBy("__b").agg(F.count("*").alias("__n"))
    places = _running(places)
    ordered = Window.partitionBy("__b").orderBy("__f", "__h", "__s", *columns)
    placed = ranked.withColumn("__q", F.row_number().over(ordered)).join(places.withColumnRenamed("__b", "__b1"), F.col("__b") == F.col("__b1"))
    place = F.col("__q") + F.col("__start") - 1
    # Shard k holds the places from ceil(k * total / shards) on.
    shard = F.expr(f"((__place * {shards}) div {max(total, 1)})")
    out = placed.withColumn("__place", place).withColumn("shard", shard.cast("int"))
    first = F.expr(f"((cast(shard as bigint) * {total} + {shards - 1}) div {shards})")
    return back(out.withColumn("slot", F.col("__place") - first), "shard", "slot")


def _slice(h: Column, slices: int) -> Column:
    """The slice of a signed 64-bit hash, by its upper 31 bits."""
    return F.shiftright((F.shiftright(h, 33) + F.lit(1 << 30)) * F.lit(slices), 31).cast("long")


def _running(counts: DataFrame, block: int = 1024) -> DataFrame:
    """``__b`` and ``__start``, the rows of all earlier slices.

    Sums run within blocks of slices and over the blocks, so the one task that
    sees all blocks gets a thousandth of the slices.
    """
    counts = counts.withColumn("__block", F.expr(f"__b div {block}"))
    blocks = counts.groupBy("__block").agg(F.sum("__n").alias("__m"))
    blocks = blocks.select(F.col("__block").alias("__block1"), (F.sum("__m").over(Window.orderBy("__block")) - F.col("__m")).alias("__ahead"))
    within = F.sum("__n").over(Window.partitionBy("__block").orderBy("__b")) - F.col("__n")
    return counts.withColumn("__within", within).join(blocks, F.col("__block") == F.col("__block1")).select("__b", (F.col("__within") + F.col("__ahead")).alias("__start"))
