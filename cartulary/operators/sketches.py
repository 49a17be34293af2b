"""Summaries that merge: distinct counts, quantiles and frequent items.

Each day's sketch is a small binary column by key. Merging the days' sketches is
as good as one sketch over all rows, in any order, so growing results are never
read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct-count sketch (error about 1.04 / 2 ** (bits / 2)) and size
#: of the quantile sketch (rank error about 1.7 / k).
DISTINCT_BITS, QUANTILE_K = 14, 400


def sketched(rows: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """By key ``n``, a sketch of the distinct ``item`` (``items``) and one of the
    distribution of ``value`` (``spread``); nulls are in neither."""
    text = F.col(item).cast("string")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(text, F.lit(DISTINCT_BITS)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("spread"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys put together."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("spread").alias("spread"))


def read_out(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``distinct`` and ``quantiles`` (in the order asked for) from sketches."""
    asked = F.array(*[F.lit(q) for q in quantiles])
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("items"), "quantiles": F.kll_sketch_get_quantile_double("spread", asked)}).drop("items", "spread")


def frequent(rows: DataFrame, keys: list[str], item: str, capacity: int = 1000) -> DataFrame:
    """``keys, top``: at most ``capacity`` counters of ``item`` with ``n``, which is at most
    the true count and short of it by less than ``rows / capacity``.

    Exact counts come by key and item, so one counter is cut at the count of
    the first that finds no place: what all merged summaries of this kind do.
    """
    counts = rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n"))
    return _cut(counts, keys, item, capacity)


def frequent_merged(tops: DataFrame, keys: list[str], capacity: int = 1000) -> DataFrame:
    """Counters of finer keys put together; the bound holds for all rows."""
    item = "item"
    counts = tops.select(*keys, F.explode("top").alias("t")).select(*keys, F.col("t.item").alias(item), F.col("t.n").alias("n"))
    return _cut(counts.groupBy(*keys, item).agg(F.sum("n").alias("n")), keys, item, capacity)


def _cut(counts: DataFrame, keys: list[str], item: str, capacity: int) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(item)))
    ranked = counts.withColumn("__r", place).where(F.col("__r") <= capacity + 1)
    spare = ranked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.when(F.col("__r") == capacity + 1, F.col("n"))).alias("__over"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    left = ranked.where(F.col("__r") <= capacity).join(spare, same).withColumn("n", F.col("n") - F.coalesce("__over", F.lit(0))).where("n > 0")
    return left.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(item).alias("item"), "n"))), lambda t: F.struct(t["item"].alias("item"), t["n"].alias("n"))).alias("top"))
