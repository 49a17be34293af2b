"""Nested bins and as-of joins against plain comparisons."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartulary.operators import joins
from cartulary.operators.asof import asof_join
from cartulary.operators.bins import containment_join
from cartulary.operators.graph import CodeGraph


def test_containment_equals_plain(spark):
    rng = random.Random(1)
    ends = [-9, -1, 0, 1, 2, 3, 7, 8, 100, 2**40, 2**62, -(2**62)]

    def ranges(n):
        out = []
        for k in range(n):
            a, b = (rng.choice(ends), rng.choice(ends)) if k % 3 == 0 else (rng.randrange(-20, 90), rng.randrange(-20, 90))
            out.append((k, rng.choice("xy"), min(a, b), max(a, b)))
        return [*out, (n, "x", None, 3), (n + 1, "x", 3, None), (n + 2, "x", 5, 1), (n + 3, None, 1, 2)]

    outer, inner = ranges(120), ranges(120)
    a = spark.createDataFrame(outer, "o long, f string, s long, e long")
    b = spark.createDataFrame(inner, "i long, f string, ps long, pe long")
    found = Counter((r.o, r.i) for r in containment_join(a, b, ["f"], ("s", "e"), ("ps", "pe")).collect())
    fine = lambda s, e: s is not None and e is not None and s <= e
    want = Counter((o, i) for o, f, s, e in outer for i, g, ps, pe in inner if f == g and f and fine(s, e) and fine(ps, pe) and s <= ps and e >= pe)
    assert found == want
    assert containment_join(a.where("false"), b, ["f"], ("s", "e"), ("ps", "pe")).count() == 0
    with pytest.raises(ValueError):
        containment_join(a, b.withColumnRenamed("i", "o"), ["f"], ("s", "e"), ("ps", "pe"))


def test_a_file_of_very_many_units_meets_few_of_them(spark):
    """A million nested units: a place meets as many as the nesting is deep."""
    n = 1_000_000
    units = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file_path"), (F.col("id") * 2).alias("line_start"), (F.col("id") * 2 + 1).alias("line_end"), F.lit(1).alias("subtree"))
    wide = spark.range(40).select(F.concat(F.lit("w"), "id").alias("id"), F.lit("f").alias("file_path"), F.col("id").alias("line_start"), (F.lit(2 * n) - F.col("id")).alias("line_end"), F.lit(9).alias("subtree"))
    units = units.union(wide)
    places = spark.range(2000).select(F.col("id").alias("place_id"), F.lit("f").alias("file_path"), (F.col("id") * 998 + 100).alias("line_start"), (F.col("id") * 998 + 100).alias("line_end"))
    met = containment_join(units.select("id", "file_path", F.col("line_start").alias("s"), F.col("line_end").alias("e")), places, ["file_path"], ("s", "e"), ("line_start", "line_end"))
    assert met.count() == 2000 * 41
    found = CodeGraph(units, units).minimal_covering(places)
    assert found.where("id <> cast((place_id * 998 + 100) div 2 as string)").count() == 0 and found.count() == 2000


def plain(left, right, direction, tolerance):
    out = []
    for lid, k, p in left:
        near = [(abs(q - p), t, q, t) for kk, q, t in right if kk == k and k is not None and p is not None and q is not None and (direction != "backward" or q <= p) and (direction != "forward" or q >= p)]
        near = [x for x in near if tolerance is None or x[0] <= tolerance]
        out.append((lid, min(near)[2:] if near else (None, None)))
    return Counter((a, *b) for a, b in out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 2])
def test_asof_equals_plain(spark, direction, tolerance):
    rng = random.Random(3)
    left = [(k, rng.choice("aab"), rng.randrange(60)) for k in range(300)] + [(900, None, 3), (901, "a", None), (902, "zz", 5), (903, "a", 7), (903, "a", 7)]
    right = [(rng.choice("aaac"), rng.randrange(0, 60, 3), rng.randrange(5)) for k in range(150)] + [(None, 3, 1), ("a", None, 0), ("b", 30, 2)]
    a = spark.createDataFrame(left, "lid long, k string, p long").repartition(3)
    b = spark.createDataFrame(right, "k string, q long, t long").repartition(3)
    found = asof_join(a, b, ["k"], "p", "q", direction, tie="t", tolerance=tolerance)
    assert Counter((r.lid, r.q, r.t) for r in found.collect()) == plain(left, right, direction, tolerance)
    inner = asof_join(a, b, ["k"], "p", "q", direction, tie="t", tolerance=tolerance, how="inner")
    assert inner.count() == found.where("q is not null").count()


def test_asof_of_one_hot_key_stays_linear(spark):
    """One key, many rows on both sides, over several ranges; places are those of a
    running value."""
    n = 20_000
    left = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("lid"), (F.col("id") * 10 + 5).cast("timestamp").alias("at"))
    right = spark.range(n // 4).select(F.lit("k").alias("key"), F.col("id").alias("rid"), (F.col("id") * 40).cast("timestamp").alias("seen"))
    found = asof_join(left, right, ["key"], "at", "seen")
    assert found.count() == n and found.where("rid <> lid div 4").count() == 0
    both = joins.nearest_row(left, right, ["key"], "at", "seen", "rid")
    assert both.where("abs(unix_seconds(at) - unix_seconds(seen)) > 35").count() == 0


def test_asof_odd_tables(spark):
    a = spark.createDataFrame([(1, "a", 3)], "lid long, k string, p int")
    b = spark.createDataFrame([], "k string, q int, t long")
    assert [tuple(r) for r in asof_join(a, b, ["k"], "p", "q").collect()] == [(1, "a", 3, None, None)]
    assert asof_join(a.where("false"), b, ["k"], "p", "q").collect() == []
    for bad in ({"direction": "sideways"}, {"how": "full"}):
        with pytest.raises(ValueError):
            asof_join(a, b, ["k"], "p", "q", **bad)
    with pytest.raises(ValueError):
        asof_join(a, b.withColumnRenamed("t", "lid"), ["k"], "p", "q")


def test_few_levels_are_asked(spark):
    """A range of up to 16 lines asks one level where ranges of one bin are all there is."""
    from cartulary.operators.bins import bin_level

    rows = spark.range(300).select(bin_level(F.lit(0), F.col("id")).alias("k")).distinct().collect()
    assert {r.k for r in rows} == {4, 8, 12}


def test_nearest_over_many_ranges(spark, monkeypatch):
    """Rows over many short ranges give what they give over one."""
    from cartulary.operators import asof

    monkeypatch.setattr(asof, "RANGE_ROWS", 7)
    right = [(k, p, 10 * k + p) for k in range(4) for p in range(0, 60, 7)]
    left = [(k, g, i) for i, (k, g) in enumerate((k, g) for k in range(5) for g in range(-3, 70, 5))]
    found = asof.asof_join(spark.createDataFrame(left, "k int, g int, i int"), spark.createDataFrame(right, "k int, p int, v int"), ["k"], "g", "p", "nearest", "p")
    want = {i: min(((abs(p - g), p) for c, p, _ in right if c == k), default=(None, None))[1] for k, g, i in left}
    assert {r.i: r.p for r in found.collect()} == want


def test_contains_functions_deals_its_rows_once(spark, tmp_path):
    """Repeated rows, equal ids of other lines, wide lines and nulls, against SQL; one shuffle."""
    import duckdb

    import __spark_entry__ as entry

    rng = random.Random(12)
    rows = [(rng.randrange(5), rng.randrange(3), rng.randrange(2), rng.choice([1, 2, 3, 15, 16, 17, 300]), float(rng.randrange(50))) for _ in range(400)]
    rows += [rows[0], (None, 1, 1, 1, 3.0), (1, None, 1, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 2, None)]
    kind = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/l")
    next(tmp_path.glob("l/*.parquet")).rename(tmp_path / "lineitem.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entry.queries()["q_contains_functions"](spark, str(tmp_path))
        got = sorted(tuple(r) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    sql = entry.oracle_sql()["q_contains_functions"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet'")
    assert got == sorted(duckdb.sql(sql).fetchall()) and len(got) > 20
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(dealt) == 1 and "SortMergeJoin" in plan
