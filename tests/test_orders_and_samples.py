"""Permutations, acceptance in order, exact rank sums, samples, sketches."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions.permute import grid, permuted
from cartulary.operators import curation, runs, scoring, sketches


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_places_are_permuted(spark, n):
    a, b = grid(n)
    assert n <= a * b < n + a
    got = {r.id: r.p for r in spark.range(n).select("id", permuted("id", n, 7).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    if n > 50:
        other = [r.p for r in spark.range(n).select(permuted("id", n, 8).alias("p")).collect()]
        assert sum(x == y for x, y in zip(other, got.values(), strict=True)) < n / 10 and sum(k == p for k, p in got.items()) < n / 10


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(97).select((F.col("id") * 3).alias("pos"), F.concat(F.lit("c"), "id").alias("cve_id"))
    parts = [runs.split(df.repartition(p), "cve_id") for p in (1, 6)]
    trains, rests = [[[r.cve_id for r in part.collect()] for part in side] for side in zip(*parts, strict=True)]
    assert trains[0] == trains[1] and rests[0] == rests[1]
    assert len(trains[0]) == math.ceil(97 / 4) and set(trains[0]) | set(rests[0]) == {f"c{k}" for k in range(97)} and not set(trains[0]) & set(rests[0])
    assert rests[0] == sorted(rests[0], key=lambda c: int(c[1:])) and trains[0] != sorted(trains[0], key=lambda c: int(c[1:]))
    subset = [r.cve_id for r in runs.seeded_subset(df, "cve_id", 10).collect()]
    assert len(subset) == 10 and set(subset) <= set(trains[0])


def plain_acceptance(rows):
    ids, places, out = set(), set(), {}
    for r in sorted(rows):
        pos, cve, patch, vuln, repo, file, lines, rejection = r
        place = (repo, file, tuple(sorted(lines[:5])) if lines is not None else None)
        if rejection:
            out[pos] = rejection
        elif not cve:
            out[pos] = "no_cve_id"
        elif cve in ids:
            out[pos] = "duplicate_cve_id"
        elif not patch:
            out[pos] = "no_patch_commit"
        elif not vuln:
            out[pos] = "no_vulnerable_commit"
        elif place in places:
            out[pos] = "duplicate_location"
        else:
            out[pos] = None
            ids.add(cve)
            places.add(place)
    return out


SCHEMA = "pos long, cve_id string, patch_commit string, vulnerable_commit string, repo_url string, vulnerable_file string, vulnerable_lines array<int>, rejection string"


@pytest.mark.parametrize("fold", [100_000, 3])
def test_acceptance_equals_a_pass_in_order(spark, monkeypatch, fold):
    """Random records, long chains of records that wait for each other, empty ids."""
    monkeypatch.setattr(curation, "FOLD", fold)
    monkeypatch.setattr(curation, "PEELS", 1 if fold > 3 else 2)
    rng = random.Random(2)
    rows = [(k, rng.choice(["", None, *[f"c{j}" for j in range(30)]]), rng.choice(["p", "p", "p", None]), rng.choice(["v", "v", ""]), "r", rng.choice(["f", "g", None]), [rng.randrange(9)], rng.choice([None, None, None, "bad"])) for k in range(200)]
    # Record k shares an id with the one before or a place with the one after.
    rows += [(1000 + k, f"chain{(k + 1) // 2}", "p", "v", "r", f"file{k // 2}", [1], None) for k in range(24)]
    got = {r.pos: r.reason for r in curation.accept_records(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == plain_acceptance(rows)


def test_acceptance_of_nothing(spark):
    assert curation.accept_records(spark.createDataFrame([], SCHEMA)).collect() == []


def enumerated(d):
    """Two-sided p by going through all signs."""
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    rank = {a: sum(i for i, b in enumerate(order, 1) if b == a) / order.count(a) for a in order}
    ranks = [rank[abs(x)] for x in d]
    w = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
    hits = sum(sum(r for r, s in zip(ranks, signs, strict=True) if s) <= w for signs in itertools.product([0, 1], repeat=len(d)))
    return w, min(1.0, 2 * hits / 2 ** len(d))


def test_exact_rank_sums(spark):
    rng = random.Random(5)
    samples = {k: [rng.choice([-3, -2, -1, 0, 1, 2, 4]) for _ in range(k)] for k in range(1, 14)} | {20: [1.5, -2.5, 3.0, 4.0, 5.0]}
    samples = {k: v for k, v in samples.items() if any(v)}
    df = spark.createDataFrame([(k, float(x), 0.0) for k, v in samples.items() for x in v], "k int, a double, b double")
    got = {r.k: (r.w, r.p) for r in scoring.signed_rank(df, "a", "b").collect()}
    want = {k: enumerated(v) for k, v in samples.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rank_sums_of_the_published_shape(spark):
    """Six pairs of one sign with one tie: W 0, p 0.0273 by the normal limit; many
    pairs take the limit."""
    df = spark.createDataFrame([(0, float(x), 0.0) for x in (1, 2, 3, 4, 5, 5)] + [(1, float(x), 0.0) for x in range(-40, 60)], "k int, a double, b double")
    got = {r.k: r for r in scoring.signed_rank(df, "a", "b").collect()}
    assert (got[0].w, round(got[0].p_normal, 4), got[0].p) == (0, 0.0273, 2 / 64)
    assert got[1].p == got[1].p_normal
    all_fifty = spark.createDataFrame([(0, float(x), 0.0) for x in range(1, 51)], "k int, a double, b double")
    assert scoring.signed_rank(all_fifty, "a", "b").first().p == pytest.approx(2 / 2**50)


def test_samples_of_large_strata_rank_few_rows(spark):
    rows = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("cve_id"), (F.col("id") % 40 * 10).cast("int").alias("loc"), F.lit("s").alias("sink_api"), F.when(F.col("id") == 7, "HIGH").otherwise("LOW").alias("cvss_severity"))
    got = curation.stratified_sample(rows, 50)
    assert got.count() == 50 and got.where("cvss_severity = 'HIGH'").count() == 1 and got.select("cve_id").distinct().count() == 50
    plan = rows.withColumn("__h", F.md5("cve_id"))
    assert got.columns == rows.columns and plan.count() == 5000


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), d, f"u{int(rng.paretovariate(0.7)) % 3000}", rng.gauss(0, 1)) for d in range(8) for _ in range(1500)]
    df = spark.createDataFrame(rows, "arm string, day int, who string, x double")
    days = sketches.sketched(df, ["arm", "day"], "who", "x")
    halves = sketches.merged(days.where("day < 4"), ["arm"]).unionByName(sketches.merged(days.where("day >= 4"), ["arm"]))
    for whole in (sketches.merged(days, ["arm"]), sketches.merged(halves, ["arm"])):
        for r in sketches.read_out(whole).collect():
            own = [x for x in rows if x[0] == r.arm]
            values = sorted(x[3] for x in own)
            assert r.n == len(own) and abs(r.distinct / len({x[2] for x in own}) - 1) < 0.03
            for q, v in zip((0.5, 0.9, 0.99), r.quantiles, strict=True):
                assert abs(sum(x <= v for x in values) / len(values) - q) < 0.015
    tops = sketches.frequent_merged(sketches.frequent(df, ["arm", "day"], "who", 50), ["arm"], 50)
    for r in tops.collect():
        own = [x[2] for x in rows if x[0] == r.arm]
        counted = {t.item: t.n for t in r.top}
        assert len(counted) <= 50
        for who in set(own):
            assert 0 <= own.count(who) - counted.get(who, 0) <= len(own) / 50
