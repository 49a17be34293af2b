"""Runs of many cases: merging, targets, rollups, phases, splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permute import permuted
from .joins import ordinal, overlay

SEED, TRAIN_FRACTION = 235711, 0.25


def merge_runs(prior: DataFrame, rerun: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The merged run and its summary."""
    out = overlay(prior, rerun, key)
    summary = out.agg(F.count("*").alias("merged"), F.count_if(F.col("origin") == "replaced").alias("replaced"), F.count_if(F.col("origin") == "appended").alias("appended"))
    counts = prior.agg(F.count("*").alias("prior")).crossJoin(rerun.agg(F.count("*").alias("rerun")))
    return out, counts.crossJoin(summary)


def missing(planned: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return planned.join(results.select(key).distinct(), key, "left_anti")


def rerun_targets(planned: DataFrame, results: DataFrame, key: str, skipped: str = "skipped") -> DataFrame:
    """Planned cases that timed out or are missing, in planned order."""
    timed = results.where(F.col(skipped) == "timeout").select(key)
    want = timed.union(missing(planned, results, key).select(key)).distinct()
    return planned.join(want, key, "left_semi").orderBy("pos")


def eligible(cases: DataFrame, skip: DataFrame, key: str) -> DataFrame:
    """Cases not on the skip-list that have ground truth."""
    return cases.join(skip.select(key), key, "left_anti").where("size(vulnerable_lines) > 0")


def only(cases: DataFrame, wanted: list[str], key: str) -> DataFrame:
    return cases.where(F.col(key).isin(wanted)) if wanted else cases


def coverage(planned: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Planned, rows, full, timeout and missing (A10)."""
    r = results.groupBy(key).agg(F.max("skipped").alias("skipped"), F.lit(True).alias("there"))
    both = planned.select(key).join(r, key, "left")
    return both.agg(
        F.count("*").alias("planned"), F.count("there").alias("rows"), F.count_if(F.col("there") & F.col("skipped").isNull()).alias("full"), F.count_if(F.col("skipped") == "timeout").alias("timeout"), F.count_if(F.col("there").isNull()).alias("missing")
    )


def rerun_outcomes(targets: DataFrame, prior: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """Before and after of each target; absent before is ``missing_row``."""
    p = prior.select(key, F.coalesce("skipped", F.lit("full")).alias("before"))
    q = rerun.select(key, F.coalesce("skipped", F.lit("full")).alias("after"))
    return targets.select(key).join(p, key, "left").join(q, key, "left").select(key, F.coalesce("before", F.lit("missing_row")).alias("before"), F.coalesce("after", F.lit("missing_row")).alias("after"))


def token_rollup(iterations: DataFrame, case: str) -> DataFrame:
    """Tokens by case, most first."""
    out = iterations.groupBy(case).agg(F.sum("llm_tokens_triage").alias("triage"), F.sum("llm_tokens_refinement").alias("refine"))
    return out.withColumn("total", F.col("triage") + F.col("refine")).orderBy(F.desc("total"), case)


def usage_sum(rows: DataFrame, usage: str = "llm_usage") -> DataFrame:
    return rows.agg(*[F.sum(f"{usage}.{c}").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "call_count")])


def phase_metrics(rows: DataFrame) -> DataFrame:
    """Overhead is what the phases leave of the wall clock, at least 0."""
    phases = [F.coalesce(c, F.lit(0.0)) for c in ("cpg_build_s", "scan_s", "llm_triage_s", "llm_refinement_s", "call_graph_s")]
    total = phases[0]
    for p in phases[1:]:
        total = total + p
    return rows.withColumn("overhead_s", F.greatest(F.lit(0.0), F.col("wall_clock_s") - total))


def patched_stats(rows: DataFrame) -> DataFrame:
    """Findings on patched code, and their verdicts."""
    v = F.col("verdict")
    return rows.agg(F.count("*").alias("findings"), *[F.count_if(v == x).alias(x) for x in ("true_positive", "false_positive", "uncertain")])


def seeded_subset(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` cases by a seeded choice, in their old order (T05): those that a seeded
    permutation of all places sends to the first ``n``."""
    placed = ordinal(df, "pos", "__at")
    total = placed.count()
    return placed.where(permuted("__at", total, seed) < n).drop("__at").orderBy("pos")


def spot_check(records: DataFrame, key: str, share: int = 10, seed: int = SEED) -> DataFrame:
    """One record in ``share`` by a seeded choice, one at least, to be reviewed
    by hand (T08)."""
    n = max(1, records.count() // share)
    return seeded_subset(records, key, n, seed).withColumn("manual_review_status", F.lit("pending"))


def split(df: DataFrame, key: str, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and validation cases (T06): the first in shuffled order (``train_pos``),
    the others in their old one. The shuffle is a permutation of places as a
    column, so sizes are exact and the driver sees one number, the count."""
    placed = ordinal(df, "pos", "__at")
    total = placed.count()
    if total < 2:
        return df.limit(0), df
    n = min(total - 1, max(1, math.ceil(total * fraction)))
    drawn = placed.withColumn("train_pos", permuted("__at", total, seed)).drop("__at")
    return drawn.where(F.col("train_pos") < n).orderBy("train_pos"), drawn.where(F.col("train_pos") >= n).drop("train_pos").orderBy("pos")


def variance_plan(cases: DataFrame, key: str, n: int = 20, seeds: int = 5, k: int = 3, seed: int = SEED) -> DataFrame:
    """Chosen cases under each of several seeds."""
    spark = cases.sparkSession
    return seeded_subset(cases, key, n, seed).crossJoin(spark.range(seeds).select((F.col("id") + seed).alias("seed"), F.lit(k).alias("k")))
