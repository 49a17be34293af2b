"""Audits of results tables: rows of causes, summaries, fingerprints, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_text, hash16, in_range, paths_match
from .scoring import clusters, fn_cause, fp_cause, match_truth, relaxed_scores

EMPTY_HASH = "e3b0c44298fc1c14"
PRIORITY = {"taint": 4, "relaxed": 3, "def_use": 2, "direct_sink": 1}


def arms(results: DataFrame, prefix: str = "joern") -> DataFrame:
    """Iterations of an arm: ``cve_id, k, patched, skipped, arm``."""
    pattern = rf"^{prefix}_(\d+)(_patched)?$"
    rows = results.select("cve_id", "skipped", F.explode_outer("arms").alias("key", "arm"))
    rows = rows.where(F.col("key").rlike(pattern))
    return rows.select("cve_id", F.regexp_extract("key", pattern, 1).cast("int").alias("k"), F.col("key").endswith("_patched").alias("patched"), "skipped", "arm")


def aligned_rows(iterations: DataFrame) -> DataFrame:
    """Verdict rows with the label of the same place; a missing one is empty."""
    zipped = F.arrays_zip(F.coalesce(F.col("arm.triage_verdicts"), F.array()).alias("t"), F.coalesce(F.col("arm.labels"), F.array()).alias("l"))
    rows = iterations.select("cve_id", "k", "patched", "skipped", F.col("arm.arm_error_type").alias("arm_error_type"), F.posexplode(zipped).alias("finding_index", "z"))
    rows = rows.select("cve_id", "k", "patched", "skipped", "arm_error_type", "finding_index", "z.t.*", F.coalesce("z.l", F.lit("")).alias("label"))
    return rows.withColumn("row_id", F.concat_ws("/", "cve_id", "k", "patched", "finding_index"))


#: Text columns of an audit's false positives that are capped.
FP_TEXTS = ("file", "rule_id", "sink_api", "verdict", "source_expr", "sink_expr", "downgrade_reason", "reasoning", "suggestion")


def fp_rows(rows: DataFrame, truth: DataFrame | None = None, tolerance: int = 5, prefix: str = "joern") -> DataFrame:
    """Rows counted against precision, with their cause, arm and capped texts.

    Rows of a patched version count whatever their label; without one it is
    ``patched_commit_alert``. With ``truth`` (as for :func:`fn_rows`) ``matched_gt_line`` is the
    first vulnerable line near the row, empty where there is none. Columns that
    ``rows`` lacks stay away; other columns stay as they are.
    """
    kept = rows.where(F.col("patched") | F.col("label").startswith("fp_"))
    cause = fp_cause(F.col("label"), F.col("verdict"), F.col("source_in_snippet"), F.col("patched"))
    kept = kept.withColumn("fp_cause", cause).withColumn("label", F.when(F.col("patched") & (F.col("label") == ""), "patched_commit_alert").otherwise(F.col("label")))
    kept = kept.withColumn("arm_key", F.concat(F.lit(f"{prefix}_"), F.col("k").cast("string"), F.when(F.col("patched"), "_patched").otherwise("")))
    if truth is not None:
        t = truth.select("cve_id", F.col("vulnerable_file").alias("gt_file"), F.col("vulnerable_lines").alias("gt_lines"))
        line = kept.withColumn("file_path", F.col("file")).withColumn("line_start", F.col("line"))
        kept = match_truth(line, t, ["cve_id"], tolerance).drop("file_path", "line_start")
        kept = kept.withColumn("matched_gt_line", F.coalesce(F.col("gt_line").cast("string"), F.lit(""))).drop("gt_line")
    texts = {c: compact_text(c) for c in FP_TEXTS if c in kept.columns}
    if "confidence" in kept.columns:
        texts["confidence"] = F.coalesce("confidence", F.lit(0.0))
    return kept.withColumns(texts)


def fn_rows(iterations: DataFrame, rows: DataFrame, truth: DataFrame, tolerance: int = 5) -> DataFrame:
    """Missed ground-truth lines of unpatched iterations, with their cause and
    the nearest row of the same file.

    ``truth``: the last record of a case counts (J08). A case with empty
    ground truth has one row, ``empty_ground_truth``.
    """
    its = iterations.where("not patched").select("cve_id", "k", "skipped", F.col("arm.arm_error_type").alias("arm_error_type"))
    t = truth.select(F.col("cve_id"), F.col("vulnerable_file").alias("gt_file"), F.coalesce("vulnerable_lines", F.array().cast("array<int>")).alias("gt"))
    base = its.join(t, "cve_id", "left").withColumn("gt", F.coalesce("gt", F.array().cast("array<int>")))
    empty = base.where("size(gt) = 0").select("cve_id", "k", F.lit(None).cast("int").alias("gt_line"), F.lit("empty_ground_truth").alias("fn_cause"), *_nearest_nulls())
    lines = base.select("cve_id", "k", "skipped", "arm_error_type", "gt_file", F.explode(F.array_distinct("gt")).alias("gt_line"))
    r = rows.where("not patched").select(F.col("cve_id").alias("__c"), F.col("k").alias("__k"), "finding_index", "file", "line", "label", "verdict", "recovery_kind")
    same = (F.col("cve_id") == F.col("__c")) & (F.col("k") == F.col("__k")) & paths_match("file", "gt_file")
    joined = lines.join(r, same, "left").withColumn("hit", F.coalesce(F.abs(F.col("line") - F.col("gt_line")) <= tolerance, F.lit(False)))
    agg = joined.groupBy("cve_id", "k", "gt_line", "skipped", "arm_error_type").agg(
        F.collect_set(F.when(F.col("hit"), F.col("label"))).alias("labels"),
        F.collect_set(F.when(F.col("hit"), F.col("verdict"))).alias("verdicts"),
        F.min_by(F.struct("finding_index", "line", "verdict", "label", "recovery_kind"), F.struct(F.abs(F.col("line") - F.col("gt_line")), "finding_index")).alias("near"),
    )
    failed = (F.coalesce("skipped", F.lit("")) != "") | (F.coalesce("arm_error_type", F.lit("")) != "")
    missed = agg.where(~F.array_contains("labels", "tp")).withColumn("fn_cause", fn_cause(failed, F.col("labels"), F.col("verdicts")))
    names = ["finding_index", "line", "verdict", "label", "recovery_kind"]
    return missed.select("cve_id", "k", "gt_line", "fn_cause", *[F.col(f"near.{n}").alias(f"nearest_{n}") for n in names]).unionByName(empty)


def _nearest_nulls() -> list:
    return [F.lit(None).cast(t).alias(f"nearest_{n}") for n, t in (("finding_index", "int"), ("line", "int"), ("verdict", "string"), ("label", "string"), ("recovery_kind", "string"))]


def iteration_rows(iterations: DataFrame) -> DataFrame:
    """Counts of each iteration, and whether its findings differ from k = 0."""
    it = iterations.select("cve_id", "k", "patched", "skipped", *[F.col(f"arm.{c}").alias(c) for c in ("tp", "fp", "fn", "fn_by_llm", "n_candidates", "n_findings_on_patched", "arm_error_type")], F.col("arm.metrics.findings_hash").alias("findings_hash"))
    first = F.first_value("findings_hash").over(Window.partitionBy("cve_id", "patched").orderBy("k"))
    return it.withColumn("findings_changed_vs_k0", F.col("findings_hash") != first)


def totals_by_k(its: DataFrame) -> DataFrame:
    """``tp, fp, fn`` by k over unpatched iterations."""
    return its.where("not patched").groupBy("k").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tp", "fp", "fn")])


def audit(results: DataFrame, truth: DataFrame, hunks: DataFrame, tolerance: int = 5, gap: int = 8) -> dict[str, DataFrame]:
    """The whole audit as tables: ``fp``, ``fn``, ``iterations``, ``totals``,
    ``fp_causes``, ``fn_causes``, ``relaxed``, ``relaxed_totals``,
    ``recovery`` and ``top_cases``."""
    its, truth = arms(results), last_by(truth, "cve_id")
    rows = aligned_rows(its)
    fp, fn, iteration = fp_rows(rows, truth, tolerance), fn_rows(its, rows, truth, tolerance), iteration_rows(its)
    lines = truth.select(F.col("cve_id").alias("case_id"), F.col("vulnerable_file").alias("gt_file"), F.explode("vulnerable_lines").alias("line"))
    gt = clusters(lines, ["case_id", "gt_file"], gap=gap)
    scored = rows.where("not patched").withColumnRenamed("cve_id", "case_id").join(gt.select("case_id").distinct(), "case_id", "left_semi")
    relaxed = relaxed_scores(scored, gt, hunks, ["case_id", "k"], tolerance)
    return {
        "fp": fp,
        "fn": fn,
        "iterations": iteration,
        "totals": totals_by_k(iteration),
        "fp_causes": fp.groupBy("fp_cause").count(),
        "fn_causes": fn.groupBy("fn_cause").count(),
        "relaxed": relaxed,
        "relaxed_totals": relaxed.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("clusters", "tp", "fp", "fn", "credits", "uncertain_tp", "uncertain_fn")]),
        "recovery": recovery_breakdown(rows, fp, fn),
        "top_cases": top_cases(fp, "cve_id").withColumn("what", F.lit("fp")).unionByName(top_cases(fn, "cve_id").withColumn("what", F.lit("fn"))),
    }


def last_by(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Of equal keys the row of the highest ``pos``. A table without that column
    must come straight from its files: then the last in reading order counts."""
    order = F.col(pos) if pos in df.columns else F.col("__n")
    placed = df.withColumn("__n", F.monotonically_increasing_id())
    return placed.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def arm_totals(its: DataFrame, chosen: list[tuple[int, bool]]) -> DataFrame:
    """``tp, fp, fn`` of chosen arms, each a k and whether it is the patched
    one, in the order of (k, patched) (A08, T10)."""
    want = F.lit(False)
    for k, patched in chosen:
        want = want | ((F.col("k") == k) & (F.col("patched") == patched))
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tp", "fp", "fn")]
    return its.where(want).groupBy("k", "patched").agg(F.count("*").alias("cases"), *sums).orderBy("k", "patched")


def top_cases(rows: DataFrame, case: str, n: int = 10) -> DataFrame:
    """The cases with most rows, ties by name."""
    return rows.groupBy(case).count().orderBy(F.desc("count"), case).limit(n)


def recovery_breakdown(rows: DataFrame, fp: DataFrame, fn: DataFrame) -> DataFrame:
    """Counts by recovery kind in four views."""

    def view(df: DataFrame, name: str, column: str, none: str) -> DataFrame:
        kind = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(none)).alias("kind")
        return df.groupBy(kind).count().select(F.lit(name).alias("view"), "kind", "count")

    out = view(rows, "rows", "recovery_kind", "(none)")
    out = out.union(view(rows.where("label = 'tp'"), "tp", "recovery_kind", "(none)"))
    return out.union(view(fp, "fp", "recovery_kind", "(none)")).union(view(fn, "fn", "nearest_recovery_kind", "(no_nearest)"))


def kind_counts(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """``kind:count;...`` by key, sorted."""
    counts = rows.groupBy(*keys, kind).count()
    return counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat(kind, F.lit(":"), "count"))), ";").alias("kinds"))


def fingerprint(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """An order-free hash of a group's values."""
    joined = F.array_join(F.array_sort(F.collect_list(value)), "\n")
    return rows.groupBy(*keys).agg(hash16(joined).alias("fingerprint"))


def dedup_flows(flows: DataFrame) -> DataFrame:
    """Flows with one sink become one finding.

    The earliest of the highest priority speaks for all; up to eight distinct
    sources and all kinds are listed. Results come with ``first_arrival``,
    the order of the findings.
    """
    named = F.lower(F.regexp_replace("recovery_kind", r"(?U)^\s+|\s+$", ""))
    kind = F.when(named.isin(*PRIORITY), named).otherwise("taint")
    prio = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])[kind]
    norm = F.substring(F.trim(F.regexp_replace(F.coalesce("sink_code", F.lit("")), r"(?U)\s+", " ")), 1, 120)
    line = F.coalesce(F.expr("try_cast(sink_line as int)"), F.lit(0))
    rows = flows.withColumns({"recovery_kind": kind, "__prio": prio, "__norm": norm, "sink_line": line})
    row = F.struct("recovery_kind", "sink_code", "source_file", "source_line", "source_code", "arrival")
    sink, code = ["sink_file", "sink_line", "sink_name", "__norm"], F.coalesce("source_code", F.lit("")).alias("__code")
    # By source first: a popular sink then has one row for each of its sources,
    # of which the eight earliest are gathered.
    rank = F.struct("__prio", -F.col("arrival"))
    seen = [F.max(F.col("recovery_kind") == k).alias(f"__{k}") for k in PRIORITY]
    by_source = rows.groupBy(*sink, code).agg(F.max_by(row, rank).alias("best"), F.max(rank).alias("__rank"), F.count("*").alias("n"), F.min("arrival").alias("first"), *seen)
    # The eight earliest: a rank with a limit, so each task sends few on; they are
    # rows beside the others, and one aggregate takes both.
    place = F.row_number().over(Window.partitionBy(*sink).orderBy("first", "__code"))
    top = by_source.where("__code <> ''").select(*sink, "first", "__code").withColumn("__place", place).where("__place <= 8")
    top = top.select(*sink, F.struct("first", "__code").alias("__listed"))
    out = by_source.drop("__code").unionByName(top, allowMissingColumns=True).groupBy(*sink).agg(
        F.max_by("best", "__rank").alias("best"),
        F.sum("n").alias("dedup_count"),
        F.min("first").alias("first_arrival"),
        F.array_sort(F.collect_list("__listed")).alias("__sources"),
        *[F.max(f"__{k}").alias(f"__{k}") for k in PRIORITY],
    )
    kinds = F.array(*[F.when(F.col(f"__{k}"), F.lit(k)) for k in PRIORITY])
    out = out.withColumn("recovery_kinds_seen", F.array_sort(F.array_compact(kinds))).withColumn("dedup_sources", F.transform("__sources", lambda x: x["__code"]))
    taint = F.col("recovery_kind") == "taint"
    out = out.select("sink_file", "sink_line", "sink_name", "best.*", "dedup_count", "first_arrival", "recovery_kinds_seen", "dedup_sources").drop("arrival")
    return out.withColumns(
        {
            "rule_id": F.when(taint, "joern-taint-reachability").otherwise(F.concat(F.lit("joern-"), "recovery_kind", F.lit("-recovery"))),
            # A source tells a flow from a direct call, whatever its kind.
            "message": F.when(F.coalesce("source_code", F.lit("")) == "", F.concat(F.lit("Direct sink call: "), F.coalesce("sink_code", F.lit("")))).otherwise(
                F.concat(F.lit("Taint flow: "), "source_code", F.lit(" -> "), F.coalesce("sink_code", F.lit("")))
            ),
            "line_end": F.col("sink_line"),
        }
    )


def recovery_counts(findings: DataFrame) -> DataFrame:
    """Findings by recovery kind, kinds without any as 0."""
    kinds = findings.sparkSession.createDataFrame([(k,) for k in PRIORITY], "recovery_kind string")
    return kinds.join(findings.groupBy("recovery_kind").count(), "recovery_kind", "left").na.fill(0, ["count"])


def rules_audit(results: DataFrame, prefix: str = "semgrep") -> dict[str, DataFrame]:
    """Rule refinements without effect, and cases whose findings never change
    (A16, A17)."""
    its = arms(results, prefix).where("not patched")
    m = F.col("arm.metrics")
    acts = F.coalesce(F.size(F.filter(F.col("arm.refinement_actions"), lambda a: a.action == "refine")), F.lit(0))
    changed = F.coalesce(m["rules_yaml_changed"], m["rules_hash_pre"] != m["rules_hash_post"], F.lit(False))
    rows = its.select("cve_id", "k", acts.alias("refines"), F.when(changed, 0).otherwise(acts).alias("no_ops"), F.coalesce(m["findings_hash"], F.lit("")).alias("findings_hash"))
    cases = rows.groupBy("cve_id").agg(F.count("*").alias("n"), F.count_distinct(F.nullif("findings_hash", F.lit(""))).alias("hashes"))
    cases = cases.withColumn("invariant", (F.col("hashes") == 1) & (F.col("n") > 1))
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("refines"), F.lit(0)).alias("refines"), F.coalesce(F.sum("no_ops"), F.lit(0)).alias("no_ops"))
    total = total.withColumn("no_op_rate", F.when(F.col("refines") > 0, F.round(F.col("no_ops") / F.col("refines"), 4)).otherwise(F.lit(0.0)))
    return {"rows": rows, "cases": cases, "summary": total.crossJoin(cases.agg(F.count_if("invariant").alias("invariant_cases")))}


def rows_on_line(rows: DataFrame, truth_lines: DataFrame, keys: list[str], tolerance: int = 5) -> DataFrame:
    """All rows on each ground-truth line."""
    t = truth_lines.select(*[F.col(k).alias(f"__{k}") for k in keys], "gt_file", "gt_line")
    on = paths_match("file", "gt_file") & in_range("line", "gt_line", "gt_line", tolerance)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(t, on).drop(*[f"__{k}" for k in keys])
