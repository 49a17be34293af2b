"""Findings, verdicts and ground truth to labels, scores and causes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_lenient, f1, near, paths_match, ratio

TOLERANCE, GAP = 5, 8
VERDICTS = ("true_positive", "false_positive", "uncertain")


def label(verdict: Column, on_truth: Column, in_snippet: Column) -> Column:
    """The label matrix."""
    return (
        F.when((verdict == "false_positive") & ~on_truth, "tn")
        .when(verdict == "false_positive", "fn_by_llm")
        .when((verdict == "true_positive") & ~in_snippet, "fp_by_hallucinated_source")
        .when((verdict == "true_positive") & on_truth, "tp")
        .when(verdict == "true_positive", "fp_by_llm_overclaim")
        .when(on_truth, "uncertain_on_gt")
        .otherwise("uncertain_off_gt")
    )


def match_truth(findings: DataFrame, truth: DataFrame, keys: list[str], tolerance: int = TOLERANCE) -> DataFrame:
    """Add ``gt_line``: the first ground-truth line, in list order, near a
    finding on a matching path, else null (J02). An empty or missing
    ground-truth file matches no path.

    ``truth``: ``keys, gt_file, gt_lines`` (an array). The lines stay an array, so no
    finding is copied for each of them.
    """
    t = truth.select(*[F.col(k).alias(f"__{k}") for k in keys], "gt_file", "gt_lines")
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    hits = F.filter("gt_lines", lambda v: near(F.col("line_start"), v, tolerance))
    found = findings.join(t, on, "left")
    return found.withColumn("gt_line", F.when((F.coalesce("gt_file", F.lit("")) != "") & paths_match("file_path", "gt_file"), F.get(hits, F.lit(0)))).drop(*[f"__{k}" for k in keys], "gt_file", "gt_lines")


def label_findings(findings: DataFrame, triage: DataFrame, truth: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Findings with their verdict, ``gt_line`` and ``label``.

    Keys: ``case_id``, ``k``, ``finding_index``; ``truth`` has ``case_id, gt_file, gt_lines``.
    An unknown or missing verdict counts as uncertain.
    """
    # Truth comes last: by then the texts have become one flag, and rows dealt by case need
    # not be dealt again for what is counted by case.
    v = triage.select("case_id", "k", "finding_index", "verdict", "source_expr")
    both = findings.join(v, ["case_id", "k", "finding_index"], "left")
    parts = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("surrounding_context", "code_snippet", "structural_evidence")])
    context = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    both = match_truth(both.withColumn("in_snippet", evidence_lenient("source_expr", context)), truth, ["case_id"], tolerance)
    verdict = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("uncertain")
    return both.withColumn("verdict", verdict).withColumn("label", label(F.col("verdict"), F.col("gt_line").isNotNull(), F.col("in_snippet")))


def iteration_scores(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 by case and k."""
    agg = labelled.groupBy("case_id", "k").agg(
        F.count_if(F.col("label") == "tp").alias("tp"),
        F.count_if(F.col("label").isin("fp_by_hallucinated_source", "fp_by_llm_overclaim")).alias("fp"),
        F.count_if(F.col("label") == "fn_by_llm").alias("fn_by_llm"),
        F.count_if(F.col("label") == "fp_by_hallucinated_source").alias("fp_by_hallucinated_source"),
        F.count_if(F.col("label") == "uncertain_on_gt").alias("uncertain_on_gt"),
        F.count_if(F.col("label") == "uncertain_off_gt").alias("uncertain_off_gt"),
        F.collect_set(F.when(F.col("label") == "tp", F.col("gt_line"))).alias("__credited"),
    )
    t = truth.select(F.col("case_id").alias("__case"), "gt_lines")
    out = agg.join(t, F.col("case_id") == F.col("__case"), "left")
    lines = F.array_distinct(F.coalesce("gt_lines", F.array().cast("array<int>")))
    out = out.withColumn("fn", F.size(F.array_except(lines, "__credited")).cast("long")).drop("__case", "__credited", "gt_lines")
    return with_prf(out)


def with_prf(df: DataFrame, digits: int | None = None) -> DataFrame:
    df = df.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    df = df.withColumn("f1", f1("precision", "recall"))
    return df if digits is None else df.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def fp_per_kloc(fp: Column | str, loc: Column | str) -> Column:
    fp, loc = (F.col(x) if isinstance(x, str) else x for x in (fp, loc))
    return F.when(loc > 0, fp * 1000.0 / loc).otherwise(F.lit(0.0))


def micro_prf(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """Micro-averaged scores by arm, and over all as ``ALL``."""
    total = rows.rollup(arm).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], F.grouping(arm).alias("__g"))
    return with_prf(total.withColumn(arm, F.when(F.col("__g") == 1, "ALL").otherwise(F.col(arm))).drop("__g"))


def clusters(lines: DataFrame, keys: list[str], line: str = "line", gap: int = GAP) -> DataFrame:
    """Runs of lines not further than ``gap`` apart: ``keys, cluster, start,
    end`` (W01). Lines that are null or not positive are left out."""
    own = lines.select(*keys, F.col(line).alias("__l")).where("__l > 0").distinct()
    w = Window.partitionBy(*keys).orderBy("__l")
    broken = F.when(F.col("__l") - F.lag("__l").over(w) <= gap, 0).otherwise(1)
    runs = own.withColumn("__b", broken).withColumn("cluster", F.sum("__b").over(w).cast("int"))
    return runs.groupBy(*keys, "cluster").agg(F.min("__l").alias("start"), F.max("__l").alias("end"))


def committed(label_: Column, verdict: Column, source_in_snippet: Column) -> Column:
    """A true positive that the reviewer stands by."""
    empty = F.coalesce(label_, F.lit("")) == ""
    return F.when(label_.isin("tp", "fp_by_llm_overclaim"), True).when(~empty, False).otherwise((verdict == "true_positive") & F.coalesce(source_in_snippet, F.lit(True)))


def hallucinated(label_: Column, verdict: Column, source_in_snippet: Column) -> Column:
    """A claimed true positive whose evidence is not there (P09). A label decides
    alone; without one only a true positive with a source that is known to be
    missing counts, so uncertain and dismissed rows do not."""
    own = F.coalesce(label_, F.lit(""))
    claimed = F.coalesce(verdict == "true_positive", F.lit(False)) & ~F.coalesce(source_in_snippet, F.lit(True))
    return (own == "fp_by_hallucinated_source") | ((own == "") & claimed)


def relaxed_scores(rows: DataFrame, gt_clusters: DataFrame, hunks: DataFrame, keys: list[str], tolerance: int = TOLERANCE) -> DataFrame:
    """Cluster- and hunk-relaxed scores with an uncertain lane, by ``keys``.

    ``rows``: ``keys, row_id, file, line, label, verdict, source_in_snippet``;
    ``gt_clusters``: ``case_id, gt_file, cluster, start, end``; ``hunks``:
    ``case_id, path, start, end``. ``case_id`` is among the keys. Keys with
    rows and keys with clusters only both appear.
    """
    c = gt_clusters.select(F.col("case_id").alias("__c"), "gt_file", "cluster", F.col("start").alias("cs"), F.col("end").alias("ce"))
    inside = (F.col("case_id") == F.col("__c")) & paths_match("file", "gt_file") & F.col("line").between(F.col("cs") - tolerance, F.col("ce") + tolerance) & (F.col("line") != 0)
    idx = rows.join(c, inside).groupBy("row_id").agg(F.min("cluster").alias("idx"))
    h = hunks.select(F.col("case_id").alias("__c"), "path", F.col("start").alias("hs"), F.col("end").alias("he"))
    suffix = F.col("file").endswith(F.col("path")) | F.col("path").endswith(F.col("file"))
    in_hunk = rows.join(h, (F.col("case_id") == F.col("__c")) & suffix & F.col("line").between(F.col("hs"), F.col("he"))).select("row_id").distinct().withColumn("in_hunk", F.lit(True))
    out = rows.join(idx, "row_id", "left").join(in_hunk, "row_id", "left").withColumn("in_hunk", F.coalesce("in_hunk", F.lit(False)))
    halluc = hallucinated(F.col("label"), F.col("verdict"), F.col("source_in_snippet"))
    sure = committed(F.col("label"), F.col("verdict"), F.col("source_in_snippet"))
    hit = F.col("idx").isNotNull() | F.col("in_hunk")
    kind = F.when(halluc, "fp").when(sure & hit, "tp").when(sure, "fp").when((F.col("verdict") == "uncertain") & F.col("idx").isNotNull(), "uncertain")
    out = out.withColumn("__kind", kind)
    agg = out.groupBy(*keys).agg(
        F.count_if(F.col("__kind") == "tp").alias("tp"),
        F.count_if(F.col("__kind") == "fp").alias("fp"),
        F.collect_set(F.when(F.col("__kind") == "tp", F.col("idx"))).alias("__covered"),
        F.collect_set(F.when(F.col("__kind") == "uncertain", F.col("idx"))).alias("__unsure"),
    )
    n = gt_clusters.groupBy(F.col("case_id").alias("__c")).agg(F.count("*").alias("clusters"))
    out = agg.join(n, F.col("case_id") == F.col("__c"), "left").withColumn("clusters", F.coalesce("clusters", F.lit(0)))
    out = out.withColumn("fn", F.col("clusters") - F.size("__covered")).withColumn("credits", F.size(F.array_except("__unsure", "__covered")).cast("long"))
    out = out.withColumn("uncertain_tp", F.col("tp") + F.col("credits")).withColumn("uncertain_fn", F.col("fn") - F.col("credits"))
    return out.select(*keys, "clusters", "tp", "fp", "fn", "credits", "uncertain_tp", "uncertain_fn")


def fp_cause(label_: Column, verdict: Column, source_in_snippet: Column, patched: Column) -> Column:
    """Why a row is a false positive; the first rule that holds."""
    lab = F.coalesce(label_, F.lit(""))
    return (
        F.when(patched, "patched_commit_alert")
        .when((lab == "fp_by_hallucinated_source") | ~F.coalesce(source_in_snippet, F.lit(True)), "evidence_hallucination")
        .when((lab == "fp_by_llm_overclaim") | (verdict == "true_positive"), "triager_overclaim")
        .when(lab.startswith("uncertain_"), "uncertain_unscored")
        .when(lab == "fp_by_location", "scanner_location_fp")
        .when((lab == "") & (verdict == "uncertain"), "scanner_location_fp")
        .when(lab.startswith("fp_"), lab)
        .otherwise("")
    )


def fn_cause(failed: Column, labels: Column, verdicts: Column) -> Column:
    """Why a ground-truth line was missed, from the labels and verdicts of the
    rows on it."""
    return (
        F.when(failed, "arm_error_or_timeout")
        .when(F.array_contains(labels, "fn_by_llm") | F.array_contains(verdicts, "false_positive"), "triager_suppressed_gt")
        .when(F.array_contains(labels, "fp_by_hallucinated_source"), "hallucinated_source_on_gt")
        .otherwise("joern_candidate_missing")
    )


def triage_brakes(rows: DataFrame) -> DataFrame:
    """Verdicts without strict evidence: a true positive without its source
    becomes uncertain; a false positive without its sink is only marked.

    ``rows``: ``verdict, confidence`` (text), ``source_in_snippet`` and
    ``sink_in_snippet`` (strict evidence).
    """
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("uncertain")
    source, sink = ~F.coalesce("source_in_snippet", F.lit(False)), ~F.coalesce("sink_in_snippet", F.lit(False))
    return rows.withColumn("verdict", known).withColumns(
        {
            "downgrade_reason": F.when((F.col("verdict") == "true_positive") & source, "source_expr_not_in_snippet").when((F.col("verdict") == "false_positive") & sink, "sink_expr_not_in_snippet").otherwise(""),
            "verdict": F.when((F.col("verdict") == "true_positive") & source, "uncertain").otherwise(F.col("verdict")),
            "confidence": F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(0.5)),
        }
    )


def pick_target(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The finding to refine on: false positive, uncertain, true positive, then
    any; the first of its kind (W07)."""
    rank = F.when(F.col("verdict") == "false_positive", 0).when(F.col("verdict") == "uncertain", 1).when(F.col("verdict") == "true_positive", 2).otherwise(3)
    return rows.groupBy(*keys).agg(F.min_by("finding_index", F.struct(rank, "finding_index")).alias("finding_index"))


def macro_scores(rows: DataFrame) -> DataFrame:
    """Means over cases by arm and k (A34): precision, recall and F1, and of what
    else the rows have: ``mean_fp_per_kloc`` (``fp``, ``loc``), ``detection_rate`` (the share of
    cases with a true positive; ``tp``), ``mean_time_s`` (``time_s``), ``mean_tokens`` (``tokens``)."""
    more = {
        "mean_fp_per_kloc": (("fp", "loc"), lambda: F.avg(fp_per_kloc("fp", "loc"))),
        "detection_rate": (("tp",), lambda: F.avg(F.when(F.col("tp") > 0, 1.0).otherwise(0.0))),
        "mean_time_s": (("time_s",), lambda: F.avg("time_s")),
        "mean_tokens": (("tokens",), lambda: F.avg("tokens")),
    }
    own = [make().alias(name) for name, (needs, make) in more.items() if all(c in rows.columns for c in needs)]
    return rows.groupBy("arm", "k").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")], *own)


def verdict_contingency(rows: DataFrame) -> DataFrame:
    """Verdicts against ground-truth matches, by arm and k."""
    return rows.groupBy("arm", "k", "verdict").pivot("gt_match", ["yes", "no"]).agg(F.count(F.lit(1))).na.fill(0, ["yes", "no"])


def signed_rank(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon's signed-rank sums of paired values, by ``k`` (A35): ``n``
    pairs that differ, ``w_plus``, ``w_minus``, ``w``, ``z`` and the two-sided ``p_normal`` of the
    normal limit (with ties, without a correction for continuity) and ``p``, which
    is exact up to EXACT_PAIRS pairs and the limit's beyond. Equal differences share
    their mean rank."""
    d = rows.select("k", (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("x", F.abs("d"))
    # The mean rank of a value follows from counts, so no task ranks all rows.
    counts = d.groupBy("k", "x").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.sum("c").over(Window.partitionBy("k").orderBy("x")) - F.col("c")
    ranks = counts.withColumn("rank", before + (F.col("c") + 1) / 2)
    out = ranks.groupBy("k").agg(
        F.sum("c").alias("n"), F.slice(F.sort_array(F.collect_list(F.when(F.col("rank") <= EXACT_PAIRS, F.struct((2 * F.col("rank")).cast("int").alias("r"), "c")))), 1, EXACT_PAIRS).alias("__ranks"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum(F.expr("c * c * c - c")).alias("__ties")
    )
    out = out.withColumn("w", F.least("w_plus", "w_minus"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24 - F.col("__ties") / 48
    out = out.withColumn("z", F.when(var > 0, (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(var)))
    out = out.withColumn("p_normal", F.least(F.lit(1.0), 2 * _normal_below(F.col("z"))))
    exact = F.when(F.col("n") <= EXACT_PAIRS, signed_rank_p(F.col("__ranks"), F.col("w")))
    return out.withColumn("p", F.coalesce(exact, F.col("p_normal"))).drop("__ties", "__ranks")


#: Pairs up to which the signed-rank sum's distribution is counted out.
EXACT_PAIRS = 50


def signed_rank_p(ranks: Column, w: Column) -> Column:
    """Two-sided p of the lesser signed-rank sum ``w`` if every rank has either
    sign with equal chance.

    ``ranks``: structs of ``r``, twice a rank (a mean rank may be a half), and ``c``, how often
    it is there. The array holds, for each doubled sum up to 2w, how many of the
    ways to choose signs have it; each rank adds the array shifted by itself.
    Counts stay below 2 ** 53, so doubles are exact.
    """
    most = F.round(2 * w).cast("int")
    none = F.transform(F.sequence(F.lit(0), most), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    every = F.flatten(F.transform(ranks, lambda x: F.array_repeat(x["r"], x["c"].cast("int"))))

    def add(ways: Column, r: Column) -> Column:
        return F.transform(ways, lambda v, s: v + F.coalesce(F.get(ways, F.when(s >= r, s - r)), F.lit(0.0)))

    ways = F.aggregate(every, none, add, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x))
    return F.least(F.lit(1.0), 2 * ways / F.pow(F.lit(2.0), F.size(every)))


def _normal_below(z: Column) -> Column:
    """The share of the standard normal distribution below z, to about 1e-7
    (a fixed rational approximation of its tail)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z <= 0, tail).otherwise(1 - tail)


def triage_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts by key."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
