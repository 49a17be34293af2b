import pytest
from pyspark.sql import functions as F

from cartulary.operators import scoring

FINDING = "case_id string, k int, finding_index int, file_path string, line_start int, surrounding_context string, code_snippet string, structural_evidence string"
TRIAGE = "case_id string, k int, finding_index int, verdict string, source_expr string"


def scores(spark, verdicts, lines, truth, context="ctx", evidence=None, source=""):
    names = {"T": "true_positive", "F": "false_positive", "U": "uncertain"}
    findings = [("c", k, i, "src/app.py", n, context, "", evidence) for k in range(len(verdicts)) for i, n in enumerate(lines)]
    triage = [("c", k, i, names[v], source) for k, vs in enumerate(verdicts) for i, v in enumerate(vs)]
    t = spark.createDataFrame([("c", "app.py", truth)], "case_id string, gt_file string, gt_lines array<int>")
    labelled = scoring.label_findings(spark.createDataFrame(findings, FINDING), spark.createDataFrame(triage, TRIAGE), t)
    return labelled, {r.k: r for r in scoring.iteration_scores(labelled, t).collect()}


def test_label_matrix_over_k(spark):
    labelled, got = scores(spark, ["UUU", "UUF", "TUT", "FTF"], [43, 82, 200], [42, 80])
    assert {k: (r.tp, r.fp, r.fn, r.fn_by_llm) for k, r in got.items()} == {0: (0, 0, 2, 0), 1: (0, 0, 2, 0), 2: (1, 1, 1, 0), 3: (1, 0, 1, 1)}
    labels = {(r.k, r.finding_index): r.label for r in labelled.collect()}
    assert [labels[2, i] for i in range(3)] == ["tp", "uncertain_on_gt", "fp_by_llm_overclaim"]
    assert [labels[1, i] for i in range(3)] == ["uncertain_on_gt", "uncertain_on_gt", "tn"]
    assert [labels[3, i] for i in range(3)] == ["fn_by_llm", "tp", "tn"]
    assert got[2].precision == 0.5 and got[2].recall == 0.5 and got[2].f1 == 0.5 and got[0].f1 == 0.0


@pytest.mark.parametrize(
    ("line", "context", "evidence", "source", "label", "fp", "fn"),
    [(42, "x = source()", None, "source()", "tp", 0, 0), (42, "nothing", None, "source()", "fp_by_hallucinated_source", 1, 1), (99, "nothing", None, "source()", "fp_by_hallucinated_source", 1, 1), (42, "nothing", None, "", "tp", 0, 0), (42, "nothing", "Source: source()", "source()", "tp", 0, 0)],
)
def test_evidence(spark, line, context, evidence, source, label, fp, fn):
    labelled, got = scores(spark, ["T"], [line], [42], context, evidence, source)
    assert labelled.first().label == label and (got[0].fp, got[0].fn) == (fp, fn)


@pytest.mark.parametrize(("lines", "want"), [([5, 6, 7, 50, 51], [(5, 7), (50, 51)]), ([5, 13, 21], [(5, 21)]), ([5, 14, 23], [(5, 5), (14, 14), (23, 23)]), ([], []), ([0, -3, None], []), ([10], [(10, 10)]), ([1, 9], [(1, 9)])])
def test_clusters(spark, lines, want):
    df = spark.createDataFrame([("c", n) for n in lines], "k string, line int")
    assert sorted((r.start, r.end) for r in scoring.clusters(df, ["k"]).collect()) == want


@pytest.mark.parametrize(
    ("rows", "truth", "hunk", "want"),
    [
        ([(44, "tp", "true_positive")], True, None, (1, 0, 2, 1, 2, 0)),
        ([(12, "fp_by_llm_overclaim", "true_positive")], True, (10, 15), (1, 0, 3, 1, 3, 0)),
        ([(999, "fp_by_llm_overclaim", "true_positive")], True, None, (0, 1, 3, 0, 3, 0)),
        ([(42, "fp_by_hallucinated_source", "true_positive")], True, None, (0, 1, 3, 0, 3, 0)),
        ([(80, "uncertain_on_gt", "uncertain")], True, None, (0, 0, 3, 1, 2, 1)),
        ([(42, "tp", "true_positive"), (43, "uncertain_on_gt", "uncertain")], True, None, (1, 0, 2, 1, 2, 0)),
        ([(10, "fp_by_llm_overclaim", "true_positive")], False, None, (0, 1, 0, 0, 0, 0)),
    ],
)
def test_relaxed_lanes(spark, rows, truth, hunk, want):
    gt = spark.createDataFrame([("c", n) for n in ([42, 43, 44, 80, 120] if truth else [])], "case_id string, line int")
    clusters = scoring.clusters(gt, ["case_id"]).withColumn("gt_file", F.lit("app.py"))
    r = spark.createDataFrame([(str(i), "c", "src/app.py", n, lab, v, True) for i, (n, lab, v) in enumerate(rows)], "row_id string, case_id string, file string, line int, label string, verdict string, source_in_snippet boolean")
    h = spark.createDataFrame([("c", "app.py", *hunk)] if hunk else [], "case_id string, path string, start int, end int")
    got = scoring.relaxed_scores(r, clusters, h, ["case_id"]).first()
    assert (got.tp, got.fp, got.fn, got.uncertain_tp, got.uncertain_fn, got.credits) == want


def test_brakes_target_and_macro(spark):
    rows = spark.createDataFrame([("c", 0, "true_positive", "0.9", False, True), ("c", 1, "false_positive", "bad", True, False), ("c", 2, "weird", None, True, True)], "case_id string, finding_index int, verdict string, confidence string, source_in_snippet boolean, sink_in_snippet boolean")
    out = {r.finding_index: r for r in scoring.triage_brakes(rows).collect()}
    assert (out[0].verdict, out[0].downgrade_reason, out[0].confidence) == ("uncertain", "source_expr_not_in_snippet", 0.9)
    assert (out[1].verdict, out[1].downgrade_reason, out[1].confidence) == ("false_positive", "sink_expr_not_in_snippet", 0.5)
    assert out[2].verdict == "uncertain"
    assert scoring.pick_target(rows, ["case_id"]).first().finding_index == 1


def test_signed_rank(spark):
    rows = spark.createDataFrame([(0, 3.0, 1.0), (0, 1.0, 3.0), (0, 5.0, 1.0), (0, 2.0, 2.0), (0, 1.0, 0.0)], "k int, a double, b double")
    got = scoring.signed_rank(rows, "a", "b").first()
    assert (got.n, got.w_plus, got.w_minus, got.w) == (4, 7.5, 2.5, 2.5)


def test_findings_are_dealt_twice(spark):
    """By verdict and by case; counts by case follow without a shuffle, and what only the index
    is made of is not shuffled (F13)."""
    from cartulary.plans import catalogue_flows

    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        f, v = spark.createDataFrame([("c", 0, 0, "a/app.py", 42, "x = source()", "", None)], FINDING), spark.createDataFrame([("c", 0, 0, "true_positive", "source()")], TRIAGE)
        t = spark.createDataFrame([("c", "app.py", [42])], "case_id string, gt_file string, gt_lines array<int>")
        counts = scoring.label_findings(f, v, t).groupBy("case_id", "k", "label").count()
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4  # findings, verdicts, findings by case, truth
        assert [tuple(r) for r in counts.collect()] == [("c", 0, "tp", 1)]
        plan = catalogue_flows.q_label_findings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "Project [o_custkey" in line and "l_suppkey" in line]
    finally:
        spark.conf.set(threshold, before)
