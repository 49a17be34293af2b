import json

import pytest
from pyspark.sql import functions as F

from cartulary import schemas
from cartulary.operators import audit, runs
from cartulary.operators.curation import old_hunks
from cartulary.sources.readers import read_results
from cartulary.sources import readers
from cartulary.sources.writers import append_results, cached, dispatch_facts, fact_row, markdown, prebuild_status, rewrite_results, save_facts, seed_key, write_audit

FLOW = "arrival long, sink_file string, sink_line string, sink_name string, sink_code string, source_file string, source_line string, source_code string, recovery_kind string"


def flow(arrival, source="src", kind="taint", line="7", code="os.system(x)"):
    return (arrival, "a.py", line, "system", code, "a.py", "1", source, kind)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([flow(1, "a"), flow(2, "b")], [(2, "taint", ["a", "b"], ["taint"])]),
        ([flow(1), flow(2, code="os.system( x\n)".replace("( x", "(x"))], None),
        ([flow(1, code="os.system(a  b)"), flow(2, code="os.system(a \n b)")], [(2, "taint", ["src"], ["taint"])]),
        ([flow(1), flow(2, line="8")], [(1, "taint", ["src"], ["taint"]), (1, "taint", ["src"], ["taint"])]),
        ([flow(i, f"s{i}") for i in range(12)], [(12, "taint", [f"s{i}" for i in range(8)], ["taint"])]),
        ([flow(1, "", "direct_sink"), flow(2)], [(2, "taint", ["src"], ["direct_sink", "taint"])]),
        ([flow(1, "a", "def_use"), flow(2, "b", "relaxed")], [(2, "relaxed", ["a", "b"], ["def_use", "relaxed"])]),
        ([flow(1, kind="bogus"), flow(2, kind=None)], [(2, "taint", ["src"], ["taint"])]),
        ([flow(1), flow(2, "", "direct_sink")], [(2, "taint", ["src"], ["direct_sink", "taint"])]),
        ([flow(1, line="x")], [(1, "taint", ["src"], ["taint"])]),
        ([], []),
    ],
)
def test_flow_dedup(spark, rows, want):
    got = audit.dedup_flows(spark.createDataFrame(rows, FLOW)).orderBy("first_arrival").collect()
    if want is not None:
        assert [(r.dedup_count, r.recovery_kind, r.dedup_sources, r.recovery_kinds_seen) for r in got] == want
    assert all(r.rule_id == ("joern-taint-reachability" if r.recovery_kind == "taint" else f"joern-{r.recovery_kind}-recovery") for r in got)
    if rows and rows[0][2] == "x":
        assert got[0].sink_line == 0


def test_recovery_counts(spark):
    got = audit.recovery_counts(spark.createDataFrame([("taint",), ("taint",)], "recovery_kind string"))
    assert {r.recovery_kind: r["count"] for r in got.collect()} == {"taint": 2, "relaxed": 0, "def_use": 0, "direct_sink": 0}


def test_fingerprint(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", None)], "k string, v string")
    got = {r.k: r.fingerprint for r in audit.fingerprint(df, ["k"], "v").collect()}
    assert got["a"] == got["b"] and got["c"] == audit.EMPTY_HASH


def verdict(line, v, snip=True, kind="taint"):
    return {"file": "src/app.py", "line": line, "verdict": v, "source_in_snippet": snip, "recovery_kind": kind}


def arm(labels, verdicts, **more):
    return {"tp": labels.count("tp"), "fp": sum(x.startswith("fp_") for x in labels), "fn": 2, "labels": labels, "triage_verdicts": verdicts, "metrics": {"findings_hash": "h0"}} | more


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    rows = [
        {
            "cve_id": "c1",
            "arms": {
                "joern_0": arm(["tp", "fn_by_llm", "fp_by_location", "fp_by_hallucinated_source"], [verdict(42, "true_positive"), verdict(80, "false_positive"), verdict(200, "uncertain"), verdict(121, "true_positive", False)]),
                "joern_1": arm(["fp_by_llm_overclaim"], [verdict(300, "true_positive", kind="")], metrics={"findings_hash": "h1"}),
                "joern_0_patched": arm([], [verdict(42, "true_positive")]),
                "semgrep_0": arm(["tp"], [verdict(42, "true_positive")]),
            },
        },
        {"cve_id": "c2", "skipped": "timeout"},
        {"cve_id": "c3", "arms": {"joern_0": arm([], [], arm_error_type="x")}},
        {"cve_id": "c4", "arms": {"joern_0": arm([], [])}},
    ]
    path = tmp_path_factory.mktemp("r") / "results.json"
    path.write_text(json.dumps(rows))
    return read_results(spark, str(path))


def test_audit(spark, results, tmp_path):
    truth = spark.createDataFrame([("c1", "old.py", [1]), ("c1", "app.py", [42, 80, 120]), ("c3", "z.py", [5]), ("c4", "z.py", [])], schemas.GROUND_TRUTH).coalesce(1)
    hunks = spark.createDataFrame([], "case_id string, path string, start int, end int")
    got = audit.audit(results, truth, hunks)
    assert {(r.k, r.patched, r.fp_cause) for r in got["fp"].collect()} == {(0, False, "scanner_location_fp"), (0, False, "evidence_hallucination"), (1, False, "triager_overclaim"), (0, True, "patched_commit_alert")}
    fn = {(r.cve_id, r.k, r.gt_line): (r.fn_cause, r.nearest_line) for r in got["fn"].collect()}
    assert fn[("c1", 0, 80)] == ("triager_suppressed_gt", 80) and fn[("c1", 0, 120)] == ("hallucinated_source_on_gt", 121)
    assert ("c1", 0, 42) not in fn and fn[("c1", 1, 42)] == ("joern_candidate_missing", 300)
    assert fn[("c3", 0, 5)][0] == "arm_error_or_timeout" and fn[("c4", 0, None)][0] == "empty_ground_truth"
    its = {(r.cve_id, r.k, r.patched): r for r in got["iterations"].collect()}
    assert its["c1", 1, False].findings_changed_vs_k0 and not its["c1", 0, False].findings_changed_vs_k0
    assert {r.k: r.tp for r in got["totals"].collect()} == {0: 1, 1: 0}
    relaxed = {r.k: r for r in got["relaxed"].collect()}
    assert (relaxed[0].tp, relaxed[0].fp, relaxed[0].fn) == (1, 1, 2) and relaxed[1].fp == 1
    assert {(r.view, r.kind) for r in got["recovery"].collect()} >= {("fp", "(none)"), ("fn", "(no_nearest)")}
    write_audit(got, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/fp")).count() == 4
    assert audit.aligned_rows(audit.arms(results)).where("patched").first().label == ""
    assert "| c1 |" in markdown(got["top_cases"].where("what = 'fp'"), "Top")


def test_rules_audit(spark, tmp_path):
    act = [{"action": "refine"}]

    def it(h, pre, post, **m):
        return {"refinement_actions": act, "metrics": {"findings_hash": h, "rules_hash_pre": pre, "rules_hash_post": post} | m}

    changed = [{"cve_id": f"c{i}", "arms": {f"semgrep_{k}": it(f"h{k}", "a", "b", rules_yaml_changed=True) for k in range(2)} | {"semgrep_0_patched": it("h", "a", "a"), "joern_0": it("h", "a", "a")}} for i in range(2)]
    same = [{"cve_id": "c", "arms": {f"semgrep_{k}": it("h", "a", "a", rules_yaml_changed=False) for k in range(3)}}]
    hashes = [{"cve_id": "c", "arms": {"semgrep_0": it("h", "a", "a"), "semgrep_1": it("g", "a", "b")}}]
    for n, (rows, want) in enumerate(((changed, (4, 0, 0.0, 0)), (same, (3, 3, 1.0, 1)), (hashes, (2, 1, 0.5, 0)))):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(rows))
        s = audit.rules_audit(read_results(spark, str(path)))["summary"].first()
        assert (s.refines, s.no_ops, s.no_op_rate, s.invariant_cases) == want


def test_runs(spark, tmp_path):
    planned = spark.createDataFrame([(f"c{i}", i) for i in range(6)], "cve_id string, pos int")
    prior = spark.createDataFrame([("c0", None, 0), ("c1", "timeout", 1), ("c2", None, 2)], "cve_id string, skipped string, pos int")
    rerun = spark.createDataFrame([("c1", None, 0), ("c5", None, 1)], "cve_id string, skipped string, pos int")
    merged, summary = runs.merge_runs(prior, rerun, "cve_id")
    assert summary.first().asDict() == {"prior": 3, "rerun": 2, "merged": 4, "replaced": 1, "appended": 1}
    assert [r.cve_id for r in merged.orderBy("is_new", "at_pos").collect()] == ["c0", "c1", "c2", "c5"]
    assert [r.cve_id for r in runs.rerun_targets(planned, prior, "cve_id").collect()] == ["c1", "c3", "c4", "c5"]
    assert runs.coverage(planned, prior, "cve_id").first().asDict() == {"planned": 6, "rows": 3, "full": 2, "timeout": 1, "missing": 3}
    out = {r.cve_id: (r.before, r.after) for r in runs.rerun_outcomes(planned, prior, rerun, "cve_id").collect()}
    assert out["c1"] == ("timeout", "full") and out["c5"] == ("missing_row", "full")
    train, rest = runs.split(planned, "cve_id")
    assert train.count() == 2 and [r.pos for r in rest.collect()] == sorted(r.pos for r in rest.collect())
    assert runs.seeded_subset(planned, "cve_id", 3).count() == 3 and runs.variance_plan(planned, "cve_id", 2, 5).count() == 10
    m = spark.createDataFrame([(10.0, 1.0, 2.0, 3.0, None, 1.0), (1.0, 5.0, 0.0, 0.0, 0.0, 0.0)], "wall_clock_s double, cpg_build_s double, scan_s double, llm_triage_s double, llm_refinement_s double, call_graph_s double")
    assert [r.overhead_s for r in runs.phase_metrics(m).collect()] == [3.0, 0.0]
    append_results(prior, str(tmp_path / "res"))
    append_results(rerun, str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 5
    for want in (False, True):
        _, hit = cached(spark, str(tmp_path / "cache"), "k", lambda: planned)
        assert hit is want
    facts = spark.createDataFrame([("x", "u")], "fact_id string, unit_id string")
    for _ in range(2):
        save_facts(facts, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 1
    built = spark.createDataFrame([("c0", "built"), ("c1", "error")], "cve_id string, status string")
    assert {r.status: r.n for r in prebuild_status(planned.withColumnRenamed("cve_id", "cache_key"), built.withColumnRenamed("cve_id", "cache_key")).collect()} == {"hit": 1, "error": 1, "missing": 4}
    assert planned.select(seed_key(["cve_id", "pos"]).alias("k")).distinct().count() == 6
    assert fact_row("S", {"__class__": "T", "b": 1})["fact_class"] == "T"


def test_hunks(spark):
    diff = "--- a/src/app.py\t2020\n+++ b/src/app.py\n@@ -10,6 +10,8 @@\n x\n@@ -42,3 +44,4 @@\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,3 @@\n--- a/o.py\n@@ -5 +5 @@\n@@ -0,0 +1 @@"
    df = spark.createDataFrame([("c", diff), ("e", "")], schemas.DIFFS)
    assert sorted((r.path, r.start, r.end) for r in old_hunks(df).collect()) == [("o.py", 5, 5), ("src/app.py", 10, 15), ("src/app.py", 42, 44)]
    assert old_hunks(df).where(F.col("case_id") == "e").count() == 0


def test_resume_and_rewrite(spark, tmp_path):
    path = tmp_path / "results.json"
    assert readers.resume_results(spark, str(path)).count() == 0
    path.write_text('[{"cve_id": "c0", "loc": 3}, {"cve_id": "c1"}]')
    done = readers.resume_results(spark, str(path))
    planned = spark.createDataFrame([(f"c{i}",) for i in range(5)], "cve_id string")
    skip = spark.createDataFrame([("c3",)], "cve_id string")
    assert sorted(r.cve_id for r in readers.left_to_run(planned, done, skip).collect()) == ["c2", "c4"]
    path.write_text("[broken")
    assert readers.resume_results(spark, str(path)).count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "cve_id string, n int")
    rewrite_results(rows(("a", 1), ("b", 1)), str(tmp_path / "table"))
    rewrite_results(rows(("b", 2), ("c", 2)), str(tmp_path / "table"))
    assert {(r.cve_id, r.n) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    cases = spark.createDataFrame([(f"c{i:02}", i) for i in range(25)], "cve_id string, pos int")
    drawn = runs.spot_check(cases, "cve_id").collect()
    assert len(drawn) == 2 and {r.manual_review_status for r in drawn} == {"pending"}
    assert runs.spot_check(cases.limit(3), "cve_id").count() == 1


def test_fact_dispatch(spark):
    facts = ['{"__kind__": "unit", "__class__": "Note", "unit_id": "u1", "name": "n"}', '{"__kind__": "relation", "__class__": "Edge", "src": "a", "dst": "b", "seq": 2}']
    units, relations = dispatch_facts(spark.createDataFrame([(f,) for f in [*facts, None]], "fact string"))
    assert [(r.unit_id, r.fact_class, r.name) for r in units.collect()] == [("u1", "Note", "n")]
    assert [(r.src, r.dst, r.seq, r.fact_class) for r in relations.collect()] == [("a", "b", 2, "Edge")]
    for bad in ('{"__kind__": "other"}', "{}"):
        with pytest.raises(Exception, match="unknown kind of fact"):
            dispatch_facts(spark.createDataFrame([(bad,)], "fact string"))[0].collect()
