"""Rules whose earlier readings differ: each case tells the two apart."""

from pyspark.sql import functions as F

from cartulary.operators import audit, catalogs, curation, scans, scoring


def test_hallucination_needs_a_claim(spark):
    """Without a label only a true positive without its source is one."""
    rows = [("", "true_positive", False), ("", "uncertain", False), ("", "false_positive", False), (None, None, False), ("", "true_positive", None), ("fp_by_hallucinated_source", "uncertain", True), ("tp", "true_positive", False)]
    df = spark.createDataFrame(rows, "l string, v string, s boolean").coalesce(1)
    got = [r[0] for r in df.select(scoring.hallucinated(F.col("l"), F.col("v"), F.col("s"))).collect()]
    assert got == [True, False, False, False, False, True, False]


def test_uncertain_rows_keep_their_credit(spark):
    rows = spark.createDataFrame([("c", 1, "f.py", 10, "", "uncertain", False), ("c", 2, "f.py", 90, "", "false_positive", False)], "case_id string, row_id int, file string, line int, label string, verdict string, source_in_snippet boolean")
    gt = spark.createDataFrame([("c", "f.py", 1, 10, 12)], "case_id string, gt_file string, cluster int, start int, end int")
    hunks = spark.createDataFrame([], "case_id string, path string, start int, end int")
    r = scoring.relaxed_scores(rows, gt, hunks, ["case_id"]).first()
    assert (r.tp, r.fp, r.fn, r.credits) == (0, 0, 1, 1)


def test_an_empty_truth_file_matches_nothing(spark):
    f = spark.createDataFrame([("a", "any.py", 5), ("b", "any.py", 5), ("c", "any.py", 5)], "case_id string, file_path string, line_start int")
    t = spark.createDataFrame([("a", "", [5]), ("b", None, [5]), ("c", "x/any.py", [5])], "case_id string, gt_file string, gt_lines array<int>")
    assert {r.case_id: r.gt_line for r in scoring.match_truth(f, t, ["case_id"]).collect()} == {"a": None, "b": None, "c": 5}


def test_widened_sources_hold_the_whole_pattern(spark):
    """`my_household` is no source for `x.household`."""
    units = spark.createDataFrame([(1, "Identifier", "my_household", "n"), (2, "Parameter", "x.household", "n"), (3, "Call", "run(a)", "run")], "id long, kind string, code string, name string").withColumns({"file_path": F.lit("f"), "line_start": F.lit(1)})
    catalog = spark.createDataFrame([("sink", 0, "run"), ("source", 0, "x.household")], "role string, pos int, pattern string")
    flow = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    assert [r.source_code for r in scans.relaxed_taint(units, catalog, flow, depth=2).collect()] == ["x.household"]
    assert [(r.source_line, r.source_code) for r in scans.direct_sinks(units, catalog).collect()] == [("-1", "")]


def test_wrappers_are_judged_one_by_one(spark):
    """Case, whole callees, script of any kind, rows of one name."""
    rows = [
        (0, "w", [], "System(x)", ""),
        (1, "w", [], "os.system \n(x)", ""),
        (2, "w", [], "nothing", ""),
        (3, "w", ["system"], None, None),
        (4, "w", ["os.system"], "", ""),
        (5, "w", None, "xsystem(y); systemé(z)", "asystem"),
        (6, "w", [], "", "see system."),
        (7, "w", [], "system", None),
        (8, "w", [], "", "ésystem"),
    ]
    c = spark.createDataFrame(rows, "n int, name string, callees array<string>, code string, evidence string")
    sinks = spark.createDataFrame([("os.system",), (None,), ("",)], "pattern string")
    got = {r.n: r.accepted for r in catalogs.gate_wrappers(c, sinks).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False, 8: False}


def test_patterns_are_compared_without_dots_and_blanks(spark):
    """A leading dot or blank saves no source; only kept repeats vanish."""
    rows = [("sink", 0, " .os.system"), ("sink", 1, ".exec"), ("source", 0, "..os.system"), ("source", 1, " os"), ("source", 2, "a.b"), ("source", 3, ".a.b "), ("source", 4, "  "), ("source", 5, "OS"), ("sanitizer", 0, "os.system "), ("sanitizer", 1, "quote")]
    kept, dropped = catalogs.cleaned(spark.createDataFrame(rows, "role string, pos int, pattern string"), [], bound=1.0)
    assert {(r.role, r.pattern) for r in kept.collect()} == {("sink", " .os.system"), ("source", "a.b"), ("source", "OS"), ("sanitizer", "quote")}
    assert {(r.role, r.pos): r.reason for r in dropped.collect()} == {("sink", 1): "bare_sink", ("source", 0): "equals_sink", ("source", 1): "ancestor_of_sink", ("sanitizer", 0): "equals_sink"}


def test_messages_of_merged_flows(spark):
    schema = "arrival long, sink_file string, sink_line string, sink_name string, sink_code string, source_file string, source_line string, source_code string, recovery_kind string"
    rows = [(1, "f", "1", "system", "os.system(cmd)", "f", "2", "input()", " Relaxed"), (2, "f", "7", "system", "os.system(a)", "", "-1", "", "taint"), (3, "f", "7", "system", "os.system(a)", "", "-1", "", "direct_sink")]
    got = {r.sink_line: (r.message, r.rule_id, r.recovery_kind) for r in audit.dedup_flows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("Taint flow: input() -> os.system(cmd)", "joern-relaxed-recovery", "relaxed"), 7: ("Direct sink call: os.system(a)", "joern-taint-reachability", "taint")}


def test_advisories_by_any_signal_in_the_record(spark):
    link = ["https://github.com/o/r/pull/3"]
    rows = [(1, ["CWE-78"], ["npm"], "Django flaw", link, None), (2, ["CWE-78"], ["npm"], "a flaw", link, "SALT master"), (3, ["CWE-78"], None, "a flaw", link, None), (4, ["CWE-78"], ["npm"], "Django", ["https://github.com/o/r"], None), (5, ["CWE-79"], ["PyPI"], "python", link, None), (6, ["CWE-78"], ["PyPI"], "", None, None)]
    adv = spark.createDataFrame(rows, "id int, cwes array<string>, ecosystems array<string>, description string, references array<string>, notes string")
    assert {r.id for r in curation.advisory_filter(adv).collect()} == {1, 2, 6}


def test_commits_by_fixed_version(spark):
    base = "https://github.com/o/r"
    rows = [(1, [f"{base}/releases/tag/v1.0"], base, "2.0"), (2, [f"{base}/releases/tag/v1.0"], base, None), (3, [f"{base}/commit/ABCDEF1"], base, "2.0"), (4, [], base, "3"), (5, [], base, "9.9"), (6, [], "https://github.com/o/x", "2.0")]
    df = spark.createDataFrame(rows, "id int, references array<string>, repo_url string, version string")
    tags = spark.createDataFrame([("o/r", "v1.0", "one"), ("o/r", "v2.0", "two"), ("o/r", "3.10", "b"), ("o/r", "3.1", "a"), ("o/r", "v3", "c")], "repo string, tag string, commit string")
    pulls = spark.createDataFrame([], "repo string, number int, commit string")
    got = {r.id: (r.commit, r.how) for r in curation.commit_of("references", pulls, tags, df, "id", "repo_url", "version").collect()}
    assert got == {1: ("two", "version"), 2: ("one", "tag"), 3: ("ABCDEF1", "commit"), 4: ("a", "version"), 5: (None, None), 6: (None, None)}


def test_places_do_not_run_into_each_other(spark):
    rows = [(1, "a|b", "c", [1]), (2, "a", "b|c", [1]), (3, None, "a", [1]), (4, "a", None, [1]), (5, "a|b", "c", [1, 2])]
    df = spark.createDataFrame(rows, "id int, r string, f string, l array<int>")
    assert df.select(curation.location_key("r", "f", "l")).distinct().count() == 5


def test_audit_rows_carry_arm_label_line_and_capped_texts(spark):
    rows = [("c", 1, True, "", "uncertain", "a/f.py", 12, "x\r\ny" + "z" * 600), ("c", 0, False, "fp_by_location", "uncertain", "g.py", 12, None), ("c", 0, False, "tp", "true_positive", "f.py", 12, None), ("c", 2, True, "tp", "true_positive", "f.py", 90, "")]
    df = spark.createDataFrame(rows, "cve_id string, k int, patched boolean, label string, verdict string, file string, line int, reasoning string").withColumn("source_in_snippet", F.lit(True))
    truth = spark.createDataFrame([("c", "src/f.py", [40, 15, 10])], "cve_id string, vulnerable_file string, vulnerable_lines array<int>")
    got = {r.k: (r.arm_key, r.label, r.fp_cause, r.matched_gt_line, r.reasoning) for r in audit.fp_rows(df, truth).collect()}
    assert got == {1: ("joern_1_patched", "patched_commit_alert", "patched_commit_alert", "15", "x\ny" + "z" * 497), 0: ("joern_0", "fp_by_location", "scanner_location_fp", "", ""), 2: ("joern_2_patched", "tp", "patched_commit_alert", "", "")}


def test_snippets_of_files_that_moved(spark):
    files = spark.createDataFrame([("b/x.py", "one"), ("a/x.py", "two"), ("y.py", "three")], "file_path string, text string")
    f = spark.createDataFrame([(1, "b/x.py", 1, 1), (2, "old/x.py", 1, 1), (3, "none.py", 1, 1)], "k int, file_path string, line_start int, line_end int")
    got = {r.k: (r.file_path, r.snippet) for r in scans.seed_snippets(f, files, ["k"]).collect()}
    assert got == {1: ("b/x.py", "    1| one"), 2: ("old/x.py", "    1| two"), 3: ("none.py", "")}


def test_eight_earliest_sources_of_a_sink(spark):
    schema = "arrival long, sink_file string, sink_line string, sink_name string, sink_code string, source_file string, source_line string, source_code string, recovery_kind string"
    rows = [(k, None, "1", None, "s", "", "", f"c{k % 12}" if k % 5 else "", "taint") for k in range(60, 0, -1)] + [(99, "f", "1", "n", "s", "", "", "", "taint")]
    got = {r.sink_file: r for r in audit.dedup_flows(spark.createDataFrame(rows, schema)).collect()}
    assert got[None].dedup_sources == ["c1", "c2", "c3", "c4", "c6", "c7", "c8", "c9"] and got[None].dedup_count == 60
    assert got["f"].dedup_sources == [] and got["f"].message == "Direct sink call: s"
