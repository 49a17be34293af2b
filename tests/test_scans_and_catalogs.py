import pytest
from pyspark.sql import functions as F

from cartulary.functions.text import human_size, identifier, numbered, paths_match, recover_json, truncate
from cartulary.operators import audit, catalogs, curation, scans
from cartulary.sources import readers


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("source", 0, "request.args"), ("source", 1, "os.getenv"), ("source", 2, "input"), ("sink", 0, "os.system"), ("sink", 1, "subprocess.run"), ("sanitizer", 0, "shlex.quote")]
    return spark.createDataFrame(rows, "role string, pos int, pattern string")


CODE = """import os, subprocess
from flask import request

def handler(name):
    cmd = request.args
    full = "ls " + cmd
    os.system(full)
    os.systematic(full)

def helper(x):
    y = x
    subprocess.run(y)

def main():
    handler(input())
    v = os.getenv("A")
    helper(v)
    os.system("fixed")
"""


def test_parse_and_scan(spark, catalog):
    files = spark.createDataFrame([("a.py", CODE), ("bad.py", "def x(:\n")], "file_path string, text string")
    units, edges, flows = readers.parse_python(files)
    units = units.cache()
    assert {r.name for r in units.where("kind = 'Function'").collect()} == {"handler", "helper", "main"}
    assert units.where("kind = 'File'").count() == 2
    calls = {(r.src.split(":")[-1], r.dst.split(":")[-1]) for r in edges.where("kind = 'Calls'").collect()}
    assert calls == {("main", "handler"), ("main", "helper")}
    assert [r.line_start for r in scans.sink_calls(units, catalog).orderBy("line_start").collect()] == [7, 12, 18]
    strict = scans.taint(units, catalog, flows).collect()
    assert [(r.sink_line, r.source_code) for r in strict] == [("7", "request.args")]
    wide = scans.def_use(units, catalog, flows)
    assert {r.sink_line for r in wide.collect()} >= {"7", "12"}
    direct = scans.direct_sinks(units, catalog)
    assert [r.sink_line for r in direct.collect()] == ["7", "12", "18"]
    assert scans.relaxed_taint(units, catalog, flows).count() >= 1
    union = scans.recovery_union(scans.taint(units, catalog, flows), direct)
    from pyspark.sql import Window

    found = audit.dedup_flows(union.withColumn("arrival", F.row_number().over(Window.orderBy("arrival_order"))))
    assert {(r.sink_line, r.recovery_kind, r.dedup_count) for r in found.collect()} == {(7, "taint", 2), (12, "direct_sink", 1), (18, "direct_sink", 1)}


def test_context_and_evidence(spark):
    files = spark.createDataFrame([("a.py", "\n".join(f"l{i}" for i in range(1, 31)))], "file_path string, text string")
    f = spark.createDataFrame([("a.py", 2, 2), ("no.py", 1, 1)], "file_path string, line_start int, line_end int")
    got = {r.file_path: r.surrounding_context for r in scans.context(f, files, 2).collect()}
    assert got == {"a.py": "    1| l1\n    2| l2\n    3| l3\n    4| l4", "no.py": ""}
    rows = [(["os.system(x)", "user", "other"], "os.system(x)", "os.system", "a.py", 3, "a.py", 7, "taint", ["direct_sink", "taint"], 2), (["system"], "", "", None, -1, "b.py", -1, "relaxed", ["relaxed"], 1)]
    df = spark.createDataFrame(rows, "sources array<string>, sink_code string, sink_api string, source_file string, source_line int, sink_file string, sink_line int, recovery_kind string, recovery_kinds_seen array<string>, dedup_count int")
    one, two = [r.structural_evidence for r in scans.evidence(df).collect()]
    assert one.split("\n") == ["Source: user (at a.py:3)", "Alt source: other", "Sink: os.system(x)", "Sink API: os.system", "Sink location: a.py:7", "recovery_kind=taint; kinds_seen=direct_sink,taint", "dedup_count=2"]
    assert two.split("\n") == ["Source: system", "recovery_kind=relaxed; kinds_seen=relaxed"]
    s = spark.createDataFrame([("x", "y", "a.b"), ("", "y", "a.b"), ("y", " y", "a.b"), ("call B()", "y", "a.b"), ("abx", "y", "a.b")], "c string, k string, a string")
    assert [r[0] for r in s.select(scans.self_flow("c", "k", "a")).collect()] == [False, True, True, True, False]


CASES = {"os.system(cmd": "os.system", "subprocess.run  # python": "subprocess.run", "subprocess.Popen[shell=True]": "subprocess.Popen", ".os.system": "os.system", "os.system.": "os.system", "os system": "os", "": None, "1.foo": None, "os..system": None, "os.system!": None, "os/system": None, "os-system": None, "$cmd": None, "(": None}


def test_identifier_and_text(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "x string")
    assert {r.x: r.y for r in df.select("x", identifier("x").alias("y")).collect()} == CASES
    one = spark.range(1).select(
        truncate(F.lit("a" * 250)).alias("t"), human_size(F.lit(1536)).alias("h"), numbered(F.array(F.lit("x"), F.lit("y")), F.lit(99999)).alias("n"), paths_match(F.lit("a/b.py"), F.lit("c/b.py")).alias("p"), paths_match(F.lit("a"), F.lit("")).alias("e"), recover_json(F.lit('x "k": "v", '), "k").alias("j")
    ).first()
    assert (len(one.t), one.t[-3:], one.h, one.n, one.p, one.e, one.j) == (240, "...", "1.5KB", "99999| x\n100000| y", True, True, "v")


def test_gate(spark):
    sinks = spark.createDataFrame([(p,) for p in ("os.system", "subprocess.Popen", "subprocess.run", "subprocess.check_output")], "pattern string")
    rows = [("a", ["system", "x"], "", ""), ("b", ["x"], "print(1)", ""), ("c", [], "return run (cmd)", ""), ("d", [], "rerun(cmd)", "calls Popen here"), ("e", None, None, None)]
    c = spark.createDataFrame(rows, "name string, callees array<string>, code string, evidence string")
    assert {r.name: r.accepted for r in catalogs.gate_wrappers(c, sinks).collect()} == {"a": True, "b": False, "c": True, "d": True, "e": False}
    assert not any(r.accepted for r in catalogs.gate_wrappers(c, sinks.where("false")).collect())


def test_catalog_cleaning(spark, catalog):
    rows = [("sink", 0, "os.system"), ("sink", 1, "shell"), ("sanitizer", 0, "os.system"), ("sanitizer", 1, "shlex.quote")]
    rows += [("source", i, p) for i, p in enumerate(["request.body", "os.environ", "sys.argv", "websocket.receive_text", "subprocess", "os", "os.system", "request.body"])]
    df = spark.createDataFrame(rows, "role string, pos int, pattern string")
    kept, dropped = catalogs.cleaned(df, ["subprocess"], bound=0.9)
    assert {r.pattern for r in kept.where("role = 'source'").collect()} == {"request.body", "os.environ", "sys.argv", "websocket.receive_text"}
    assert {(r.role, r.pattern): r.reason for r in dropped.collect()} == {("sink", "shell"): "bare_sink", ("sanitizer", "os.system"): "equals_sink", ("source", "subprocess"): "blacklist", ("source", "os"): "ancestor_of_sink", ("source", "os.system"): "equals_sink"}
    with pytest.raises(ValueError, match="dropped"):
        catalogs.cleaned(df, ["subprocess"])
    both, added = catalogs.merged(catalog, df)
    assert added.where("pattern = 'sys.argv'").count() == 1 and both.where("pattern = 'os.system' and role = 'sink'").count() == 1
    assert {r.role: r.grew for r in catalogs.grew(catalog, both).collect()} == {"source": True, "sink": True, "sanitizer": True}
    assert catalogs.normalised(spark.createDataFrame([("sink", 0, "os.system("), ("sink", 1, "os.system"), ("sink", 2, "$x")], "role string, pos int, pattern string")).count() == 1


def test_curation(spark):
    d = "--- a/readme.md\n@@ -1 +1 @@\n-x\n--- a/m.py\n+++ b/m.py\n@@ -10,4 +10,4 @@\n a\n-os.system(x)\n+safe(x)\n b\n-c\n@@ -30,2 +30,1 @@\n-d\n e\n--- a/z.py\n@@ -1 +1 @@\n-q\n"
    only_added = "--- a/m.py\n+++ b/m.py\n@@ -5,2 +5,3 @@\n a\n+new\n b\n"
    df = spark.createDataFrame([("c", d), ("n", only_added)], "case_id string, diff string")
    got = {r.case_id: r for r in curation.vulnerable_lines(df).collect()}
    assert got["c"].path == "m.py" and got["c"].lines == [11, 13, 30] and got["c"].removed.startswith("os.system(x)")
    assert got["n"].lines and got["n"].lines[0] >= 7
    assert {r.case_id: r.loc for r in curation.diff_loc(df).collect()}["c"] == 32
    sink = spark.createDataFrame([("os.system(x)",), ("z",)], "removed string").select(curation.sink_of("removed", ["popen", "os.system"]))
    assert [r[0] for r in sink.collect()] == ["os.system", "unknown"]
    schema = "pos int, cve_id string, patch_commit string, vulnerable_commit string, repo_url string, vulnerable_file string, vulnerable_lines array<int>, rejection string"
    rows = [(0, "a", "p", "v", "r", "f", [3, 1], None), (1, "a", "p", "v", "r", "g", [1], None), (2, "b", "p", "v", "r", "f", [1, 3], None), (3, "b", "p", "v", "r", "h", [1], None), (4, "", "p", "v", "r", "k", [1], None), (5, "d", "", "v", "r", "k", [1], None), (6, "e", "p", "", "r", "k", [1], None), (7, "f", "p", "v", "r", "k", [1], "old")]
    got = {r.pos: r.reason for r in curation.accept_records(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: None, 1: "duplicate_cve_id", 2: "duplicate_location", 3: None, 4: "no_cve_id", 5: "no_patch_commit", 6: "no_vulnerable_commit", 7: "old"}
    dup = curation.duplicate_locations(spark.createDataFrame(rows[:3], schema)).collect()
    assert [(r.cve_id, r.first_id) for r in dup] == [("b", "a")]
    adv = spark.createDataFrame([(1, ["CWE-78"], ["PyPI"], "", []), (2, ["CWE-78"], [], "Python tool", ["https://github.com/a/b/commit/abcdef1"]), (3, ["CWE-78"], [], "Python tool", []), (4, ["CWE-79"], ["pip"], "", [])], "id int, cwes array<string>, ecosystems array<string>, description string, references array<string>")
    assert {r.id for r in curation.advisory_filter(adv).collect()} == {1, 2}
    pulls = spark.createDataFrame([("a/b", 7, "pc")], "repo string, number int, commit string")
    tags = spark.createDataFrame([("a/b", "v1", "tc")], "repo string, tag string, commit string")
    refs = spark.createDataFrame([(1, ["https://github.com/a/b/pull/7", "https://github.com/a/b/commit/abcdef1"]), (2, ["https://github.com/a/b/pull/7"]), (3, ["https://github.com/a/b/releases/tag/v1"]), (4, [])], "id int, references array<string>")
    assert {r.id: (r.commit, r.how) for r in curation.commit_of("references", pulls, tags, refs, "id").collect()} == {1: ("abcdef1", "commit"), 2: ("pc", "pull"), 3: ("tc", "tag"), 4: (None, None)}
    many = spark.range(300).select(F.col("id").cast("string").alias("cve_id"), (F.col("id") * 10).cast("int").alias("loc"), F.lit("os.system").alias("sink_api"), F.lit("HIGH").alias("cvss_severity"))
    sample = curation.stratified_sample(many, 60)
    assert sample.count() == 60 and {r.bin: r["count"] >= 10 for r in sample.groupBy(curation.loc_bin("loc").alias("bin")).count().collect()}["<100"]
    s = curation.length_summary(many).first()
    assert (s.n, s.least, s.most, s["median"], s["mean"]) == (300, 0, 2990, 1500, 1495)
    assert {(r.what, r.n) for r in curation.diversity(many).collect()} >= {("sink", 300), ("severity", 300)}


def test_sources(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/sub/b.py").write_text("x\ny\n")
    (tmp_path / "src/a.py").write_text("")
    (tmp_path / "src/venv").mkdir()
    (tmp_path / "src/venv/z.py").write_text("z")
    files = readers.read_files(spark, str(tmp_path / "src"), "*.py")
    assert {r.file_path: r.n_lines for r in files.collect()} == {"a.py": 1, "sub/b.py": 3, "venv/z.py": 1}
    assert readers.tree_text(files).first().tree == "sub/\n  b.py (4.0B)\na.py (0.0B)"
    assert readers.file_units(files).where("line_end = 3").count() == 1 and readers.read_file(spark, str(tmp_path / "src"), "a.py").count() == 1
    (tmp_path / "out.json").write_text('{"results": [{"path": "a.py", "check_id": "r", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "lines": "l", "metadata": {"sink_api": "os.system"}}}]}')
    r = readers.read_pattern_results(spark, str(tmp_path / "out.json")).first()
    assert (r.file_path, r.line_start, r.line_end, r.rule_id, r.sink_api) == ("a.py", 3, 4, "r", "os.system")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/CVE-1.diff").write_text("--- a/x.py\n@@ -1 +1 @@\n")
    diffs = readers.read_diffs(spark, str(tmp_path / "d"))
    cases = spark.createDataFrame([("diffs/CVE-1.diff",), ("diffs/no.diff",)], "patch_diff_path string")
    assert {r.patch_diff_path: r.diff is not None for r in readers.resolve_diffs(cases, diffs).collect()} == {"diffs/CVE-1.diff": True, "diffs/no.diff": False}
    assert readers.catalog_from(spark, {"sources": [{"pattern": "a"}], "sinks": [{"api": "b"}, {"api": "c"}]}).count() == 3
    assert readers.decode_response('val res1: String = """[{"a": 1}]"""') == [{"a": 1}]
    assert readers.decode_response("Some(3)") == 3 and readers.decode_response("None") is None and readers.decode_response("text") == "text"


def test_stream_totals(spark, tmp_path):
    from cartulary.streaming.results import append_stream, result_stream, running_totals

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": 0, "tp": 1, "fp": 2, "fn": 0}\n{"k": 1, "tp": 1, "fp": 0, "fn": 0}\n')
    schema = "k int, tp long, fp long, fn long"
    run = lambda: append_stream(result_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text('{"k": 0, "tp": 4, "fp": 0, "fn": 1}\n')
    run()
    got = {r.k: (r.tp, r.fp, r.fn) for r in running_totals(spark.read.schema(schema).parquet(str(tmp_path / "out"))).collect()}
    assert got == {0: (5, 2, 1), 1: (1, 0, 0)}


def test_refinement_and_expansion(spark, catalog):
    rules = spark.createDataFrame([(c, 0, "r1", "old") for c in "abcde"], "case_id string, pos int, rule_id string, rule string")
    patches = spark.createDataFrame([("a", "refine", "r1", "new"), ("b", "refine", "r2", "new"), ("c", "add_rule", "r1", "new"), ("d", "refine", None, "x"), ("e", "keep", "r1", "x")], "case_id string, action string, rule_id string, rule string")
    got = sorted((r.case_id, r.pos, r.rule_id, r.rule, r.apply_status) for r in catalogs.refined(rules, patches).collect())
    assert got == [("a", 0, "r1", "new", "refined"), ("b", 0, "r1", "old", "refined"), ("b", 1, "r2", "new", "refined"), ("c", 0, "r1", "old", "added"), ("c", 1, "r1", "new", "added"), ("d", 0, "r1", "old", "noop_empty_patch"), ("e", 0, "r1", "old", "kept")]
    found = [("wrap", "sink", ["system"], "", ""), ("plain", "sink", [], "", ""), ("get_arg", "source", [], "", ""), ("x", "unrelated", ["system"], "", "")]
    helpers = spark.createDataFrame(found, "name string, role string, callees array<string>, code string, evidence string")
    out = catalogs.expand_by_role(catalog, helpers, catalog.where("role = 'sink'"))
    assert {(r.role, r.pattern) for r in out.collect()} - {(r.role, r.pattern) for r in catalog.collect()} == {("sink", "wrap"), ("source", "get_arg")}


def test_text_cuts(spark):
    from cartulary.functions.text import code_lines, head_tail

    one = spark.range(1).select(head_tail(F.lit("1\n2\n3\n4\n5"), 4).alias("a"), head_tail(F.lit("1\n2"), 4).alias("b"), code_lines(F.lit("a\n \n\nb")).alias("c")).first()
    assert (one.a, one.b, one.c) == ("1\n2\n...\n4\n5", "1\n2", 2)
    files = spark.createDataFrame([("a.py", "l1\nl2\nl3")], "file_path string, text string")
    f = spark.createDataFrame([("k", "a.py", 2, 2), ("k", "a.py", 3, 3)], "k string, file_path string, line_start int, line_end int")
    assert scans.seed_snippets(f, files, ["k"], 0).first().snippet == "    2| l2\n    3| l3"


def test_all_unit_kinds(spark):
    code = "# top\nimport os\nlimit = 1 + 2 + 3\n\nclass A:\n    size = 4\n\ndef f(a):\n    global limit\n    limit = 2\n    b = [x for x in a]  # all\n    b = a\n    return q.one(a).one(b)\n"
    deep = "x = " + " + ".join(["y"] * 5000) + "\n"
    units = readers.parse_python(spark.createDataFrame([("m.py", code), ("deep.py", deep)], "file_path string, text string"))[0]
    found = {}
    for r in units.where("file_path = 'm.py'").collect():
        found.setdefault(r.kind, []).append((r.name, r.line_start))
    assert sorted(found["LocalVariable"]) == [("b", 11), ("x", 11)] and found["GlobalVariable"] == [("limit", 3)]
    assert found["Module"] == [("m", 1)] and sorted(found["Comment"]) == [("all", 11), ("top", 1)]
    assert sorted(found["Expression"]) == [("BinOp", 3), ("ListComp", 11)]
    assert sorted(n for n, _ in found["Statement"]) == ["Assign", "Assign", "Assign", "Assign", "Assign", "Global", "Import", "Return"]
    assert [n for n, _ in found["Call"]] == ["one", "one"]
    assert units.where("file_path = 'deep.py' and kind = 'File'").count() == 1
