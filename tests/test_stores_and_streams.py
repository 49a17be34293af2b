"""A graph that follows its files; streams that equal their tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cartulary.sources.graph_store import GraphStore, content_hashes, diff_files
from cartulary.streaming import events as s


def extract(files):
    """A function a line; calls by name, in whatever file."""
    lines = files.select("file_path", F.posexplode(F.split("text", "\n")).alias("n", "code")).where("code like 'def %'")
    name = F.regexp_extract("code", r"def (\w+)", 1)
    units = lines.select(name.alias("id"), F.lit("Function").alias("kind"), "code", "file_path")
    edges = lines.select(name.alias("src"), F.explode(F.regexp_extract_all("code", F.lit(r"(\w+)\(\)"), 1)).alias("dst"), F.lit("Calls").alias("kind"), "file_path")
    return units, edges


def plain(files):
    units = {(m, p) for p, t in files.items() for m in re.findall(r"def (\w+)", t or "")}
    names = {u for u, _ in units}
    edges = {(m, c) for t in files.values() for m, rest in re.findall(r"def (\w+)(.*)", t or "") for c in re.findall(r"(\w+)\(\)", rest) if c in names}
    return units, edges


def test_incremental_equals_rebuilt(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), extract)
    steps = [
        {"a": "def f: g() h()\ndef g: f()", "b": "def h: g()", "c": None, "d": ""},
        {"a": "def f: g() h()\ndef g: f()", "b": "def k: f()", "c": "def h: k()", "d": ""},
        {"b": "def k: f() k()", "c": "def h: k()"},
        {"b": "def k: f() k()", "c": "def h: k()"},
        {"a": "def f: h()", "b": "def k: f() k()", "c": "def h: k()", "e": "def x: k()"},
    ]
    counts = [(4, 0, 0, 0), (0, 2, 0, 2), (0, 1, 2, 1), (0, 0, 0, 2), (2, 0, 0, 2)]
    before = None
    for files, want in zip(steps, counts, strict=True):
        done = {r.change: r.files for r in store.refresh(spark.createDataFrame(list(files.items()), "file_path string, text string")).collect()}
        assert tuple(done[c] for c in ("added", "changed", "removed", "same")) == want
        graph = store.open()
        units, edges = plain(files)
        assert sorted((u.id, u.file_path) for u in graph.units.collect()) == sorted(units)
        assert sorted((e.src, e.dst) for e in graph.edges.collect()) == sorted(edges)
        # Files that did not change keep the segment that held them.
        now = {r.file_path: r.segment for r in store.manifest().collect()}
        if before:
            old_files, old = before
            assert all(now[p] == old[p] for p in files if p in old_files and (old_files[p] or "") == (files[p] or ""))
        before = files, now
    first = plain(steps[0])
    assert {u.id for u in store.open(0).units.collect()} == {u for u, _ in first[0]}
    assert store.import_or_open(spark.createDataFrame([], "file_path string, text string")).units.count() == len(plain(steps[-1])[0])


def test_an_unfinished_import_changes_nothing(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), extract)
    with pytest.raises(ValueError):
        store.open()
    files = spark.createDataFrame([("a", "def f: f()")], "file_path string, text string")
    store.refresh(files)
    (tmp_path / "g/manifest/v=1").mkdir()  # as a driver that died leaves it
    (tmp_path / "g/units/segment=dead").mkdir()
    assert store.open().units.count() == 1
    assert {r.change: r.files for r in store.refresh(files).collect()}["same"] == 1
    hashes = content_hashes(files)
    assert [r.change for r in diff_files(hashes, hashes.where("false")).collect()] == ["removed"]


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def feed(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")


SCHEMA = "who string, at timestamp, v int"


def lines(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


@pytest.mark.parametrize("kind", [{"length": "10 minutes"}, {"length": "10 minutes", "slide": "5 minutes"}, {"gap": "4 minutes"}])
def test_windows_with_late_rows(spark, tmp_path, kind):
    """A row behind the last batch's watermark is left out, one before it counts; a
    restart goes on; what is final equals the table's windows."""
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        rows = s.file_stream(spark, f"{source}/*", SCHEMA)
        done = s.windowed(rows, "at", "10 minutes", ["who"], F.count("*").alias("n"), F.sum("v").alias("v"), **kind)
        s.write_table(done, out, ck).awaitTermination()
        return done.schema

    first = [("a", at(1), 1), ("a", at(2), 2), ("b", at(4), 3), ("a", at(33), 4)]
    late_but_in_time = [("b", at(24), 5), ("a", at(35), 6), ("b", at(70), 7)]
    too_late = [("a", at(3), 100), ("b", at(200), 8)]
    for n, rows in enumerate((first, late_but_in_time, too_late)):
        feed(spark, source, n, rows, SCHEMA)
        schema = run()
    every = spark.createDataFrame(first + late_but_in_time + too_late[1:], SCHEMA)
    want = s.windowed(every, "at", "10 minutes", ["who"], F.count("*").alias("n"), F.sum("v").alias("v"), **kind).where(F.col("end") <= F.lit(at(190)))
    assert lines(spark.read.schema(schema).parquet(out)) == lines(want) != []


def test_repeats_within_the_watermark(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for n, rows in enumerate([[("a", at(1), 1), ("a", at(2), 1)], [("a", at(3), 1), ("b", at(4), 2)], [("c", at(50), 3)]]):
        feed(spark, source, n, rows, SCHEMA)
        s.write_table(s.first_of_each(s.file_stream(spark, f"{source}/*", SCHEMA), "at", "10 minutes", ["who", "v"]), out, ck).awaitTermination()
    assert sorted(r.who for r in spark.read.schema(SCHEMA).parquet(out).collect()) == ["a", "b", "c"]


def test_state_of_cases(spark, tmp_path):
    """Verdicts ahead of their iteration, of an earlier one, and repeated; the
    stream's last states are those of the table. An idle case is closed."""
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    batches = [
        [("x", at(0), "iteration", 0, 5, None, None), ("x", at(1), "verdict", 0, None, 0, "true_positive"), ("y", at(2), "verdict", 1, None, 3, "uncertain")],
        [("x", at(5), "iteration", 1, 4, None, None), ("x", at(6), "verdict", 0, None, 1, "true_positive"), ("x", at(7), "verdict", 1, None, 0, "uncertain"), ("y", at(8), "iteration", 1, 2, None, None)],
        [("x", at(9), "verdict", 1, None, 0, "false_positive"), ("x", at(4), "verdict", 1, None, 2, "true_positive"), ("y", at(10), "iteration", 0, 9, None, None)],
        [("z", at(600), "iteration", 0, 1, None, None)],
        [("z", at(1300), "verdict", 0, None, 0, "true_positive")],
    ]
    for n, rows in enumerate(batches):
        feed(spark, source, n, rows, s.CASE_EVENTS)
        s.write_states(s.last_iterations(s.file_stream(spark, f"{source}/*", s.CASE_EVENTS), "30 minutes", 3_600_000), out, ck).awaitTermination()
    states = spark.read.option("mergeSchema", True).parquet(out)
    every = spark.createDataFrame([r for b in batches for r in b], s.CASE_EVENTS)
    assert lines(s.settled(states).select("case_id", "k", "candidates", *s.VERDICTS)) == lines(s.last_iterations_batch(every))
    assert {r.case_id for r in states.where("closed").collect()} >= {"x", "y"}


def test_tasks_take_few_bytes_of_a_shuffle(spark):
    """Queries over the tables bound what one task takes of a shuffle."""
    from cartulary.plans.catalogue import _t
    from cartulary.session import SETTINGS, TASK_BYTES

    spark.conf.unset(TASK_BYTES[0])
    _t(spark, "/root/testdata/sf0.001", "part")
    assert spark.conf.get(TASK_BYTES[0]) == SETTINGS[TASK_BYTES[0]] == "8m"


def test_parts_of_a_shuffle_follow_the_findings(spark, monkeypatch):
    """A task's rows do not grow with the tables."""
    from cartulary import session
    from cartulary.plans import catalogue

    d, few = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted(map(tuple, catalogue.q_label_matrix(spark, d).collect()))
    assert spark.conf.get(session.PARTS, None) is None  # as many as the session says, while the table is small
    n = spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(session, "PART_ROWS", n // (10 * few))
    try:
        got = catalogue.q_label_matrix(spark, d)
        assert int(spark.conf.get(session.PARTS)) == n // session.PART_ROWS >= 10 * few
        assert sorted(map(tuple, got.collect())) == want
        spark.conf.set(session.PARTS, "5000")
        session.parts_for(spark, n)
        assert spark.conf.get(session.PARTS) == "5000"
    finally:
        spark.conf.unset(session.PARTS)
