from pyspark.sql import functions as F

import pytest

from cartulary.operators.graph import CodeGraph, apply_updates, bounded_reach_sql, reach, shortest_path

UNITS = [("f1", "Function", "os.system(x)\n", "run", "a.py", 2, 4, False), ("f2", "Function", "", "main", "a.py", 6, 9, False), ("f3", "Function", "", "ext", "b.py", 1, 1, True), ("g", "Function", "", "<global>", "a.py", 1, 10, False), ("a", "File", "", "a.py", "a.py", 1, 10, False), ("f4", "Function", "", "helper", "b.py", 3, 8, False)]
EDGES = [("f2", "f1", "Calls", None, "m1"), ("f2", "f1", "Calls", None, "m1"), ("f2", "f1", "Calls", None, "m2"), ("f1", "f3", "Calls", None, ""), ("f1", "f4", "Calls", None, ""), ("f4", "f2", "Calls", None, ""), ("f4", "f4", "Calls", None, "self")]


@pytest.fixture(scope="module")
def g(spark):
    units = spark.createDataFrame(UNITS, "id string, kind string, code string, name string, file_path string, line_start int, line_end int, is_external boolean")
    return CodeGraph(units, spark.createDataFrame(EDGES, "src string, dst string, kind string, level string, metadata string"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_lookups(spark, g):
    assert {r.id for r in g.functions().collect()} == {"f1", "f2", "f4"}
    assert {r.id: r.known for r in g.has_units(ids(spark, "f1", "zz")).collect()} == {"f1": True, "zz": False}
    assert g.sql("select count(*) c from units").first().c == 6
    assert g.by_kind("Class").count() == 0 and g.unit("f1").count() == 1
    assert g.register("Class", lambda s: s.units.limit(1)).by_kind("Class").count() == 1


def test_relations(spark, g):
    assert g.relations("Calls").count() == 6
    assert sorted((r.id, r.neighbour) for r in g.callees(ids(spark, "f1", "f2")).collect()) == [("f1", "f4"), ("f2", "f1"), ("f2", "f1")]
    assert sorted((r.id, r.neighbour) for r in g.callers(ids(spark, "f4")).collect()) == [("f4", "f1"), ("f4", "f4")]
    assert g.related(ids(spark, "f4"), "Calls", "both").where("neighbour = 'f4'").count() == 2
    assert {(r.id, r.inner_id) for r in g.contains(ids(spark, "a")).collect()} == {("a", "f1"), ("a", "f2")}
    assert g.contains(ids(spark, "a"), "class").count() == 0
    assert [(r.id, r.file_id) for r in g.contained_in(ids(spark, "f1")).collect()] == [("f1", "a")]
    assert {r.id: r.callers for r in g.find_callers("elp").collect()} == {"f4": ["f1", "f4"]}


def test_traversals(spark, g):
    got = {(r.seed, r.node): r.depth for r in g.reachable(ids(spark, "f2"), "Calls").collect()}
    assert got == {("f2", "f1"): 1, ("f2", "f3"): 2, ("f2", "f4"): 2}
    assert {r.node for r in g.reachable(ids(spark, "f2"), "Calls", max_depth=1).collect()} == {"f1"}
    assert g.reachable(ids(spark, "f3"), "Calls").count() == 0
    assert g.shortest_path("f2", "f4").first().path == ["f2", "f1", "f4"]
    assert g.shortest_path("f3", "f1").first().path is None and g.shortest_path("f3", "f3").first().path == ["f3"]
    assert g.shortest_path("f2", "f4", max_depth=1).first().path is None
    up = {r.id: (r.depth, r.callees) for r in g.khop_callers(spark.createDataFrame([("helper",)], "name string"), 1).collect()}
    assert up == {"f4": (0, ["helper", "main"]), "f1": (1, ["ext", "helper"])}


def test_reach_in_sql_agrees(spark):
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, i // 2) for i in range(0, 50, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (10,)], "id long")
    edges.createOrReplaceTempView("e")
    seeds.createOrReplaceTempView("s")
    sql = {tuple(r) for r in spark.sql(bounded_reach_sql("e", "s", 5)).collect()}
    assert {tuple(r) for r in reach(edges, seeds, 5).collect()} == sql
    assert shortest_path(edges, 1, 1).first().path == [1]


def test_minimal_covering(spark):
    u = spark.createDataFrame([("big", "f", 1, 20, 50), ("exact_small", "f", 5, 7, 3), ("exact_large", "f", 5, 7, 9), ("x", "g", 1, 2, 1), ("y1", "h", 1, 4, 5), ("y2", "h", 2, 5, 2)], "id string, file_path string, line_start int, line_end int, subtree int")
    places = spark.createDataFrame([(1, "f", 5, 7), (2, "f", 5, 6), (3, "f", 8, 9), (4, "f", 19, 30), (5, "h", 2, 3)], "place_id int, file_path string, line_start int, line_end int")
    assert {r.place_id: r.id for r in CodeGraph(u, u).minimal_covering(places).collect()} == {1: "exact_large", 2: "exact_small", 3: "big", 4: None, 5: "y2"}


def test_facts_and_updates(spark, g):
    with pytest.raises(ValueError, match="unknown"):
        g.add_unit_facts(spark.createDataFrame([("zz", "S", "n", "s", "{}")], "unit_id string, fact_class string, name string, summary string, details string"))
    h = g.add_unit_facts(spark.createDataFrame([("f1", "S", "n", "s", "{}")], "unit_id string, fact_class string, name string, summary string, details string"))
    assert h.facts_of("f1", "S").count() == 1 and h.facts_of("f2").count() == 0
    facts = [("CallFact", "f1", "f2", "add_edge", "Calls", "new", 1), ("CallFact", "f2", "f1", "remove_edge", "Calls", "m1", 2), ("CallFact", "f1", "f2", "remove_edge", "Calls", "new", 3), ("CallFact", "f1", "f2", "add_edge", "Calls", "new", 4)]
    k = h.add_relation_facts(spark.createDataFrame(facts, "fact_class string, src string, dst string, operation string, kind string, metadata string, seq long"))
    assert {(r.src, r.dst, r.metadata) for r in k.relations().collect()} == {(a, b, m) for a, b, _, _, m in EDGES if m != "m1"} | {("f1", "f2", "new")}
    assert k.relation_facts_of("CallFact").count() == 4
    stats = {(r.what, r.kind): r.n for r in k.stats().collect()}
    assert stats[("units", "ALL")] == 6 and stats[("units", "Function")] == 5 and stats[("edges", "Calls")] == 6 and stats[("unit_facts", "S")] == 1
    empty = spark.createDataFrame([], "src long, dst long")
    assert apply_updates(empty, empty.withColumns({"operation": F.lit("add_edge"), "seq": F.lit(1)})).count() == 0
