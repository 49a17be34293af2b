"""Components, labels and paths against plain searches."""

import random

import pytest

from cartulary.operators import reachability as r
from cartulary.operators import scans
from cartulary.operators.paths import path_elements, witness_paths


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def fast_reached(edges, starts):
    out, adj = {}, {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    for s in starts:
        seen, todo = set(), [s]
        while todo:
            for y in adj.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[s] = seen
    return out


def ids(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"id {kind}")


GRAPHS = {
    "sparse": (40, 45, 1),
    "cyclic": (30, 70, 2),
    "loops": (12, 40, 3),
}


@pytest.mark.parametrize(("name", "small"), [("sparse", 1000), ("cyclic", 0), ("cyclic", 1000), ("loops", 0)])
def test_components_equal_plain(spark, monkeypatch, name, small):
    monkeypatch.setattr(r, "SMALL", small)
    n, m, seed = GRAPHS[name]
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    nodes = {x for e in edges for x in e}
    up = {x: reached(edges, x) | {x} for x in nodes}
    want = {x: min(y for y in nodes if y in up[x] and x in up[y]) for x in nodes}
    got = r.strong_components(spark.createDataFrame(edges, "src string, dst string"))
    assert {t.node: t.component for t in got.collect()} == want


@pytest.mark.parametrize("name", ["sparse", "cyclic"])
def test_pairs_and_asked_equal_plain(spark, monkeypatch, name):
    monkeypatch.setattr(r, "COMPACT", 1)
    n, m, seed = GRAPHS[name]
    rng = random.Random(10 + seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    sources, targets = rng.sample(range(n + 2), n // 2), rng.sample(range(n + 2), n // 3)
    index = r.reach_index(spark.createDataFrame(edges, "src long, dst long"), ids(spark, targets))
    up = fast_reached(edges, range(n + 2))
    want = sorted((s, t) for s in sources for t in targets if t in up[s] and s != t)
    assert sorted((p.source, p.target) for p in index.pairs(ids(spark, sources)).collect()) == want
    asked = [(s, t) for s in range(n) for t in targets] + [(0, n + 50), (n + 50, n + 50)]
    found = {(p.source, p.target): p.reaches for p in index.reaches(spark.createDataFrame(asked, "source long, target long")).collect()}
    assert found == {(s, t): s == t or t in up.get(s, ()) for s, t in asked}


def test_a_large_graph_full_of_cycles(spark):
    """10^5 edges: the pairs are those of a search, and no table is as large as
    all nodes of all targets."""
    rng = random.Random(4)
    n = 60_000
    edges = [(a, rng.randrange(n)) for a in (rng.randrange(n) for _ in range(40_000))] + [(rng.randrange(n // 100), rng.randrange(n // 100)) for _ in range(60_000)]
    sources, targets = rng.sample(range(n), 60), rng.sample(range(n), 300)
    index = r.reach_index(spark.createDataFrame(edges, "src long, dst long"), ids(spark, targets))
    up = fast_reached(edges, sources)
    want = {(s, t) for s in sources for t in targets if t in up[s] and s != t}
    assert {(p.source, p.target) for p in index.pairs(ids(spark, sources)).collect()} == want
    assert index.ranges.count() < 3 * n


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert r.strong_components(none).collect() == []
    assert r.reachable_pairs(none, ids(spark, [1]), ids(spark, [1, 2])).collect() == []
    odd = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 2), (2, None)], "src long, dst long")
    assert [(p.source, p.target) for p in r.reachable_pairs(odd, ids(spark, [1, 2]), ids(spark, [1, 2])).collect()] == [(1, 2)]


def least_path(edges, s, t, limit):
    if s == t:
        return [s]
    layer = {s: [s]}
    seen = {s}
    for _ in range(limit):
        step = {}
        for x, path in layer.items():
            for a, b in edges:
                if a == x and b not in seen:
                    step[b] = min(step.get(b, [*path, b]), [*path, b])
        if t in step:
            return step[t]
        seen |= set(step)
        layer = step
    return None


@pytest.mark.parametrize("limit", [None, 3])
def test_witness_paths_equal_plain(spark, limit):
    rng = random.Random(7)
    edges = [(f"{rng.randrange(40)}", f"{rng.randrange(40)}") for _ in range(90)] + [(f"c{k}", f"c{k + 1}") for k in range(9)]
    pairs = [(f"{rng.randrange(42)}", f"{rng.randrange(42)}") for _ in range(150)] + [("c0", "c9"), ("c9", "c0"), (None, "1"), ("1", None), ("5", "5")]
    found = {(p.source, p.target): p.path for p in witness_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "source string, target string"), limit).collect()}
    want = {(s, t): least_path(edges, s, t, limit or 50) for s, t in pairs if s is not None and t is not None}
    assert found == {k: p for k, p in want.items() if p is not None}


def test_paths_of_no_pairs(spark):
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert witness_paths(edges, spark.createDataFrame([], "source long, target long")).collect() == []
    assert witness_paths(edges, spark.createDataFrame([(2, 1)], "source long, target long")).collect() == []


def test_unbounded_taint_and_its_elements(spark):
    units = [(1, "FieldAccess", "request.args", "args", "a.py", 3), (2, "Identifier", "y", "y", "a.py", None), (3, "Identifier", "z\n", "z", None, 5), (4, "Call", "os.system(z,\n1)", "system", "a.py", None), (5, "FieldAccess", "request.args", "args", "b.py", 1)]
    units = spark.createDataFrame(units, "id long, kind string, code string, name string, file_path string, line_start int")
    catalog = spark.createDataFrame([("sink", 0, "os.system"), ("source", 0, "request.args")], "role string, pos int, pattern string")
    flow = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    for depth in (None, 20):
        flows = scans.taint(units, catalog, flow, depth=depth).collect()
        assert [(f.sink_file, f.sink_line, f.sink_code, f.source_file, f.source_line) for f in flows] == [("a.py", "-1", "os.system(z, 1)", "a.py", "3")]
    assert scans.taint(units, catalog, flow, depth=2).count() == 0
    paths = scans.taint_paths(units, catalog, flow, 4)
    assert [(p.source, p.target, p.path) for p in paths.collect()] == [(1, 4, [1, 2, 3, 4])]
    elements = path_elements(paths, units).orderBy("at").collect()
    assert [(e["at"], e.id, e.line_start) for e in elements] == [(0, 1, 3), (1, 2, None), (2, 3, 5), (3, 4, None)]


def test_long_cycles_are_folded(spark, monkeypatch):
    """Cycles of many nodes with few branches shrink until one task may take them;
    no colour walks around them."""
    monkeypatch.setattr(r, "SMALL", 40)
    monkeypatch.setattr(r, "_colours", lambda *_: pytest.fail("colours"))
    edges = [(x, (x + 1) % 200) for x in range(200)] + [(200 + x, 200 + (x + 1) % 100) for x in range(100)]
    edges += [(x, 0) for x in range(205, 300, 30)] + [(5, 7), (9, 8), (300, 0), (301, 300), (17, 302), (302, 303)]
    got = {t.node: t.component for t in r.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: 0 if x < 200 else 200 if x < 300 else x for x in range(304)}


def test_sources_of_one_component_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(r, "SOURCES", 3)
    edges = [(x, (x + 1) % 20) for x in range(20)] + [(3, 40), (41, 3)]
    index = r.reach_index(spark.createDataFrame(edges, "src long, dst long"), ids(spark, [1, 2, 40]))
    want = sorted((s, t) for s in [*range(20), 41] for t in (1, 2, 40) if s != t)
    assert sorted((p.source, p.target) for p in index.pairs(ids(spark, range(60))).collect()) == want
