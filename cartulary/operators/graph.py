"""The code graph: units, relations and facts as tables.

Units and edges are DataFrames in the schemas of :mod:`cartulary.schemas`;
every call builds a plan, nothing is loaded ahead. Traversals that need
rounds write each frontier to the shared scratch folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard
from .bins import containment_join

#: Lets a join take sides as they are that are dealt by some of its keys.
FEWER_KEYS = ("spark.sql.requireAllClusterKeysForCoPartition", "false")

EDGE_KEY = ["src", "dst", "kind", "level", "metadata"]


@dataclass(frozen=True)
class CodeGraph:
    units: DataFrame
    edges: DataFrame
    unit_facts: DataFrame | None = None
    relation_facts: DataFrame | None = None
    meta: DataFrame | None = None
    builders: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.units.sparkSession

    # -- lookups ----------------------------------------------------------

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the views ``units``, ``edges`` and the facts (S02). Spark
        runs a failed task again, so no call is repeated here."""
        for name in ("units", "edges", "unit_facts", "relation_facts", "meta"):
            if (table := getattr(self, name)) is not None:
                table.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def unit(self, unit_id: str) -> DataFrame:
        return self.units.where(F.col("id") == unit_id)

    def has_units(self, ids: DataFrame) -> DataFrame:
        """``id`` and ``known`` for each wanted id."""
        known = self.units.select(F.col("id").alias("__id")).distinct().withColumn("known", F.lit(True))
        return ids.join(known, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("known", F.lit(False)).alias("known"))

    def by_kind(self, kind: str) -> DataFrame:
        """All units of a kind; registered kinds are built from their source."""
        if kind in self.builders:
            return self.builders[kind](self)
        return self.units.where(F.col("kind") == kind)

    def functions(self) -> DataFrame:
        """Internal functions, without the file-level pseudo function."""
        own = self.by_kind("Function").where("not coalesce(is_external, false) and name <> '<global>'")
        return own.dropDuplicates(["id"])

    def files(self) -> DataFrame:
        return self.by_kind("File")

    def language(self) -> DataFrame | None:
        return self.meta

    def register(self, kind: str, builder) -> CodeGraph:
        """A graph whose units (or edges) of ``kind`` come from a function of
        the graph."""
        return replace(self, builders=self.builders | {kind: builder})

    def minimal_covering(self, places: DataFrame) -> DataFrame:
        """The smallest unit that covers each place.

        ``places``: ``place_id, file_path, line_start, line_end``; units need ``subtree``
        (nodes below). Of equal spans an exact one with the largest subtree
        wins, else the one with the smallest; then the least id. Places that
        nothing covers have a null ``id``.
        """
        u = self.units.select(F.col("id"), "file_path", F.col("line_start").alias("s"), F.col("line_end").alias("e"), "subtree")
        asked = places.select("place_id", "file_path", "line_start", "line_end")
        met = containment_join(u, asked, ["file_path"], ("s", "e"), ("line_start", "line_end"))
        exact = F.expr("s = line_start and e = line_end")
        order = F.struct(F.expr("e - s"), F.when(exact, 0).otherwise(1), F.when(exact, -F.col("subtree")).otherwise(F.col("subtree")), "id")
        found = met.select("place_id", "id", order.alias("order"))
        # Places without a unit come by a row of their own, not by an outer join.
        none = places.select("place_id", F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.lit(None).cast(found.schema["order"].dataType).alias("order"))
        return found.union(none).groupBy("place_id").agg(F.min_by("id", "order").alias("id"))

    # -- relations --------------------------------------------------------

    def relations(self, kind: str | None = None, where: Column | str | None = None) -> DataFrame:
        """Edges once each, parallel equal ones merged."""
        if kind in self.builders:
            return self.builders[kind](self)
        edges = self.edges if kind is None else self.edges.where(F.col("kind") == kind)
        edges = edges if where is None else edges.where(where)
        return edges.dropDuplicates([c for c in EDGE_KEY if c in edges.columns])

    def related(self, ids: DataFrame, kind: str, direction: str = "out", where: Column | str | None = None) -> DataFrame:
        """Neighbours of each ``id``: ``id, neighbour, direction`` and the edge's columns.

        ``both`` is the bag of both directions, so a self-loop comes twice.
        """
        edges = self.relations(kind, where)
        sides = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
        more = [c for c in edges.columns if c not in ("src", "dst")]
        out = None
        for here, there in sides:
            part = edges.select(F.col(here).alias("id"), F.col(there).alias("neighbour"), F.lit("out" if here == "src" else "in").alias("direction"), *more)
            part = part.join(ids.select("id").distinct(), "id", "left_semi")
            out = part if out is None else out.unionByName(part)
        return out

    def callees(self, ids: DataFrame) -> DataFrame:
        return self._internal(self.related(ids, "Calls", "out"))

    def callers(self, ids: DataFrame) -> DataFrame:
        return self._internal(self.related(ids, "Calls", "in"))

    def _internal(self, found: DataFrame) -> DataFrame:
        own = self.units.where("not coalesce(is_external, false)").select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"))
        return found.join(own, "neighbour")

    def contains(self, ids: DataFrame, level: str = "function") -> DataFrame:
        """Functions whose lines lie in a unit's lines, same file (J19); other
        levels hold nothing."""
        outer = self.units.join(ids.select("id"), "id", "left_semi").select("id", F.col("file_path").alias("f"), F.col("line_start").alias("s"), F.col("line_end").alias("e"))
        inner = self.functions().select(F.col("id").alias("inner_id"), "file_path", "line_start", "line_end")
        if level != "function":
            inner = inner.where("false")
        both = containment_join(outer.withColumnRenamed("f", "file_path"), inner, ["file_path"], ("s", "e"), ("line_start", "line_end"))
        return both.where("inner_id <> id").select("id", "inner_id")

    def containments(self, spans: DataFrame | None = None) -> DataFrame:
        """``file_path, id, inner_id``: all units with the functions in their lines.

        A function with several places counts at each. Units that are dealt by
        file already stay where they are if the session's join keys may be dealt
        by fewer (:data:`FEWER_KEYS`); then all units of one file are in one task.
        ``spans`` has the lines of all units before they were dealt.
        """
        place = ["id", "file_path", "line_start", "line_end"]
        outer = self.units.select("file_path", "id", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
        inner = self.by_kind("Function").where("not coalesce(is_external, false) and name <> '<global>'").select(place).dropDuplicates(place)
        if spans is not None:
            spans = spans.select(F.col("line_start").alias("s"), F.col("line_end").alias("e"))
        both = containment_join(outer, inner.withColumnRenamed("id", "inner_id"), ["file_path"], ("s", "e"), ("line_start", "line_end"), spans)
        return both.where("inner_id <> id").select("file_path", "id", "inner_id")

    def contained_in(self, ids: DataFrame) -> DataFrame:
        """The file unit of each unit."""
        files = self.files().select(F.col("id").alias("file_id"), F.col("file_path").alias("f"))
        return self.units.join(ids.select("id"), "id", "left_semi").join(files, F.col("file_path") == F.col("f")).select("id", "file_id")

    def find_callers(self, name: str) -> DataFrame:
        """Functions whose name holds ``name``, with their callers."""
        found = self.functions().where(F.col("name").contains(name)).select("id", "name")
        callers = self.callers(found).groupBy("id").agg(F.array_sort(F.collect_set("neighbour")).alias("callers"))
        return found.join(callers, "id", "left").select("id", "name", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))

    # -- traversals -------------------------------------------------------

    def reachable(self, seeds: DataFrame, kind: str | None = None, where: Column | str | None = None, max_depth: int | None = None, backwards: bool = False) -> DataFrame:
        """``seed, node, depth`` (least) of all nodes that each ``id`` reaches,
        the seed itself left out (J24)."""
        edges = self.relations(kind, where).select("src", "dst")
        return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backwards else edges, seeds, max_depth)

    def shortest_path(self, start: str, end: str, kind: str | None = None, where: Column | str | None = None, max_depth: int | None = None) -> DataFrame:
        """One row ``path``: ids from ``start`` to ``end``, null if there is
        none (J25). Of equal lengths the least in order."""
        edges = self.relations(kind, where).select("src", "dst").distinct()
        return shortest_path(edges, start, end, max_depth)

    def khop_callers(self, names: DataFrame, depth: int = 3) -> DataFrame:
        """Callers up to ``depth`` hops above the functions of each ``name``
        with their body (1500 characters, line ends as spaces) and up to 50
        distinct callee names (J26). Depth 0 is the function itself."""
        start = self.functions().join(names.select("name").distinct(), "name", "left_semi").select("id")
        above = self.reachable(start, "Calls", max_depth=depth, backwards=True).groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
        found = start.select("id", F.lit(0).alias("depth")).unionByName(above).groupBy("id").agg(F.min("depth").alias("depth"))
        callee = self.related(found, "Calls", "out").join(self.units.select(F.col("id").alias("neighbour"), F.col("name").alias("callee")), "neighbour")
        callee = callee.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("callee")), 1, 50).alias("callees"))
        body = F.regexp_replace(F.substring("code", 1, 1500), "[\r\n]", " ").alias("code")
        return found.join(self.units.select("id", "name", F.col("file_path").alias("filename"), F.col("line_start").alias("line"), body), "id").join(callee, "id", "left")

    # -- statistics and facts --------------------------------------------

    def stats(self) -> DataFrame:
        """Counts of units, edges and facts by kind, with totals."""
        parts = [self.units.select(F.lit("units").alias("what"), "kind"), self.relations().select(F.lit("edges"), "kind")]
        for name in ("unit_facts", "relation_facts"):
            if (table := getattr(self, name)) is not None:
                parts.append(table.select(F.lit(name), F.col("fact_class")))
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        return kind_rollup(every)

    def add_unit_facts(self, facts: DataFrame) -> CodeGraph:
        """A graph with more unit facts; an unknown unit is an error."""
        unknown = facts.join(self.units, F.col("unit_id") == F.col("id"), "left_anti")
        if not unknown.isEmpty():
            raise ValueError("facts of unknown units")
        facts = with_fact_id(facts, ["unit_id", "fact_class", "name", "summary", "details"])
        return replace(self, unit_facts=facts if self.unit_facts is None else self.unit_facts.unionByName(facts))

    def add_relation_facts(self, facts: DataFrame) -> CodeGraph:
        """A graph with more relation facts, their updates applied to the
        edges in ``seq`` order (F02, U08). Both ends must exist."""
        ends = facts.select(F.col("src").alias("id")).union(facts.select("dst"))
        if not ends.join(self.units, "id", "left_anti").isEmpty():
            raise ValueError("facts of unknown units")
        facts = with_fact_id(facts, ["fact_class", "src", "dst", "operation", "kind", "metadata", "seq"])
        return replace(self, edges=apply_updates(self.edges, facts), relation_facts=facts if self.relation_facts is None else self.relation_facts.unionByName(facts))

    def facts_of(self, unit_id: str, fact_class: str | None = None) -> DataFrame:
        found = self.unit_facts.where(F.col("unit_id") == unit_id)
        return found if fact_class is None else found.where(F.col("fact_class") == fact_class)

    def relation_facts_of(self, fact_class: str | None = None) -> DataFrame:
        return self.relation_facts if fact_class is None else self.relation_facts.where(F.col("fact_class") == fact_class)

    def cached(self) -> CodeGraph:
        return replace(self, units=self.units.cache(), edges=self.edges.cache())

    def released(self) -> CodeGraph:
        self.units.unpersist()
        self.edges.unpersist()
        return self


def with_fact_id(facts: DataFrame, cols: list[str]) -> DataFrame:
    """A stable id from the facts' content."""
    return facts.withColumn("fact_id", F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256))


def apply_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Edges after ``add_edge`` and ``remove_edge``: for an edge the update of
    the highest ``seq`` decides (U08). Edges are a set under EDGE_KEY."""
    key = [c for c in EDGE_KEY if c in edges.columns]
    updates = updates.select(*[F.col(c) if c in updates.columns else F.lit(None).cast("string").alias(c) for c in key], "operation", "seq")
    last = updates.groupBy(*key).agg(F.max_by("operation", "seq").alias("operation"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"u.{c}")) for c in key]
    kept = edges.dropDuplicates(key).alias("e").join(last.alias("u"), same, "left_anti")
    return kept.unionByName(last.where("operation = 'add_edge'").drop("operation"), allowMissingColumns=True)


def kind_rollup(rows: DataFrame) -> DataFrame:
    """``what, kind, n``: counts by kind, and ``ALL`` for each ``what``."""
    grouped = rows.rollup("what", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.where("g in (0, 1)").select("what", F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce("kind", F.lit("(none)"))).alias("kind"), "n")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first rounds: each joins the last frontier with the edges and
    drops what is known, so cycles end and rows are never made twice."""
    edges = cut(edges.select("src", "dst").distinct(), "reach-edges")
    frontier = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct(), "reach")
    rounds, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        known = rounds[0].select("seed", "node")
        for r in rounds[1:]:
            known = known.union(r.select("seed", "node"))
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            discard(frontier)
            break
        rounds.append(frontier)
        if len(rounds) > 8:  # so that a round reads few tables, however deep it is
            whole = rounds[0]
            for r in rounds[1:]:
                whole = whole.unionByName(r)
            rounds = [cut(whole, "reach")]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.where("depth > 0")


def shortest_path(edges: DataFrame, start, end, max_depth: int | None = None) -> DataFrame:
    """Layers from ``start``, each node with its least path, until ``end``."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    layer = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("path"))
    known, depth = layer.select("node"), 0
    while True:
        hit = layer.where(F.col("node") == F.lit(end)).select("path")
        if not hit.isEmpty():
            return hit
        if max_depth is not None and depth >= max_depth or layer.isEmpty():
            return spark.range(1).select(F.lit(None).cast(f"array<{kind}>").alias("path"))
        depth += 1
        step = layer.join(edges, F.col("node") == F.col("src")).join(known.withColumnRenamed("node", "dst"), "dst", "left_anti")
        step = step.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        layer = cut(step.groupBy("node").agg(F.min("path").alias("path")), "path")
        known = known.union(layer.select("node"))


def bounded_reach_sql(edges: str, seeds: str, depth: int) -> str:
    """A recursive query for shallow reachability: ``seed, node, depth``."""
    return f"""with recursive r(seed, node, depth) as (
      select id, id, 0 from {seeds}
      union all select r.seed, e.dst, r.depth + 1 from r join {edges} e on r.node = e.src where r.depth < {depth})
    select seed, node, min(depth) as depth from r where node <> seed group by seed, node"""


