"""Shortest paths of many pairs at once.

Both ends of all pairs are searched in breadth, the side with the smaller
frontier first, until the two meet. What is kept is which nodes were first seen
at which depth; paths are rebuilt from that: backwards from where the sides met,
marking the nodes that lie on a shortest path, then forwards along the least of
them. No path is carried along while searching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, cut_counted, discard
from .reachability import _union


def witness_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``source, target, path`` for each distinct pair (``source``, ``target``) with a path
    of at most ``max_depth`` edges: the nodes of the shortest, of equally short ones
    the least in the order of its nodes. A node's path to itself is itself. Pairs
    with a null or without a path are left out.
    """
    asked = cut(pairs.select("source", "target").where("source is not null and target is not null").distinct(), "asked")
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct(), "path-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left = asked.where("source <> target")
    sides = {"source": edges, "target": back}
    first = {s: cut_counted(left.select(F.col(s).alias("end"), F.col(s).alias("node")).distinct(), "front") for s in sides}
    seen = {s: [table] for s, (table, _) in first.items()}
    sizes = {s: n["n"] for s, (_, n) in first.items()}
    met = []
    while all(sizes.values()):
        depth = {s: len(seen[s]) - 1 for s in sides}
        if max_depth is not None and sum(depth.values()) >= max_depth:
            break
        side = min(sides, key=sizes.get)
        # Ends of pairs that are all met need no further search.
        front = seen[side][-1].join(left.select(F.col(side).alias("end")).distinct(), "end", "left_semi")
        known = _union(seen[side])
        step = front.join(sides[side], F.col("node") == F.col("src")).select("end", F.col("dst").alias("node")).distinct()
        fresh, n = cut_counted(step.join(known, ["end", "node"], "left_anti"), "front")
        seen[side].append(fresh)
        sizes[side] = n["n"]
        one, two = seen["source"][-1], seen["target"][-1]
        both = one.select(F.col("end").alias("source"), "node").join(two.select(F.col("end").alias("target"), "node"), "node").join(left, ["source", "target"], "left_semi")
        meets, n = cut_counted(both.select("source", "target", "node", F.lit(len(seen["source"]) - 1).alias("ahead"), F.lit(len(seen["target"]) - 1).alias("behind")), "meets")
        if n["n"]:
            met.append(meets)
            left = cut(left.join(meets.select("source", "target").distinct(), ["source", "target"], "left_anti"), "left")
    same = asked.where("source = target").select("source", "target", F.array("source").alias("path"))
    if not met:
        return same
    rows = _walked(edges, seen, _union(met))
    paths = rows.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x.node).alias("path"))
    return same.unionByName(paths)


def _walked(edges: DataFrame, seen: dict[str, list[DataFrame]], meets: DataFrame) -> DataFrame:
    """``source, target, at, node``: the nodes of each pair's path by place."""
    key = ["source", "target"]
    behind = _union(t.select(F.col("end").alias("target"), "node", F.lit(d).alias("behind")) for d, t in enumerate(seen["target"]))
    # Nodes on a shortest path, from where the sides met back to the source.
    marks = [meets.select(*key, "node", F.col("ahead").alias("at")).distinct()]
    current = cut(marks[0], "marks")
    for depth in range(len(seen["source"]) - 1, 0, -1):
        at = current.where(F.col("at") == depth)
        up = at.join(edges, F.col("node") == F.col("dst")).select(*key, F.col("src").alias("node")).distinct()
        layer = seen["source"][depth - 1].select(F.col("end").alias("source"), "node")
        old, current = current, cut(current.union(up.join(layer, ["source", "node"], "left_semi").select(*key, "node", F.lit(depth - 1).alias("at"))), "marks")
        discard(old)
    marked = current
    lengths = meets.select(*key, "ahead", (F.col("ahead") + F.col("behind")).alias("length")).distinct()
    here = cut(lengths.select(*key, "ahead", "length", F.lit(0).alias("at"), F.col("source").alias("node")), "walk")
    steps = [here]
    while True:
        more = here.where("at < length").join(edges, F.col("node") == F.col("src")).select(*key, "ahead", "length", (F.col("at") + 1).alias("at"), F.col("dst").alias("node"))
        first = more.where("at <= ahead").join(marked, [*key, "at", "node"], "left_semi")
        second = more.where("at > ahead").withColumn("behind", F.col("length") - F.col("at")).join(behind, ["target", "node", "behind"], "left_semi").drop("behind")
        here, n = cut_counted(first.unionByName(second).groupBy(*key, "ahead", "length", "at").agg(F.min("node").alias("node")), "walk")
        if not n["n"]:
            return _union(steps).select(*key, "at", "node")
        steps.append(here)


def path_elements(paths: DataFrame, units: DataFrame) -> DataFrame:
    """The units of each path in their order: ``source, target, at`` (from 0) and
    the columns of ``units``; an id without a unit keeps nulls."""
    rows = paths.select("source", "target", F.posexplode("path").alias("at", "__node"))
    return rows.join(units, F.col("__node") == F.col("id"), "left").drop("__node")
