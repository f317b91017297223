"""Cycles as paths: a closed walk for every component of a graph that has one, edge by edge.

All components are searched at once. A breadth-first search from each component's least node finds the shortest walk back to it
while that is short. What is longer is found by pointer jumping, in rounds by the logarithm of the length: each node follows one edge within
its component, so from every node these lead onto a ring, and the places on the ring are counted by jumps as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.storage import materialize
from loam.operators.graph import cycle_components, typed_edges

#: Edges up to which a walk is the shortest one through its component's least node.
NEAR = 12


def _searched(inner: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """part and path (the nodes of a shortest walk from the least node, without the last) where it has up to ``near`` edges; and the other parts."""
    root = inner.groupBy("part").agg(F.min("a").alias("root"))
    front = materialize(root.select("part", "root", F.col("root").alias("id"), F.array("root").alias("path")), "walk-front")
    seen, found, open_parts = front.select("part", "id"), [], front.select("part")
    for _ in range(near):
        step = front.join(inner.withColumnRenamed("a", "id"), ["part", "id"]).groupBy("part", "root", "b").agg(F.min("path").alias("path"))
        step = materialize(step, "walk-step")
        closed = step.where("b = root").select("part", "path")
        found.append(closed)
        open_parts = materialize(open_parts.join(closed, "part", "left_anti"), "walk-open")
        new = step.withColumnRenamed("b", "id").join(open_parts, "part", "left_semi").join(seen, ["part", "id"], "left_anti")
        front = materialize(new.select("part", "root", "id", F.concat("path", F.array("id")).alias("path")), "walk-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("part", "id"))
    return reduce(DataFrame.unionByName, found), open_parts


def _ringed(inner: DataFrame) -> DataFrame:
    """part, start, pos, from_node, to_node of one ring for each part, which every node's least edge within the part leads to."""
    follow = materialize(inner.groupBy("part", "a").agg(F.min("b").alias("b")), "ring-follow")
    most = follow.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jump = follow
    for _ in range(most.bit_length()):
        jump = materialize(jump.join(jump.select("part", F.col("a").alias("b"), F.col("b").alias("far")), ["part", "b"]).select("part", "a", F.col("far").alias("b")), "ring-jump")
    on_ring = jump.select("part", F.col("b").alias("a")).distinct()
    ring = materialize(follow.join(on_ring, ["part", "a"], "left_semi"), "ring")
    low = ring.withColumn("low", F.least("a", "b"))
    for _ in range(most.bit_length()):
        ahead = low.select("part", F.col("a").alias("b"), F.col("b").alias("far"), F.col("low").alias("more"))
        low = materialize(low.join(ahead, ["part", "b"]).select("part", "a", F.col("far").alias("b"), F.least("low", "more").alias("low")), "ring-low")
    first = low.groupBy("part").agg(F.min("low").alias("start"))
    own = low.join(first, "part").where("low = start").select("part", "a", "start")
    ring = ring.join(own, ["part", "a"])
    # Edges from each node on to the ring's first one; that one stays where it is.
    at = ring.select("part", "a", "start", F.when(F.col("a") == F.col("start"), F.col("a")).otherwise(F.col("b")).alias("to"), (F.col("a") != F.col("start")).cast("long").alias("left"))
    for _ in range(most.bit_length()):
        ahead = at.select("part", F.col("a").alias("to"), F.col("to").alias("far"), F.col("left").alias("more"))
        at = materialize(at.join(ahead, ["part", "to"]).select("part", "a", "start", F.col("far").alias("to"), (F.col("left") + F.col("more")).alias("left")), "ring-places")
    size = at.groupBy("part").agg(F.count("*").alias("n"))
    placed = at.join(size, "part").select("part", "a", "start", F.when(F.col("left") == 0, 0).otherwise(F.col("n") - F.col("left")).cast("long").alias("pos"))
    return placed.join(ring.select("part", "a", "b"), ["part", "a"]).select("part", "start", "pos", F.col("a").alias("from_node"), F.col("b").alias("to_node"))


def cycle_paths(edges: DataFrame, edge_type: str | None = "SUPERSEDES", near: int = NEAR) -> DataFrame:
    """part, start, pos, from_node, to_node: the edges of one simple cycle for each component with cycles, pos from 0 at ``start``.

    ``edges`` has from_node, to_node, edge_type and is_active (null counts as active). A cycle of up to ``near`` edges through the component's
    least node is a shortest one through it; else a longer one is given, and ``start`` is its least node. A loop is a cycle of one edge. Edges
    with a null end and repeated edges count once or not at all; an empty table has no cycles.
    """
    own = materialize(typed_edges(edges, edge_type), "edges")
    parts = materialize(cycle_components(own), "cycle-parts")
    inner = own.join(parts.toDF("a", "part"), "a").join(parts.toDF("b", "other"), "b").where("part = other").select("part", "a", "b")
    inner = materialize(inner, "cycle-edges")
    short, others = _searched(inner, near)
    ways = short.select("part", F.col("path")[0].alias("start"), F.posexplode("path").alias("pos", "from_node"), "path")
    after = F.when(F.col("pos") + 1 < F.size("path"), F.get("path", F.col("pos") + 1)).otherwise(F.col("start"))
    out = ways.select("part", "start", F.col("pos").cast("long").alias("pos"), "from_node", after.alias("to_node"))
    if others.isEmpty():
        return out
    return out.unionByName(_ringed(inner.join(others, "part", "left_semi")))


def cycle_messages(paths: DataFrame, most: int = 1000) -> DataFrame:
    """part, length, message: what is said of each cycle, its nodes joined by arrows; no message where it has over ``most`` edges."""
    sizes = paths.groupBy("part").agg(F.count("*").alias("length"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("from_node").cast("string").alias("node")))), lambda x: x.node), " → ")
    shown = paths.join(sizes.where(F.col("length") <= most), "part").groupBy("part").agg(F.concat(F.lit("SUPERSEDES cycle detected: "), text, F.lit(" → "), F.max(F.col("start").cast("string"))).alias("message"))
    return sizes.join(shown, "part", "left")


def simple(paths: DataFrame) -> DataFrame:
    """part, ok: whether each path is closed, begins at its start, and meets no node twice."""
    following = F.lead("from_node").over(Window.partitionBy("part").orderBy("pos"))
    linked = paths.withColumn("next", F.coalesce(following, "start"))
    return linked.groupBy("part").agg((F.bool_and(F.col("to_node") == F.col("next")) & (F.count_distinct("from_node") == F.count("*")) & (F.min_by("from_node", "pos") == F.first("start"))).alias("ok"))
