"""Integrity and views of a temporal property graph held in two tables.

``nodes``: id, type, is_active (null counts as active); ``edges``: id, from_node, to_node, edge_type,
is_active. A violation is a row (kind, entity_id, side, detail). Large graphs shuffle on ids alone; nothing
is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.storage import materialize

# The largest subgraph that is shown.
SUBGRAPH_LIMIT = 100


def active(c: Column | None = None) -> Column:
    """True unless the flag is false: null counts as active."""
    return F.coalesce(F.col("is_active") if c is None else c, F.lit(True))


def _violations(df: DataFrame, kind: str, entity: str | Column, side: Column | None = None, detail: Column | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.select(F.lit(kind).alias("kind"), entity.cast("string").alias("entity_id"), (nothing if side is None else side).alias("side"), (nothing if detail is None else detail.cast("string")).alias("detail"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame, exempt: tuple[str, ...] = ("TERM",)) -> DataFrame:
    """Active nodes, but for exempt types, at which no active edge ends, whatever is at its other end."""
    ends = edges.where(active()).select(F.explode(F.array("from_node", "to_node")).alias("id"))
    return nodes.where(active() & ~F.coalesce(F.col("type").isin(*exempt), F.lit(False))).join(ends, "id", "left_anti")


def broken_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, side, missing_node: each end of an active edge without a node, active or not."""
    ends = edges.where(active()).select(F.col("id").alias("edge_id"), F.explode(F.create_map(F.lit("from"), "from_node", F.lit("to"), "to_node")).alias("side", "missing_node"))
    return ends.join(nodes.select(F.col("id").alias("missing_node")), "missing_node", "left_anti").select("edge_id", "side", "missing_node")


def repeated_ids(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The second and further rows of every key, by ``order``, with ``occurrence``; empty and null keys are left out."""
    key, order = ([x] if isinstance(x, str) else x for x in (key, order))
    filled = reduce(Column.__and__, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in key])
    # Keys with a single row, most as a rule, are told apart by a count that is summed before the shuffle.
    many = rows.where(filled).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key)
    ranked = rows.join(many, key, "left_semi").withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("occurrence > 1")


def invalid_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.where(F.col(key).isNull() | (F.col(key).cast("string") == ""))


def _peeled(edges: DataFrame) -> DataFrame:
    """``edges`` without those from a node without entry, or to one without exit, dropped twice over."""
    for _ in range(2):
        edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        edges = edges.join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
    return materialize(edges.select("a", "b"), "peel")


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges`` with every chain of nodes that have one edge in and one out put into one edge; the chains' nodes as (id, a, b) with
    the ends of that edge; and, as (id, part), the nodes of rings that consist of such nodes alone, with the ring's least one.

    Ends are found by pointer jumping in both directions, so the rounds grow with the logarithm of the chains' length.
    """
    out = edges.groupBy("a").agg(F.min("b").alias("next"), F.count("*").alias("n")).where("n = 1").select(F.col("a").alias("id"), "next")
    come = edges.groupBy("b").agg(F.min("a").alias("last"), F.count("*").alias("n")).where("n = 1").select(F.col("b").alias("id"), "last")
    inner = materialize(out.join(come, "id"), "inner")
    number = inner.count()
    if not number:
        return edges, inner.selectExpr("id", "last AS a", "next AS b"), inner.selectExpr("id", "id AS part")
    ids = inner.select("id")
    # on, back: whether the pointer still stands at an inner node.
    at = inner.join(ids.toDF("next").withColumn("on", F.lit(True)), "next", "left").join(ids.toDF("last").withColumn("back", F.lit(True)), "last", "left")
    at = materialize(at.select("id", "next", "last", F.col("id").alias("low"), F.coalesce("on", F.lit(False)).alias("on"), F.coalesce("back", F.lit(False)).alias("back")), "jump")
    for _ in range(number.bit_length() + 1):
        if not at.where("on OR back").limit(1).count():
            break
        ahead, behind = at.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("on").alias("on2"), F.col("low").alias("low2")), at.select(F.col("id").alias("last"), F.col("last").alias("last2"), F.col("back").alias("back2"))
        both = at.join(ahead, "next", "left").join(behind, "last", "left")
        step = lambda flag, own, far: F.when(F.col(flag), F.col(far)).otherwise(F.col(own))
        at = materialize(both.select("id", F.least("low", "low2").alias("low"), step("on", "next", "next2").alias("next"), step("back", "last", "last2").alias("last"), step("on", "on", "on2").alias("on"), step("back", "back", "back2").alias("back")), "jump")
    rings = at.where("on").select("id", F.col("low").alias("part"))
    chains = at.where("NOT on").select("id", F.col("last").alias("a"), F.col("next").alias("b"))
    rest = edges.join(ids.toDF("a"), "a", "left_anti").join(ids.toDF("b"), "b", "left_anti").select("a", "b")
    return materialize(rest.union(chains.select("a", "b")).distinct(), "contracted"), chains, rings


def _components(rest: DataFrame, rounds: int) -> DataFrame:
    """id, part: nodes in strongly connected components of two or more nodes, by colouring.

    The greatest id that reaches a node is its colour, and what reaches that node within its colour is its component.
    Found components are removed and the rest is coloured anew. Every loop that runs out of ``rounds`` raises.
    """
    found = []
    for _ in range(rounds):
        if not rest.limit(1).count():
            break
        colour = rest.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("colour", F.col("id"))
        for _ in range(rounds):
            come = rest.join(colour, rest["a"] == colour["id"]).groupBy("b").agg(F.max("colour").alias("come"))
            new = colour.join(come, colour["id"] == come["b"], "left").select("id", F.greatest("colour", "come").alias("colour"), (F.col("come") > F.col("colour")).alias("moved"))
            new = materialize(new, "colour")
            colour = new.select("id", "colour")
            if not new.where("moved").limit(1).count():
                break
        else:
            raise RuntimeError(f"colours still move after {rounds} rounds")
        inside = rest.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour"))
        inside = materialize(inside, "inside")
        part, size = colour.where("id = colour").select("id"), 0
        for _ in range(rounds):
            back = inside.join(part, inside["b"] == part["id"]).select(F.col("a").alias("id"))
            part = materialize(part.union(back).distinct(), "part")
            if (n := part.count()) == size:
                break
            size = n
        else:
            raise RuntimeError(f"components still grow after {rounds} rounds")
        in_part = inside.join(part.toDF("a"), "a", "left_semi").join(part.toDF("b"), "b", "left_semi")
        found.append(materialize(in_part.select(F.col("a").alias("id"), F.col("colour").alias("part")).distinct(), "found"))
        rest = materialize(_peeled(rest.join(part.toDF("a"), "a", "left_anti").join(part.toDF("b"), "b", "left_anti")), "rest")
    else:
        raise RuntimeError(f"components are left after {rounds} rounds")
    return reduce(DataFrame.union, found) if found else rest.selectExpr("a AS id", "a AS part")


def typed_edges(edges: DataFrame, edge_type: str | None) -> DataFrame:
    """a, b: the distinct active edges of ``edge_type`` (None: of any) that have both ends."""
    own = edges.where(active())
    if edge_type is not None:
        own = own.where(F.col("edge_type") == edge_type)
    rest = own.where(F.col("from_node").isNotNull() & F.col("to_node").isNotNull())
    return rest.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct()


def nodes_on_cycles(edges: DataFrame, edge_type: str | None = "SUPERSEDES", rounds: int = 1000) -> DataFrame:
    """id: every node on a directed cycle of active edges of ``edge_type``; a loop is a cycle."""
    return cycle_components(materialize(typed_edges(edges, edge_type), "edges"), rounds).select("id")


def cycle_components(rest: DataFrame, rounds: int = 1000) -> DataFrame:
    """id, part: the nodes on directed cycles of the distinct edges ``rest`` (a, b), with a name for their component, one of its nodes.

    Chains, the usual shape, are put into single edges by pointer jumping, and edges that no cycle can use are peeled, in turn
    until neither changes anything. What is left is searched for strongly connected components; then the
    chains' nodes are unfolded, the last contraction first: such a node is on a cycle if both ends of its edge are in one component.
    """
    loops, folded = [rest.where("a = b").select(F.col("a").alias("id"))], []
    rest = rest.where("a != b")
    size = rest.count()
    for _ in range(rounds):
        rest, chains, rings = _contracted(_peeled(rest))
        folded.append((chains, rings))
        loops.append(rest.where("a = b").select(F.col("a").alias("id")))
        rest = rest.where("a != b")
        if (now := rest.count()) == size or not now:
            break
        size = now
    else:
        raise RuntimeError(f"the graph still peels after {rounds} rounds")
    looped = reduce(DataFrame.union, loops).distinct().withColumn("own", F.lit(True))
    parts = _components(rest, rounds)
    # A node with a loop of its own is a component even where it is in no other.
    parts = materialize(parts.join(looped, "id", "full").select("id", F.coalesce("part", "id").alias("part")), "parts")
    for chains, rings in reversed(folded):
        ends = chains.join(parts.toDF("a", "pa"), "a").join(parts.toDF("b", "pb"), "b").where("pa = pb").select("id", F.col("pa").alias("part"))
        more = ends.union(rings)
        parts = parts.join(more.select("id", F.col("part").alias("more")), "id", "full").select("id", F.coalesce("more", "part").alias("part"))
        parts = materialize(parts, "parts")
    return parts


def integrity(nodes: DataFrame, edges: DataFrame, order: str = "_pos") -> DataFrame:
    """All violations: input ids, orphans, broken edges, cycles. ``order`` is the input order within each table."""
    parts = []
    for rows in (nodes, edges):
        parts.append(_violations(invalid_ids(rows), "INVALID_ID", F.coalesce(F.col("id").cast("string"), F.lit(""))))
        parts.append(_violations(repeated_ids(rows, "id", order), "DUPLICATE_ID", "id", detail=F.col("occurrence")))
    parts.append(_violations(orphan_nodes(nodes, edges), "ORPHAN_NODE", "id"))
    parts.append(_violations(broken_edges(nodes, edges), "BROKEN_EDGE", "edge_id", F.col("side"), F.col("missing_node")))
    parts.append(_violations(nodes_on_cycles(edges), "SUPERSEDE_CYCLE", "id"))
    return reduce(DataFrame.unionByName, parts)


KINDS = ("INVALID_ID", "DUPLICATE_ID", "ORPHAN_NODE", "BROKEN_EDGE", "SUPERSEDE_CYCLE")


def integrity_stats(nodes: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: totals, active counts, violations by kind, and whether there are none."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KINDS]
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_if(active()).alias("active_nodes"))
    e = edges.agg(F.count("*").alias("total_edges"), F.count_if(active()).alias("active_edges"))
    v = violations.agg(*counts, (F.count("*") == 0).alias("valid"))
    key = F.lit(1).alias("_one")  # one row each
    return n.select("*", key).join(e.select("*", key), "_one").join(v.select("*", key), "_one").drop("_one")


def subgraph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, equal: dict[str, str] | None = None, limit: int = SUBGRAPH_LIMIT, order: str = "_pos") -> tuple[DataFrame, DataFrame]:
    """The nodes that pass the filters, the ``limit`` of greatest truth weight if there are more, and the edges between them.

    A filter that is None or empty lets all pass; ties go by ``order``. Edges must be marked active.
    """
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    for name, value in (equal or {}).items():
        if value is not None:
            nodes = nodes.where(F.col(name) == value)
    kept = nodes.orderBy(F.desc("truth_weight"), F.asc(order)).limit(limit)
    ids = F.broadcast(kept.select("id").distinct())  # at most ``limit`` rows
    inside = edges.where(F.col("is_active")).join(ids.toDF("from_node"), "from_node", "left_semi").join(ids.toDF("to_node"), "to_node", "left_semi")
    return kept, inside


def endpoints(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with ``columns`` of the nodes at both ends, as from_<column> and to_<column>; edges that miss one are dropped."""
    a = nodes.select(F.col("id").alias("from_node"), *[F.col(c).alias(f"from_{c}") for c in columns])
    b = nodes.select(F.col("id").alias("to_node"), *[F.col(c).alias(f"to_{c}") for c in columns])
    return edges.join(a, "from_node").join(b, "to_node")


def current_versions(rows: DataFrame, key: str | list[str], version: str | list[str], as_of: Column | None = None) -> DataFrame:
    """The latest row of each key, by ``version``; with ``as_of``, of those up to it (on the first version column)."""
    key, version = ([x] if isinstance(x, str) else x for x in (key, version))
    if as_of is not None:
        rows = rows.where(F.col(version[0]) <= as_of)
    others = [c for c in rows.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("row"))
    return latest.select(*key, "row.*").select(*rows.columns)


# --- gate -----------------------------------------------------------------------------------------

# Thresholds of the gate, and the formulas that must be there after each batch.
LEAST_NODES, LEAST_EDGES = 40, 80
FORMULAS_AFTER = {"BATCH-1": 7, "BATCH-2": 30, "BATCH-3": 38, "BATCH-4": 53, "BATCH-5": 68}


def gate(stats: DataFrame, n_formulas: int, accuracy: DataFrame, batch: str = "BATCH-1") -> DataFrame:
    """check, actual, required, passed: scale, formula registry, formula accuracy and integrity.

    ``stats`` is ``integrity_stats``; ``accuracy`` has one row for each golden case, with passed.
    """
    need = FORMULAS_AFTER.get(batch, FORMULAS_AFTER["BATCH-1"])
    one = stats.select("*", F.lit(1).alias("_one")).join(accuracy.agg(F.count("*").alias("cases"), F.count_if("passed").alias("right"), F.lit(1).alias("_one")), "_one")  # one row each
    checks = [
        ("active_nodes", F.col("active_nodes"), F.lit(LEAST_NODES), F.col("active_nodes") >= LEAST_NODES),
        ("active_edges", F.col("active_edges"), F.lit(LEAST_EDGES), F.col("active_edges") >= LEAST_EDGES),
        ("formula_registry", F.lit(n_formulas), F.lit(need), F.lit(n_formulas >= need)),
        ("formula_accuracy", F.col("right"), F.col("cases"), F.col("right") == F.col("cases")),
        *[(f"no_{k}", F.col(f"n_{k}"), F.lit(0), F.col(f"n_{k}") == 0) for k in ("orphan_node", "broken_edge", "supersede_cycle")],
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), a.cast("long").alias("actual"), r.cast("long").alias("required"), p.alias("passed")) for n, a, r, p in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def gate_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("checks"))
