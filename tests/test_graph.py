import random

import pytest

from loam.operators import graph

SCHEMA = "from_node long, to_node long, edge_type string, is_active boolean"


def on_cycles(pairs):
    """Nodes that reach themselves, by searching from each."""
    out, after = set(), {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for start in after:
        seen, left = set(), list(after[start])
        while left:
            node = left.pop()
            if node not in seen:
                seen.add(node)
                left += after.get(node, ())
        if start in seen:
            out.add(start)
    return out


def found(spark, pairs, **how):
    edges = spark.createDataFrame([(a, b, "SUPERSEDES", None) for a, b in pairs], SCHEMA)
    return {r.id for r in graph.nodes_on_cycles(edges, **how).collect()}


def test_random_graphs(spark):
    """Sparse graphs with chains, rings, loops, bridges and dense knots."""
    draw = random.Random(8)
    for n, m in ((12, 12), (40, 48)):
        pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(m)}
        pairs |= {(1000 + k, 1001 + k) for k in range(9)} | {(1009, 5), (3, 1000)}  # a chain between two nodes
        pairs |= {(2000 + k, 2000 + (k + 1) % 7) for k in range(7)}  # a ring by itself
        assert found(spark, pairs) == on_cycles(pairs)


def test_long_ring_and_long_chain(spark):
    """Rings and chains of thousands of nodes take rounds in the logarithm of their length."""
    ring = [(k, (k + 1) % 5000) for k in range(5000)]
    chain = [(10_000 + k, 10_001 + k) for k in range(3000)]
    tails = [(20_000 + k, 20_001 + k) for k in range(50)] + [(20_050, 17)]
    assert found(spark, ring + chain + tails, rounds=40) == set(range(5000))


def test_cycles_are_whole_or_an_error(spark):
    """A component that needs more rounds than are allowed is never left out in silence."""
    two_way = [(k, k + 1) for k in range(12)] + [(k + 1, k) for k in range(12)]
    assert found(spark, two_way) == set(range(13))
    with pytest.raises(RuntimeError, match="rounds"):
        found(spark, two_way, rounds=3)


def test_inactive_other_and_null_edges(spark):
    rows = [(1, 2, "SUPERSEDES", None), (2, 1, "SUPERSEDES", False), (3, 4, "CROSS_REF", None), (4, 3, "CROSS_REF", None), (5, None, "SUPERSEDES", None), (None, 5, "SUPERSEDES", None), (6, 6, "SUPERSEDES", True)]
    edges = spark.createDataFrame(rows, SCHEMA)
    assert {r.id for r in graph.nodes_on_cycles(edges).collect()} == {6}
    assert {r.id for r in graph.nodes_on_cycles(edges, edge_type=None).collect()} == {3, 4, 6}
    assert graph.nodes_on_cycles(edges.limit(0)).count() == 0
