import random

from loam.operators import paths

SCHEMA = "from_node long, to_node long, edge_type string, is_active boolean"


def reach(after, start):
    """Every node that can be reached from ``start`` by an edge or more, with the fewest edges."""
    depth, layer, d = {}, {start}, 0
    while layer:
        d += 1
        layer = {b for a in layer for b in after.get(a, ()) if b not in depth}
        depth |= dict.fromkeys(layer, d)
    return depth


def components(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    far = {n: reach(after, n) for n in after}
    own = {n: frozenset(m for m in far[n] if n in far.get(m, ())) for n in after if n in far[n]}
    return set(own.values()), far


def check(spark, pairs, **how):
    rows = paths.cycle_paths(spark.createDataFrame([(a, b, "SUPERSEDES", None) for a, b in pairs], SCHEMA), **how)
    assert all(r.ok for r in paths.simple(rows).collect())
    found = {}
    for r in rows.collect():
        assert (r.from_node, r.to_node) in pairs
        found.setdefault(r.part, []).append(r)
    wanted, far = components(pairs)
    assert len(found) == len(wanted)
    near = how.get("near", paths.NEAR)
    for walk in found.values():
        part = next(c for c in wanted if walk[0].start in c)
        assert {r.from_node for r in walk} <= part and sorted(r.pos for r in walk) == list(range(len(walk)))
        if far[min(part)][min(part)] <= near:
            assert walk[0].start == min(part) and len(walk) == far[min(part)][min(part)]
        else:
            assert walk[0].start == min(r.from_node for r in walk)
    return found


def test_random_graphs(spark):
    draw = random.Random(9)
    pairs = {(draw.randrange(40), draw.randrange(40)) for _ in range(52)} | {(100 + k, 100 + (k + 1) % 7) for k in range(7)} | {(200, 200), (201, 202), (202, 201), (202, 202)}
    assert len(check(spark, pairs)) >= 3
    check(spark, pairs, near=1)


def test_long_ring(spark):
    """A ring of thousands of nodes, and one that a tail leads into, are whole and in order."""
    draw = random.Random(2)
    nodes = draw.sample(range(10**6), 1500)
    pairs = set(zip(nodes, nodes[1:] + nodes[:1], strict=True)) | {(2_000_000 + k, 2_000_001 + k) for k in range(20)} | {(2_000_020, nodes[5])}
    found = check(spark, pairs, near=2)
    assert [len(x) for x in found.values()] == [1500]


def test_messages_and_odd_rows(spark):
    rows = [(1, 2, "SUPERSEDES", None), (2, 1, "SUPERSEDES", True), (2, 1, "SUPERSEDES", True), (3, 4, "SUPERSEDES", False), (4, 3, "SUPERSEDES", None), (5, None, "SUPERSEDES", None), (6, 7, "OTHER", None), (7, 6, "OTHER", None)]
    edges = spark.createDataFrame(rows, SCHEMA)
    said = paths.cycle_messages(paths.cycle_paths(edges)).collect()
    assert [(r.length, r.message) for r in said] == [(2, "SUPERSEDES cycle detected: 1 → 2 → 1")]
    assert paths.cycle_messages(paths.cycle_paths(edges), most=1).collect()[0].message is None
    assert paths.cycle_paths(edges.limit(0)).collect() == []
