import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import temporal

START = dt.datetime(2024, 1, 1)


def expected(facts, versions):
    """Every fact with the last version of its key up to its time, by looking at all of them."""
    out = []
    for i, k, t in facts:
        fit = [(s, n, v) for key, s, n, v in versions if key == k and k is not None and s is not None and t is not None and s <= t]
        out.append((i, k, t, max(fit)[2] if fit else None))
    return out


def rows_of(spark, facts, versions, **how):
    f = spark.createDataFrame(facts, "id int, k string, t timestamp").withColumn("v", F.lit("old"))
    v = spark.createDataFrame(versions, "key string, since timestamp, n int, v string")
    return temporal.as_of(f, v, ("k", "key"), ("t", "since"), ["v"], ["n"], **how)


@pytest.mark.parametrize("range_rows", [1_000_000, 400, 37, 3])
def test_ranges_change_nothing(spark, range_rows):
    """A key with most rows, times that many rows share, ties of versions, and keys without versions."""
    draw = random.Random(4)

    def some(n):
        hot = ["hot"] * 6 + ["a", "b", "c", None]
        at = [START + dt.timedelta(seconds=s) for s in (0, 50, 50, 50)] + [None]
        return [(draw.choice(hot), draw.choice(at) if draw.random() < 0.5 else START + dt.timedelta(seconds=draw.randrange(100))) for _ in range(n)]

    facts = [(i, k, t) for i, (k, t) in enumerate(some(900))] + [(0, "none", START), (0, "none", START)]
    versions = [(k, t, n % 7, f"v{n // 7 % 40}-{n % 7}") for n, (k, t) in enumerate(some(120))]
    versions = list({(k, t, n): (k, t, n, v) for k, t, n, v in versions}.values())
    got = rows_of(spark, facts, versions, range_rows=range_rows).collect()
    assert sorted(map(str, ((r.id, r.k, r.t, r.v) for r in got))) == sorted(map(str, expected(facts, versions)))


def test_few_versions_reach_far(spark):
    """A version long before, with many ranges without any in between, is still the one that counts."""
    facts = [(i, "k", START + dt.timedelta(hours=i)) for i in range(300)]
    versions = [("k", START - dt.timedelta(days=9), 1, "first"), ("k", START + dt.timedelta(hours=200), 1, "second")]
    got = {r.id: r.v for r in rows_of(spark, facts, versions, range_rows=10).collect()}
    assert got == {i: "first" if i < 200 else "second" for i in range(300)}


def test_nothing_to_meet(spark):
    assert rows_of(spark, [], []).collect() == [] and rows_of(spark, [], [("k", START, 1, "x")]).collect() == []
    assert [r.v for r in rows_of(spark, [(1, "k", START)], []).collect()] == [None]


def test_work_is_dealt_out(spark):
    """No range of a key that has all rows holds more than its share."""
    facts = spark.range(20_000).select(F.col("id").cast("int"), F.lit("k").alias("key"), F.timestamp_seconds("id").alias("time"))
    edges = temporal._edges(facts.select("key", "time"), 1000).collect()[0].edges
    assert len(edges) == 19 and max(b - a for a, b in zip(edges, edges[1:], strict=False)) < 2_500 * 1_000_000


def test_ranges_are_found_by_halving(spark):
    """As bisection finds them, up to the greatest number of edges, also where edges repeat."""
    for edges in ([], [5], [1, 3, 3, 3, 9], sorted(n * 7 % 2000 for n in range(999))):
        rows = spark.range(-1, 2001).withColumn("edges", F.array(*map(F.lit, edges)).cast("array<bigint>"))
        found = rows.select("id", temporal._before("edges", lambda e: e < F.col("id")).alias("below"), temporal._before("edges", lambda e: e <= F.col("id")).alias("upto"))
        assert [(r.below, r.upto) for r in found.orderBy("id").collect()] == [(bisect.bisect_left(edges, i), bisect.bisect_right(edges, i)) for i in range(-1, 2001)]


def test_no_ranges_without_large_keys(spark):
    """Where no key is large the plan has neither quantiles nor a join."""
    plan = rows_of(spark, [(1, "k", START)], [("k", START, 1, "x")])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "Join" not in plan
