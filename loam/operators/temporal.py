"""Lookups at a row's own time: each fact meets the version of its key that was valid then.

A merge of facts and versions by key and time would put a frequent key into one task. Keys with many rows are therefore cut
into ranges of time, at quantiles of their own rows, and each range starts with the last version of the ranges before it, its
carried edge. A range is merged by itself, whatever the key. Which range a time lies in is found by halving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.storage import materialize

#: Rows of a key, facts and versions together, up to which it stays in one range; more are cut into ranges of about as many.
RANGE_ROWS = 500_000
#: Ranges of a key, at most, and the steps in which a time's range is found among them.
MOST_RANGES, HALVES = 1000, [1 << k for k in reversed(range(10))]


def _many(rows: DataFrame, range_rows: int) -> DataFrame:
    """key, n: the keys with over ``range_rows`` rows, as a table of one row for each ``range_rows`` rows at most."""
    return materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > range_rows), "many")


def _before(edges: str, fits) -> Column:
    """How many of the sorted ``edges`` fit, by halving; those that fit come first."""
    step = lambda found, half: F.when(fits(F.get(edges, found + half - 1)), found + half).otherwise(found)
    return F.aggregate(F.array(*map(F.lit, HALVES)), F.lit(0), step)


def _edges(rows: DataFrame, range_rows: int) -> DataFrame:
    """key, edges: the times at which the ranges of a key with many rows begin, sorted; a time that is a range by itself stands there twice or more."""
    many = _many(rows, range_rows).select("key", F.least(F.ceil(F.col("n") / range_rows), F.lit(MOST_RANGES)).cast("int").alias("ranges"))
    # Quantiles by a mergeable sketch, over a grid that is then thinned to the key's number of ranges.
    grid = F.percentile_approx(F.unix_micros("time"), [k / 1000 for k in range(1, 1000)], 10_000)
    found = rows.join(F.broadcast(many), "key").groupBy("key", "ranges").agg(grid.alias("grid"))
    picked = F.transform(F.sequence(F.lit(1), F.col("ranges") - 1), lambda i: F.element_at("grid", F.greatest(F.lit(1), (i * 1000 / F.col("ranges")).cast("int"))))
    return found.where("ranges > 1").select("key", picked.alias("edges"))


def as_of(facts: DataFrame, versions: DataFrame, key: tuple[str, str], time: tuple[str, str], columns: list[str], ties: list[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """``facts`` with ``columns`` of the latest version of their key whose time is not after theirs; nulls where there is none.

    ``key`` and ``time`` name the columns of facts and of versions, times as timestamps. Of versions of one time the greatest by ``ties`` counts. Every fact
    comes back once, also repeated ones and those with a null key or time, which meet no version; versions with a null
    key or time meet no fact. Columns of facts that have the names of ``columns`` are replaced.
    """
    kept = [c for c in facts.columns if c not in columns]
    fact = F.struct(*kept)
    valid = F.col(key[0]).isNotNull() & F.col(time[0]).isNotNull()
    kind = dict(versions.dtypes)[key[1]]
    left = facts.where(valid).select(F.col(key[0]).cast(kind).alias("key"), F.col(time[0]).cast("timestamp").alias("time"), fact.alias("fact"))
    version = F.struct(F.struct(F.lit(0).alias("_"), *ties).alias("ties"), F.struct(*columns).alias("row"))
    right = versions.where(F.col(key[1]).isNotNull() & F.col(time[1]).isNotNull()).select(F.col(key[1]).alias("key"), F.col(time[1]).cast("timestamp").alias("time"), version.alias("version"))

    edges = materialize(_edges(left.select("key", "time").unionByName(right.select("key", "time")), range_rows), "edges")
    if edges.isEmpty():
        facts_in, met = left.withColumn("range", F.lit(0)), right.withColumn("range", F.lit(0))
    else:
        facts_in, met = _ranged(left, right, edges)

    nothing = F.lit(None)
    both = facts_in.select("key", "range", "time", F.lit(1).alias("kind"), "fact", nothing.cast(right.schema["version"].dataType).alias("version"))
    both = both.unionByName(met.select("key", "range", "time", F.lit(0).alias("kind"), nothing.cast(left.schema["fact"].dataType).alias("fact"), "version"))
    order = Window.partitionBy("key", "range").orderBy("time", "kind", "version.ties").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("version", F.last("version", ignorenulls=True).over(order)).where("kind = 1")
    out = found.select("fact.*", "version.row.*")
    types = dict(versions.dtypes)
    rest = facts.where(~F.coalesce(valid, F.lit(False))).select(*kept, *[F.lit(None).cast(types[c]).alias(c) for c in columns])
    return out.unionByName(rest)


def _ranged(left: DataFrame, right: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts, and versions with the carried ones, each with its range.

    The edges are as many as all rows have ranges, so they are broadcast. Versions come down to one for each time first.
    """
    none = F.array().cast("array<bigint>")
    at = F.unix_micros("time")
    below, upto = _before("edges", lambda e: e < at), _before("edges", lambda e: e <= at)

    def edged(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(edges), "key", "left").withColumn("edges", F.coalesce("edges", none))

    # Versions of a time that fills ranges go to the first of them; its facts are spread over all.
    places = edged(left).select("key", "time", "fact", below.alias("below"), upto.alias("upto"))
    facts_in = places.withColumn("range", F.col("below") + F.pmod(F.xxhash64("fact"), F.col("upto") - F.col("below") + 1).cast("int"))
    single = right.groupBy("key", "time").agg(F.max_by("version", "version.ties").alias("version"))
    versions_in = materialize(edged(single).select("key", "time", "version", below.alias("range"), F.size("edges").alias("last_range")), "versions")
    last = versions_in.where("last_range > 0").groupBy("key", "range").agg(F.max("last_range").alias("last_range"), F.max("time").alias("time"), F.max_by("version", "time").alias("version"))
    # A row for each range of a key behind one that has versions, with the last of them.
    after = F.lead("range", 1).over(Window.partitionBy("key").orderBy("range"))
    until = last.withColumn("until", F.coalesce(after, F.col("last_range")))
    carried = until.where("until > range").select("key", F.explode(F.sequence(F.col("range") + 1, F.col("until"))).alias("range"), "time", "version")
    return facts_in, versions_in.select("key", "range", "time", "version").unionByName(carried)
