"""Queries over time, outside ``loam.llm``: lookups at a row's own time, state of streams, synchronised tables, and cycle paths; and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loam.catalogue import _STATUS_SQL, _statuses, query, table
from loam.functions.storage import materialize, shared_dir
from loam.operators import paths, temporal, vectors
from loam.streaming import events as streams
from loam.streaming import state, sync

_VERSIONS = """v AS (SELECT p_partkey, CAST(k AS INTEGER) AS version, TIMESTAMP '1993-01-01' + to_days(CAST(k * (200 + p_size * 5) AS INTEGER)) AS since, p_retailprice + k AS price FROM part, range(1, 10) AS t(k))"""


@query(f"""WITH {_VERSIONS} SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, version, price FROM lineitem ASOF LEFT JOIN v ON p_partkey = l_partkey AND since <= l_shipdate""")
def asof_part_version(spark, sf):
    """Every line with the version of its part that was valid when it was shipped; nine versions a part."""
    k = F.col("version")
    versions = table(spark, sf, "part").withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(9))))
    since = F.lit("1993-01-01").cast("timestamp") + F.make_dt_interval(k * (F.col("p_size") * 5 + 200))
    versions = versions.select("p_partkey", "version", since.alias("since"), (F.col("p_retailprice") + k).alias("price"))
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    return temporal.as_of(facts, versions, ("l_partkey", "p_partkey"), ("l_shipdate", "since"), ["version", "price"])


@query("""WITH o AS (SELECT o_orderstatus, o_orderdate, max(o_orderkey) AS last_order FROM orders GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, last_order FROM lineitem ASOF LEFT JOIN o ON o_orderstatus = l_linestatus AND o_orderdate <= l_shipdate""")
def asof_last_order(spark, sf):
    """Every line with the last order of its status up to its shipping; two keys have all lines, so both are cut into ranges."""
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderdate", F.col("o_orderkey").alias("last_order"))
    found = temporal.as_of(facts, orders, ("l_linestatus", "o_orderstatus"), ("l_shipdate", "o_orderdate"), ["last_order"], ["last_order"], range_rows=4_000)
    return found.drop("l_shipdate")


@query("""SELECT e.event_id, e.user_id, e.event_type, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON p.user_id = e.user_id AND p.ts <= e.ts""")
def asof_last_purchase(spark, sf):
    """Every event with its user's last purchase up to then."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    bought = rows.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return temporal.as_of(rows, bought, ("user_id", "user_id"), ("ts", "ts"), ["purchase"], ["purchase"]).drop("ts")


# --- state of streams -----------------------------------------------------------------------------

#: Batches in which events arrive, out of order by up to half an hour, and a tenth of them once more in the next batch.
ARRIVALS = 4


def _arriving(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    start, length = span[0] or 0, (span[1] or 0) - (span[0] or 0) + 1801
    late = F.unix_seconds("ts") - start + F.col("event_id") * 7919 % 1800
    first = rows.withColumn("group", (late * ARRIVALS / length).cast("int"))
    again = first.where("event_id % 10 = 0").withColumn("group", F.least(F.col("group") + 1, F.lit(ARRIVALS - 1)))
    return streams.arriving(first.unionByName(again), F.col("group"), ARRIVALS).drop("group")


@query("""WITH s AS (SELECT user_id || '-' || CAST(ts AS DATE) AS session, (min(epoch_us(ts)) + 21600000000) // 1000 AS e, min(epoch_us(ts) // 1000) FILTER (event_type = 'error') AS r FROM events GROUP BY 1)
SELECT session, make_timestamp(e * 1000) AS expired_at FROM s WHERE (r IS NULL OR r >= e) AND e < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""")
def stream_session_expiry(spark, sf):
    """A user's day as a session of six hours from its first event, revoked by an error; each is told once, out of late and repeated events."""
    state.prepare(spark)
    session = F.concat_ws("-", "user_id", F.to_date("ts")).alias("session")
    records = table(spark, sf, "events").groupBy(session).agg((F.min("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("expires"))
    rows = _arriving(spark, sf).select(session, "ts", (F.col("event_type") == "error").alias("revoked")).join(materialize(records, "sessions"), "session")
    return streams.drain(state.expired_sessions(rows, "session", "ts", "expires", "revoked"))


@query(f"""WITH f AS (SELECT user_id, ts, event_id, {_STATUS_SQL} AS s FROM events WHERE (epoch_us(ts) // 60000000 + 1) * 60000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)),
x AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS old_status FROM f)
SELECT user_id AS key, CAST(event_id AS VARCHAR) AS id, old_status, s AS new_status FROM x WHERE old_status IS NOT NULL AND old_status <> s
  AND NOT (old_status = 'received' AND s IN ('processing', 'processed', 'failed')) AND NOT (old_status = 'processing' AND s IN ('processed', 'failed'))""")
def stream_transitions_ordered(spark, sf):
    """Wrong steps of each user's status out of late and repeated events, through a reorder buffer."""
    state.prepare(spark)
    bad = state.ordered_violations(_statuses(_arriving(spark, sf)), "user_id", "ts", "event_id", "status")
    return streams.drain(bad).drop("ts")


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def sync_last_writes(spark, sf):
    """A table kept by a stream of writes, with a batch that is delivered twice and one that comes too late."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    held = sync.SyncedTable(spark, f"{shared_dir(spark)}/loam-synced-{uuid.uuid4().hex}", rows.schema, "user_id", ["ts", "event_id"], buckets=16)
    stream = _arriving(spark, sf).select("user_id", "event_id", "ts", "value")
    writer = stream.writeStream.foreachBatch(held.upsert).option("checkpointLocation", f"{held.path}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    held.upsert(rows.where("event_id % 3 = 0"), 0)  # known by its number
    held.upsert(rows.where("event_id % 3 = 1"), 1_000)  # old writes, which lose
    return held.rows().select("user_id", "event_id", "value")


# --- cycles ---------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey * p_partkey + 3) % 1009 AS b FROM part),
image(k, id) AS (SELECT 0, a FROM e UNION SELECT k + 1, b FROM image JOIN e ON id = a WHERE k < 1009), c AS (SELECT DISTINCT id FROM image WHERE k = 1009),
walk(start, pos, a, b) AS (SELECT id, 0, id, b FROM c JOIN e ON a = id UNION ALL SELECT start, pos + 1, e.a, e.b FROM walk JOIN e ON e.a = walk.b WHERE walk.b <> start),
least AS (SELECT start FROM walk GROUP BY start HAVING min(a) = start)
SELECT start, CAST(pos AS BIGINT) AS pos, a AS from_node, b AS to_node FROM walk WHERE start IN (SELECT start FROM least)""")
def graph_cycle_paths(spark, sf):
    """A closed walk for each component of parts that supersede one another, edge by edge."""
    k = F.col("p_partkey")
    edges = table(spark, sf, "part").select(k.alias("from_node"), ((k * k + 3) % 1009).alias("to_node"), F.lit("SUPERSEDES").alias("edge_type"), F.lit(None).cast("boolean").alias("is_active"))
    return paths.cycle_paths(edges).drop("part")


# --- vectors --------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) + 1e-9, 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p WHERE similarity >= 0.1) WHERE rank <= 5""")
def vector_nearest(spark, sf):
    """The five vectors nearest to each whose id is divisible by 20, among all, through an inverted file."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 5, 0.1)
