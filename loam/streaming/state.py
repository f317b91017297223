"""Streams whose answers need state of their own: sessions that run out, and events put back in order.

Both are windows of Spark's own, in small parts, so that no key's history is ever held in memory and nothing is called for a
row or a key: a session is a session window of its own length with two values, and a reorder buffer is cut into slots of event time, tumbling windows.
The watermark says when a part is final. The state store is RocksDB (``prepare``). The last status of each key is a table, joined once a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators.rules import EVENT_STATUSES, allowed
from loam.streaming.events import Followed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Sets the state store, which need not fit into memory and commits only what changed; for streams that start afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _strictly(delay: str) -> str:
    """``delay`` by which a window is final when its end is before the watermark; Spark's are so at the watermark itself. Both count milliseconds."""
    return f"{delay} 1 millisecond"


def expired_sessions(stream: DataFrame, session: str, ts: str, expires: str, revoked: str, delay: str = "1 hour") -> DataFrame:
    """session, expired_at (in milliseconds): one row for each session when it runs out without having been revoked.

    Every row is a use of a session and names its end, ``expires``; one that is marked ``revoked`` ends it in silence. Uses at the end
    or after it count for nothing, so a session whose end is past is never opened anew and needs no memory: its state goes when it ends. If the rows of a session
    differ, the earliest end counts, and is told when the latest of them has passed. Rows may come in any order within ``delay``, and more than once; what is later than
    that counts only while its session is open. Rows with a null session, time or end are left out.
    """
    rows = stream.where(F.col(session).isNotNull() & F.col(ts).isNotNull() & F.col(expires).isNotNull()).withWatermark(ts, _strictly(delay))
    rows = rows.select(F.col(session).alias("session"), F.col(ts).alias("ts"), F.unix_millis(F.col(expires).cast("timestamp")).alias("ends"), F.col(revoked).cast("boolean").alias("revoked"))
    # From a use to the end: the uses of one session overlap, since all of them reach there.
    length = ((F.col("ends") * 1000 - F.unix_micros("ts")).cast("decimal(24,0)") / 1_000_000).cast("decimal(18,6)")
    at = F.unix_millis("ts")
    held = rows.where(at < F.col("ends")).groupBy("session", F.session_window("ts", F.make_interval(secs=length)).alias("w"))
    ended = held.agg(F.min("ends").alias("ends"), F.min(F.when(F.col("revoked"), at)).alias("stopped"))
    return ended.where("stopped IS NULL OR stopped >= ends").select("session", F.timestamp_millis("ends").alias("expired_at"))


def ordered_violations(stream: DataFrame, key: str, ts: str, event: str, status: str, delay: str = "1 hour", slot_seconds: int = 60, table: dict[str, list[str]] = EVENT_STATUSES) -> Followed:
    """key, ts, id, old_status, new_status of events whose status may not follow that of the key's event before, in event time.

    Events may come in any order within ``delay`` and more than once (equal rows count once); they are answered for
    when their slot of ``slot_seconds`` is final, and only a slot's events of one key are in memory together. What is later than ``delay`` counts
    only while its slot is not final. Rows with a null key or time are left out, null statuses change nothing. The last status of a key is kept,
    and meets the first event of the key's next slot in a batch's join.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, _strictly(delay))
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.coalesce(F.col(event).cast("string"), F.lit("")).alias("id"), F.col(status).alias("status"))
    own = F.when(F.col("status").isNotNull(), F.struct(F.unix_micros("ts").alias("at"), "id", "status"))
    slots = rows.groupBy("key", F.window("ts", f"{slot_seconds} seconds").alias("w")).agg(F.collect_set(own).alias("events"))
    slots = slots.select("key", F.array_sort("events").alias("events")).where(F.size("events") > 0)

    def step(old, new, last):
        return F.struct(new["at"].alias("at"), new["id"].alias("id"), old.alias("old_status"), new["status"].alias("new_status"), last.alias("last"))

    none, behind = F.lit(None).cast("string"), F.size("events") - 1
    pairs = F.zip_with(F.slice("events", F.lit(1), behind), F.slice("events", F.lit(2), behind), lambda a, b: step(a["status"], b, none))
    inside = F.filter(pairs, lambda p: ~allowed(p["old_status"], p["new_status"], table))
    # A slot is its first event with its last status, and the wrong steps within it.
    first = F.array(step(none, F.get("events", 0), F.element_at("events", -1)["status"]))
    steps = slots.select("key", F.inline(F.concat(first, inside)))

    def follow(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        start = F.lit(-(1 << 63)).cast("long").alias("at")
        ends = batch.where("last IS NOT NULL").select("key", "at", "id", "new_status", "last")
        ends = ends.unionByName(held.select("key", start, none.alias("id"), none.alias("new_status"), "last"))
        before = F.lag("last").over(Window.partitionBy("key").orderBy("at"))
        between = ends.withColumn("old_status", before).where(F.col("new_status").isNotNull() & F.col("old_status").isNotNull() & ~allowed(F.col("old_status"), F.col("new_status"), table))
        columns = ["key", F.timestamp_micros("at").alias("ts"), "id", "old_status", "new_status"]
        found = batch.where("last IS NULL").select(*columns).unionByName(between.select(*columns))
        return found, ends.groupBy("key").agg(F.max_by("last", "at").alias("last"))

    return Followed(steps, follow, f"key {kind}, ts timestamp, id string, old_status string, new_status string", f"key {kind}, last string")
