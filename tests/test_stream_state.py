import datetime as dt
import random

from pyspark.sql import functions as F

from loam.operators.rules import EVENT_STATUSES
from loam.streaming import events as streams
from loam.streaming import state

START = dt.datetime(2024, 1, 1)


def delivered(spark, rows, schema, order, batch):
    """``rows`` as a stream, in batches, in the order of arrival."""
    rows = [(*r, k // batch) for k, r in enumerate(sorted(rows, key=order))]
    frame = spark.createDataFrame(rows, schema + ", part int")
    return streams.arriving(frame, F.col("part"), -(-len(rows) // batch)).drop("part")


def test_sessions_run_out_once(spark):
    """Sessions under late and repeated events, revocations before and after their end, and uses long after it."""
    state.prepare(spark)
    draw, rows = random.Random(6), []
    for s in range(30):
        opened = START + dt.timedelta(minutes=draw.randrange(600))
        at = [opened, *(opened + dt.timedelta(minutes=draw.randrange(1, 400)) for _ in range(draw.randrange(6)))]
        rows += [(f"s{s}", t, opened + dt.timedelta(hours=1), draw.random() < 0.2) for t in at]
    rows += [(None, START, START, False), ("s1", None, START, True), ("s2", START, None, True), ("end", START + dt.timedelta(days=2), START + dt.timedelta(days=3), False)]
    rows += rows[::3]
    stream = delivered(spark, rows, "s string, ts timestamp, ends timestamp, stop boolean", lambda r: ((r[1] or START) + dt.timedelta(minutes=hash(r) % 20)), 30)
    got = streams.drain(state.expired_sessions(stream, "s", "ts", "ends", "stop", "30 minutes")).collect()
    want = []
    for s in {r[0] for r in rows} - {None, "end"}:
        own = [r for r in rows if r[0] == s and r[1] and r[2]]
        if not any(r[3] and r[1] < r[2] for r in own):
            want.append((s, own[0][2]))
    assert sorted((r.session, r.expired_at) for r in got) == sorted(want) and 10 < len(want) < 30


def test_events_are_put_in_order(spark):
    """One key has most of the events; they come late, twice, and in an order of their own."""
    state.prepare(spark)
    draw, rows = random.Random(3), []
    kinds = [*EVENT_STATUSES, "unknown", None]
    for n in range(400):
        rows.append(("hot" if n % 3 else f"k{n % 5}", START + dt.timedelta(seconds=draw.randrange(20_000), microseconds=n), n, draw.choice(kinds)))
    rows += rows[::7] + [(None, START, 1, "failed"), ("end", START + dt.timedelta(days=1), 2, "received")]
    stream = delivered(spark, rows, "k string, ts timestamp, n int, s string", lambda r: r[1] + dt.timedelta(seconds=hash(r[2] * 37) % 1500), 120)
    got = streams.drain(state.ordered_violations(stream, "k", "ts", "n", "s", "30 minutes", slot_seconds=600)).collect()
    want = []
    for k in {r[0] for r in rows} - {None}:
        last = None
        for _, ts, n, s in sorted({r for r in rows if r[0] == k and r[3]}, key=lambda r: r[1]):
            if last and s != last and s not in EVENT_STATUSES.get(last, []):
                want.append((k, ts, str(n), last, s))
            last = s
    assert sorted((r.key, r.ts, r.id, r.old_status, r.new_status) for r in got) == sorted(want) and len(want) > 50


def test_too_late_is_dropped(spark):
    """A revocation two batches behind the watermark changes nothing: the session was told, and is not told again."""
    state.prepare(spark)
    end = START + dt.timedelta(hours=1)
    rows = [("a", START, end, False), ("b", START + dt.timedelta(days=1), START + dt.timedelta(days=2), False), ("x", START + dt.timedelta(days=1), end, False)]
    rows += [("a", START + dt.timedelta(minutes=1), end, True), ("a", START + dt.timedelta(days=1, hours=1), end, False), ("c", START + dt.timedelta(days=3), START + dt.timedelta(days=9), False)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, ts timestamp, ends timestamp, stop boolean, part int")
    stream = streams.arriving(frame, F.col("part"), len(rows))
    got = streams.drain(state.expired_sessions(stream, "s", "ts", "ends", "stop", "1 hour")).collect()
    assert sorted(r.session for r in got) == ["a", "b"]


def test_nothing_is_called_for_a_key(spark):
    """Sessions and slots are windows of Spark's own; Python sees neither their rows nor their keys."""
    rows = spark.readStream.format("rate").load().select(F.col("value").cast("string").alias("s"), F.col("timestamp").alias("ts"), F.lit("failed").alias("status"))
    ordered = state.ordered_violations(rows, "s", "ts", "s", "status").stream
    sessions = state.expired_sessions(rows.withColumn("stop", F.lit(False)), "s", "ts", "ts", "stop")
    for stream in (ordered, sessions):
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan


def test_final_is_what_is_before_the_watermark(spark):
    """A slot and a session that end at the watermark itself are not final; those a millisecond before it are."""
    state.prepare(spark)
    end = START + dt.timedelta(hours=1)
    for late, told in ((0, []), (1, ["a"])):
        last = end + dt.timedelta(hours=1, milliseconds=late)
        rows = [("a", START, end, False, "failed", 0), ("b", last, last + dt.timedelta(days=1), False, "failed", 1)]
        uses = spark.createDataFrame(rows, "s string, ts timestamp, ends timestamp, stop boolean, status string, part int")
        assert [r.session for r in streams.drain(state.expired_sessions(streams.arriving(uses, F.col("part"), 2), "s", "ts", "ends", "stop")).collect()] == told


def test_batches_of_several_files(spark):
    """Each batch holds its group, whole and in turn, also where the groups have different numbers of files."""
    rows = spark.createDataFrame([(n, k) for k, size in enumerate((95, 3, 0, 40)) for n in range(size)], "n int, part int")
    seen, stream = [], streams.arriving(rows, F.col("part"), 4, file_rows=10)
    stream.writeStream.foreachBatch(lambda batch, _: seen.append((batch.rdd.getNumPartitions() > 1, sorted({r.part for r in batch.collect()}), batch.count()))).trigger(availableNow=True).start().awaitTermination()
    assert [x[1:] for x in seen] == [([0], 95), ([1], 3), ([], 0), ([3], 40)]
