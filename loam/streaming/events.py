"""The event rules as Structured Streaming: idempotent ingestion, windows, and the status machine as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.functions.storage import materialize, shared_dir
from loam.operators.rules import EVENT_STATUSES

#: Rows of a file of a stream's input.
FILE_ROWS = 500_000


@dataclass(frozen=True)
class Followed:
    """A stream whose micro-batches are worked on one after another, with what the one before left.

    ``step`` makes of a batch and of what is kept the rows of the result and what is kept next; ``rows`` and ``kept`` are their schemas.
    """

    stream: DataFrame
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
    rows: str
    kept: str


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten ``delay`` after them, so state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def counted(stream: DataFrame, ts: str, keys: list[str], seconds: int, delay: str = "1 hour") -> DataFrame:
    """window_start, keys, n of tumbling windows; late events up to ``delay`` still count."""
    rows = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding_failures(stream: DataFrame, ts: str, failed: str, delay: str = "1 minute") -> DataFrame:
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, "60 seconds", "10 seconds").alias("w"))
    return w.agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures")).select(F.col("w.start").alias("window_start"), "calls", "failures")


def transition_violations(stream: DataFrame, key: str, ts: str, status: str, delay: str = "1 hour", table: dict[str, list[str]] = EVENT_STATUSES) -> DataFrame:
    """key, ts, old_status, new_status of events whose status may not follow the key's last; idle keys expire."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        last, out = (state.get[0] if state.exists else None), []
        for at, new in zip(rows["ts"], rows["status"], strict=True):
            if last is not None and new != last and new not in table.get(last, []):
                out.append((k[0], at, last, new))
            last = new
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000)) + 3_600_000)
        yield pd.DataFrame(out, columns=["key", "ts", "old_status", "new_status"])

    rows = stream.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(status).alias("status"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, ts timestamp, old_status string, new_status string", "status string", "append", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream, with the schema that it has now; event times need a time zone, the session's."""
    now = spark.read.parquet(path)
    local = [n for n, t in now.dtypes if t == "timestamp_ntz"]
    reader = spark.readStream.schema(now.schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # streams read folders
        reader, path = reader.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return reader.parquet(path).withColumns({c: F.col(c).cast("timestamp") for c in local})


def drain(stream: DataFrame | Followed, mode: str = "append") -> DataFrame:
    """Runs ``stream`` over what is available now, into a table in the shared folder, and reads that.

    ``append`` writes what is final; ``complete`` the whole result of the last batch.
    """
    if isinstance(stream, Followed):
        return _followed(stream)
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/loam-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/rows")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = (writer.foreachBatch(write) if mode == "complete" else writer.format("parquet").option("path", f"{path}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _followed(followed: Followed) -> DataFrame:
    """Batches, results and what is kept lie in folders by the batch's number, so a batch that comes again writes the same once more."""
    spark, stream = followed.stream.sparkSession, followed.stream
    path = f"{shared_dir(spark)}/loam-stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], followed.rows).write.parquet(f"{path}/rows/start")
    spark.createDataFrame([], followed.kept).write.parquet(f"{path}/kept/0")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch/{number}")  # else the stream's state would be read for each use of it
        own, held = (spark.read.schema(s).parquet(f"{path}/{name}/{number}") for name, s in (("batch", stream.schema), ("kept", followed.kept)))
        rows, kept = followed.step(own, held)
        rows.write.mode("overwrite").parquet(f"{path}/rows/{number}")
        kept.write.mode("overwrite").parquet(f"{path}/kept/{number + 1}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(followed.rows).parquet(f"{path}/rows/*")


def arriving(rows: DataFrame, group: Column, groups: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``rows`` as a stream that delivers them in ``groups`` batches, by ``group`` from 0 on; each is written once, in that order.

    A batch is a fixed number of files, as many as the largest group has ``file_rows``; empty files fill up the others.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/loam-arriving-{uuid.uuid4().hex}"
    kept = materialize(rows.withColumn("_group", group.cast("int")), "arriving")
    counts = {r["_group"]: r["count"] for r in kept.groupBy("_group").count().collect()}  # a row a group
    most = max((counts.get(k, 0) for k in range(groups)), default=0)
    files = max(-(-most // file_rows), 1)
    for k in range(groups):
        own, n = kept.where(F.col("_group") == k).drop("_group"), max(-(-counts.get(k, 0) // file_rows), 1)
        dealt = own.coalesce(1) if n == 1 else own.repartition(n)
        dealt.write.mode("append").parquet(path)
        for _ in range(n, files):
            own.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
