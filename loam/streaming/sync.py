"""A table that takes writes from streams, the last write of each key winning.

Rows lie in folders by a hash bucket of the key. A batch rewrites the buckets that it touches, into new folders, and then puts one commit
file beside the others; that file names the folders of all buckets and the last batch of every stream. Readers see a commit or nothing of it. A batch that is
delivered again is known by its number and changes nothing, and since writes are held against each other by their
own order, batches may come in any order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.operators.events import last_writes


class SyncedTable:
    """The table at ``path``: one row a ``key``, the greatest by ``order`` (columns that put a key's writes in one order).

    Keys may be null, which is a key like others. There is one writer at a time; a second one that commits the same version fails.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        folder = self.hadoop.Path(f"{self.path}/commits")
        if not self.files.exists(folder):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.files.listStatus(folder)) if n.endswith(".json"))

    def state(self) -> dict:
        """The last commit: its version, the folder of each bucket, and the last batch of each stream."""
        names = self._commits()
        if not names:
            return {"version": 0, "folders": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        """Writes the commit under another name and renames it, which fails if that version is there."""
        draft = self.hadoop.Path(f"{self.path}/commits/draft-{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self.hadoop.Path(f"{self.path}/commits/{state['version']:012d}.json")
        if self.files.exists(final) or not self.files.rename(draft, final):
            raise RuntimeError(f"version {state['version']} of {self.path} was committed by another writer")

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def rows(self) -> DataFrame:
        """The table as of its last commit."""
        return self._folders(list(self.state()["folders"].values()))

    def upsert(self, batch: DataFrame, number: int, stream: str = "default") -> None:
        """Puts a batch of writes into the table, once for its ``number``; fit for ``foreachBatch``."""
        state = self.state()
        if number <= state["batches"].get(stream, -1):
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        own = last_writes(batch.select(*self.schema.names), self.key, self.order)
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most a number for each bucket
        version = state["version"] + 1
        if touched:
            folders = [state["folders"][str(b)] for b in touched if str(b) in state["folders"]]
            merged = last_writes(self._folders(folders).unionByName(own), self.key, self.order).withColumn("bucket", bucket)
            place = f"data/{version:012d}-{uuid.uuid4().hex[:8]}"
            merged.repartition(min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{place}")
            state["folders"] |= {str(b): f"{place}/bucket={b}" for b in touched}
        self._commit({"version": version, "folders": state["folders"], "batches": state["batches"] | {stream: number}})

    def tidy(self) -> None:
        """Removes folders and commits that the last commit does not need; for times without readers of older ones."""
        state, names = self.state(), self._commits()
        used = {f.rsplit("/", 1)[0] for f in state["folders"].values()}
        data = self.hadoop.Path(f"{self.path}/data")
        for s in self.files.listStatus(data) if self.files.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in used:
                self.files.delete(s.getPath(), True)
        for n in names[:-1]:
            self.files.delete(self.hadoop.Path(f"{self.path}/commits/{n}"), False)
