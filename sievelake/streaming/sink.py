"""A table that a stream's micro-batches change exactly once.

A batch is written to a folder of its own and counts from the moment at which its manifest, a small file named by the batch's number, is there. A manifest is made
once: a batch that Spark replays after a failure finds it and changes nothing, and what an attempt wrote that never got its manifest is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.review import latest


class BatchTable:
    """Rows of committed batches at ``path``, a folder of any file system that Spark writes to. ``schema`` is that of the batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self) -> dict[int, str]:
        """Folders of the committed batches, by number."""
        store, at = self._file("manifest")
        if not store.exists(at):
            return {}
        names = [f.getPath().getName() for f in store.listStatus(at)]
        return {m["batch"]: m["folder"] for name in names if name.endswith(".json") for m in [self._read(f"manifest/{name}")]}

    def _read(self, name: str) -> dict:
        store, at = self._file(name)
        stream = store.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, batch: int, folder: str) -> bool:
        """Whether this attempt's folder is the batch's: the manifest is written aside and renamed, which fails where one is there already."""
        store, target = self._file(f"manifest/{batch:012d}.json")
        _, aside = self._file(f"manifest/.{batch}-{uuid.uuid4().hex}")
        out = store.create(aside, False)
        try:
            out.write(json.dumps({"batch": batch, "folder": folder}).encode())
        finally:
            out.close()
        done = not store.exists(target) and store.rename(aside, target)
        if not done:
            store.delete(aside, False)
        return done

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch, for foreachBatch; false, and no change, if it has been added before."""
        if batch in self.committed():
            return False
        folder = f"data/{batch:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return self._commit(batch, folder)

    def read(self, batches: dict[int, str] | None = None) -> DataFrame:
        """All committed rows with ``batch``, the number of theirs; a batch that was compacted has the number of the last one in it."""
        found = self.committed() if batches is None else batches
        live = {folder: b for b, folder in found.items()}  # a compaction's folder stands for all of its batches, under the greatest number
        empty = self.spark.createDataFrame([], self.schema)
        if not live:
            return empty.withColumn("batch", F.lit(0).cast("long"))
        own = F.element_at(F.create_map(*[x for folder, b in live.items() for x in (F.lit(folder.split("/")[1]), F.lit(b).cast("long"))]), F.element_at(F.split(F.input_file_name(), "/"), -2))
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.path}/{folder}" for folder in live]).withColumn("batch", own)

    def compact(self, key: str, *order: Column) -> DataFrame:
        """The last row of each key by ``order``, then later batches first; written in place of the batches so far, whose manifests then name the new folder.

        A manifest is replaced one by one; rows of a batch that was merged already come out once more until then, and lose against themselves.
        """
        found = self.committed()
        if not found:
            return self.read(found)
        folder = f"data/{max(found):012d}-{uuid.uuid4().hex}"
        self.latest(key, *order).write.parquet(f"{self.path}/{folder}")
        for batch in sorted(found):
            store, target = self._file(f"manifest/{batch:012d}.json")
            out = store.create(target, True)
            try:
                out.write(json.dumps({"batch": batch, "folder": folder}).encode())
            finally:
                out.close()
        for old in set(found.values()) - {folder}:
            store, at = self._file(old)
            store.delete(at, True)
        return self.latest(key, *order)

    def latest(self, key: str, *order: Column) -> DataFrame:
        """The state after all committed batches: each key's last row by ``order``, of equal ones the later batch's."""
        return latest(self.read(), key, *order, F.desc("batch")).drop("batch")


def upserted(stream: DataFrame, to: BatchTable, checkpoint: str) -> None:
    """Reads everything that ``stream`` has into ``to``, one micro-batch after the other."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: to.write(rows, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
