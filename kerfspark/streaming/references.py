"""Streams: references checked as they arrive, and windowed counts of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfspark.operators import orphans
from kerfspark.runtime import shared_folder


class OrphanMonitor:
    """Moves the orphan state along micro-batches; give ``references`` or ``parents`` to ``foreachBatch``.

    The state is a folder of numbered versions, each with the tables ``refs`` and ``parents``; a version counts once its
    marker is written after both. A monitor opened on a folder goes on from the latest version that counts, so a restart
    loses nothing; a batch that runs again finds its references and parents there already (they keep their first times)
    and changes nothing. The last two versions are kept.
    """

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/orphans-{uuid.uuid4().hex}").rstrip("/")
        self.version = max(self._versions(), default=0)

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done")]

    @property
    def refs(self) -> DataFrame:
        return self._table("refs", orphans.REFS)

    @property
    def parents(self) -> DataFrame:
        return self._table("parents", orphans.PARENTS)

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v{self.version}/{name}")

    def _advance(self, new_refs: DataFrame, new_parents: DataFrame) -> None:
        refs, parents = orphans.advance((self.refs, self.parents), new_refs, new_parents)
        fresh, fs = self.version + 1, self._fs()
        refs.write.mode("overwrite").parquet(f"{self.folder}/v{fresh}/refs")
        parents.write.mode("overwrite").parquet(f"{self.folder}/v{fresh}/parents")
        fs.create(self._path(f"v{fresh}.done"), True).close()
        self.version = fresh
        for old in self._versions():
            if old < fresh - 1:
                fs.delete(self._path(f"v{old}.done"), False)
                fs.delete(self._path(f"v{old}"), True)

    def on_references(self, batch: DataFrame, _batch_id: int) -> None:
        self._advance(batch.select(*orphans.IDENTITY, "seen"), self.spark.createDataFrame([], orphans.PARENTS))

    def on_parents(self, batch: DataFrame, _batch_id: int) -> None:
        none = self.spark.createDataFrame([], orphans.REFS)
        self._advance(none.select(*orphans.IDENTITY, "seen"), batch.select("target_id", "born", "died", "told"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of an event stream by window and type, late events within the watermark included; works on tables too."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    by = kept.groupBy(F.window("ts", width).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("_w.start").alias("start"), "event_type", "n", "total")
