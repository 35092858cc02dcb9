"""A contact map that is kept by increments: a base, and what arrived since, in batches that count once.

Below a folder lie ``deltas/batch=K`` (pixels of batch K), ``base/N`` (pixels of all batches up to a compaction) and
``current.json``, which names the base and the last batch that it holds. A batch that is written again after a failure
replaces its own folder; one that the base holds already is left out. Batches have growing numbers, as those of a stream.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.scratch import delete
from gridloom.sources.contacts import PIXELS, upper

#: Shares of the pixels that are recounted as a check, by hash.
PARITY = 16


class MapStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- the small file that says what holds -------------------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict:
        path, fs = self._path("current.json")
        if not fs.exists(path):
            return {"base": None, "upto": -1}
        return json.loads("".join(r[0] for r in self.spark.read.text(path.toString()).collect()))  # one line

    def _commit(self, state: dict) -> None:
        """Written beside and renamed, so that a reader finds the old state or the new one."""
        new, fs = self._path("current.json.new")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        old, _ = self._path("current.json")
        if fs.exists(old) and not fs.rename(new, old):
            fs.delete(old, False)  # a store whose rename doesn't replace: the new file is complete by now
        if fs.exists(new):
            fs.rename(new, old)

    # -- writing -------------------------------------------------------------------------------------------------------
    def add(self, contacts: DataFrame, batch: int) -> None:
        """Contacts (bin1_id, bin2_id [, count]) of a batch; in either order, counted once however often it is added."""
        if batch <= self.current()["upto"]:
            return
        rows = contacts if "count" in contacts.columns else contacts.withColumn("count", F.lit(1.0))
        upper(rows).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")

    def follow(self, contacts: DataFrame, checkpoint: str, **trigger):
        """A streaming frame of contacts into the store; a batch that the stream runs again replaces itself."""
        return contacts.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _batches(self) -> list[int]:
        path, fs = self._path("deltas")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def compact(self, before: int | None = None) -> None:
        """A new base of the old one and all batches (below ``before``). Old files go after the new state holds, so a run
        that breaks off leaves a map that reads the same."""
        state = self.current()
        fresh = [b for b in self._batches() if b > state["upto"] and (before is None or b < before)]
        if not fresh:
            return
        name = f"base/{fresh[-1]}"
        # In order of first bin, so that a region reads few row groups.
        self._folded(state, fresh).repartitionByRange("bin1_id").sortWithinPartitions("bin1_id", "bin2_id").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self._commit({"base": name, "upto": fresh[-1]})
        gone = [f"{self.folder}/deltas/batch={b}" for b in self._batches() if b <= fresh[-1]]
        delete(self.spark, *gone, *([f"{self.folder}/{state['base']}"] if state["base"] else []))

    # -- reading -------------------------------------------------------------------------------------------------------
    def _folded(self, state: dict, batches: list[int]) -> DataFrame:
        paths = [f"{self.folder}/deltas/batch={b}" for b in batches] + ([f"{self.folder}/{state['base']}"] if state["base"] else [])
        if not paths:
            return self.spark.createDataFrame([], PIXELS)
        # A base alone has each pixel once; batches may repeat them.
        rows = self.spark.read.schema(PIXELS).parquet(*paths)
        return rows.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count")) if batches else rows

    def pixels(self) -> DataFrame:
        """The map as it stands: base and later batches folded; filters on bins reach both."""
        state = self.current()
        return self._folded(state, [b for b in self._batches() if b > state["upto"]])

    def parity(self) -> DataFrame:
        """(share, pixels, contacts) by hash of the bins: equal before and after a compaction, and between two stores of
        the same contacts, however they were cut into batches."""
        share = F.pmod(F.xxhash64("bin1_id", "bin2_id"), F.lit(PARITY)).cast("int").alias("share")
        return self.pixels().groupBy(share).agg(F.count(F.lit(1)).alias("pixels"), F.sum("count").alias("contacts"))
