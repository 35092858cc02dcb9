"""Compaction of the state of ``exact_dedup`` that outlives a run.

A batch adds the digests that it touched to a folder of its own, and a run reads all of these folders. ``compact_state``
folds them: the last row of each digest is added to the newest batch, then older batches go, so a run reads a row a digest
(and those of the newest batch twice, with equal values) however many batches there have been.

At any moment a reader sees the same state: before the older batches go, the folded rows stand beside them under the newest
batch; a call that breaks off leaves repeated rows, never missing ones, and can be made again. It is to be made between
runs, since a batch that a broken run left without a commit is written anew by the next run: then nothing is folded.

Defined results: a state without batches, or with one, stays as it is; null digests don't occur (null texts are empty).
Keys of earlier runs stay where they are: they are listed, but not read again.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.scratch import delete


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    """Numbers that names in ``folder`` end with, in order; files beside them (checksums, markers) don't count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]  # as many as batches
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def compact_state(spark: SparkSession, state: str) -> int:
    """Fold the batches below ``state``; returns how many there were before that are gone now."""
    sink = f"{state}/updates"
    batches = _numbers(spark, sink, "batch=")
    committed = set(_numbers(spark, f"{state}/checkpoint/commits"))
    if len(batches) < 2 or batches[-1] not in committed:
        return 0
    newest, older = batches[-1], batches[:-1]
    rows = spark.read.option("basePath", sink).parquet(*[f"{sink}/batch={n}" for n in batches])
    columns = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy("digest").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("s.*")
    last.write.mode("append").parquet(f"{sink}/batch={newest}")
    delete(spark, *[f"{sink}/batch={n}" for n in older])
    return len(older)
