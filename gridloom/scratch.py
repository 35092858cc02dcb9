"""Work tables of one run below the folder that driver and executors share; written tables cut the lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if it is set; else a temporary folder in plain local mode, the warehouse elsewhere."""
    global _local_root
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="gridloom-core-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        return f"file://{_local_root}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"


_folders: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Work folders whose tables a caller may still read go when the application ends."""
    if not _folders:
        atexit.register(_remove_all)
    _folders.append((spark, folder))


def _remove_all() -> None:
    while _folders:
        spark, folder = _folders.pop()
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001  the JVM has gone before: the folder stays
            return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridloom-ship-")) / "gridloom_package.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


class Scratch:
    """Tables that are written once and read from then on; ``forget`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        remove_at_exit(spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, *{f.rsplit("/", 1)[0] for f in table.inputFiles()})
