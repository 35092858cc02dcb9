"""Helpers shared by the training-data operators: shared work folders, shipping of code, reading."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.scratch import delete, remove_at_exit, shared_root, ship

#: Java regular expressions of ASCII white space and of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to Python: texts can be long, and pandas holds a batch several times over.
ARROW_BYTES = 8 << 20


class Workspace:
    """Tables of one run below the shared folder; a written table cuts the lineage and survives lost executors.

    Also sends the package to the executors and bounds the session's Arrow batches by bytes.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        self.spark = spark
        self.path = f"{shared_root(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        remove_at_exit(spark, self.path)

    def sub(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = self.sub(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        """Delete files that nothing reads any more."""
        delete(self.spark, *paths)

    def forget(self, *tables: DataFrame | None) -> None:
        """Delete tables of ``keep`` that nothing reads any more: what came of them is written."""
        for table in tables:
            if table is not None and (files := table.inputFiles()):
                self.drop(files[0].rsplit("/", 1)[0])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that no column's name can clash with those of an operator."""
    return docs.select(whole_row(docs))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def located(docs: DataFrame, work: Workspace) -> DataFrame:
    """``packed`` rows and ``at``, the place of each: its file and its number in it.

    Rows that come straight from Parquet files have such a place; other frames are written first.
    """
    straight = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns
    if straight:
        try:
            docs.select("_metadata.row_index")
        except Exception:  # noqa: BLE001  files of another format
            straight = False
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("n")).alias("at")
    if straight:
        return docs.select(whole_row(docs), place)
    return work.keep(packed(docs), "rows").select("row", place)


#: A key that more than one in so many rows have is hot. There are fewer hot keys than this, which bounds what is broadcast.
SHARES = 1000
#: A key with so few rows is never hot.
LEAST_HOT = 64


def hot_keys(counted: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """counted (key, n; one row a key) to (key, salts): hot keys, and over how many tasks to deal each."""
    per = max(total / SHARES, LEAST_HOT)
    return counted.where(F.col(n) > per).select(key, F.ceil(F.col(n) / per).cast("int").alias("salts"))


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """The inner join of ``many`` rows to the ``one`` row of their key, without all rows of a hot key in one task.

    Rows of hot keys are dealt out by ``by`` (a column of ``many``), and their row of ``one`` comes once a share.
    """
    shares = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    left = many.join(shares, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    right = one.join(shares, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def map_batches(rows: DataFrame, kept: list[str], made: str, compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The columns ``kept`` of ``rows``, and those of the schema ``made`` that ``compute`` gives for a batch.

    Kept columns pass by as Arrow: as pandas, a long beside a null would become a fraction and lose digits.
    """
    new = T.StructType.fromDDL(made)
    schema = T.StructType([rows.schema[c] for c in kept] + new.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(new)
        for batch in batches:
            columns = [pa.array(values, field.type) for values, field in zip(compute(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, [*kept, *kinds.names])
        trim()

    return rows.mapInArrow(each, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(column).to_pylist()


def held_out(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers live on between stages."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file: below ``folder`` if given, else where the library of files is installed."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
