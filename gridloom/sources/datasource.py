"""Spark data source ``contactmap``: tables of contact maps in other formats, read in slices by the executors.

``spark.read.format("contactmap").options(path=..., table="pixels" | "bins").load()``, once ``register`` has run. The kind
follows from the path, or the option ``kind``: ``cool`` for HDF5 maps (``file.cool``, or ``file.mcool::/resolutions/1000``;
needs the library h5py, which is only imported then), ``dump`` for tab-separated tables as tools that dump such maps write
them, with or without a header line. Filters on ``bin1_id`` go to the source: an HDF5 map has an index by first bin, so
other rows aren't read; lines of a dump are left out as they are read. Slices are ranges of rows, or of bytes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.sources.contacts import BINS, PIXELS, ContactMap, chrom_table

#: Rows of an HDF5 map, and bytes of a dump, in a slice; rows of an Arrow batch.
ROWS, BYTES, BATCH = 1 << 21, 32 << 20, 1 << 17


@dataclass
class Slice(InputPartition):
    low: int
    high: int


def _h5(path: str):
    """The group of an HDF5 map as (file to close, group)."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 maps need the library h5py; dump the map's tables instead") from e
    name, _, group = path.partition("::")
    file = h5py.File(name, "r")
    return file, file[group] if group else file


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, size: int):
        self.path, self.table, self.rows, self.size = path, table, rows, size
        self.low, self.high = None, None  # first bins: from, below

    def pushFilters(self, filters):
        for f in filters:
            kind, value = type(f), getattr(f, "value", None)
            if self.table != "pixels" or getattr(f, "attribute", None) != ("bin1_id",) or kind not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) or not isinstance(value, int):
                yield f
                continue
            if kind is not LessThan and kind is not LessThanOrEqual:
                low = value + (kind is GreaterThan)
                self.low = low if self.low is None else max(low, self.low)
            if kind is not GreaterThan and kind is not GreaterThanOrEqual:
                high = value + (kind is not LessThan)
                self.high = high if self.high is None else min(high, self.high)


class CoolReader(_Reader):
    """HDF5: ``pixels/bin1_id`` and so on, in order of ``bin1_id``; ``indexes/bin1_offset`` has each bin's first row."""

    def partitions(self) -> list[Slice]:
        file, group = _h5(self.path)
        try:
            if self.table == "bins":
                first, last = 0, len(group["bins/start"])
            else:
                offsets = group["indexes/bin1_offset"]
                n = len(offsets) - 1
                at = lambda b: int(offsets[min(max(b, 0), n)])
                first, last = at(0 if self.low is None else self.low), at(n if self.high is None else self.high)
        finally:
            file.close()
        return [Slice(k, min(k + self.rows, last)) for k in range(first, last, self.rows)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        file, group = _h5(self.path)
        try:
            for low in range(partition.low, partition.high, BATCH):
                part = slice(low, min(low + BATCH, partition.high))
                if self.table == "pixels":
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(group[f"pixels/{c}"][part]).astype(kind)) for c, kind in (("bin1_id", "i8"), ("bin2_id", "i8"), ("count", "f8"))], ["bin1_id", "bin2_id", "count"])
                    continue
                names = np.array([x.decode() if isinstance(x, bytes) else str(x) for x in group["chroms/name"][:]], object)
                start, end = (np.asarray(group[f"bins/{c}"][part]).astype("i8") for c in ("start", "end"))
                weight = np.asarray(group["bins/weight"][part], float) if "weight" in group["bins"] else np.full(len(start), np.nan)
                ids = np.arange(part.start, part.start + len(start))
                chrom = names[np.asarray(group["bins/chrom"][part]).astype(int)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(chrom, pa.string()), pa.array(start), pa.array(end), pa.array(weight, pa.float64(), from_pandas=True)], ["bin_id", "chrom", "start", "end", "weight"])
        finally:
            file.close()


class DumpReader(_Reader):
    """Tab-separated pixels; a slice holds the lines that begin in its range of bytes."""

    def partitions(self) -> list[Slice]:
        if self.table != "pixels":
            raise ValueError("bins of a dump are numbered by their lines: use read_dump")
        total = os.path.getsize(self.path)
        return [Slice(k, min(k + self.size, total)) for k in range(0, total, self.size)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bin1_id", "bin2_id", "count"], [pa.int64(), pa.int64(), pa.float64()]
        rows: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        with open(self.path, "rb") as file:
            if partition.low:
                file.seek(partition.low - 1)
                file.readline()  # the line before began in another slice
            while file.tell() < partition.high and (line := file.readline()):
                fields = line.split(b"\t")
                try:
                    a, b, n = int(fields[0]), int(fields[1]), float(fields[2])
                except (ValueError, IndexError):
                    continue  # a header line
                if (self.low is None or a >= self.low) and (self.high is None or a < self.high):
                    rows.append((a, b, n))
                    if len(rows) == BATCH:
                        yield packed()
                        rows.clear()
        if rows:
            yield packed()


class ContactMapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contactmap"

    def _table(self) -> str:
        table = self.options.get("table", "pixels")
        if table not in ("pixels", "bins"):
            raise ValueError("table is pixels or bins")
        return table

    def schema(self) -> str:
        return PIXELS if self._table() == "pixels" else BINS

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        kind = self.options.get("kind") or ("cool" if path.partition("::")[0].endswith(("cool", ".h5", ".hdf5")) else "dump")
        if kind not in ("cool", "dump"):
            raise ValueError("kind is cool or dump")
        return (CoolReader if kind == "cool" else DumpReader)(path, self._table(), int(self.options.get("rows", ROWS)), int(self.options.get("bytes", BYTES)))


def register(spark: SparkSession) -> None:
    from gridloom.scratch import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContactMapSource)


def read_cool(spark: SparkSession, path: str) -> ContactMap:
    """An HDF5 map (one resolution of it: ``file.mcool::/resolutions/1000``)."""
    from pyspark.sql import functions as F

    register(spark)
    table = lambda name: spark.read.format("contactmap").options(path=path, table=name, kind="cool").load()
    bins = table("bins")
    size = bins.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    return ContactMap(chrom_table(bins), bins, table("pixels"), int(size))
