"""Numbers along a total order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark's growing numbers hold the partition above this bit and the place in it below.
_BITS = 33


def numbered(rows: DataFrame, order: list[Column | str], keep: Callable[[DataFrame], DataFrame], column: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``column``: 1, 2, 3, ... along ``order``; with ``by``, a prefix of the order, for each of its values anew.

    The sort deals the rows out by range, so a value that many rows share may lie over several partitions. Each partition
    numbers its rows; what lies in the partitions before is added from counts: one row a partition, or one a partition and
    value of ``by``. ``keep`` writes the sorted rows.
    """
    by = list(by or [])
    placed = keep(rows.orderBy(*order).withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, _BITS).alias("_part")
    counts = placed.groupBy(*by, part).agg(F.count(F.lit(1)).alias("_n"), F.min(column).alias("_first"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", part)
    met = rows.join(starts, [*by, "_part"]) if by else rows.join(F.broadcast(starts), "_part")  # one row a partition
    return met.withColumn(column, F.col(column) - F.col("_first") + F.col("_before") + 1).drop("_part", "_first", "_before")
