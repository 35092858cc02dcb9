"""Exact medians of groups of any size, without a buffer of a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.scratch import Scratch

#: A group (or what is left of it around its middle) of no more values is gathered; a range is cut into so many cells.
MOST, CELLS = 100_000, 1024


def _cell(v: Column, low: Column, high: Column) -> Column:
    """Cells of a range, of equal width; of equal ratio where all is positive and spans more than CELLS-fold.

    They grow with v, and the ends of the range lie in two cells (if they differ), so each round leaves values behind.
    """
    most = F.lit(1.7976931348623157e308)
    v, low, high = (F.greatest(F.least(x, most), -most) for x in (v, low, high))  # infinite values
    huge = F.when(F.greatest(F.abs(low), F.abs(high)) > 1e300, F.lit(0.25)).otherwise(F.lit(1.0))  # or the width is infinite
    equal = (v * huge - low * huge) / (high * huge - low * huge)
    share = F.when(low == high, F.lit(0.0)).when((low > 0) & (high / CELLS > low), (F.log(v) - F.log(low)) / (F.log(high) - F.log(low))).otherwise(equal)
    return F.least(F.greatest(F.floor(share * CELLS), F.lit(0).cast("long")), F.lit(CELLS - 1).cast("long"))


def exact_median(values: DataFrame, by: list[str], column: str, most: int = MOST) -> DataFrame:
    """(by, median): the middle value of each group, the mean of the two middle ones of an even number; nulls and NaN don't count.

    Groups of at most ``most`` values are gathered, which bounds a task. Of larger ones the values are counted by cells of
    their range, the cell that holds the middle is the next range, and so on until ``most`` values are left or all left are
    equal; a round shuffles a row a cell and task. The least and largest value of each cell are known, so where the two
    middle values lie in two cells they are found as well.
    """
    if not by:
        return exact_median(values.select(F.lit(1).alias("_group"), column), ["_group"], column, most).drop("_group")
    scratch = Scratch(values.sparkSession, "median")
    rows = values.select(*by, F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = scratch.keep(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes")
    large = sizes.where(F.col("_n") > most)
    if large.isEmpty():
        return rows.groupBy(*by).agg(F.median("_v").alias("median"))
    done = [rows.join(sizes.where(F.col("_n") <= most).select(*by), by).groupBy(*by).agg(F.median("_v").alias("median"))]
    # Ranks of the two middle values, and how many values lie below the range that holds both.
    ranges = large.select(*by, "_low", "_high", "_n", F.expr("(_n + 1) div 2").alias("_k1"), F.expr("_n div 2 + 1").alias("_k2"), F.lit(0).cast("long").alias("_below"))
    rising = Window.partitionBy(*by).orderBy("_cell")
    while True:
        inside = rows.join(ranges, by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        state = ["_k1", "_k2", "_below"]
        cells = inside.groupBy(*by, *state, _cell(F.col("_v"), F.col("_low"), F.col("_high")).alias("_cell")).agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_m").over(rising.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
        cells = cells.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_m"))
        holds = lambda k: (F.col("_before") < F.col(k)) & (F.col(k) <= F.col("_upto"))
        held = scratch.keep(cells.where(holds("_k1") | holds("_k2")), "cells")
        one = holds("_k1") & holds("_k2")
        # Middle values in two cells are the largest of the first and the least of the second.
        split = held.where(~one).groupBy(*by).agg(((F.min("_high") + F.max("_low")) / 2).alias("median"))
        equal = held.where(one & (F.col("_low") == F.col("_high"))).select(*by, F.col("_low").alias("median"))
        done += [split, equal]
        going = held.where(one & (F.col("_low") < F.col("_high")))
        few = going.where(F.col("_m") <= most).select(*by, "_low", "_high", "_k1", "_k2", F.col("_before").alias("_below"))
        left = rows.join(few, by).where(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*by, *state).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        at = lambda k: F.element_at("_all", (F.col(k) - F.col("_below")).cast("int"))
        done.append(left.select(*by, ((at("_k1") + at("_k2")) / 2).alias("median")))
        ranges = going.where(F.col("_m") > most).select(*by, "_low", "_high", F.col("_m").alias("_n"), "_k1", "_k2", F.col("_before").alias("_below"))
        if ranges.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
