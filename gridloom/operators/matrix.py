"""Small matrix operations on coordinate rows: padding, diagonals, masks, gathering, symmetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zero_pad(local: DataFrame, rows: int, columns: int) -> DataFrame:
    """Margins of zeros on all sides: an offset of the coordinates."""
    return local.withColumn("i", F.col("i") + rows).withColumn("j", F.col("j") + columns)


def set_diagonal(local: DataFrame, n: int | DataFrame, diagonal: int, value: float) -> DataFrame:
    """One diagonal gets a value, stored or not; ``n`` is the size of all sub-matrices, or a frame (sub, n)."""
    sizes = n if isinstance(n, DataFrame) else local.select("sub").distinct().withColumn("n", F.lit(n))
    first = max(0, -diagonal)
    last = F.col("n") - max(diagonal, 0) - 1
    line = sizes.where(last >= first).select("sub", F.explode(F.sequence(F.lit(first).cast("long"), last.cast("long"))).alias("i"))
    line = line.select("sub", "i", (F.col("i") + diagonal).alias("j"), F.lit(float(value)).alias("v"))
    return local.where(F.col("j") - F.col("i") != diagonal).select("sub", "i", "j", "v").unionByName(line)


def complement(valid: DataFrame, n: int) -> DataFrame:
    """The indices 0 to n - 1 that aren't in ``valid`` (bin)."""
    return valid.sparkSession.range(n).select(F.col("id").alias("bin")).join(valid.select("bin"), "bin", "left_anti")


def check_mask(local: DataFrame, missing: DataFrame) -> None:
    """No stored value other than zero may lie in a missing row or column."""
    for axis in ("i", "j"):
        bad = local.where("v <> 0").join(missing.select("sub", F.col("bin").alias(axis)), ["sub", axis], "left_semi")
        if bad.limit(1).count():
            raise ValueError(f"values under the mask on axis {axis}")


def gather(local: DataFrame, chroms: DataFrame) -> DataFrame:
    """Processed sub-matrices (sub1, sub2, i, j, v) as one upper triangle of whole-map bins."""
    for k, axis in ((1, "i"), (2, "j")):
        start = chroms.select(F.col("chrom_idx").alias(f"sub{k}"), F.col("start_bin").alias(f"_s{k}"))
        local = local.join(F.broadcast(start), f"sub{k}").withColumn(f"bin{k}_id", F.col(axis) + F.col(f"_s{k}"))
    return local.where("bin1_id <= bin2_id").select("bin1_id", "bin2_id", "v")


def symmetric(local: DataFrame) -> DataFrame:
    """The lower triangle too."""
    swap = {"i": "j", "j": "i"}
    turned = local.where("i <> j").select(*[F.col(swap.get(c, c)).alias(c) for c in local.columns])
    return local.unionByName(turned)


def inside_region(pixels: DataFrame, start: int, end: int, value: str = "v", log: bool = False) -> DataFrame:
    """Pixels with both bins strictly inside, for display: zeros become null, optionally logarithms."""
    kept = pixels.where((F.col("bin1_id") > start) & (F.col("bin1_id") < end) & (F.col("bin2_id") > start) & (F.col("bin2_id") < end))
    shown = F.nullif(F.col(value), F.lit(0.0))
    return kept.withColumn(value, F.log(shown) if log else shown)
