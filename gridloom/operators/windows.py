"""Windows around patterns: cells, validity, pile-ups, and scores of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.kernels import small_frame


def cells(patterns: DataFrame, local: DataFrame, sizes: DataFrame, missing: DataFrame, size: int, missing_columns: DataFrame | None = None) -> DataFrame:
    """patterns (pid, sub, i, j) to (pid, sub, a, b, v, raw): v is null where missing, 0 where empty; a, b count from 0;
    raw is the stored value, 0 where there is none.

    With ``missing_columns`` the map is one between chromosomes: ``sizes`` has n rows and m columns, nothing below the
    diagonal is missing.
    """
    h = size // 2
    width = "n" if missing_columns is None else "m"
    spark = patterns.sparkSession
    footprint = small_frame(spark, [(a, b) for a in range(size) for b in range(size)], "a int, b int")
    # One row a chromosome; of pairs of chromosomes there may be many.
    known = F.broadcast(sizes) if missing_columns is None else sizes
    at = patterns.join(F.broadcast(footprint)).join(known, "sub").withColumn("x", F.col("i") + F.col("a") - h).withColumn("y", F.col("j") + F.col("b") - h)
    gone = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") >= F.col("n")) | (F.col("y") >= F.col(width))
    for axis, side in (("x", missing), ("y", missing if missing_columns is None else missing_columns)):
        at = at.join(side.select("sub", F.col("bin").alias(axis), F.lit(True).alias(f"_{axis}")), ["sub", axis], "left")
        gone = gone | F.coalesce(f"_{axis}", F.lit(False))
    if missing_columns is None:
        gone = gone | (F.col("y") - F.col("x")).between(-size, -1)
    filled = local.select("sub", F.col("i").alias("x"), F.col("j").alias("y"), "v")
    value = F.coalesce("v", F.lit(0.0))
    return at.join(filled, ["sub", "x", "y"], "left").select("pid", "sub", "a", "b", F.when(~gone, value).alias("v"), value.alias("raw"))


def validity(patterns: DataFrame, window_cells: DataFrame, sizes: DataFrame, most_zero: float, most_missing: float) -> DataFrame:
    """Adds undetected, zero (shares) and valid. A pattern in the last row or column is never valid."""
    n = F.count(F.lit(1))
    stats = window_cells.groupBy("pid").agg((F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)) / n).alias("undetected"), F.try_divide(F.sum(F.when(F.col("v") == 0, 1).otherwise(0)), F.count("v")).alias("zero"))
    width = "m" if "m" in sizes.columns else "n"
    joined = patterns.join(stats, "pid").join(sizes if width == "m" else F.broadcast(sizes), "sub")
    inside = (F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < F.col("n") - 1) & (F.col("j") < F.col(width) - 1)
    ok = inside & (F.col("undetected") < most_missing / 100) & F.coalesce(F.col("zero") < most_zero / 100, F.lit(False))
    return joined.withColumn("valid", ok).drop("n", "m")


def pileup(window_cells: DataFrame) -> DataFrame:
    """Mean over windows by cell, missing cells left out."""
    return window_cells.groupBy("a", "b").agg(F.avg("v").alias("mean"))


def symmetric(pile: DataFrame) -> DataFrame:
    """Sum with the transpose, the diagonal once; missing counts as 0."""
    other = pile.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("mean").alias("other"))
    zero = F.lit(0.0)
    own, turned = F.coalesce("mean", zero), F.coalesce("other", zero)
    return pile.join(other, ["a", "b"]).select("a", "b", F.when(F.col("a") == F.col("b"), own).otherwise(own + turned).alias("mean"))


def corner_score(window_cells: DataFrame, size: int) -> DataFrame:
    """By window: mean of the middle 3 x 3 cells minus that of the upper right corner of a third of the size."""
    h, third = size // 2, size // 3
    middle = F.col("a").between(h - 1, h + 1) & F.col("b").between(h - 1, h + 1)
    corner = (F.col("a") < third) & (F.col("b") >= size - third)
    score = F.avg(F.when(middle, F.col("v"))) - F.avg(F.when(corner, F.col("v")))
    return window_cells.groupBy("pid").agg(score.alias("score"))


def bands(window_cells: DataFrame) -> DataFrame:
    """By window and place k: mean of the sums of row k and column k after the window's mean is taken off."""
    mean = window_cells.groupBy("pid").agg(F.avg("v").alias("m"))
    flat = window_cells.join(mean, "pid").withColumn("z", F.col("v") - F.col("m"))
    rows = flat.groupBy("pid", F.col("a").alias("k")).agg(F.sum("z").alias("rows"))
    columns = flat.groupBy("pid", F.col("b").alias("k")).agg(F.sum("z").alias("columns"))
    return rows.join(columns, ["pid", "k"]).select("pid", "k", ((F.col("rows") + F.col("columns")) / 2).alias("band"))


def as_arrays(window_cells: DataFrame, size: int) -> DataFrame:
    """(pid, window): rows of the window as arrays, missing cells null, on the pattern's own row."""
    ordered = F.array_sort(F.collect_list(F.struct("a", "b", "v")))
    flat = window_cells.groupBy("pid").agg(F.transform(ordered, lambda c: c["v"]).alias("flat"))
    return flat.select("pid", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.slice("flat", k * size + 1, size)).alias("window"))


def to_numpy(rows: list, size: int) -> np.ndarray:
    return np.array([[[np.nan if v is None else v for v in row] for row in r["window"]] for r in rows], float).reshape(-1, size, size)
