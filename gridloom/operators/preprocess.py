"""Balancing by weights, marginals, detectable bins, distance law, detrending, scaling, subsampling."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.order_statistics import exact_median
from gridloom.operators.genome import at_bins
from gridloom.scratch import Scratch

#: Detrended values from here on become 1.
OUTLIER = 10.0


def balanced(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """v = count * weight1 * weight2; pixels of bins without a weight go."""
    for k in (1, 2):
        pixels = at_bins(pixels, bins.where("weight IS NOT NULL").select(F.col("bin_id").alias(f"bin{k}_id"), F.col("weight").alias(f"w{k}")), f"bin{k}_id")
    return pixels.withColumn("v", F.col("w1") * F.col("w2") * F.col("count")).drop("w1", "w2")


def raw_values(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """v = count, only between bins with a weight."""
    return erase_missing(pixels, bins.where("weight IS NOT NULL")).withColumn("v", F.col("count"))


def erase_missing(pixels: DataFrame, detectable: DataFrame) -> DataFrame:
    """Pixels whose bins are both in ``detectable`` (bin_id)."""
    for k in (1, 2):
        pixels = at_bins(pixels, detectable.select(F.col("bin_id").alias(f"bin{k}_id")), f"bin{k}_id", "left_semi")
    return pixels


def missing_bins(bins: DataFrame, detectable: DataFrame) -> DataFrame:
    return bins.join(detectable.select("bin_id"), "bin_id", "left_anti").select("bin_id")


def _ends(pixels: DataFrame) -> DataFrame:
    """Each pixel at both of its bins, those of the diagonal once."""
    both = F.when(F.col("bin1_id") == F.col("bin2_id"), F.array("bin1_id")).otherwise(F.array("bin1_id", "bin2_id"))
    return pixels.withColumn("bin_id", F.explode(both))


def marginals(pixels: DataFrame, value: str = "count") -> DataFrame:
    """Sums of the symmetric matrix by bin."""
    return _ends(pixels).groupBy("bin_id").agg(F.sum(value).alias("marginal"))


def degrees(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """Number of filled pixels by bin, zero for empty bins."""
    n = _ends(pixels.where("count <> 0")).groupBy("bin_id").agg(F.count(F.lit(1)).alias("n"))
    return bins.select("bin_id").join(n, "bin_id", "left").select("bin_id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def median_mad(values: DataFrame, column: str) -> DataFrame:
    """One row: median, and the median distance from it; none without values. The values are made once."""
    values = Scratch(values.sparkSession, "spread").keep(values.select(column), "values")
    middle = exact_median(values, [], column)
    apart = values.crossJoin(F.broadcast(middle)).select(F.abs(F.col(column) - F.col("median")).alias("apart"))  # one row
    return middle.crossJoin(exact_median(apart, [], "apart").withColumnRenamed("median", "mad"))


def detectable_intra(pixels: DataFrame, bins: DataFrame, n_mads: float = 3.0) -> DataFrame:
    """Bins with at least max(1, median - n_mads * MAD) filled pixels. Pixels are looked through once: degrees are a table."""
    degree = Scratch(bins.sparkSession, "degrees").keep(degrees(pixels, bins), "degree")
    spread = median_mad(degree, "degree")
    return degree.join(F.broadcast(spread)).where(F.col("degree") >= F.greatest(F.lit(1.0), F.col("median") - n_mads * F.col("mad"))).select("bin_id")


def detectable_inter(cells: DataFrame, n_mads: float = 3.0) -> DataFrame:
    """cells (row_id, col_id, count) of a rectangular map: rows and columns whose sum is over median - n_mads * MAD."""
    out = None
    for axis in ("row", "col"):
        sums = Scratch(cells.sparkSession, "sums").keep(cells.groupBy(F.col(f"{axis}_id").alias("bin_id")).agg(F.sum("count").alias("total")), axis)
        kept = sums.join(F.broadcast(median_mad(sums, "total"))).where(F.col("total") > F.col("median") - n_mads * F.col("mad"))
        kept = kept.select(F.lit(axis).alias("axis"), "bin_id")
        out = kept if out is None else out.unionByName(kept)
    return out


def diag_trim(local: DataFrame, most: int) -> DataFrame:
    """The band 0 <= j - i <= most."""
    return local.where((F.col("j") - F.col("i")).between(0, most))


def distance_law(local: DataFrame, max_dist: int | None = None, fun: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(sub, d, y): an aggregate of positive values by diagonal; ``fun`` is any aggregate of a column. Medians don't gather a
    diagonal."""
    d = (F.col("j") - F.col("i")).alias("d")
    rows = local.where("v > 0").select("sub", d, "v")
    rows = rows if max_dist is None else rows.where(F.col("d").between(0, max_dist))
    if fun is F.median:
        return exact_median(rows, ["sub", "d"], "v").withColumnRenamed("median", "y")
    return rows.groupBy("sub", "d").agg(fun(F.col("v")).alias("y"))


#: Distances of a curve that one task pools.
PART = 65_536


def pool(means: list[float], weights: list[int]) -> list[tuple[int, int, float]]:
    """(first, weight, mean) of the runs that become one level, so that levels never rise."""
    levels: list[tuple[int, int, float]] = []
    for k, (y, n) in enumerate(zip(means, weights, strict=True)):
        first = k
        while levels and levels[-1][2] < y:
            first, n0, y0 = levels.pop()
            y, n = (y0 * n0 + y * n) / (n0 + n), n0 + n
        levels.append((first, n, y))
    return levels


_LEVELS = "sub int, part long, d long, n long, mean double"


def _pool_frame(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("d", ignore_index=True)
    runs = pool(frame["mean"].tolist(), frame["n"].tolist())
    first = frame.iloc[[r[0] for r in runs]]
    return first.assign(n=[r[1] for r in runs], mean=[r[2] for r in runs])[["sub", "part", "d", "n", "mean"]]


def smoothed(law: DataFrame, part: int = PART) -> DataFrame:
    """The closest law that never rises with distance, by pooling neighbours that violate it; nulls and NaN count as zero.

    Curves are cut into parts of ``part`` distances that are pooled apart, to levels that fall. Neighbouring parts are then
    merged, two by two: where the first level on the right lies above the last on the left, the levels between these two
    heights, which lie together around the border, are pooled; all others fall already and stay where they are. What was
    pooled before a merge is pooled after it as well, so any cut gives the same curve. No task holds a curve: it holds a
    part, or the levels of two neighbours between the heights of a border.
    """
    scratch = Scratch(law.sparkSession, "smoothed")
    at = F.floor(F.col("d") / part).alias("part")
    law = scratch.keep(law.select("sub", at, "d", F.coalesce(F.nanvl("y", F.lit(0.0)), F.lit(0.0)).alias("y")), "law")
    last = law.agg(F.max("part")).first()[0] or 0
    levels = law.select("sub", "part", "d", F.lit(1).cast("long").alias("n"), F.col("y").alias("mean")).groupBy("sub", "part").applyInPandas(_pool_frame, _LEVELS)
    if last:
        levels = scratch.keep(levels, "levels")
    width = 1
    while width <= last:
        levels = scratch.keep(_merged(levels, width), "levels")
        width *= 2
    # A level is known in each part that it reaches into: up to the next level of its curve there, the law's last distance at most.
    starts = levels.select("sub", "part", "d", "mean")
    if last:
        carried = Window.partitionBy("sub").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ends = starts.groupBy("sub", "part").agg(F.max_by("mean", "d").alias("end"))
        every = law.select("sub", "part").distinct().join(ends, ["sub", "part"], "left")  # a row a part
        before = every.select("sub", "part", (F.col("part") * part).alias("d"), F.last("end", ignorenulls=True).over(carried).alias("mean"))
        starts = before.where("mean IS NOT NULL").unionByName(starts)
    none = F.lit(None).cast("double")
    both = starts.withColumn("asks", F.lit(0)).unionByName(law.select("sub", "part", "d", none.alias("mean"), F.lit(1).alias("asks")))
    # At the border of a part, a level that starts there comes after the one that is carried over.
    rising = Window.partitionBy("sub", "part").orderBy("d", "asks", F.desc("mean"))
    return both.withColumn("y", F.last("mean", ignorenulls=True).over(rising)).where("asks = 1").select("sub", "d", "y")


def _merged(levels: DataFrame, width: int) -> DataFrame:
    """Falling levels of runs of ``width`` parts to those of runs of twice as many."""
    at = ["sub", "_pair"]
    rows = levels.withColumn("_pair", F.expr(f"part div {2 * width}")).withColumn("_right", F.expr(f"part div {width} % 2 = 1"))
    ends = rows.groupBy(*at).agg(
        F.max_by("mean", F.when(~F.col("_right"), F.col("d"))).alias("_low"), F.min_by("mean", F.when(F.col("_right"), F.col("d"))).alias("_high")
    )
    met = rows.join(ends.where("_low < _high"), at, "left")
    between = F.coalesce(F.when(F.col("_right"), F.col("mean") > F.col("_low")).otherwise(F.col("mean") < F.col("_high")), F.lit(False))
    columns = ["sub", "part", "d", "n", "mean"]
    pooled = met.where(between).select(*columns, "_pair").groupBy(*at).applyInPandas(_pool_frame, _LEVELS)
    return met.where(~between).select(*columns).unionByName(pooled)


def detrend(local: DataFrame, law: DataFrame, max_val: float | None = OUTLIER) -> DataFrame:
    """v / y of its diagonal; values from ``max_val`` on become 1, also where the law is zero; zeros go."""
    ratio = F.try_divide("v", "y")
    joined = local.withColumn("d", F.col("j") - F.col("i")).join(law, ["sub", "d"])
    if max_val is not None:
        ratio = F.when(F.coalesce(ratio, F.lit(float("inf"))) >= max_val, F.lit(1.0)).otherwise(ratio)
    return joined.withColumn("v", ratio).drop("d", "y").where("v IS NOT NULL AND v <> 0")


def inter_scale(local: DataFrame) -> DataFrame:
    """v over the median of stored values of its pair of chromosomes (sub1, sub2).

    Medians are a table, a row a pair: pixels aren't shuffled by pair, of which there may be few, where it can be broadcast.
    """
    middle = Scratch(local.sparkSession, "medians").keep(exact_median(local, ["sub1", "sub2"], "v"), "medians")
    return local.join(middle, ["sub1", "sub2"]).withColumn("v", F.try_divide("v", "median")).drop("median")


def z_transform(local: DataFrame) -> DataFrame:
    """(v - mean) / standard deviation of the stored values of its sub-matrix."""
    stats = local.groupBy("sub").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return local.join(stats, "sub").withColumn("v", F.try_divide(F.col("v") - F.col("mean"), "sd")).drop("mean", "sd")


def _draws(pixels: DataFrame, seed: int) -> DataFrame:
    """One row a contact (bin1_id, bin2_id, n) with a draw of 32 bits: a hash of its pixel, number and seed, the same in any engine."""
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count").cast("long"))).alias("n")
    key = F.concat_ws(":", F.lit(seed), "bin1_id", "bin2_id", "n")
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")
    return pixels.where("count >= 1").select(*[c for c in pixels.columns if c != "count"], one).withColumn("draw", draw)


def _counted(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("bin1_id", "bin2_id").agg(F.count(F.lit(1)).cast("double").alias("count"))


def sample_by_hash(pixels: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each contact is kept if its draw falls below ``share``."""
    return _counted(_draws(pixels, seed).where(F.col("draw") < int(share * (1 << 32))))


#: Draws are counted in so many cells to find where the sample ends.
CELLS = 1 << 16


def subsample(pixels: DataFrame, n_contacts: int, seed: int = 0) -> DataFrame:
    """Exactly ``n_contacts`` contacts without replacement: those with the smallest draws, ties by bins and number.

    One pass counts the draws by cell (a bounded list); all contacts of the cells before the last one are kept, and only
    those of the last cell, a 65,536th of all, are put in order.
    """
    draws = _draws(pixels, seed)
    cell = F.floor(F.col("draw") / ((1 << 32) // CELLS))
    counts = {r["cell"]: r["n"] for r in draws.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if n_contacts > sum(counts.values()):
        raise ValueError("more contacts asked for than there are")
    left, last = n_contacts, -1
    for last in sorted(counts):
        if counts[last] >= left:
            break
        left -= counts[last]
    whole = draws.where(cell < last).select("bin1_id", "bin2_id")
    part = draws.where(cell == last).orderBy("draw", "bin1_id", "bin2_id", "n").limit(left).select("bin1_id", "bin2_id")
    return _counted(whole.unionByName(part))


def subsample_share(pixels: DataFrame, chroms: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each sub-matrix, the whole number of contacts below ``share`` of its sum, without replacement: those with the
    smallest draws.

    Counts by sub-matrix and cell of draws say where each sample ends; only contacts of that cell are put in order.
    """
    from gridloom.operators.genome import to_local

    if not 0 < share <= 1:
        raise ValueError("a share of contacts lies above 0 and is at most 1")
    sub = ["sub1", "sub2"]
    placed = to_local(pixels, chroms, inter=True).select(*sub, "bin1_id", "bin2_id", "count")
    draws = _draws(placed, seed).withColumn("cell", F.floor(F.col("draw") / (1 << 20)))  # 4,096 cells
    rising = Window.partitionBy(*sub).orderBy("cell")
    counts = draws.groupBy(*sub, "cell").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(rising.rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.floor(F.sum("k").over(Window.partitionBy(*sub)) * F.lit(share))
    ends = counts.select(*sub, "cell", (upto - F.col("k")).alias("before"), upto.alias("upto"), wanted.alias("wanted")).where("before < wanted AND upto >= wanted")
    # A row a sub-matrix: no hint, its table decides by its size.
    ends = Scratch(pixels.sparkSession, "share").keep(ends.select(*sub, F.col("cell").alias("last"), (F.col("wanted") - F.col("before")).alias("room")), "ends")
    kept = draws.join(ends, sub)
    whole = kept.where("cell < last").select("bin1_id", "bin2_id")
    place = F.row_number().over(Window.partitionBy(*sub).orderBy("draw", "bin1_id", "bin2_id", "n"))
    part = kept.where("cell = last").withColumn("place", place).where("place <= room").select("bin1_id", "bin2_id")
    return _counted(whole.unionByName(part))
