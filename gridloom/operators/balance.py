"""Iterative correction: weights that give all detectable bins equal marginals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.operators.preprocess import degrees, marginals, median_mad
from gridloom.scratch import Scratch

IGNORED_DIAGONALS = 2
LEAST_FILLED = 10
TOLERANCE = 1e-5


def usable_pixels(pixels: DataFrame, bins: DataFrame, inter: bool = False) -> DataFrame:
    """Without the first diagonals; of one chromosome each unless ``inter``."""
    kept = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= IGNORED_DIAGONALS)
    if inter:
        return kept
    for k in (1, 2):
        kept = kept.join(bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("chrom").alias(f"_chrom{k}")), f"bin{k}_id")
    return kept.where("_chrom1 = _chrom2").select("bin1_id", "bin2_id", "count")


def usable_bins(pixels: DataFrame, bins: DataFrame, n_mads: float = 5.0, least: int = LEAST_FILLED) -> DataFrame:
    """Bins with enough filled pixels and a log marginal not far below the median."""
    filled = degrees(pixels, bins).where(F.col("degree") >= least).select("bin_id")
    logs = marginals(pixels).join(filled, "bin_id").where("marginal > 0").select("bin_id", F.log("marginal").alias("log"))
    return logs.join(F.broadcast(median_mad(logs, "log"))).where(F.col("log") >= F.col("median") - n_mads * F.col("mad")).select("bin_id")


def correction_round(pixels: DataFrame, bias: DataFrame) -> DataFrame:
    """bias (bin_id, b) to (bin_id, b, m): b divided by its marginal over the mean of the marginals that aren't zero."""
    weighed = pixels
    for k in (1, 2):
        weighed = weighed.join(bias.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("b").alias(f"b{k}")), f"bin{k}_id")
    own = marginals(weighed.withColumn("v", F.col("b1") * F.col("b2") * F.col("count")), "v")
    mean = own.where("marginal <> 0").agg(F.avg("marginal").alias("mean"))
    joined = bias.join(own, "bin_id", "left").join(F.broadcast(mean))
    m = F.coalesce(F.nullif(F.try_divide("marginal", "mean"), F.lit(0.0)), F.lit(1.0))
    return joined.select("bin_id", (F.col("b") / m).alias("b"), m.alias("m"))


def _both_ways(pixels: DataFrame, folder: str, buckets: int) -> str:
    """A table (i, j, count) of each pixel from both of its bins, bucketed by j: the name of the table."""
    turned = pixels.where("bin1_id <> bin2_id").select(F.col("bin2_id").alias("i"), F.col("bin1_id").alias("j"), "count")
    rows = pixels.select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count").unionByName(turned)
    name = f"gridloom_pixels_{uuid.uuid4().hex}"
    rows.repartition(buckets, "j").write.bucketBy(buckets, "j").sortBy("j").option("path", folder).saveAsTable(name)
    return name


def marginals_of(both: DataFrame, bias: DataFrame) -> DataFrame:
    """bias (bin_id, b) to (bin_id, b, own): own is the bin's sum of b * count * b over its pixels.

    The pixels lie in buckets by j and meet the bias of j there; what is shuffled is the bias and the partial sums by i.
    """
    side = bias.select(F.col("bin_id").alias("j"), F.col("b").alias("_b"))
    sums = both.join(side, "j").groupBy("i").agg(F.sum(F.col("count") * F.col("_b")).alias("_s"))
    return bias.join(sums.withColumnRenamed("i", "bin_id"), "bin_id", "left").select("bin_id", "b", (F.col("b") * F.col("_s")).alias("own"))


def ice(pixels: DataFrame, bins: DataFrame, iterations: int = 200, n_mads: float = 5.0, inter: bool = False, least: int = LEAST_FILLED, tolerance: float = TOLERANCE) -> DataFrame:
    """bins with new weights (null where masked).

    Pixels are shuffled once, into a bucketed table with each pixel under both of its bins; a round joins it to the bias
    without an exchange of pixels and ends in a table of one row a bin. Only the spread of the marginals comes to the driver.
    """
    spark = pixels.sparkSession
    scratch = Scratch(spark, "balance")
    kept = usable_pixels(pixels, bins, inter)
    kept = scratch.keep(kept, "usable")
    good = usable_bins(kept, bins, n_mads, least)
    good = scratch.keep(good, "bins")
    for k in (1, 2):
        kept = kept.join(good.select(F.col("bin_id").alias(f"bin{k}_id")), f"bin{k}_id", "left_semi")
    name = _both_ways(kept, f"{scratch.path}/pixels", int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        both = spark.table(name)
        marginal = F.when(F.col("own") != 0, F.col("own"))
        sums = [F.count(F.lit(1)).alias("bins"), F.count(marginal).alias("n"), F.sum(marginal).alias("s"), F.sum(marginal * marginal).alias("q")]

        def written(bias: DataFrame) -> tuple[DataFrame, float, float]:
            """A round's table, the mean marginal, and the variance of marginals over it (empty ones count as the mean);
            the sums are taken while the table is written."""
            seen = Observation()
            table = scratch.keep(marginals_of(both, bias).observe(seen, *sums), "marginals")
            of = seen.get
            if not of["n"]:
                return table, 1.0, 0.0
            mean = of["s"] / of["n"]
            return table, mean, (of["q"] / mean**2 + of["bins"] - of["n"]) / of["bins"] - 1

        state, mean, spread = written(good.withColumn("b", F.lit(1.0)))
        for _ in range(iterations):
            last = spread < tolerance
            before, (state, mean, spread) = state, written(state.select("bin_id", (F.col("b") / F.coalesce(marginal / F.lit(mean), F.lit(1.0))).alias("b")))
            scratch.forget(before)
            if last:
                break
        weights = state.select("bin_id", (F.col("b") / F.lit(mean**0.5)).alias("weight"))
        return bins.drop("weight").join(weights, "bin_id", "left")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def normalise(cmap, norm: str = "auto", **options):
    """auto and raw keep weights that are there, force computes them anew; returns a map with weights."""
    from dataclasses import replace

    if norm not in ("auto", "raw", "force"):
        raise ValueError("norm is auto, raw or force")
    if norm != "force" and cmap.bins.where("weight IS NOT NULL").limit(1).count():
        return cmap
    return replace(cmap, bins=ice(cmap.pixels, cmap.bins, **options))
