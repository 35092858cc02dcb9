"""Benjamini-Hochberg, p-values of correlations, rank glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of erfc with a relative error below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log10_two_sided(z: Column) -> Column:
    """log10 of 2 * Phi(-|z|); never underflows, stays inside generated code."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + F.lit(c)
    return (F.log(t) - x * x + poly) / F.lit(2.302585092994046)


def corr_to_log10p(r: Column, n: Column, rho0: float = 0.0) -> Column:
    """Fisher's z test of a correlation against ``rho0``; null for n <= 3, minus infinity never: |r| = 1 is taken just below."""
    inside = F.greatest(F.least(r, F.lit(1.0 - 1e-12)), F.lit(-1.0 + 1e-12))
    z = (F.atanh(inside) - F.atanh(F.lit(rho0))) * F.sqrt(n - 3)
    return F.when(n > 3, log10_two_sided(z))


def benjamini_hochberg(rows: DataFrame, p: str = "pvalue", q: str = "qvalue", partition: list[str] | None = None) -> DataFrame:
    """Adds q-values; null p-values take no part and get null. ``partition`` ranks groups apart.

    Equal p-values are counted first. The order of the distinct ones is cut into cells by 256ths and by sixteenths of a
    decade, both of which grow with p; sums before and least values behind a cell come from the cells, some thousand rows
    at most, so no task sees all p-values.
    """
    group = list(partition or [])
    cell = [*group, "_a", "_b"]
    counts = rows.where(F.col(p).isNotNull()).groupBy(*group, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    decade = F.when(F.col("_p") > 0, F.least(F.floor(F.log10("_p") * -16), F.lit(6000).cast("long"))).otherwise(6000)
    counts = counts.withColumn("_a", F.floor(F.col("_p") * 256)).withColumn("_b", -decade)
    every, rise = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_a", "_b")
    before = F.coalesce(F.sum("_t").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.groupBy(*cell).agg(F.sum("_n").alias("_t")).select(*cell, before.alias("_before"), F.sum("_t").over(every).alias("_m"))
    up, down = Window.partitionBy(*cell).orderBy("_p"), Window.partitionBy(*cell).orderBy(F.desc("_p"))
    rank = F.col("_before") + F.sum("_n").over(up)  # the last of equal p-values
    raw = counts.join(cells, cell).withColumn("_raw", F.col("_p") * F.col("_m") / rank)
    fall = Window.partitionBy(*group).orderBy(F.desc("_a"), F.desc("_b"))
    least = raw.groupBy(*cell).agg(F.min("_raw").alias("_low")).select(*cell, F.min("_low").over(fall.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    known = raw.join(least, cell).select(*group, "_p", F.least(F.lit(1.0), F.min("_raw").over(down), F.coalesce("_later", F.lit(1.0))).alias(q))
    known = known.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_p", q)
    met = F.col(p) == F.col("_p")
    for c in group:
        met = met & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(known, met, "left").drop("_p", *[f"_of_{c}" for c in group])


def rank_glyphs(cells: DataFrame, value: str, glyphs: str = " .:-=+*#%@") -> DataFrame:
    """A glyph by the share of values below: strict-less rank over the count, in tenths."""
    share = (F.rank().over(Window.partitionBy(F.lit(1)).orderBy(value)) - 1) * len(glyphs) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    at = F.floor(share).cast("int")
    return cells.withColumn("level", at).withColumn("glyph", F.substring(F.lit(glyphs), at + 1, F.lit(1)))
