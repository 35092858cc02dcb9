"""Contacts drawn without replacement from pixel counts: work by pixels, however many contacts they hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.genome import to_local
from gridloom.scratch import Scratch

#: Pixels of a leaf on average.
LEAF = 50_000
#: From here on numpy draws no hypergeometric numbers.
_LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are good. Beyond numpy's range by inversion over twelve standard
    deviations around the mean (what lies outside has a probability below 1e-30)."""
    total = good + bad
    if total < _LARGE:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * (good / total)
    reach = 12 * (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5 + 10
    low, high = max(0, n - bad, int(mean - reach)), min(n, good, int(mean + reach) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    odds = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(odds - odds.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` contacts come from each of ``counts``: halves, halves of these, and so on down a tree."""
    out = np.zeros(len(counts), np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    todo = [(0, len(counts), int(n))]
    while todo:
        low, high, take = todo.pop()
        total = int(upto[high] - upto[low])
        if take == 0:
            continue
        if take == total:
            out[low:high] = counts[low:high]
        elif high - low == 1:
            out[low] = take
        elif total < _LARGE:
            out[low:high] = rng.multivariate_hypergeometric(counts[low:high], take, method="marginals")
        else:
            middle = (low + high) // 2
            left = int(upto[middle] - upto[low])
            first = hypergeometric(rng, left, total - left, take)
            todo += [(middle, high, take - first), (low, middle, first)]
    return out


def draw_contacts(pixels: DataFrame, wanted: Column, seed: int = 0, by: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """(bin1_id, bin2_id, count) of contacts drawn without replacement from pixels with whole counts, exactly ``wanted`` of
    each group (an expression over its ``total``). ``by`` are whole numbers.

    A seeded tree splits a group's draw among leaves (pixels by a hash of their bins, as many leaves as the group's pixels
    need) and a leaf's among its pixels in order, so the result depends on seed and pixels, not on how they lie. A group's
    leaves meet in one task: a row for each ``leaf`` pixels.
    """
    scratch = Scratch(pixels.sparkSession, "draws")
    by = list(by or [])
    keys = by or ["_all"]
    rows = pixels.where("count >= 1").select(*(by or [F.lit(0).alias("_all")]), "bin1_id", "bin2_id", F.col("count").cast("long").alias("n"))
    rows = scratch.keep(rows, "pixels")
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / leaf).alias("_leaves"), F.sum("n").alias("total"))
    sizes = scratch.keep(sizes.withColumn("_wanted", wanted.cast("long")), "sizes")
    if not sizes.where(F.col("_wanted") > F.col("total")).isEmpty():
        raise ValueError("more contacts asked for than there are")
    dealt = rows.join(sizes.select(*keys, "_leaves"), keys).withColumn("_leaf", F.pmod(F.xxhash64("bin1_id", "bin2_id"), F.col("_leaves"))).drop("_leaves")
    totals = dealt.groupBy(*keys, "_leaf").agg(F.sum("n").alias("n")).join(sizes.select(*keys, "_wanted"), keys)
    number = lambda key: np.random.default_rng([seed & (2**63 - 1), *(int(k) & (2**63 - 1) for k in key)])

    def by_leaf(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_leaf")
        return frame.assign(_take=split(number(key), frame["n"].to_numpy(), frame["_wanted"].iloc[0]))[[*keys, "_leaf", "_take"]]

    def by_pixel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bin1_id", "bin2_id"])
        count = split(number([*key, 1]), frame["n"].to_numpy(), frame["_take"].iloc[0])
        return frame.assign(count=count.astype(float))[["bin1_id", "bin2_id", "count"]][count > 0]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    takes = scratch.keep(totals.groupBy(*keys).applyInPandas(by_leaf, f"{kinds}, _leaf long, _take long"), "takes")
    met = dealt.join(takes.where(F.col("_take") > 0), [*keys, "_leaf"])
    return met.groupBy(*keys, "_leaf").applyInPandas(by_pixel, "bin1_id long, bin2_id long, count double")


def draw_share(pixels: DataFrame, chroms: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each sub-matrix, the whole number of contacts below ``share`` of its sum, without replacement."""
    if not 0 < share <= 1:
        raise ValueError("a share of contacts lies above 0 and is at most 1")
    local = to_local(pixels.select("bin1_id", "bin2_id", "count"), chroms, inter=True)
    return draw_contacts(local, F.floor(F.col("total") * F.lit(share)), seed, ["sub1", "sub2"])
