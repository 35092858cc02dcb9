"""Foci: 4-connected groups of pixels over a threshold, their sizes and best pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import component_of
from gridloom.operators.ordering import numbered
from gridloom.scratch import Scratch


def candidates(corr: DataFrame, threshold: float) -> DataFrame:
    return corr.where((F.col("r") >= threshold) & (F.col("r") != 0))


def adjacency(pixels: DataFrame) -> DataFrame:
    """Links of each pixel to its right and lower neighbour, by two ordered scans instead of self-joins."""
    base = ["sub", "kernel_id"]
    out = None
    for fixed, moving in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(*base, fixed).orderBy(moving)
        step = pixels.select(*base, "i", "j").withColumn("next", F.lead(moving).over(w)).where(F.col("next") == F.col(moving) + 1)
        i2, j2 = ("i", "next") if moving == "j" else ("next", "j")
        step = step.select(*base, "i", "j", F.col(i2).alias("i2"), F.col(j2).alias("j2"))
        out = step if out is None else out.unionByName(step)
    return out


#: Rows and columns of a tile that is labelled in one step.
TILE = 1024
#: Pixels are numbered by row * WIDTH + column.
WIDTH = 1 << 31
#: Pixels of a focus at least.
LEAST = 2


def roots(flat: np.ndarray) -> np.ndarray:
    """For sorted row-major pixel numbers: the number of the first pixel of each one's 4-connected group."""
    low = np.arange(len(flat))
    links = []
    for step in (1, WIDTH):
        at = np.minimum(np.searchsorted(flat, flat + step), len(flat) - 1)
        hit = np.flatnonzero(flat[at] == flat + step)
        links.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    return flat[_least(low, a, b)]


def _least(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label of each component of links (a, b): take the least of neighbours, then the label's own label."""
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        for end in (a, b, low[a], low[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


#: Links of a sub-matrix and kernel between groups of its tiles that one task may merge.
MOST_LINKS = 1_000_000


def _type(rows: DataFrame) -> str:
    """Sub-matrices are numbered by integers, pairs of chromosomes by longs."""
    return rows.schema["sub"].dataType.simpleString()


def merged(links: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """links (sub, kernel_id, root, other) between groups of tiles to (sub, kernel_id, root, first): the first pixel of each
    one's whole group. Where a sub-matrix has more than ``most`` links, all are contracted in tables."""
    base = ["sub", "kernel_id"]
    links = scratch.keep(links, "links")
    largest = links.groupBy(*base).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        node = lambda c: F.struct(*base, F.col(c).alias("root"))
        heads = component_of(links.select(node("root").alias("a"), node("other").alias("b")), scratch)
        first = heads.groupBy("head").agg(F.min("node.root").alias("first"))
        return heads.join(first, "head").select("node.*", "first")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        roots, ends = np.unique(frame[["root", "other"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        low = _least(np.arange(len(roots)), ends[:, 0], ends[:, 1])
        return pd.DataFrame({"sub": frame["sub"].iloc[0], "kernel_id": frame["kernel_id"].iloc[0], "root": roots, "first": roots[low]})

    return links.groupBy(*base).applyInPandas(merge, f"sub {_type(links)}, kernel_id int, root long, first long")


def label(pixels: DataFrame, tile: int = TILE, most: int = MOST_LINKS) -> DataFrame:
    """Adds ``label``: foci of a sub-matrix and kernel numbered from 1 by their first pixel in row-major order.

    Tiles are labelled apart, with a margin of one pixel from the tiles before; pixels of the margin, which two tiles
    have, link the groups of both. Foci are numbered by a sort dealt out by range, not by a window over a chromosome.
    """
    scratch = Scratch(pixels.sparkSession, "foci")
    base = ["sub", "kernel_id"]
    placed = pixels.withColumn("flat", F.col("i") * WIDTH + F.col("j")).withColumn("ti", F.floor(F.col("i") / tile)).withColumn("tj", F.floor(F.col("j") / tile))
    last = lambda c: F.col(c) % tile == tile - 1
    at = lambda i, j, ghost: F.struct((F.col("ti") + i).alias("ti"), (F.col("tj") + j).alias("tj"), F.lit(ghost).alias("ghost"))
    homes = F.filter(F.array(at(0, 0, False), F.when(last("i"), at(1, 0, True)), F.when(last("j"), at(0, 1, True))), lambda x: x.isNotNull())
    spread = placed.select(*base, "flat", F.explode(homes).alias("h")).select(*base, "flat", "h.*")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("flat", ignore_index=True)
        return frame.assign(root=roots(frame["flat"].to_numpy()))[[*base, "flat", "ghost", "root"]]

    local = scratch.keep(spread.groupBy(*base, "ti", "tj").applyInPandas(each, f"sub {_type(pixels)}, kernel_id int, flat long, ghost boolean, root long"), "tiles")
    own = local.where("NOT ghost").drop("ghost")
    links = local.where("ghost").select(*base, "flat", F.col("root").alias("other")).join(own, [*base, "flat"]).where("root <> other").select(*base, "root", "other").distinct()
    rooted = own.join(merged(links, scratch, most), [*base, "root"], "left").select(*base, "flat", F.coalesce("first", "root").alias("first"))
    firsts = rooted.where(F.col("flat") == F.col("first")).select(*base, "first")  # a group's first pixel names it
    numbers = numbered(firsts, [*base, "first"], lambda x: scratch.keep(x, "firsts"), "label", base)
    labels = rooted.join(numbers, [*base, "first"]).drop("first")
    return placed.drop("ti", "tj").join(labels, [*base, "flat"]).drop("flat")


def sized(labelled: DataFrame, least: int = LEAST) -> DataFrame:
    """Foci of at least ``least`` pixels."""
    n = F.count(F.lit(1)).over(Window.partitionBy("sub", "kernel_id", "label"))
    return labelled.withColumn("size", n).where(F.col("size") >= least)


def best_pixel(labelled: DataFrame) -> DataFrame:
    """The largest correlation of each focus, the first in row-major order of equals."""
    rest = [c for c in labelled.columns if c not in ("sub", "kernel_id", "label")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("r"), -F.col("i"), -F.col("j"))).alias("b")
    return labelled.groupBy("sub", "kernel_id", "label").agg(best).select("sub", "kernel_id", "label", "b.*")


def snap_to_diagonal(patterns: DataFrame, max_dist: float) -> DataFrame:
    """Patterns of presets without distance lie on the diagonal."""
    return patterns.withColumn("i", F.col("j")) if max_dist == 0 else patterns
