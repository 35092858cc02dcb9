"""Greedy removal of close patterns: the best stays and drops all within the separation, dropped ones drop nothing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.scratch import Scratch

#: Rows and columns of a tile of the first round, and its margin, in separations.
SIDE, MARGIN = 128, 8
#: From one round to the next a tile's side grows so many times, as long as no tile gets more points than MOST.
GROWTH, MOST = 8, 1_000_000
GONE, STAYS, OPEN = 0, 1, 2


def walk(x: np.ndarray, y: np.ndarray, sure: np.ndarray, separation: int) -> np.ndarray:
    """States of points in rank order: GONE beside a better one that stays, OPEN beside a better one that is open (or where
    not ``sure``: a better one may lie out of sight), else STAYS.

    Points lie in cells of the separation's size, so only nine cells matter, and a cell holds one that stays at most.
    """
    out = np.empty(len(x), np.int8)
    stays: dict[tuple[int, int], tuple[int, int]] = {}
    open_: dict[tuple[int, int], list[tuple[int, int]]] = {}
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for k, (px, py, known) in enumerate(zip(x.tolist(), y.tolist(), sure.tolist(), strict=True)):
        cx, cy = px // separation, py // separation
        state = STAYS if known else OPEN
        for a, b in around:
            q = stays.get((cx + a, cy + b))
            if q is not None and abs(q[0] - px) < separation and abs(q[1] - py) < separation:
                state = GONE
                break
        else:
            if open_ and state == STAYS and any(abs(qx - px) < separation and abs(qy - py) < separation for a, b in around for qx, qy in open_.get((cx + a, cy + b), ())):
                state = OPEN
        out[k] = state
        if state == STAYS:
            stays[cx, cy] = (px, py)
        elif state == OPEN:
            open_.setdefault((cx, cy), []).append((px, py))
    return out


def _decided(points: DataFrame, separation: int, side: int, margin: int, shift: int) -> DataFrame:
    """points (place, bin1, bin2) that stay or are open after each tile of ``side`` bins was walked, with ``state``, and
    whether they lie at the ``edge`` of their tile, near points of others."""
    cell = lambda c, off: F.floor((F.col(c) + shift + off) / side)
    seen = points
    for axis, name in (("bin1", "t1"), ("bin2", "t2")):
        seen = seen.withColumn(name, F.explode(F.sequence(cell(axis, -margin), cell(axis, margin))))

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", ignore_index=True)
        x, y = frame["bin1"].to_numpy(), frame["bin2"].to_numpy()
        low = [int(t) * side - shift for t in key]
        # Better ones may lie out of sight of points near the outer edge of the margin.
        inner = lambda v, a: (v - separation >= a - margin - 1) & (v + separation <= a + side + margin)
        own = (x >= low[0]) & (x < low[0] + side) & (y >= low[1]) & (y < low[1] + side)
        state = walk(x, y, inner(x, low[0]) & inner(y, low[1]), separation)
        beside = lambda v, a: (v < a + separation) | (v >= a + side - separation)
        edge = beside(x, low[0]) | beside(y, low[1])
        return frame[["place", "bin1", "bin2"]].assign(state=state, edge=edge)[own & (state != GONE)]

    return seen.groupBy("t1", "t2").applyInPandas(each, "place long, bin1 long, bin2 long, state byte, edge boolean")


def _still_open(decided: DataFrame, separation: int) -> DataFrame:
    """Open points without one that stays beside them: another tile may know more of it. An equi-join on grid cells."""
    cell = lambda c: F.floor(F.col(c) / separation)
    points = decided.where(F.col("state") == OPEN).select("place", "bin1", "bin2")
    around = F.array(*[F.struct((cell("bin1") + a).alias("c1"), (cell("bin2") + b).alias("c2")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asks = points.select("place", "bin1", "bin2", F.explode(around).alias("c")).select("place", "bin1", "bin2", "c.*")
    stays = decided.where((F.col("state") == STAYS) & F.col("edge")).select(F.col("bin1").alias("x"), F.col("bin2").alias("y"), cell("bin1").alias("c1"), cell("bin2").alias("c2"))
    close = (F.abs(F.col("bin1") - F.col("x")) < separation) & (F.abs(F.col("bin2") - F.col("y")) < separation)
    return points.join(asks.join(stays, ["c1", "c2"]).where(close).select("place"), "place", "left_anti")


def remove_neighbours(patterns: DataFrame, separation: int, order: list | None = None, side: int | None = None, most: int = MOST) -> DataFrame:
    """patterns (bin1, bin2, score, …) without close worse ones; ties by bin1, bin2, kernel_id, iteration as far as there.

    Equal to the one-by-one greedy walk under that strict order. Tiles of ``side`` bins are walked apart, each with a
    margin; a point stays or goes once all better ones near it are decided, and is open otherwise. Open points are few where
    scores vary, since chains of ever better neighbours are short, and lie at borders. Those beside a point that another
    tile knows to stay go; the rest are a problem of the same kind again (what is decided can't touch them), so the next
    round takes larger tiles, one for all once they are no more than ``most``.
    On a plateau a chain may run through all points: a round then decides at least a tile of ``most`` points of each chain,
    so a chain of k points takes about log(k) + k / most rounds; it can't be walked from both ends.
    """
    scratch = Scratch(patterns.sparkSession, "suppression")
    ties = [F.col(c) for c in ("bin1", "bin2", "kernel_id", "iteration") if c in patterns.columns]
    # Numbers that grow along the order, without gathering the patterns in one partition: the sort deals them out by range.
    whole = patterns.orderBy(*(order or [F.desc("score"), *ties])).withColumn("_place", F.monotonically_increasing_id())
    whole = scratch.keep(whole, "placed")
    points = whole.select(F.col("_place").alias("place"), F.col("bin1").cast("long").alias("bin1"), F.col("bin2").cast("long").alias("bin2"))
    side, margin, shift = side or SIDE * separation, MARGIN * separation, 0
    kept = []
    while True:
        decided = scratch.keep(_decided(points, separation, side, margin, shift), "decided")
        kept.append(decided.where(F.col("state") == STAYS).select("place"))
        points = scratch.keep(_still_open(decided, separation), "open")
        seen = points.agg(F.count(F.lit(1)), F.min("bin1"), F.max("bin1"), F.min("bin2"), F.max("bin2")).first()
        if not seen[0]:
            break
        if seen[0] <= most:
            # One tile for the rest.
            shift = margin + 1 - min(seen[1], seen[3])
            side = max(seen[2], seen[4]) + shift + margin + 1
            continue
        wider = points.groupBy(*[F.floor(F.col(c) / (side * GROWTH)) for c in ("bin1", "bin2")]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if wider <= most:
            side, shift = side * GROWTH, 0
        else:
            shift = side // 2 if not shift else 0  # the same size: borders move
    return whole.join(reduce(DataFrame.unionByName, kept).withColumnRenamed("place", "_place"), "_place", "left_semi").drop("_place")


def farther_than(patterns: DataFrame, least: float) -> DataFrame:
    """Patterns of one chromosome closer than ``least`` base pairs go; those of two chromosomes stay."""
    return patterns.where((F.col("chrom1") != F.col("chrom2")) | (F.abs(F.col("start2") - F.col("start1")) >= least))


def best_kernel(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best score for each position, null scores last; repeated positions become one."""
    rest = [c for c in scored.columns if c not in keys]
    order = F.struct(F.col("score").isNotNull(), F.coalesce("score", F.lit(0.0)), -F.col("kernel_id"))
    return scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")
