"""Patterns between chromosomes, found inside the tiles that correlate them: only parts of foci leave a tile.

A thin map has up to 49 windows a pixel, most isolated pixels make a focus, and a focus has a window of 49 cells: as tables
these are many times the map. A tile has all that its windows need, so it groups its candidates, picks the best of each group
and checks its window in place. Groups that lie whole inside a tile leave it only if they are valid patterns; of those that
reach a border shared with another tile their best pixel and their pixels at borders leave it, and meet as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import corr_to_log10p
from gridloom.operators import correlate, foci
from gridloom.scratch import Scratch

_NAMES = ("sub", "kernel_id", "root", "size", "i", "j", "r", "n_obs", "valid", "window", "edges")
_PARTS = "kernel_id int, root long, size long, i long, j long, r double, n_obs double, valid boolean, window array<double>, edges array<long>"


def _reached(x: np.ndarray, y: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which points (x, y) lie in a 4-connected group with one of ``seeds``: a walk from these, a step at a time."""
    if not seeds.any():
        return seeds
    wide = int(y.max()) + 3
    place = (x + 1) * wide + y + 1
    number = np.full((int(x.max()) + 3) * wide, -1, np.int32)
    number[place] = np.arange(len(x))
    reached, front = seeds.copy(), np.flatnonzero(seeds)
    while len(front):
        beside = number[(place[front][:, None] + np.array([1, -1, wide, -wide])).ravel()]
        beside = beside[beside >= 0]
        front = np.unique(beside[~reached[beside]])
        reached[front] = True
    return reached


class _Tile:
    """Pixels of a tile and its halo, for the windows around its cells (x, y), which count from the tile's first."""

    def __init__(self, frame: pd.DataFrame, seen: list[np.ndarray], size: int, tile: int, origin: tuple[int, int], shape: tuple[int, int]):
        h = size // 2
        self.size, self.tile, self.origin, self.shape = size, tile, origin, shape
        self.values = np.zeros((tile + 2 * h, tile + 2 * h))
        self.values[frame["i"].to_numpy() - origin[0] + h, frame["j"].to_numpy() - origin[1] + h] = frame["v"].to_numpy()
        self.rows, self.columns = seen
        self.area = np.zeros((tile + 2 * h + 1, tile + 2 * h + 1), np.int32)
        self.area[1:, 1:] = (self.values != 0).cumsum(0, dtype=np.int32).cumsum(1, dtype=np.int32)

    def filled(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, s = self.area, self.size
        return a[x + s, y + s] - a[x, y + s] - a[x + s, y] + a[x, y]

    def valid(self, x: np.ndarray, y: np.ndarray, observed: np.ndarray, most_zero: float, most_missing: float) -> np.ndarray:
        """As ``windows.validity``: the last row and column are never valid, nor is a window that is mostly missing or empty."""
        cells = float(self.size**2)
        inside = (x + self.origin[0] < self.shape[0] - 1) & (y + self.origin[1] < self.shape[1] - 1)
        return inside & ((cells - observed) / cells < most_missing / 100) & ((observed - self.filled(x, y)) / observed < most_zero / 100)

    def open(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells beside another tile of the matrix."""
        out = np.zeros(len(x), bool)
        for v, o, n in ((x, self.origin[0], self.shape[0]), (y, self.origin[1], self.shape[1])):
            out |= ((v == 0) & (o > 0)) | ((v == self.tile - 1) & (v + o + 1 < n))
        return out

    def window(self, x: int, y: int) -> np.ndarray:
        """Cells of a window by rows, NaN where missing."""
        s = self.size
        return np.where(self.rows[x : x + s, None] & self.columns[None, y : y + s], self.values[x : x + s, y : y + s], np.nan).ravel()


def _parts(t: _Tile, i: np.ndarray, j: np.ndarray, r: np.ndarray, observed: np.ndarray, most_zero: float, most_missing: float) -> Iterator[tuple]:
    """Candidates in row-major order to rows (root, size, i, j, r, n_obs, valid, window, edges), one a group that leaves the tile."""
    x, y = i - t.origin[0], j - t.origin[1]
    valid, edge = t.valid(x, y, observed, most_zero, most_missing), t.open(x, y)
    # A group without a valid window has no valid best pixel: if it is closed as well, nothing comes of it.
    some = _reached(x, y, valid | edge)
    x, y, i, j, r, observed, valid, edge = (a[some] for a in (x, y, i, j, r, observed, valid, edge))
    if not len(x):
        return
    flat = i * foci.WIDTH + j
    root = foci.roots(flat)
    order = np.lexsort((flat, -r, root))
    starts = np.flatnonzero(np.diff(root[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        best, group = order[a], order[a:b]
        borders = flat[group[edge[group]]]
        if len(borders) or (valid[best] and b - a >= foci.LEAST):
            window = t.window(x[best], y[best]) if valid[best] else None
            yield root[best], b - a, i[best], j[best], r[best], observed[best], valid[best], window, borders if len(borders) else None


def valid_foci(local: DataFrame, kernel: DataFrame, sizes: DataFrame, missing_rows: DataFrame, missing_columns: DataFrame, size: int, threshold: float, most_zero: float, most_missing: float, factors: list | None = None, tile: int | None = None, most: int = foci.MOST_LINKS) -> DataFrame:
    """(sub, kernel_id, label, i, j, r, n_obs, log10_p, window): the best pixel of each focus between chromosomes whose window is
    valid, with the cells of the window by rows, null where missing. ``label`` is the number of the focus' first pixel, so it
    grows as that of ``foci.label`` does.

    Same as ``foci.label`` of the correlation's candidates, ``foci.sized``, ``foci.best_pixel`` and ``windows.validity``.
    """
    scratch, base = Scratch(local.sparkSession, "areas"), ["sub", "kernel_id"]
    tile = tile or correlate.area_tile(sizes)
    grids = correlate.grids(kernel, size)

    def each(sub: int, frame: pd.DataFrame, seen: list[np.ndarray], origin: tuple[int, int], shape: tuple[int, int]) -> pd.DataFrame:
        t, rows = _Tile(frame, seen, size, tile, origin, shape), []
        for kernel_id, i, j, r, observed in correlate.area_points(frame, *seen, size, grids, factors, most_missing / 100, correlate.EPS, tile, origin, shape):
            enough = r >= threshold
            rows += [(sub, kernel_id, *p) for p in _parts(t, *(a[enough] for a in (i, j, r, observed)), most_zero, most_missing)]
        return pd.DataFrame(rows, columns=_NAMES)

    parts = correlate.on_area_tiles(local, size, sizes, missing_rows, missing_columns, each, _PARTS, tile)
    known = F.transform("window", lambda v: F.when(~F.isnan(v), v))
    parts = scratch.keep(parts.withColumn("window", known), "parts")
    edges = parts.where("edges IS NOT NULL").select(*base, "root", F.explode("edges").alias("flat"))
    last = lambda c: c % tile == tile - 1
    below = edges.where(last(F.floor(F.col("flat") / foci.WIDTH))).withColumn("flat", F.col("flat") + foci.WIDTH)
    right = edges.where(last(F.col("flat") % foci.WIDTH)).withColumn("flat", F.col("flat") + 1)
    links = below.unionByName(right).join(edges.withColumnRenamed("root", "other"), [*base, "flat"]).select(*base, "root", "other").distinct()
    open_ = parts.where("edges IS NOT NULL").join(foci.merged(links, scratch, most), [*base, "root"], "left")
    best = F.max_by(F.struct("i", "j", "r", "n_obs", "valid", "window"), F.struct("r", -F.col("i"), -F.col("j"))).alias("b")
    met = open_.groupBy(*base, F.coalesce("first", "root").alias("label")).agg(F.sum("size").alias("size"), best)
    found = met.where((F.col("size") >= foci.LEAST) & F.col("b.valid")).select(*base, "label", "b.i", "b.j", "b.r", "b.n_obs", "b.window")
    found = found.unionByName(parts.where("edges IS NULL").withColumnRenamed("root", "label").select(found.columns))
    return found.withColumn("log10_p", corr_to_log10p(F.col("r"), F.col("n_obs")))
