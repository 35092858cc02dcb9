"""Cross-correlation of sparse bands with small kernels, missing cells left out, by two plans with equal results.

``scatter``: each pixel meets each kernel cell (a broadcast of at most a few thousand rows) and adds to an output pixel;
partial sums before the only shuffle. ``tile``: each pixel goes to the tiles whose halo holds it and a tile is a dense
numpy block; for wide kernels and large maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import corr_to_log10p
from gridloom.sources.kernels import small_frame

#: Sums closer to zero than this become zero.
EPS = 1e-4
#: Denominators below this make the correlation zero.
LEAST_DENOMINATOR = 1e-10
TILE = 256
#: Windows whose kernel sums are taken at once.
CHUNK = 1 << 17


def snapped(x: Column, eps: float = EPS) -> Column:
    return F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x) if eps else x


def scatter_sums(local: DataFrame, kernel: DataFrame, max_dist: int | None, intra: bool = True) -> DataFrame:
    """Window sums by output pixel: (sub, kernel_id, i, j, vk, v1, v2); only the band is put out."""
    # The kernel is bounded: at most 31 x 31 rows for each kernel.
    spread = local.where("v <> 0").join(F.broadcast(kernel)).select("sub", "kernel_id", (F.col("i") - F.col("di")).alias("i"), (F.col("j") - F.col("dj")).alias("j"), "v", "w")
    spread = spread.where("i >= 0 AND j >= 0")
    if intra:
        spread = spread.where("j >= i")
        spread = spread if max_dist is None else spread.where(F.col("j") - F.col("i") <= max_dist)
    sums = (F.sum(F.col("v") * F.col("w")).alias("vk"), F.sum("v").alias("v1"), F.sum(F.col("v") * F.col("v")).alias("v2"))
    return spread.groupBy("sub", "kernel_id", "i", "j").agg(*sums)


def whole_windows(outputs: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Outputs whose window of ``size`` lies inside its matrix: sizes (sub, n [, m]). The margins have no whole window."""
    h, width = size // 2, "m" if "m" in sizes.columns else "n"
    inside = (F.col("i") >= h) & (F.col("j") >= h) & (F.col("i") < F.col("_n") - h) & (F.col("j") < F.col("_m") - h)
    return outputs.join(F.broadcast(sizes.select("sub", F.col("n").alias("_n"), F.col(width).alias("_m"))), "sub").where(inside).drop("_n", "_m")


def centred_windows(outputs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Outputs whose centre lies inside its matrix: windows may hang over the borders, where nothing is stored."""
    width = "m" if "m" in sizes.columns else "n"
    met = outputs.join(F.broadcast(sizes.select("sub", F.col("n").alias("_n"), F.col(width).alias("_m"))), "sub")
    return met.where("i < _n AND j < _m").drop("_n", "_m")


def xcorr2(local: DataFrame, kernel: DataFrame, sizes: DataFrame, size: int, max_dist: int | None = None, eps: float = EPS, intra: bool = True, whole: bool = True) -> DataFrame:
    """The plain cross-correlation: sum of v * w, of ``whole`` windows or also of those that hang over a border."""
    sums = scatter_sums(local, kernel, max_dist, intra)
    sums = whole_windows(sums, sizes, size) if whole else centred_windows(sums, sizes)
    return sums.select("sub", "kernel_id", "i", "j", snapped(F.col("vk"), eps).alias("x")).where("x <> 0")


def xcorr2_factored(local: DataFrame, down: np.ndarray, across: np.ndarray, sizes: DataFrame, max_dist: int | None = None, eps: float = EPS, intra: bool = True) -> DataFrame:
    """``xcorr2`` with ``down @ across`` (size x factors, factors x size) as two stencils of one dimension.

    A pixel spreads to size * factors rows twice, where the plain stencil gives size * size.
    """
    spark, size = local.sparkSession, down.shape[0]
    h = size // 2
    frame = lambda m, name: small_frame(spark, [(f, k - h, float(w)) for (k, f), w in np.ndenumerate(m) if w], f"f int, {name} int, w double")
    first = local.where("v <> 0").join(F.broadcast(frame(down, "di"))).withColumn("i", F.col("i") - F.col("di")).where("i >= 0")
    if intra:
        first = first.where(F.col("j") - F.col("i") >= -h)
        first = first if max_dist is None else first.where(F.col("j") - F.col("i") <= max_dist + h)
    column = first.groupBy("sub", "f", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    second = column.join(F.broadcast(frame(across.T, "dj")), "f").withColumn("j", F.col("j") - F.col("dj")).where("j >= 0")
    if intra:
        second = second.where("j >= i")
        second = second if max_dist is None else second.where(F.col("j") - F.col("i") <= max_dist)
    sums = second.groupBy("sub", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("x"))
    return whole_windows(sums, sizes, size).select("sub", "i", "j", snapped(F.col("x"), eps).alias("x")).where("x <> 0")


def factored_sums(local: DataFrame, factors: list[tuple[np.ndarray, np.ndarray]], max_dist: int | None, intra: bool = True) -> DataFrame:
    """``scatter_sums`` for kernels given by factors (size x k, k x size), as two stencils of one dimension.

    A pixel spreads to size * (all factors + 2) rows twice, where the plain stencil gives size * size: the two are the box
    sums of values and squares, whose kernel of ones has one factor.
    """
    spark, size = local.sparkSession, factors[0][0].shape[0]
    h, ones = size // 2, np.ones((size, 1))
    owner = [-1, -1] + [k for k, (down, _) in enumerate(factors) for _ in range(down.shape[1])]
    lines = [np.hstack([ones, ones, *(d for d, _ in factors)]), np.hstack([ones, ones, *(a.T for _, a in factors)])]
    frame = lambda m, name: small_frame(spark, [(f, k - h, float(w), owner[f]) for (k, f), w in np.ndenumerate(m) if w], f"f int, {name} int, w double, kernel int")
    value = F.when(F.col("f") == 1, F.col("v") * F.col("v")).otherwise(F.col("v")) * F.col("w")
    first = local.where("v <> 0").join(F.broadcast(frame(lines[0], "di"))).select("sub", "f", (F.col("i") - F.col("di")).alias("i"), "j", value.alias("v")).where("i >= 0")
    if intra:
        first = first.where(F.col("j") - F.col("i") >= -h)
        first = first if max_dist is None else first.where(F.col("j") - F.col("i") <= max_dist + h)
    column = first.groupBy("sub", "f", "i", "j").agg(F.sum("v").alias("v"))
    second = column.join(F.broadcast(frame(lines[1], "dj")), "f").select("sub", "f", "kernel", "i", (F.col("j") - F.col("dj")).alias("j"), (F.col("v") * F.col("w")).alias("v")).where("j >= 0")
    if intra:
        second = second.where("j >= i")
        second = second if max_dist is None else second.where(F.col("j") - F.col("i") <= max_dist)
    part = lambda on: F.sum(F.when(on, F.col("v")).otherwise(0.0))
    each = [part(F.col("kernel") == k).alias(f"k{k}") for k in range(len(factors))]
    sums = second.groupBy("sub", "i", "j").agg(part(F.col("f") == 0).alias("v1"), part(F.col("f") == 1).alias("v2"), *each)
    kernels = F.explode(F.array(*[F.struct(F.lit(k).alias("kernel_id"), F.col(f"k{k}").alias("vk")) for k in range(len(factors))])).alias("k")
    return sums.select("sub", "i", "j", "v1", "v2", kernels).select("sub", "k.kernel_id", "i", "j", "k.vk", "v1", "v2")


def box_sums(local: DataFrame, sizes: DataFrame, size: int, max_dist: int | None = None, tile: int = TILE) -> DataFrame:
    """(sub, i, j, v1, v2): sums of values and squares in each window of ``size`` with a stored value, at a cost that
    doesn't depend on ``size``.

    A pixel goes to its tile, and to neighbours only from their margins (less than 1.3 rows a pixel for windows of 31 and
    tiles of 256); a tile is a summed-area table, so a window is four of its cells however large it is.
    """
    h = size // 2
    cell = lambda c, off: F.floor((F.col(c) + off) / tile)
    rows = local.where("v <> 0").join(F.broadcast(sizes.select("sub", "n")), "sub").select("sub", "n", "i", "j", "v")
    for axis, name in (("i", "ti"), ("j", "tj")):
        last = F.floor((F.col("n") - 1) / tile)
        rows = rows.withColumn(name, F.explode(F.sequence(F.greatest(cell(axis, -h), F.lit(0)), F.least(cell(axis, h), last))))
    rows = rows.where(F.col("tj") >= F.col("ti"))
    rows = rows if max_dist is None else rows.where((F.col("tj") - F.col("ti") - 1) * tile <= max_dist)

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sub, ti, tj = (int(k) for k in key)
        n = int(frame["n"].iloc[0])
        at = frame["i"].to_numpy() - ti * tile + h, frame["j"].to_numpy() - tj * tile + h
        edge = tile + 2 * h

        def windows(values: np.ndarray) -> np.ndarray:
            area = np.zeros((edge + 1, edge + 1), values.dtype)
            area[1:, 1:][at] = values
            area = area.cumsum(0).cumsum(1)
            return area[size:, size:] - area[:-size, size:] - area[size:, :-size] + area[:-size, :-size]

        v = frame["v"].to_numpy()
        filled = windows(np.ones(len(v), np.int64))  # whole numbers: empty windows are exactly empty
        x, y = np.arange(tile)[:, None] + ti * tile, np.arange(tile)[None, :] + tj * tile
        a, b = np.nonzero((filled > 0) & (x < n) & (y < n) & (y >= x) & (y - x <= (n if max_dist is None else max_dist)))
        return pd.DataFrame({"sub": sub, "i": a + ti * tile, "j": b + tj * tile, "v1": windows(v)[a, b], "v2": windows(v * v)[a, b]})

    return rows.groupBy("sub", "ti", "tj").applyInPandas(each, "sub int, i long, j long, v1 double, v2 double")


def missing_cell(x: np.ndarray, y: np.ndarray, n: np.ndarray, max_dist: int, size: int, miss_x: np.ndarray, miss_y: np.ndarray) -> np.ndarray:
    """Whether a cell of the framed matrix of one chromosome counts as missing; ``size`` is that of a square kernel.

    Missing bins inside the band; the top margin up to the band and the kernel; the corner above the start; the right
    margin beside the last rows of the band; and as many diagonals below the main one as the kernel is wide.
    """
    d = y - x
    return (
        ((x >= 0) & (d >= 0) & (y < n) & (d <= max_dist) & (miss_x | miss_y))
        | ((x < 0) & (y < max_dist + size))
        | ((y >= n) & (x >= n - max_dist - 2))
        | ((d >= -size) & (d <= -1))
    )


def nearby(missing: DataFrame, size: int, axis: str, name: str) -> DataFrame:
    """Rows (or columns) of a window's centre with missing bins in reach: (sub, axis, name), bit k for the k-th row of the window.

    At most ``size`` rows a missing bin; kernels have at most 63 rows.
    """
    h = size // 2
    at = missing.select("sub", "bin", F.explode(F.sequence(F.lit(-h), F.lit(h))).alias("d"))
    bit = F.expr("shiftleft(1L, d)")
    return at.select("sub", (F.col("bin") - F.col("d")).alias(axis), (F.col("d") + h).alias("d")).select("sub", axis, bit.alias(name)).groupBy("sub", axis).agg(F.bit_or(name).alias(name))


def with_mask_sums(outputs: DataFrame, kernel: DataFrame, missing: DataFrame, size: int, gone: Callable, touches: Column, n: str, m: str, columns: DataFrame | None = None) -> DataFrame:
    """Adds m0, mk, mkk: number of missing cells under the kernel, and their sums of w and w squared.

    Output pixels near a missing bin find its bits by row and by column; only they, and those that ``touches`` a border,
    walk over the kernel's cells, in place: nothing is spread out or shuffled. The walk takes a cell of all pixels of an
    Arrow batch at a time: expressions over arrays aren't compiled and take a hundred times longer.
    ``gone(x, y, n, m, miss_x, miss_y)`` says of arrays whether cells are missing; ``n`` and ``m`` name the columns of sizes.
    """
    rows, cols = nearby(missing, size, "i", "_rows"), nearby(missing if columns is None else columns, size, "j", "_cols")
    met = outputs.join(rows, ["sub", "i"], "left").join(cols, ["sub", "j"], "left")
    zero = F.lit(0).cast("long")
    met = met.withColumns({"_rows": F.coalesce("_rows", zero), "_cols": F.coalesce("_cols", zero)})
    h = size // 2
    cells: dict[int, list[tuple[int, int, float]]] = {}
    for row in kernel.collect():  # at most 31 x 31 cells a kernel
        cells.setdefault(row["kernel_id"], []).append((row["di"], row["dj"], row["w"]))

    @F.pandas_udf("m0 long, mk double, mkk double")
    def walk(kernel_id: pd.Series, i: pd.Series, j: pd.Series, n: pd.Series, m: pd.Series, rows: pd.Series, cols: pd.Series, near: pd.Series) -> pd.DataFrame:
        total = len(i)
        m0, mk, mkk = np.zeros(total, np.int64), np.zeros(total), np.zeros(total)
        kind, beside = kernel_id.to_numpy(), near.to_numpy(bool)
        for which, offsets in cells.items():
            k = np.flatnonzero(beside & (kind == which))
            if not len(k):
                continue
            i_, j_, n_, m_, rows_, cols_ = (s.to_numpy()[k] for s in (i, j, n, m, rows, cols))
            for di, dj, w in offsets:
                lost = gone(i_ + di, j_ + dj, n_, m_, rows_ >> (di + h) & 1 != 0, cols_ >> (dj + h) & 1 != 0)
                m0[k] += lost
                mk[k] += lost * w
                mkk[k] += lost * (w * w)
        return pd.DataFrame({"m0": m0, "mk": mk, "mkk": mkk})

    near = (F.col("_rows") != 0) | (F.col("_cols") != 0) | touches
    long = [F.col(c).cast("long") for c in ("i", "j", n, m)]
    summed = met.withColumn("_mask", walk("kernel_id", *long, "_rows", "_cols", near))
    return summed.select(*outputs.columns, "_mask.m0", "_mask.mk", "_mask.mkk")


def band_mask(outputs: DataFrame, kernel: DataFrame, sizes: DataFrame, missing: DataFrame, max_dist: int, size: int) -> DataFrame:
    """``with_mask_sums`` for windows within one chromosome."""
    h = size // 2
    gone = lambda x, y, n, m, mx, my: missing_cell(x, y, n, max_dist, size, mx, my)
    touches = (F.col("i") < h) | (F.col("j") >= F.col("_n") - h) | (F.col("j") - F.col("i") < 2 * h)
    sized = outputs.join(F.broadcast(sizes.select("sub", F.col("n").alias("_n"))), "sub")
    return with_mask_sums(sized, kernel, missing, size, gone, touches, "_n", "_n").drop("_n")


def mask_sums(outputs: DataFrame, kernel: DataFrame, sizes: DataFrame, missing: DataFrame, max_dist: int, size: int) -> DataFrame:
    """For each output pixel with missing cells: their number and their sums of w and w squared (m0, mk, mkk)."""
    masked = band_mask(outputs.select("sub", "kernel_id", "i", "j"), kernel, sizes, missing, max_dist, size)
    return masked.where("m0 > 0")


def pearson(sums: DataFrame, kernel: DataFrame, missing_tol: float = 0.75, eps: float = EPS, keep: list[str] | None = None) -> DataFrame:
    """(sub, kernel_id, i, j, vk, v1, v2 [, m0, mk, mkk]) to r, n_obs and log10_p; zeros and undefined values go."""
    total = kernel.groupBy("kernel_id").agg(F.count(F.lit(1)).alias("K"), F.sum("w").alias("k1"), F.sum(F.col("w") * F.col("w")).alias("k2"))
    rows = sums.join(F.broadcast(total), "kernel_id")
    masked = "m0" in sums.columns
    zero = F.lit(0.0)
    m0 = snapped(F.coalesce(F.col("m0").cast("double"), zero), eps) if masked else zero
    mk, mkk = (snapped(F.coalesce(F.col(c), zero), eps) if masked else zero for c in ("mk", "mkk"))
    size = F.col("K").cast("double")
    rows = rows.withColumn("n_obs", size - m0).where("n_obs > 0")
    n = F.col("n_obs")
    rows = rows.withColumns({
        "km": (F.col("k1") - mk) / n, "k2m": (F.col("k2") - mkk) / n,
        "sm": snapped(F.col("v1") / size, eps) * size / n, "s2": snapped(F.col("v2") / size, eps) * size / n,
    })
    spread = (F.col("s2") - F.col("sm") * F.col("sm")) * (F.col("k2m") - F.col("km") * F.col("km"))
    den = F.when(n < F.floor(F.lit(1 - missing_tol) * size), zero).otherwise(F.sqrt(F.greatest(spread, zero)))
    num = (snapped(F.col("vk") / size, eps) - F.col("sm") * F.col("km") * n / size) * size / n
    r = F.when(den >= LEAST_DENOMINATOR, num / F.when(den >= LEAST_DENOMINATOR, den).otherwise(F.lit(1.0))).otherwise(zero)
    out = rows.withColumn("r", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).where("r <> 0")
    return out.select(*(keep or []), "sub", "kernel_id", "i", "j", "r", "n_obs", corr_to_log10p(F.col("r"), n).alias("log10_p"))


def normxcorr2(local: DataFrame, kernel: DataFrame, max_dist: int, size: int, sizes: DataFrame, missing: DataFrame | None = None, missing_tol: float = 0.75, eps: float = EPS, plan: str = "scatter", factors: list | None = None) -> DataFrame:
    """Correlation of each window of the band with each kernel; sizes (sub, n). With ``missing`` (sub, bin), missing
    cells are left out and windows run over the borders; without ``missing``, every cell counts and only whole windows are
    put out.
    ``factors`` of the kernels make two stencils of one dimension of each.
    """
    if plan == "tile" and missing is not None:
        return _tiled(local, kernel, max_dist, size, sizes, missing, missing_tol, eps, factors)
    sums = factored_sums(local, factors, max_dist) if factors else scatter_sums(local, kernel, max_dist)
    if missing is None:
        return pearson(whole_windows(sums, sizes, size), kernel, missing_tol, eps)
    inside = sums.join(F.broadcast(sizes.select("sub", "n")), "sub").where("i < n AND j < n").drop("n")
    return pearson(band_mask(inside, kernel, sizes, missing, max_dist, size), kernel, missing_tol, eps)


def normxcorr2_inter(local: DataFrame, kernel: DataFrame, sizes: DataFrame, missing_rows: DataFrame, missing_columns: DataFrame, size: int, missing_tol: float = 0.75, eps: float = EPS, plan: str = "tile", factors: list | None = None, tile: int | None = None) -> DataFrame:
    """Between chromosomes: sizes (sub, n, m); cells outside, and those of missing rows or columns, are left out; no band.
    ``plan`` as in ``normxcorr2``; ``scatter`` shuffles every window (up to size * size rows a pixel), several times where
    missing bins aren't few, and is for small maps. ``factors`` of the kernels serve the tiles."""
    if plan == "tile":
        return _tiled_inter(local, kernel, size, sizes, missing_rows, missing_columns, missing_tol, eps, factors, tile)
    # Pairs of chromosomes may be many: no hint, their table decides by its size.
    sums = scatter_sums(local, kernel, None, intra=False).join(sizes, "sub").where("i < n AND j < m")
    return pearson(area_mask(sums, kernel, missing_rows, missing_columns, size).drop("n", "m"), kernel, missing_tol, eps)


def area_mask(outputs: DataFrame, kernel: DataFrame, missing_rows: DataFrame, missing_columns: DataFrame, size: int) -> DataFrame:
    """``with_mask_sums`` for windows between two chromosomes; outputs carry the sizes n and m of their sub-matrix."""
    h = size // 2
    gone = lambda x, y, n, m, mx, my: (x < 0) | (y < 0) | (x >= n) | (y >= m) | mx | my
    touches = (F.col("i") < h) | (F.col("j") < h) | (F.col("i") >= F.col("n") - h) | (F.col("j") >= F.col("m") - h)
    return with_mask_sums(outputs, kernel, missing_rows, size, gone, touches, "n", "m", missing_columns)


def normxcorr2_at(points: DataFrame, cells: DataFrame, kernel: DataFrame, sizes: DataFrame, missing: DataFrame, max_dist: int, size: int, missing_columns: DataFrame | None = None, missing_tol: float = 0.75, eps: float = EPS) -> DataFrame:
    """Correlations at given points only, for each kernel: points (pid, sub, i, j), cells (pid, a, b, raw) of their windows.

    Costs the windows of the points, not the band that they lie in. Same result as looking the points up in a whole map.
    """
    h = size // 2
    weights = kernel.select("kernel_id", (F.col("di") + h).alias("a"), (F.col("dj") + h).alias("b"), "w")
    v = F.col("raw")
    sums = (F.sum(v * F.col("w")).alias("vk"), F.sum("raw").alias("v1"), F.sum(v * v).alias("v2"))
    of_kernel = cells.where("raw <> 0").join(F.broadcast(weights), ["a", "b"]).groupBy("pid", "kernel_id").agg(*sums)
    met = points.select("pid", "sub", "i", "j").join(of_kernel, "pid")
    if missing_columns is None:
        met = met.where((F.col("i") >= 0) & (F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") <= max_dist))
        masked = band_mask(met, kernel, sizes, missing, max_dist, size)
    else:
        masked = area_mask(met.join(sizes, "sub"), kernel, missing, missing_columns, size).drop("n", "m")
    return pearson(masked, kernel, missing_tol, eps, ["pid"])


def check_mask(local: DataFrame, missing: DataFrame, sizes: DataFrame, missing_columns: DataFrame | None = None) -> DataFrame:
    """``local`` as it is; the task that reads a row fails if it lies outside its matrix or, with a value, on a missing bin.

    The check is part of the plan and costs no job: sizes are one row a matrix, missing bins meet the rows by their keys.
    """
    width = "m" if "m" in sizes.columns else "n"
    rows = local.join(sizes.select("sub", F.col("n").alias("_n"), F.col(width).alias("_m")), "sub", "left")
    for axis, side in (("i", missing), ("j", missing if missing_columns is None else missing_columns)):
        rows = rows.join(side.select("sub", F.col("bin").alias(axis), F.lit(True).alias(f"_{axis}")).distinct(), ["sub", axis], "left")
    outside = F.col("_n").isNull() | (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= F.col("_n")) | (F.col("j") >= F.col("_m"))
    covered = (F.coalesce("_i", F.lit(False)) | F.coalesce("_j", F.lit(False))) & (F.coalesce("v", F.lit(0.0)) != 0)
    fault = F.when(outside, F.lit("the mask and the signal have different shapes")).when(covered, F.lit("there is signal under the mask"))
    return rows.withColumn("v", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("v"))).select(*local.columns)


def check_kernels(kernels: list[np.ndarray], shape: tuple[int, int] | None = None) -> None:
    """What a correlation needs: square kernels of one odd size that aren't flat, smaller than the signal's ``shape``."""
    size = kernels[0].shape[0]
    for k in kernels:
        if k.ndim != 2 or k.shape != (size, size) or size % 2 == 0:
            raise ValueError("kernels of one configuration must be square and of one odd size")
        if not k.std() > 0:
            raise ValueError("a flat kernel has no correlation")
    if shape is not None and size >= max(shape):
        raise ValueError("the kernel is larger than the signal")


def grids(kernel: DataFrame, size: int) -> dict[int, np.ndarray]:
    h = size // 2
    out: dict[int, np.ndarray] = {}
    for row in kernel.collect():  # at most 31 x 31 cells a kernel
        out.setdefault(row["kernel_id"], np.zeros((size, size)))[row["di"] + h, row["dj"] + h] = row["w"]
    return out


def _block(v: np.ndarray, m: np.ndarray, size: int, grids: dict[int, np.ndarray], factors: list | None, missing_tol: float, eps: float, tile: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kernel_id, correlations, observed cells) of a dense tile: values ``v`` and missing cells ``m``, both with a halo."""

    def windows(a: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros((tile, tile))
        for a0, b0 in np.argwhere(k != 0):
            out += k[a0, b0] * a[a0 : a0 + tile, b0 : b0 + tile]
        return out

    def by_factors(a: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
        out = np.zeros((tile, tile))
        for f in range(down.shape[1]):
            column = sum(w * a[x0 : x0 + tile] for x0, w in enumerate(down[:, f].tolist()) if w)
            out += sum(w * column[:, y0 : y0 + tile] for y0, w in enumerate(across[f].tolist()) if w)
        return out

    cut = lambda z: np.where(np.abs(z) < eps, 0.0, z)
    box, K = (np.ones((size, 1)), np.ones((1, size))), float(size * size)
    v1, v2, m0 = by_factors(v, *box), by_factors(v * v, *box), cut(by_factors(m, *box))
    seen = (v2 != 0) & (K - m0 > 0)
    for kernel_id, k in grids.items():
        with np.errstate(all="ignore"):
            N = K - m0
            km, k2m = (k.sum() - cut(windows(m, k))) / N, ((k * k).sum() - cut(windows(m, k * k))) / N
            sm, s2 = cut(v1 / K) * K / N, cut(v2 / K) * K / N
            den = np.sqrt(np.maximum((s2 - sm * sm) * (k2m - km * km), 0))
            den[N < int((1 - missing_tol) * K)] = 0
            vk = by_factors(v, *factors[kernel_id]) if factors else windows(v, k)
            r = (cut(vk / K) - sm * km * N / K) * K / N / den
            r = np.clip(np.where((den >= LEAST_DENOMINATOR) & np.isfinite(r) & seen, r, 0), -1, 1)
        yield kernel_id, r, N


def _halos(local: DataFrame, h: int, tile: int) -> DataFrame:
    """Pixels at each tile (ti, tj) that they lie in or beside."""
    cell = lambda c, off: F.floor((F.col(c) + off) / tile)
    for axis, name in (("i", "ti"), ("j", "tj")):
        local = local.withColumn(name, F.explode(F.sequence(F.greatest(cell(axis, -h), F.lit(0).cast("long")), cell(axis, h))))
    return local


def _tiles(rows: DataFrame, gone: DataFrame, size: int, missing_cells: Callable[..., np.ndarray], put_out: Callable[..., np.ndarray], correlated: Callable[..., Iterator], tile: int) -> DataFrame:
    """rows (sub, n, m, ti, tj, i, j, v) and missing bins gone (sub, ti, tj, bin, of_row, of_column) to r, n_obs and log10_p.

    ``missing_cells(x, y, n, m, lost)`` and ``put_out(x, y, n, m)`` give cells of a tile by their rows and columns.
    """
    h, edge = size // 2, tile + 2 * (size // 2)

    def each(key: tuple, frame: pd.DataFrame, lost_bins: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("sub", "kernel_id", "i", "j", "r", "n_obs")})
        sub, ti, tj = (int(x) for x in key)
        n, m = int(frame["n"].iloc[0]), int(frame["m"].iloc[0])
        x0, y0 = ti * tile - h, tj * tile - h
        v = np.zeros((edge, edge))
        v[frame["i"].to_numpy() - x0, frame["j"].to_numpy() - y0] = frame["v"].to_numpy()
        x, y = np.arange(edge)[:, None] + x0, np.arange(edge)[None, :] + y0
        lost = np.isin(x, lost_bins.loc[lost_bins["of_row"], "bin"]) | np.isin(y, lost_bins.loc[lost_bins["of_column"], "bin"])
        own = put_out(x[h : h + tile], y[:, h : h + tile], n, m)
        frames = []
        for kernel_id, r, seen in correlated(v, missing_cells(x, y, n, m, lost).astype(float)):
            a, b = np.nonzero(own & (r != 0))
            frames.append(pd.DataFrame({"sub": sub, "kernel_id": kernel_id, "i": a + ti * tile, "j": b + tj * tile, "r": r[a, b], "n_obs": seen[a, b]}))
        return pd.concat(frames)

    at = ["sub", "ti", "tj"]
    gone = gone.toDF(*gone.columns)  # new names: both sides may come from one table
    got = rows.groupBy(*at).cogroup(gone.groupBy(*at)).applyInPandas(each, f"sub {rows.schema['sub'].dataType.simpleString()}, kernel_id int, i long, j long, r double, n_obs double")
    return got.withColumn("log10_p", corr_to_log10p(F.col("r"), F.col("n_obs")))


def _tiled(local: DataFrame, kernel: DataFrame, max_dist: int, size: int, sizes: DataFrame, missing: DataFrame, missing_tol: float, eps: float, factors: list | None = None) -> DataFrame:
    """Dense blocks along the band; pixels are copied only into halos."""
    h, of_kernels = size // 2, grids(kernel, size)
    local = _halos(local, h, TILE).where(F.col("tj") >= F.col("ti")).where((F.col("tj") - F.col("ti") - 1) * TILE <= max_dist)
    rows = local.join(F.broadcast(sizes.select("sub", "n", F.col("n").alias("m"))), "sub").select("sub", "n", "m", "ti", "tj", "i", "j", "v")
    # Missing bins go to the tiles whose rows or columns hold them.
    reach = -(-(max_dist + h) // TILE) + 1
    far = F.floor((F.col("bin") + h) / TILE)
    near = F.greatest(F.floor((F.col("bin") - h) / TILE), F.lit(0).cast("long"))
    spread = lambda low, high, name: F.explode(F.sequence(low, high)).alias(name)
    as_row = missing.select("sub", "bin", spread(near, far, "ti")).select("sub", "bin", "ti", spread(F.col("ti"), F.col("ti") + reach, "tj"))
    as_column = missing.select("sub", "bin", spread(near, far, "tj")).select("sub", "bin", spread(F.greatest(F.col("tj") - reach, F.lit(0).cast("long")), F.col("tj"), "ti"), "tj")
    both = F.lit(True)
    gone = as_row.unionByName(as_column).distinct().withColumn("of_row", both).withColumn("of_column", both)

    def missing_cells(x: np.ndarray, y: np.ndarray, n: int, m: int, lost: np.ndarray) -> np.ndarray:
        d = y - x
        inside = (x >= 0) & (d >= 0) & (y < n) & (d <= max_dist) & lost
        return inside | ((x < 0) & (y < max_dist + size)) | ((y >= n) & (x >= n - max_dist - 2)) | ((d >= -size) & (d <= -1))

    put_out = lambda x, y, n, m: (x < n) & (y < n) & (y >= x) & (y - x <= max_dist)
    return _tiles(rows, gone, size, missing_cells, put_out, lambda v, m: _block(v, m, size, of_kernels, factors, missing_tol, eps, TILE), TILE)


def area_points(frame: pd.DataFrame, rows_seen: np.ndarray, columns_seen: np.ndarray, size: int, grids: dict[int, np.ndarray], factors: list | None, missing_tol: float, eps: float, tile: int, origin: tuple[int, int], shape: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kernel_id, i, j, correlations, observed cells) of a tile's windows with a stored value: work by pixels, not by cells.

    A pixel adds to the windows around it, one place of the kernel at a time. A cell is observed if its row and its column
    are, so the sums of a kernel over observed cells are products of ``rows_seen`` and ``columns_seen`` with it.
    """
    h, K = size // 2, float(size * size)
    wide = tile + 4 * h  # windows of halo pixels fall beside the tile and are cut off
    at = (frame["i"].to_numpy() - origin[0] + 3 * h) * wide + frame["j"].to_numpy() - origin[1] + 3 * h
    v = frame["v"].to_numpy()
    inside = min(tile, shape[0] - origin[0]), min(tile, shape[1] - origin[1])

    def spread(values: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(wide * wide)
        for a, b in np.argwhere(k != 0):
            out[at - (a * wide + b)] += values * k[a, b]  # pixels are distinct, so are their places
        return out.reshape(wide, wide)[2 * h : 2 * h + inside[0], 2 * h : 2 * h + inside[1]]

    ones = np.ones((size, size))
    squares = spread(v * v, ones)
    x, y = np.nonzero(squares)
    down, across = (np.lib.stride_tricks.sliding_window_view(s.astype(float), size) for s in (rows_seen, columns_seen))
    seen = down.sum(1)[x] * across.sum(1)[y]
    some = seen > 0
    x, y, N = x[some], y[some], seen[some]
    v1, v2 = spread(v, ones)[x, y], squares[x, y]
    cut = lambda z: np.where(np.abs(z) < eps, 0.0, z)

    def observed(k: np.ndarray) -> np.ndarray:
        half = down @ k
        return np.concatenate([np.einsum("pk,pk->p", half[x[s : s + CHUNK]], across[y[s : s + CHUNK]]) for s in range(0, len(x), CHUNK)] or [np.zeros(0)])

    sm, s2 = cut(v1 / K) * K / N, cut(v2 / K) * K / N
    for kernel_id, k in grids.items():
        with np.errstate(all="ignore"):
            km, k2m = (k.sum() - cut(k.sum() - observed(k))) / N, ((k * k).sum() - cut((k * k).sum() - observed(k * k))) / N
            den = np.sqrt(np.maximum((s2 - sm * sm) * (k2m - km * km), 0))
            den[N < int((1 - missing_tol) * K)] = 0
            vk = spread(v, np.matmul(*factors[kernel_id]) if factors else k)[x, y]
            r = (cut(vk / K) - sm * km * N / K) * K / N / den
            r = np.clip(np.where((den >= LEAST_DENOMINATOR) & np.isfinite(r), r, 0), -1, 1)
        full = r != 0
        yield kernel_id, x[full] + origin[0], y[full] + origin[1], r[full], N[full]


def area_tile(sizes: DataFrame) -> int:
    """Side of the tiles between chromosomes: TILE, and up to four times as many bins where that gives over 16,384 tiles.

    Far maps are thin: the work of a tile follows its pixels, and larger ones are fewer.
    """
    area = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    tile = TILE
    while tile < 4 * TILE and area / tile**2 > 1 << 14:
        tile *= 2
    return tile


def _tiled_inter(local: DataFrame, kernel: DataFrame, size: int, sizes: DataFrame, missing_rows: DataFrame, missing_columns: DataFrame, missing_tol: float, eps: float, factors: list | None = None, tile: int | None = None) -> DataFrame:
    """The correlation between chromosomes by tiles: windows are put out by the task that makes them."""
    of_kernels, tile = grids(kernel, size), tile or area_tile(sizes)
    names = ("sub", "kernel_id", "i", "j", "r", "n_obs")

    def each(sub: int, frame: pd.DataFrame, seen: list[np.ndarray], origin: tuple[int, int], shape: tuple[int, int]) -> pd.DataFrame:
        found = area_points(frame, *seen, size, of_kernels, factors, missing_tol, eps, tile, origin, shape)
        return pd.concat([pd.DataFrame(dict(zip(names, (sub, *columns), strict=True))) for columns in found])

    got = on_area_tiles(local, size, sizes, missing_rows, missing_columns, each, "kernel_id int, i long, j long, r double, n_obs double", tile)
    return got.withColumn("log10_p", corr_to_log10p(F.col("r"), F.col("n_obs")))


def on_area_tiles(local: DataFrame, size: int, sizes: DataFrame, missing_rows: DataFrame, missing_columns: DataFrame, made: Callable[..., pd.DataFrame], columns: str, tile: int) -> DataFrame:
    """What ``made(sub, pixels, [observed rows, observed columns], origin, shape)`` makes of each tile between chromosomes: sub
    and ``columns``. Pixels and observed rows and columns reach over the tile by half a window.

    Tiles are only where pixels lie: one without any has no window to put out. Missing rows and columns meet the tiles
    that there are, so their number doesn't grow with the other chromosome. The only shuffle is that of the pixels (and
    halos) to their tiles.
    """
    h = size // 2
    # Pairs of chromosomes may be many: no hint, their table decides by its size.
    rows = _halos(local.where("v <> 0"), h, tile).join(sizes.select("sub", "n", "m"), "sub").select("sub", "n", "m", "ti", "tj", "i", "j", "v")
    tiles = rows.select("sub", "ti", "tj").distinct()
    far = F.floor((F.col("bin") + h) / tile)
    near = F.greatest(F.floor((F.col("bin") - h) / tile), F.lit(0).cast("long"))
    side = lambda lost, at: lost.select("sub", "bin", F.explode(F.sequence(near, far)).alias(at)).join(tiles, ["sub", at])
    parts = [side(lost, at).select("sub", "ti", "tj", "bin", F.lit(at == "ti").alias("of_row")) for lost, at in ((missing_rows, "ti"), (missing_columns, "tj"))]
    schema = f"sub {rows.schema['sub'].dataType.simpleString()}, {columns}"
    names = ["sub", *(c.split()[0] for c in columns.split(", "))]

    def each(key: tuple, frame: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({c: [] for c in names})
        sub, ti, tj = (int(x) for x in key)
        shape, origin = (int(frame["n"].iloc[0]), int(frame["m"].iloc[0])), (ti * tile, tj * tile)
        seen = []
        for o, n, bins in zip(origin, shape, (lost.loc[lost["of_row"], "bin"], lost.loc[~lost["of_row"], "bin"]), strict=True):
            x = np.arange(o - h, o + tile + h)
            seen.append((x >= 0) & (x < n) & ~np.isin(x, bins))
        return made(sub, frame, seen, origin, shape)

    at = ["sub", "ti", "tj"]
    gone = parts[0].unionByName(parts[1])
    gone = gone.toDF(*gone.columns)  # new names: both sides may come from one table
    return rows.groupBy(*at).cogroup(gone.groupBy(*at)).applyInPandas(each, schema)
