"""The end-to-end plans: detect, quantify, and making a configuration from positions."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.stats import benjamini_hochberg
from gridloom.operators import areas, correlate, foci, genome, nms, preprocess, windows
from gridloom.scratch import Scratch
from gridloom.sources.contacts import ContactMap, near, swap_anchors
from gridloom.sources.kernels import KernelConfig, blur, factorise, kernel_frame
from gridloom.sources.sinks import dump_stage

DETECT = ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "bin1", "bin2", "kernel_id", "iteration", "score", "pvalue", "qvalue"]
QUANTIFY = [c for c in DETECT if c not in ("kernel_id", "iteration")]


def max_dist_bins(config: KernelConfig, bin_size: int) -> int:
    """At least one diagonal beside the main one, so that foci of two pixels exist for patterns on the diagonal."""
    return max(int(config.max_dist // bin_size), 1)


def prepared(cmap: ContactMap, max_dist: int, largest: int, raw: bool = False, smooth: bool = False, diagonals: DataFrame | None = None, stages: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(local pixels of chromosomes: detrended band, sizes, missing bins).

    The band is cut before anything else, in the scan where the map is laid out for that: the law of a diagonal needs no
    other diagonal. With ``diagonals`` (sub, d) only those are read. ``stages`` collects the frames in between, by name,
    and takes the first of them from the whole map.
    """
    pixels = cmap.pixels if stages is not None else near(cmap.pixels, max_dist + largest)
    values = preprocess.raw_values(pixels, cmap.bins) if raw else preprocess.balanced(pixels, cmap.bins)
    local = genome.to_local(values, cmap.chroms).select(F.col("sub1").alias("sub"), "i", "j", "v")
    band = preprocess.diag_trim(local, max_dist + largest)
    if diagonals is not None:
        band = band.withColumn("d", F.col("j") - F.col("i")).join(diagonals, ["sub", "d"], "left_semi").select("sub", "i", "j", "v")
    law = preprocess.distance_law(band)
    if smooth:
        law = preprocess.smoothed(law)
    signal = preprocess.detrend(band, law, None if raw else preprocess.OUTLIER)
    sizes = cmap.chroms.select(F.col("chrom_idx").alias("sub"), (F.col("end_bin") - F.col("start_bin")).alias("n"))
    gone = cmap.bins.where("weight IS NULL").join(F.broadcast(cmap.chroms), "chrom").select(F.col("chrom_idx").alias("sub"), (F.col("bin_id") - F.col("start_bin")).alias("bin"))
    if stages is not None:
        stages |= {"00_balanced": local, "02_diag_trim": band, "02_distance_law": law}
    return signal, sizes, gone


def prepared_inter(cmap: ContactMap, raw: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pixels between chromosomes over their pair's median, sizes (sub, n, m), missing rows, missing columns).

    ``sub`` is sub1 * number of chromosomes + sub2, a long: of 10^5 scaffolds there are 10^10 pairs. Only pairs with pixels have rows: of many scaffolds, few meet.
    """
    n_chroms = cmap.chroms.count()
    values = preprocess.raw_values(cmap.pixels, cmap.bins) if raw else preprocess.balanced(cmap.pixels, cmap.bins)
    scratch = Scratch(cmap.bins.sparkSession, "inter")
    across = scratch.keep(genome.to_local(values, cmap.chroms, inter=True).where("sub1 <> sub2").select("sub1", "sub2", "i", "j", "v"), "across")
    scaled = preprocess.inter_scale(across)
    pair = (F.col("sub1").cast("long") * n_chroms + F.col("sub2")).alias("sub")
    signal = scaled.select(pair, "i", "j", "v").where("v IS NOT NULL AND v <> 0")
    side = lambda k, n: cmap.chroms.select(F.col("chrom").alias(f"chrom{k}"), F.col("chrom_idx").alias(f"sub{k}"), (F.col("end_bin") - F.col("start_bin")).alias(n))
    pairs = across.select("sub1", "sub2").distinct().join(side(1, "n"), "sub1").join(side(2, "m"), "sub2")
    pairs = scratch.keep(pairs.select("chrom1", "chrom2", "sub1", "sub2", "n", "m"), "pairs")
    # Tables, whose size tells whether the pixels that meet them have to be shuffled.
    gone = cmap.bins.where("weight IS NULL").join(F.broadcast(cmap.chroms), "chrom").select("chrom", (F.col("bin_id") - F.col("start_bin")).alias("bin"))
    rows, columns = (scratch.keep(pairs.join(gone.withColumnRenamed("chrom", f"chrom{k}"), f"chrom{k}").select(pair, "bin"), f"gone{k}") for k in (1, 2))
    return signal, pairs.select(pair, "n", "m"), rows, columns


def _p_value() -> Column:
    return F.coalesce(F.pow(F.lit(10.0), F.col("log10_p")), F.lit(1.0))


def _search(scratch: Scratch, cmap: ContactMap, config: KernelConfig, part: tuple, kernels: list, turn: int, plan: str | None, dump: str | None, factors: list | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over one kind of sub-matrices: (patterns in whole-map bins, their windows, sums of windows by kernel and cell).

    ``part`` is (signal, sizes, missing) within chromosomes, (signal, sizes, missing rows, missing columns) between.
    The map is correlated once: what is needed of it goes to a table. These are its candidates, and between chromosomes by
    tiles, where no stage is dumped, only parts of foci.
    """
    spark, size = cmap.bins.sparkSession, kernels[0].shape[0]
    inter = len(part) == 4
    name = "inter" if inter else "intra"
    kernel, reach = kernel_frame(spark, kernels), max_dist_bins(config, cmap.bin_size)
    tolerance = config.max_perc_undetected / 100
    pid = F.struct(F.lit(turn).alias("turn"), F.lit(inter).alias("inter"), "kernel_id", F.col("sub").cast("long").alias("sub"), "label").alias("pid")
    if inter and plan in (None, "tile") and not dump:
        found = areas.valid_foci(part[0], kernel, *part[1:], size, config.pearson, config.max_perc_zero, config.max_perc_undetected, factors)
        found = scratch.keep(found.select(pid, "sub", "kernel_id", "i", "j", F.col("r").alias("score"), _p_value().alias("pvalue"), "window"), "found")
        cells = found.select("pid", F.posexplode("window").alias("at", "v")).select("pid", F.expr(f"at div {size}").alias("a"), (F.col("at") % size).alias("b"), "v")
        return _placed(scratch, cmap, found.drop("window"), cells, size, turn, inter)
    if inter:
        corr = correlate.normxcorr2_inter(part[0], kernel, *part[1:], size, tolerance, plan=plan or "tile", factors=factors)
    else:
        corr = correlate.normxcorr2(part[0], kernel, reach, size, part[1], part[2], tolerance, plan=plan or "scatter", factors=factors)
    corr = dump_stage(corr, dump, f"03_normxcorr2_{name}_{turn}")
    snaps = config.max_dist == 0 and not inter
    enough = (F.col("r") >= config.pearson) & (F.col("r") != 0)
    corr = scratch.keep(corr.where(enough | (F.col("i") == F.col("j"))) if snaps else corr.where(enough), "candidates")
    labelled = foci.sized(foci.label(foci.candidates(corr, config.pearson)))
    picked = foci.best_pixel(dump_stage(labelled, dump, f"05_foci_{name}_{turn}"))
    if snaps:
        at = corr.select("sub", "kernel_id", "i", "j", "r", "log10_p")
        picked = foci.snap_to_diagonal(picked, 0).drop("r", "log10_p").join(at, ["sub", "kernel_id", "i", "j"], "left")
    score = F.coalesce("r", F.lit(0.0)).alias("score")  # off the stored pixels of the diagonal there is no correlation
    picked = scratch.keep(picked.select(pid, "sub", "kernel_id", "i", "j", score, _p_value().alias("pvalue")), "picked")
    cells = scratch.keep(windows.cells(picked, part[0], part[1], part[2], size, part[3] if inter else None), "cells")
    checked = windows.validity(picked, cells, part[1], config.max_perc_zero, config.max_perc_undetected).where("valid")
    out = _placed(scratch, cmap, checked, cells, size, turn, inter)
    scratch.forget(corr, picked, cells)
    return out


def _placed(scratch: Scratch, cmap: ContactMap, checked: DataFrame, cells: DataFrame, size: int, turn: int, inter: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``_search`` returns, of valid patterns and of the cells of all windows."""
    checked = checked.withColumn("iteration", F.lit(turn))
    if inter:
        n = cmap.chroms.count()
        placed = checked.withColumn("sub1", F.expr(f"cast(sub div {n} as int)")).withColumn("sub2", (F.col("sub") % n).cast("int"))
        for k, axis in ((1, "i"), (2, "j")):
            start = cmap.chroms.select(F.col("chrom_idx").alias(f"sub{k}"), F.col("start_bin").alias(f"_s{k}"))
            placed = placed.join(F.broadcast(start), f"sub{k}").withColumn(f"bin{k}", F.col(axis) + F.col(f"_s{k}"))
    else:
        placed = genome.to_global(checked, cmap.chroms).withColumn("sub1", F.col("sub")).withColumn("sub2", F.col("sub"))
    order = F.struct("kernel_id", "iteration", "sub1", "sub2", "pid.label").alias("order")
    rows = scratch.keep(placed.select("pid", "bin1", "bin2", "kernel_id", "iteration", "score", "pvalue", order), "patterns")
    valid = cells.join(rows.select("pid"), "pid", "left_semi")
    pile = scratch.keep(valid.groupBy("pid.kernel_id", "a", "b").agg(F.sum("v").alias("total"), F.count("v").alias("n")), "pile")
    shown = scratch.keep(windows.as_arrays(valid, size), "windows")
    return rows, shown, pile


def detect(cmap: ContactMap, config: KernelConfig, raw: bool = False, smooth: bool = False, plan: str | None = None, dump: str | None = None, factor: float | None = None, inter: bool = False, tsvd: float | None = None, with_windows: bool = False, resume: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns with the columns DETECT, mean window by kernel: kernel_id, a, b, mean); ``with_windows`` adds the columns
    ``window`` and ``order`` (by kernel, iteration, sub-matrix and focus) to the patterns.

    ``tsvd`` keeps only the singular factors of the kernels that hold this share of their energy, and correlates by them.

    ``plan`` is that of the correlation; without one, ``scatter`` within chromosomes and ``tile`` between them.
    ``inter`` also looks between chromosomes, for configurations whose patterns lie off the diagonal. ``resume`` is the
    ``dump`` folder of an earlier run over the same map: its signal is taken instead of preparing the map again.
    """
    from gridloom.sources.kernels import resize

    spark = cmap.bins.sparkSession
    scratch = Scratch(spark, "detect")
    kernels = [resize(k, factor) for k in config.kernels] if factor else list(config.kernels)
    size = kernels[0].shape[0]
    stages: dict[str, DataFrame] | None = {} if dump else None
    signal, sizes, gone = prepared(cmap, max_dist_bins(config, cmap.bin_size), size, raw, smooth, stages=stages)
    for stage, frame in (stages or {}).items():
        dump_stage(frame, dump, stage)
    sizes = sizes.where(F.col("n") > size)
    parts = [(signal, sizes, gone)]
    if inter:
        across, shapes, rows, columns = prepared_inter(cmap, raw)
        parts.append((across, shapes.where((F.col("n") > size) & (F.col("m") > size)), rows, columns))
    if resume:
        parts = [(spark.read.parquet(f"{resume}/01_signal_{k}"), *p[1:]) for k, p in enumerate(parts)]
    else:
        parts = [(scratch.keep(dump_stage(correlate.check_mask(p[0].join(p[1].select("sub"), "sub", "left_semi"), p[2], p[1], *p[3:]), dump, f"01_signal_{k}"), "signal"), *p[1:]) for k, p in enumerate(parts)]
        if inter:
            scratch.forget(across)  # the pixels that the signal was made of
    found, shown, piles = [], [], None
    for turn in range(config.max_iterations):
        correlate.check_kernels(kernels)
        factors = [factorise(k, tsvd) for k in kernels] if tsvd else None
        used = [np.matmul(*f) for f in factors] if factors else kernels
        results = [_search(scratch, cmap, config, p, used, turn, plan, dump, factors) for p in parts]
        found += [r[0] for r in results]
        shown += [r[1] for r in results]
        total = reduce(DataFrame.unionByName, [r[2] for r in results])
        mean = total.groupBy("kernel_id", "a", "b").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
        pile = mean.toPandas()  # one window a kernel
        if len(pile) or piles is None:
            piles = mean
        if not len(pile) or turn + 1 == config.max_iterations:
            break
        for k, cells_of in pile.groupby("kernel_id"):
            kernels[k] = _learned(cells_of, size, config.max_dist == 0)
    found, shown = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, shown)
    kept = nms.remove_neighbours(found, max(int(config.min_separation // cmap.bin_size), 1))
    placed = nms.farther_than(genome.bins_to_coords(kept, cmap.bins), config.min_dist).where("pvalue IS NOT NULL")
    patterns = benjamini_hochberg(placed)
    if with_windows:
        return patterns.join(shown, "pid").select(*DETECT, "window", "order"), piles
    return patterns.select(*DETECT), piles


def _learned(cells_of, size: int, on_diagonal: bool) -> np.ndarray:
    """The mean window as the next kernel; that of patterns on the diagonal is symmetrised, as its lower cells are missing."""
    window = np.zeros((size, size))
    window[cells_of["a"], cells_of["b"]] = cells_of["mean"].fillna(0.0)
    return window + window.T - np.diag(np.diag(window)) if on_diagonal else window


def _scored(config: KernelConfig, part: tuple, wanted: DataFrame, kernels: list, reach: int) -> DataFrame:
    """wanted (qid, sub, i, j) to (qid, kernel_id, score, pvalue, window); rejected ones have nulls. ``part`` as in _search.

    Only the windows of the positions are read and correlated.
    """
    spark, size = wanted.sparkSession, kernels[0].shape[0]
    ids = spark.range(len(kernels)).select(F.col("id").cast("int").alias("kernel_id"))
    points = wanted.withColumnRenamed("qid", "pid")
    columns = part[3] if len(part) == 4 else None
    cells = Scratch(spark, "quantify").keep(windows.cells(points, part[0], part[1], part[2], size, columns), "cells")
    corr = correlate.normxcorr2_at(points, cells, kernel_frame(spark, kernels), part[1], part[2], reach, size, columns, config.max_perc_undetected / 100)
    checked = windows.validity(points, cells, part[1], config.max_perc_zero, config.max_perc_undetected).select("pid", "valid")
    each = checked.join(windows.as_arrays(cells, size), "pid").join(F.broadcast(ids))
    scored = each.join(corr.select("pid", "kernel_id", "r", "log10_p"), ["pid", "kernel_id"], "left")
    kept = {"score": F.coalesce("r", F.lit(0.0)), "pvalue": _p_value(), "window": F.col("window")}
    return scored.select(F.col("pid").alias("qid"), "kernel_id", *[F.when(F.col("valid"), v).alias(c) for c, v in kept.items()])


def quantify(cmap: ContactMap, config: KernelConfig, positions: DataFrame, raw: bool = False, inter: bool = False, tsvd: float | None = None) -> DataFrame:
    """Scores of given pairs of positions (six columns), with each pair's window; rejected or unknown ones have nulls.

    Bins come from the middles of the anchors for scoring. Repeated pairs are one row. Pairs between chromosomes are
    scored with ``inter``, in whichever order their chromosomes are given. ``tsvd`` as for detection.
    """
    kernels = [np.matmul(*factorise(k, tsvd)) for k in config.kernels] if tsvd else list(config.kernels)
    correlate.check_kernels(kernels)
    size = kernels[0].shape[0]
    anchors = swap_anchors(positions).dropDuplicates(["chrom1", "start1", "chrom2", "start2"])
    known = anchors.where("chrom1 = chrom2").join(F.broadcast(cmap.chroms.select(F.col("chrom").alias("chrom1"), "length")), "chrom1").where("start2 < length")
    reach = known.agg(F.max(F.col("start2") - F.col("start1"))).first()[0] or 0
    reach_bins = max_dist_bins(replace(config, max_dist=reach), cmap.bin_size) + 1
    scratch = Scratch(cmap.bins.sparkSession, "positions")
    rows = scratch.keep(anchors.withColumn("qid", F.monotonically_increasing_id()), "numbered")
    for k in (1, 2):
        pos = rows.withColumn("chrom", F.col(f"chrom{k}")).withColumn("pos", F.floor((F.col(f"start{k}") + F.col(f"end{k}")) / 2))
        rows = genome.coords_to_bins(pos, cmap.bins, cmap.bin_size).withColumnRenamed("bin_id", f"m{k}").drop("chrom", "pos")
    lost = rows.where("m1 IS NULL OR m2 IS NULL").count()
    if lost:
        warnings.warn(f"{lost} positions lie outside the genome: they get no score", stacklevel=2)
    at = rows.where("m1 IS NOT NULL AND m2 IS NOT NULL")
    for k in (1, 2):
        side = cmap.chroms.select(F.col("chrom").alias(f"chrom{k}"), F.col("chrom_idx").alias(f"x{k}"), F.col("start_bin").alias(f"s{k}"))
        at = at.join(F.broadcast(side), f"chrom{k}")
    place = lambda k: F.col(f"m{k}") - F.col(f"s{k}")
    cis = scratch.keep(at.where("x1 = x2").select("qid", F.col("x1").alias("sub"), place(1).alias("i"), place(2).alias("j")), "cis")
    # A far pair widens the band to its distance, but only the diagonals that windows reach are read.
    d = F.col("j") - F.col("i")
    diagonals = cis.select("sub", F.explode(F.sequence(d - size + 1, d + size - 1)).alias("d")).where("d >= 0").distinct()
    scored = _scored(config, prepared(cmap, reach_bins, size, raw, diagonals=diagonals), cis, kernels, reach_bins)
    if inter:
        n, x1, x2 = cmap.chroms.count(), F.col("x1").cast("long"), F.col("x2").cast("long")
        first = x1 < x2
        pair = F.when(first, x1 * n + x2).otherwise(x2 * n + x1)
        across = at.where("x1 <> x2").select("qid", pair.alias("sub"), F.when(first, place(1)).otherwise(place(2)).alias("i"), F.when(first, place(2)).otherwise(place(1)).alias("j"))
        scored = scored.unionByName(_scored(config, prepared_inter(cmap, raw), across, kernels, reach_bins))
    best = nms.best_kernel(scored, ["qid"])
    out = rows.join(best, "qid", "left")
    for k in (1, 2):
        pos = out.withColumn("chrom", F.col(f"chrom{k}")).withColumn("pos", F.col(f"start{k}"))
        out = genome.coords_to_bins(pos, cmap.bins, cmap.bin_size).withColumnRenamed("bin_id", f"bin{k}").drop("chrom", "pos")
    return benjamini_hochberg(out).select(*QUANTIFY, "window").orderBy("bin1", "bin2")


def _any_kernel(size: int) -> np.ndarray:
    """A kernel that isn't flat, where only windows are wanted."""
    return np.eye(size)


def make_config(cmap: ContactMap, config: KernelConfig, positions: DataFrame, size: int, raw: bool = False, inter: bool = False) -> KernelConfig:
    """A configuration whose kernel is the blurred mean window of given positions."""
    base = replace(config, kernels=[_any_kernel(size)], max_perc_zero=101.0, max_perc_undetected=101.0)
    rows = quantify(cmap, base, positions, raw=raw, inter=inter).where("window IS NOT NULL")
    cells = rows.select(F.posexplode("window").alias("a", "row")).select("a", F.posexplode("row").alias("b", "v"))
    mean = np.zeros((size, size))
    for r in cells.groupBy("a", "b").agg(F.avg("v").alias("mean")).collect():  # as many rows as a window has cells
        mean[r["a"], r["b"]] = r["mean"] or 0.0
    return replace(config, kernels=[blur(mean)])


def top_windows(patterns: DataFrame, n: int) -> DataFrame:
    """The ``n`` best patterns of each kernel."""
    place = F.row_number().over(Window.partitionBy("kernel_id").orderBy(F.desc("score"), "bin1", "bin2"))
    return patterns.withColumn("place", place).where(F.col("place") <= n)
