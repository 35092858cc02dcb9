import json
import math

import numpy as np
import pandas as pd
import pytest

from gridloom.functions.stats import benjamini_hochberg, corr_to_log10p
from gridloom.operators import correlate, foci, nms, windows
from gridloom.plans import pipeline
from gridloom.sources import kernels, sinks
from gridloom.synth import synthetic_map
from pyspark.sql import functions as F


def brute(v, k, n, D, lost):
    """Correlation of the cells that aren't missing, cell by cell."""
    s, h = k.shape[0], k.shape[0] // 2
    out = {}
    for i in range(n):
        for j in range(i, min(n, i + D + 1)):
            a, b = [], []
            any_signal = False
            for di in range(-h, h + 1):
                for dj in range(-h, h + 1):
                    x, y = i + di, j + dj
                    val = v.get((x, y), 0.0)
                    any_signal |= val != 0
                    gone = (0 <= x <= y < n and y - x <= D and (x in lost or y in lost)) or (x < 0 and 0 <= y < D + s) or (x < 0 and y < 0) or (y >= n and x >= n - D - 2) or -s <= y - x <= -1
                    if not gone:
                        a.append(val)
                        b.append(k[di + h, dj + h])
            if any_signal and len(a) >= int(0.5 * s * s) and len(a) > 3 and np.std(a) > 1e-9 and np.std(b) > 1e-9:
                out[i, j] = (float(np.corrcoef(a, b)[0, 1]), len(a))
    return out


@pytest.mark.parametrize("plan", ["scatter", "tile"])
def test_masked_correlation_equals_brute_force(spark, plan):
    rng = np.random.default_rng(5)
    n, D, lost = 40, 12, {5, 6, 20, 39}
    v = {(i, j): float(rng.random()) for i in range(n) for j in range(i, min(n, i + D + 8)) if rng.random() < 0.6 and i not in lost and j not in lost}
    kernel = kernels.bump(7, 1.3)
    local = spark.createDataFrame([(0, i, j, x) for (i, j), x in v.items()], "sub int, i long, j long, v double")
    sizes = spark.createDataFrame([(0, n)], "sub int, n long")
    gone = spark.createDataFrame([(0, b) for b in lost], "sub int, bin long")
    got = correlate.normxcorr2(local, kernels.kernel_frame(spark, [kernel]), D, 7, sizes, gone, 0.5, eps=0.0, plan=plan).collect()
    got = {(r.i, r.j): (r.r, r.n_obs) for r in got}
    want = brute(v, kernel, n, D, lost)
    assert {k for k, x in want.items() if abs(x[0]) > 1e-9} <= set(got)
    for k, (r, m) in want.items():
        if k in got:
            assert got[k][1] == m and abs(got[k][0] - r) < 1e-9, k


@pytest.mark.parametrize("factored", [False, True])
def test_plans_agree_over_tiles(spark, factored):
    cmap, _ = synthetic_map(spark, 300, reach=80, missing=(50, 51, 249, 258, 299))
    signal, sizes, gone = pipeline.prepared(cmap, 60, 7)
    both = [kernels.bump(7, 1.3), kernels.blocks(7)]
    k = kernels.kernel_frame(spark, both)
    factors = [kernels.factorise(x, 1 - 1e-12) for x in both] if factored else None
    a, b = (correlate.normxcorr2(signal, k, 60, 7, sizes, gone, plan=p, factors=f) for p, f in (("scatter", None), ("tile", factors)))
    if factored:
        b = correlate.normxcorr2(signal, k, 60, 7, sizes, gone, factors=factors)
    both = a.join(b.withColumnRenamed("r", "r2").drop("n_obs", "log10_p"), ["sub", "kernel_id", "i", "j"], "full")
    assert both.where("r IS NULL OR r2 IS NULL OR abs(r - r2) > 1e-9").count() == 0 and a.count() > 10_000


@pytest.mark.parametrize("factored", [False, True])
def test_plans_agree_between_chromosomes(spark, factored):
    """Two pairs of unlike sizes over several small tiles, one of them empty in the middle, with missing rows and columns."""
    rng = np.random.default_rng(2)
    shapes, lost = {1: (50, 35), 2: (20, 61)}, ({(1, 0), (1, 15), (1, 16), (2, 19)}, {(1, 34), (2, 31), (2, 32)})
    rows = [(s, i, j, float(rng.random())) for s, (n, m) in shapes.items() for i in range(n) for j in range(m) if rng.random() < 0.4 and (s, i) not in lost[0] and (s, j) not in lost[1] and not (s == 2 and 16 <= j < 50)]
    local = spark.createDataFrame(rows, "sub int, i long, j long, v double")
    sizes = spark.createDataFrame([(s, *nm) for s, nm in shapes.items()], "sub int, n long, m long")
    gone = [spark.createDataFrame(sorted(x), "sub int, bin long") for x in lost]
    both = [kernels.bump(7, 1.3), kernels.blocks(7)]
    factors = [kernels.factorise(x, 1 - 1e-12) for x in both] if factored else None
    scatter, tile = (
        {tuple(r[:4]): r[4:6] for r in correlate.normxcorr2_inter(local, kernels.kernel_frame(spark, both), sizes, *gone, 7, 0.5, plan=p, factors=factors, tile=16).collect()} for p in ("scatter", "tile")
    )
    assert len(scatter) > 3000 and scatter.keys() == tile.keys()
    assert all(abs(r - tile[k][0]) < 1e-9 and n == tile[k][1] for k, (r, n) in scatter.items())


def log10_erfc(x):
    """From the continued fraction of erfc, which holds far below the smallest double."""
    if x < 2:
        return math.log10(math.erfc(x))
    f = 0.0
    for k in range(200, 0, -1):
        f = k / 2 / (x + f)
    return (-x * x - math.log(math.sqrt(math.pi) * (x + f))) / math.log(10)


def test_p_values(spark):
    rows = spark.createDataFrame([(0.0, 20.0), (0.3, 49.0), (-0.9, 100.0), (0.99, 289.0), (0.5, 3.0), (0.9999, 961.0), (0.999, 5000.0)], "r double, n double")
    for r in rows.withColumn("p", corr_to_log10p(F.col("r"), F.col("n"))).collect():
        if r.n <= 3:
            assert r.p is None
        else:
            z = abs(math.atanh(r.r)) * math.sqrt(r.n - 3)
            assert abs(r.p - log10_erfc(z / math.sqrt(2))) < 1e-6


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.1), (2, 0.05), (3, 0.01), (4, None)], "k int, pvalue double")
    got = {r.k: r.qvalue for r in benjamini_hochberg(rows).collect()}
    assert got[4] is None and [round(got[k], 9) for k in range(4)] == [0.1, 0.1, 0.1, 0.04]


def test_labels(spark):
    m = [[1, 0, 0, 0, 1, 1], [1, 0, 1, 0, 0, 0], [1, 0, 1, 1, 0, 0], [0, 1, 0, 0, 0, 1]]
    want = [[1, 0, 0, 0, 2, 2], [1, 0, 3, 0, 0, 0], [1, 0, 3, 3, 0, 0], [0, 4, 0, 0, 0, 5]]
    rows = spark.createDataFrame([(0, 0, i, j, 1.0) for i in range(4) for j in range(6) if m[i][j]], "sub int, kernel_id int, i long, j long, r double")
    got = foci.label(rows)
    assert {(r.i, r.j): r.label for r in got.collect()} == {(i, j): want[i][j] for i in range(4) for j in range(6) if want[i][j]}
    assert foci.sized(got, 2).select("label").distinct().count() == 3 and foci.sized(got, 3).select("label").distinct().count() == 2


def test_snake_shaped_focus_is_one(spark):
    cells, i, j = [], 0, 0
    for k in range(60):
        cells.append((0, 0, i, j, 1.0))
        i, j = (i + 1, j) if k % 2 else (i, j + 1)
    assert {r.label for r in foci.label(spark.createDataFrame(cells, "sub int, kernel_id int, i long, j long, r double")).collect()} == {1}


@pytest.mark.parametrize(("tile", "most"), [(3, 1), (3, 10**6), (7, 5), (1024, 1)])
def test_labels_over_tiles(spark, tile, most):
    """Random maps near the density where groups wind through many tiles, against a flood fill."""
    rng = np.random.default_rng(tile)
    m = rng.random((30, 30)) < 0.58
    want, n = np.zeros(m.shape, int), 0
    for i, j in zip(*np.nonzero(m), strict=True):
        if not want[i, j]:
            n += 1
            todo = [(i, j)]
            while todo:
                x, y = todo.pop()
                if 0 <= x < 30 and 0 <= y < 30 and m[x, y] and not want[x, y]:
                    want[x, y] = n
                    todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    rows = spark.createDataFrame([(0, 0, int(i), int(j), 1.0) for i, j in zip(*np.nonzero(m), strict=True)], "sub int, kernel_id int, i long, j long, r double")
    got = foci.label(rows, tile, most).collect()
    assert {(r.i, r.j): r.label for r in got} == {(int(i), int(j)): int(want[i, j]) for i, j in zip(*np.nonzero(m), strict=True)}


def test_nms_equals_the_greedy_walk(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        pts = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 60, 80), rng.integers(0, 60, 80), rng.integers(0, 20, 80), strict=True)]
        kept = []
        for p in sorted(set(pts), key=lambda p: (-p[2], p[0], p[1])):
            if not any(abs(p[0] - q[0]) < 8 and abs(p[1] - q[1]) < 8 for q in kept):
                kept.append(p)
        got = nms.remove_neighbours(spark.createDataFrame(list(set(pts)), "bin1 long, bin2 long, score double"), 8)
        assert sorted(map(tuple, got.collect())) == sorted(kept)


@pytest.mark.parametrize(("side", "most"), [(16, 10**6), (16, 40), (200, 1)])
def test_tiles_equal_the_greedy_walk(spark, side, most):
    """Plateaus, a line and repeated places over many small tiles; ``most`` forces rounds of one size."""
    rng = np.random.default_rng(side + most)
    pts = [(int(a) - 50, int(b), float(s), int(k)) for a, b, s, k in zip(rng.integers(0, 150, 900), rng.integers(0, 150, 900), rng.integers(0, 4, 900), rng.integers(0, 3, 900), strict=True)]
    pts += [(k, 300, 1.0, 0) for k in range(0, 160 if most > 1 else 40)]
    pts = list(set(pts))[: 10**6 if most > 1 else 60]
    kept = []
    for p in sorted(pts, key=lambda p: (-p[2], p[0], p[1], p[3])):
        if not any(abs(p[0] - q[0]) < 5 and abs(p[1] - q[1]) < 5 for q in kept):
            kept.append(p)
    rows = spark.createDataFrame(pts, "bin1 long, bin2 long, score double, kernel_id int").repartition(4)
    assert sorted(map(tuple, nms.remove_neighbours(rows, 5, side=side, most=most).collect())) == sorted(kept)


def test_a_plateau_takes_few_rounds(spark, monkeypatch):
    """100,000 equal scores on the diagonal, each next to the one before."""
    rounds, walked = [], nms._decided
    monkeypatch.setattr(nms, "_decided", lambda *a: rounds.append(1) or walked(*a))
    line = spark.range(100_000).select(F.col("id").alias("bin1"), F.col("id").alias("bin2"), F.lit(1.0).alias("score"))
    got = nms.remove_neighbours(line, 5)
    assert sorted(r.bin1 for r in got.select("bin1").collect()) == list(range(0, 100_000, 5)) and len(rounds) == 2


def test_detect_finds_planted_loops(spark, tmp_path):
    cmap, places = synthetic_map(spark, 200, chroms=2)
    config = kernels.KernelConfig("t", [kernels.bump(7, 1.5)], 45_000, 2000, 1, 5000, 0.5, 1000, 30, 50)
    patterns, pile = pipeline.detect(cmap, config, dump=str(tmp_path / "dump"))
    assert patterns.columns == pipeline.DETECT
    rows = patterns.collect()
    found = [p for p in places if any(abs(r.bin1 - p[0]) <= 1 and abs(r.bin2 - p[1]) <= 1 for r in rows)]
    assert len(found) >= 0.9 * len(places) and len(rows) <= 2 * len(places)
    assert pile.count() == 49 and all(r.qvalue >= r.pvalue - 1e-12 for r in rows)
    positions = spark.createDataFrame([("chr1", r.start1, r.end1, "chr1", r.start2, r.end2) for r in rows if r.chrom1 == "chr1"] + [("chr9", 0, 10, "chr9", 5, 15)], "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long")
    scored = pipeline.quantify(cmap, config, positions)
    assert scored.columns == [*pipeline.QUANTIFY, "window"]
    by = {(r.bin1, r.bin2): r for r in scored.collect()}
    assert by[None, None].score is None
    for r in rows:
        if r.chrom1 == "chr1":
            assert abs(by[r.bin1, r.bin2].score - r.score) < 0.1 and len(by[r.bin1, r.bin2].window) == 7
    path = sinks.write_patterns(patterns, str(tmp_path / "out"), 4, ["bin1", "bin2"])
    lines = open(path).read().splitlines()
    assert lines[0].split("\t") == pipeline.DETECT and len(lines) == len(rows) + 1 and all(len(x.split("\t")[10].split(".")[1]) == 4 for x in lines[1:])


def test_iterations_refine_the_kernel(spark):
    cmap, places = synthetic_map(spark, 120)
    config = kernels.KernelConfig("t", [kernels.bump(7, 1.5)], 45_000, 0, 2, 5000, 0.5, 1000, 30, 50)
    patterns, pile = pipeline.detect(cmap, config, with_windows=True)
    rows = patterns.collect()
    assert {r.iteration for r in rows} == {0, 1} and pile.count() == 49
    # The learned kernel fits planted loops better than the drawn one.
    again = [r for r in rows if r.iteration == 1]
    assert max(r.score for r in again) > 0.8 and any(abs(r.bin1 - a) <= 1 and abs(r.bin2 - b) <= 1 for r in again for a, b in places)
    assert all(len(r.window) == 7 and len(r.window[0]) == 7 for r in rows)


def test_iterations_on_the_diagonal(spark):
    """The mean window of patterns on the diagonal lacks its lower cells: it is symmetrised before it serves as a kernel."""
    window = pipeline._learned(pd.DataFrame([(a, b, float(a + b) if b >= a else None) for a in range(5) for b in range(5)], columns=["a", "b", "mean"]), 5, True)
    assert (window == window.T).all() and window[0, 4] == 4 and window[2, 2] == 4
    cmap, _ = synthetic_map(spark, 120)
    config = kernels.KernelConfig("t", [kernels.blocks(7)], 0, 0, 2, 5000, 0.1, 1000, 60, 75)
    patterns, _ = pipeline.detect(cmap, config)
    assert all(r.bin1 == r.bin2 for r in patterns.collect())


def test_points_score_as_in_the_whole_map(spark):
    cmap, _ = synthetic_map(spark, 150, missing=(20, 50, 51))
    signal, sizes, gone = pipeline.prepared(cmap, 40, 7)
    k = kernels.kernel_frame(spark, [kernels.bump(7, 1.3), kernels.blocks(7)])
    whole = {(r.i, r.j, r.kernel_id): (r.r, r.n_obs) for r in correlate.normxcorr2(signal, k, 40, 7, sizes, gone, 0.5).collect()}
    points = spark.createDataFrame([(i * 1000 + j, 0, i, j) for i in range(0, 150, 5) for j in range(i, min(150, i + 40), 3)], "pid long, sub int, i long, j long")
    cells = windows.cells(points, signal, sizes, gone, 7)
    got = {(r.i, r.j, r.kernel_id): (r.r, r.n_obs) for r in correlate.normxcorr2_at(points, cells, k, sizes, gone, 40, 7, missing_tol=0.5).collect()}
    want = {key: v for key, v in whole.items() if key[0] % 5 == 0 and (key[1] - key[0]) % 3 == 0}
    assert got.keys() == want.keys() and all(abs(got[key][0] - want[key][0]) < 1e-9 and got[key][1] == want[key][1] for key in want)


def test_arguments_of_the_correlation():
    good = kernels.bump(7, 1.3)
    correlate.check_kernels([good, good], (10, 10))
    for bad, shape in (([np.ones((7, 7))], None), ([np.zeros((4, 4))], None), ([good, kernels.bump(9, 1.3)], None), ([good[:5]], None), ([good], (7, 5))):
        with pytest.raises(ValueError):
            correlate.check_kernels(bad, shape)


def test_kernel_sizes():
    k = np.zeros((15, 15))
    k[7, 7] = 10
    for f in (0.6, 1.0, 1.7, 2.0):
        r = kernels.resize(k, f)
        assert r.shape[0] % 2 and r.shape[0] >= 7 and r.argmax() == r.size // 2
    assert kernels.resize(k, 0.1).shape == (7, 7) and kernels.crop(k, 4).shape == (5, 5) and kernels.crop(k, 5).max() == 10
    with pytest.raises(ValueError):
        kernels.resize(np.zeros((4, 4)), 2)
    u, v = kernels.factorise(np.outer(np.arange(1, 8), np.ones(7)))
    assert u.shape == (7, 1) and np.allclose(u @ v, np.outer(np.arange(1, 8), np.ones(7)))
    assert abs(kernels.blur(np.ones((9, 9))) - 1).max() < 1e-12


def test_configurations(tmp_path):
    for name in kernels.PRESETS:
        assert all(x % 2 for k in kernels.load_config(name).kernels for x in k.shape)
    config = {"name": "x", "max_dist": 1, "min_dist": 0, "max_iterations": 1, "min_separation": 1, "pearson": 0.2, "resolution": 5}
    path = sinks.write_config(config, [np.ones((3, 3))], str(tmp_path / "k"))
    assert kernels.load_config(path, custom=True).kernels[0].shape == (3, 3)
    for change in ({"max_dist": -1}, {"pearson": None}, {"name": 3}):
        broken = {**json.loads((tmp_path / "k.json").read_text()), **change}
        with pytest.raises(ValueError):
            kernels.validate({k: v for k, v in broken.items() if v is not None})
    assert kernels.overridden(kernels.load_config("loops"), pearson="0.7", min_dist="auto").pearson == 0.7


def test_window_files(tmp_path):
    w = np.random.default_rng(0).random((4, 3, 3))
    assert np.allclose([json.load(open(sinks.save_windows(w, str(tmp_path / "w"))))[str(i)] for i in range(4)], w)
    assert np.allclose(np.load(sinks.save_windows(w, str(tmp_path / "w"), "npy")), w)
    with pytest.raises(ValueError):
        sinks.save_windows(w, str(tmp_path / "w"), "txt")
    with pytest.raises(OSError):
        sinks.check_prefix(str(tmp_path / "none" / "x"))


@pytest.mark.parametrize("plan", ["scatter", "tile"])
def test_pairs_between_chromosomes(spark, plan):
    """A bump planted between two chromosomes is found, and scored in either order of its anchors."""
    from gridloom.sources.contacts import BINS, PIXELS, ContactMap, chrom_offsets

    rng = np.random.default_rng(11)
    n = 40
    bins = spark.createDataFrame([(b, f"chr{b // n + 1}", b % n * 1000, b % n * 1000 + 1000, None if b == 3 else 1.0) for b in range(2 * n)], BINS)
    i, j = np.triu_indices(2 * n)
    mean = np.where((i < n) & (j >= n), 20 * (1 + 4 * np.exp(-((i - 15) ** 2 + (j - n - 22) ** 2) / 4.5)), 60.0)
    pixels = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(i, j, rng.poisson(mean), strict=True) if c], PIXELS)
    cmap = ContactMap(chrom_offsets(bins), bins, pixels, 1000)
    config = kernels.KernelConfig("t", [kernels.bump(7, 1.5)], 10_000, 0, 1, 5000, 0.6, 1000, 30, 50)
    rows = [r for r in pipeline.detect(cmap, config, plan=plan, inter=True)[0].collect() if r.chrom1 != r.chrom2]
    assert any(abs(r.bin1 - 15) <= 1 and abs(r.bin2 - n - 22) <= 1 for r in rows)
    assert not any(r.chrom1 != r.chrom2 for r in pipeline.detect(cmap, config)[0].collect())
    pairs = [("chr1", 15_000, 16_000, "chr2", 22_000, 23_000), ("chr2", 22_000, 23_000, "chr1", 15_000, 16_000), ("chr1", 5000, 6000, "chr1", 9000, 10_000)]
    got = pipeline.quantify(cmap, config, spark.createDataFrame(pairs, "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long"), inter=True).collect()
    across = [r for r in got if r.chrom1 != r.chrom2]
    assert len(across) == 2 and across[0].score == across[1].score > 0.6 and len(got) == 3


@pytest.mark.parametrize("name", sorted(kernels.PRESETS))
def test_a_planted_kernel_peaks_at_its_place(spark, name):
    for kernel in kernels.load_config(name).kernels:
        size, h, place = kernel.shape[0], kernel.shape[0] // 2, (60, 80)
        signal = np.zeros((100, 100))
        signal[place[0] - h : place[0] + h + 1, place[1] - h : place[1] + h + 1] = kernel
        signal = np.triu(signal)
        local = spark.createDataFrame([(0, int(i), int(j), float(signal[i, j])) for i, j in zip(*np.nonzero(signal), strict=True)], "sub int, i long, j long, v double")
        sizes = spark.createDataFrame([(0, 100)], "sub int, n long")
        corr = correlate.normxcorr2(local, kernels.kernel_frame(spark, [kernel]), 60, size, sizes)
        best = corr.orderBy(F.desc("r"), "i", "j").first()
        assert (best.i, best.j) == place and best.r > 0.5


def test_shapes_of_presets():
    left, right = (kernels.load_config(f"stripes_{side}").kernels[0] for side in ("left", "right"))
    assert left[15].all() and left.sum() == 31 and (right == left.T).all()  # left: along the row
    border, end, start = kernels.load_config("borders").kernels
    assert end[0, 0] > end[8, 8] == end[16, 16] and start[16, 16] == start[8, 8] > start[0, 0] and border[0, 0] == border[16, 16] > border[0, 16]
    hairpin = kernels.load_config("hairpins").kernels[0]
    assert hairpin[7, 7] == hairpin[0, 14] == hairpin[14, 0] > hairpin[0, 0] == hairpin[14, 14]
    for name in kernels.PRESETS:
        flat = [k.ravel() for k in kernels.load_config(name).kernels]
        assert all(np.corrcoef(a, b)[0, 1] < 0.95 for i, a in enumerate(flat) for b in flat[:i])


def test_windows_between_chromosomes_are_not_shuffled(spark):
    """Up to 49 windows a pixel: only pixels go to other tasks, and tiles of thin maps are larger."""
    local = spark.createDataFrame([(1, 3, 4, 1.0), (1, 9, 60, 2.0)], "sub int, i long, j long, v double")
    sizes = spark.createDataFrame([(1, 20, 70)], "sub int, n long, m long")
    lost = spark.createDataFrame([(1, 2)], "sub int, bin long")
    got = correlate.normxcorr2_inter(local, kernels.kernel_frame(spark, [kernels.bump(7, 1.3)]), sizes, lost, lost, 7, 0.5)
    text = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Exchange" not in text.split("FlatMapCoGroupsInPandas")[0] and "FlatMapCoGroupsInPandas" in text
    assert {(r.i, r.j) for r in got.where("abs(i - 9) <= 1 AND abs(j - 60) <= 1").collect()} >= {(9, 60)}
    side = lambda n: correlate.area_tile(spark.createDataFrame([(1, n, n)], "sub int, n long, m long"))
    assert (side(2000), side(50_000), side(10**6)) == (256, 512, 1024)
