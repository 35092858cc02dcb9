"""Patterns between chromosomes: what leaves the tiles equals the steps over tables, and doesn't grow with isolated pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import areas, correlate, foci, preprocess, windows
from gridloom.plans import pipeline
from gridloom.scratch import Scratch
from gridloom.sources.contacts import BINS, PIXELS, ContactMap, chrom_offsets
from gridloom.sources.kernels import KernelConfig, bump, kernel_frame, stripe

LOST = {(1, 0), (1, 15), (1, 16), (2, 19)}, {(1, 34), (2, 31), (2, 32)}


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def by_tables(corr, local, sizes, gone, size, threshold, most_zero, most_missing):
    picked = foci.best_pixel(foci.sized(foci.label(foci.candidates(corr, threshold)))).withColumn("pid", F.struct("sub", "kernel_id", "label"))
    cells = windows.cells(picked.select("pid", "sub", "i", "j"), local, sizes, gone[0], size, gone[1])
    valid = windows.validity(picked, cells, sizes, most_zero, most_missing).where("valid")
    return valid.join(windows.as_arrays(cells, size), "pid").orderBy("sub", "kernel_id", "label").collect()


@pytest.mark.parametrize("share,threshold,most_zero,tile,most", [(0.35, 0.2, 75.0, 16, 10**6), (0.35, 0.2, 75.0, 16, 1), (0.9, -0.2, 60.0, 8, 10**6), (0.6, 0.1, 45.0, 256, 10**6)])
def test_foci_of_tiles_equal_those_of_tables(spark, share, threshold, most_zero, tile, most):
    """Small tiles that groups cross several times, windows over borders and missing rows, two kernels; ties (whole numbers)."""
    rng = np.random.default_rng(5)
    shapes = {1: (50, 35), 2: (20, 61), 9: (7, 40)}
    rows = [(s, i, j, float(rng.integers(1, 5))) for s, (n, m) in shapes.items() for i in range(n) for j in range(m) if rng.random() < share and (s, i) not in LOST[0] and (s, j) not in LOST[1]]
    local = spark.createDataFrame(rows, "sub long, i long, j long, v double")
    sizes = spark.createDataFrame([(s, *nm) for s, nm in shapes.items()], "sub long, n long, m long")
    gone = [spark.createDataFrame(sorted(x), "sub long, bin long") for x in LOST]
    kernel = kernel_frame(spark, [bump(7, 1.3), stripe(7, True)])
    corr = correlate.normxcorr2_inter(local, kernel, sizes, *gone, 7, 0.5, tile=tile)
    want = by_tables(corr, local, sizes, gone, 7, threshold, most_zero, 50.0)
    got = areas.valid_foci(local, kernel, sizes, *gone, 7, threshold, most_zero, 50.0, tile=tile, most=most).orderBy("sub", "kernel_id", "label").collect()
    place = lambda r: (r.sub, r.kernel_id, r.i, r.j, r.r, r.n_obs, r.log10_p)
    assert [place(r) for r in got] == [place(r) for r in want] and len(want) > 3
    assert [r.window for r in got] == [[v for row in r.window for v in row] for r in want]


def thin_map(spark, n=300):
    rng = np.random.default_rng(4)
    bins = spark.createDataFrame([(b, f"chr{b // n + 1}", b % n * 1000, b % n * 1000 + 1000, None if b == 3 else 1.0) for b in range(2 * n)], BINS)
    far = {(int(i), n + int(j)) for i, j in rng.integers(0, n, (1500, 2))} | {(100 + a, n + 200 + b) for a in range(7) for b in range(7)}
    # Values of a bump at one place, one contact elsewhere.
    pixels = [(i, j, 5 + 40 * float(np.exp(-((i - 103) ** 2 + (j - n - 203) ** 2) / 4)) if 100 <= i < 107 and 200 <= j - n < 207 else 5.0) for i, j in sorted(far)]
    pixels += [(b, b + d, 9.0) for b in range(n - 5) for d in range(3)]
    return ContactMap(chrom_offsets(bins), bins, spark.createDataFrame(pixels, PIXELS), 1000)


def test_isolated_pixels_leave_no_tables_of_windows(spark, monkeypatch):
    """Nearly every pixel makes a focus whose window is empty: neither it nor its 49 cells are written."""
    cmap = thin_map(spark)
    written, keep = {}, Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    config = KernelConfig("t", [bump(7, 1.3)], 10_000, 2000, 1, 5000, 0.35, 1000, 60.0, 50.0)
    want = [r for r in pipeline.detect(cmap, config, plan="scatter", inter=True)[0].collect() if r.chrom1 != r.chrom2]
    monkeypatch.setattr(Scratch, "keep", counted)
    patterns, piles = pipeline.detect(cmap, config, inter=True, with_windows=True)
    rows = [r for r in patterns.collect() if r.chrom1 != r.chrom2]
    assert [(r.bin1, r.bin2) for r in rows] == [(r.bin1, r.bin2) for r in want] == [(103, 503)]
    assert rows[0].score == pytest.approx(want[0].score) and rows[0].window[3][3] == max(max(r) for r in rows[0].window)
    assert max(written.values()) <= cmap.pixels.count()


def test_pixels_between_chromosomes_meet_medians_and_missing_bins_in_place(spark):
    signal, pairs, *gone = pipeline.prepared_inter(thin_map(spark))
    text = plan(correlate.check_mask(signal, gone[0], pairs, gone[1]))
    assert "SortMergeJoin" not in text and "hashpartitioning(sub1" not in text
    assert preprocess.inter_scale(spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (0, 2, 5.0)], "sub1 int, sub2 int, v double")).count() == 3
