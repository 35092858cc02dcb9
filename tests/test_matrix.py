import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import correlate, matrix
from gridloom.sources.kernels import bump, factorise, kernel_frame, stripe


def frame(spark, m):
    return spark.createDataFrame([(0, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "sub int, i long, j long, v double")


def dense(rows, n, value="v"):
    out = np.zeros((n, n))
    for r in rows.collect():
        out[r.i, r.j] = r[value]
    return out


def test_plain_operations(spark):
    m = np.triu(np.random.default_rng(0).integers(0, 4, (8, 8))).astype(float)
    rows = frame(spark, m)
    assert (dense(matrix.symmetric(rows), 8) == m + m.T - np.diag(np.diag(m))).all()
    assert (dense(matrix.zero_pad(rows, 1, 2), 11)[1:9, 2:10] == m).all()
    want = m.copy()
    np.fill_diagonal(want[:, 2:], 9)
    assert (dense(matrix.set_diagonal(rows, 8, 2, 9), 8) == want).all()
    valid = spark.createDataFrame([(1,), (4,)], "bin long")
    assert sorted(r.bin for r in matrix.complement(valid, 6).collect()) == [0, 2, 3, 5]
    matrix.check_mask(rows, spark.createDataFrame([], "sub int, bin long"))
    with pytest.raises(ValueError):
        matrix.check_mask(rows, spark.createDataFrame([(0, int(np.nonzero(m.any(1))[0][0]))], "sub int, bin long"))


@pytest.mark.parametrize("kernel", [bump(7, 1.3), stripe(7, True), np.random.default_rng(2).random((5, 5))])
def test_correlation_equals_direct_sums(spark, kernel):
    n, h, D = 30, kernel.shape[0] // 2, 12
    m = np.triu(np.random.default_rng(1).random((n, n))) * (np.random.default_rng(3).random((n, n)) < 0.7)
    padded = np.pad(m, h)
    want = np.array([[(padded[i : i + 2 * h + 1, j : j + 2 * h + 1] * kernel).sum() for j in range(n)] for i in range(n)])
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    want[(d < 0) | (d > D)] = 0
    # Windows over the border aren't put out.
    want[:h], want[-h:], want[:, :h], want[:, -h:] = 0, 0, 0, 0
    rows, sizes = frame(spark, m), spark.createDataFrame([(0, n)], "sub int, n long")
    assert np.allclose(dense(correlate.xcorr2(rows, kernel_frame(spark, [kernel]), sizes, 2 * h + 1, D, eps=0), n, "x"), want)
    down, across = factorise(kernel, 1 - 1e-13) if np.linalg.matrix_rank(kernel) > 1 else factorise(kernel)
    assert np.allclose(dense(correlate.xcorr2_factored(rows, down, across, sizes, D, eps=0), n, "x"), want, atol=1e-5)


def test_correlation_without_a_mask_equals_direct_coefficients(spark):
    n, D, kernel = 24, 10, bump(5, 1.0)
    m = np.triu(np.random.default_rng(4).random((n, n)))
    m[np.triu_indices(n, D + 5)] = 0
    got = correlate.normxcorr2(frame(spark, m), kernel_frame(spark, [kernel]), D, 5, spark.createDataFrame([(0, n)], "sub int, n long"), eps=0.0).collect()
    want = {(i, j): np.corrcoef(m[i - 2 : i + 3, j - 2 : j + 3].ravel(), kernel.ravel())[0, 1] for i in range(2, n - 2) for j in range(i, min(n - 2, i + D + 1))}
    assert {(r.i, r.j) for r in got} == set(want)
    assert all(abs(r.r - want[r.i, r.j]) < 1e-9 and r.n_obs == 25 for r in got)


@pytest.mark.parametrize(("size", "tile"), [(7, 16), (31, 16), (31, 256)])
def test_sliding_box_sums(spark, size, tile):
    n, h, D = 90, size // 2, 40
    m = np.triu(np.random.default_rng(7).random((n, n))) * (np.random.default_rng(8).random((n, n)) < 0.02)
    rows, sizes = frame(spark, m), spark.createDataFrame([(0, n)], "sub int, n long")
    got = {(r.i, r.j): (r.v1, r.v2) for r in correlate.box_sums(rows, sizes, size, D, tile).collect()}
    padded = np.pad(m, h)
    want = {}
    for i in range(n):
        for j in range(i, min(n, i + D + 1)):
            w = padded[i : i + size, j : j + size]
            if w.any():
                want[i, j] = (w.sum(), (w * w).sum())
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_masks_are_checked_inside_the_plan(spark):
    rows = spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 3, 0.0), (0, 2, 4, 2.0)], "sub int, i long, j long, v double")
    sizes, gone = spark.createDataFrame([(0, 5)], "sub int, n long"), lambda *b: spark.createDataFrame([(0, x) for x in b], "sub int, bin long")
    assert sorted(correlate.check_mask(rows, gone(0, 3), sizes).collect()) == sorted(rows.collect())
    for mask, n, said in ((gone(4), 5, "under the mask"), (gone(1), 5, "under the mask"), (gone(0), 4, "shapes")):
        with pytest.raises(Exception, match=said):
            correlate.check_mask(rows, mask, spark.createDataFrame([(0, n)], "sub int, n long")).collect()


def test_a_thousand_scaffolds(spark):
    """Pairs of chromosomes are made from pixels, not from the square of their number."""
    from gridloom.plans import pipeline
    from gridloom.sources.contacts import BINS, PIXELS, ContactMap, chrom_offsets

    bins = spark.createDataFrame([(k, f"s{k // 3}", k % 3 * 10, k % 3 * 10 + 10, 1.0) for k in range(3000)], BINS)
    pixels = spark.createDataFrame([(k, k + 30 + d, 1.0 + d) for k in range(0, 2900, 7) for d in (0, 1)], PIXELS)
    signal, pairs, _, _ = pipeline.prepared_inter(ContactMap(chrom_offsets(bins), bins, pixels, 10))
    met = {(k // 3, (k + 30 + d) // 3) for k in range(0, 2900, 7) for d in (0, 1)}
    assert pairs.count() == len(met) and {r.sub for r in pairs.collect()} == {a * 1000 + b for a, b in met}
    assert signal.count() == pixels.count()


def test_pairs_of_very_many_scaffolds_have_numbers_of_their_own(spark):
    """The square of 60,000 doesn't fit an integer; correlation by either plan and foci keep the number."""
    from gridloom.operators import foci
    from gridloom.plans import pipeline
    from gridloom.sources.contacts import ContactMap, chrom_offsets

    n = 60_000
    k = F.col("id")
    bins = spark.range(n * 2).select(k.alias("bin_id"), F.concat(F.lit("s"), F.floor(k / 2)).alias("chrom"), (k % 2 * 10).alias("start"), (k % 2 * 10 + 10).alias("end"), F.lit(1.0).alias("weight"))
    cmap = ContactMap(chrom_offsets(bins), bins, spark.createDataFrame([(2 * n - 4, 2 * n - 1, 5.0), (2 * n - 4, 2 * n - 2, 1.0)], "bin1_id long, bin2_id long, count double"), 10)
    signal, pairs, rows, columns = pipeline.prepared_inter(cmap)
    want = (n - 2) * n + n - 1
    assert [tuple(r) for r in pairs.collect()] == [(want, 2, 2)]
    for plan in ("scatter", "tile"):
        corr = correlate.normxcorr2_inter(signal, kernel_frame(spark, [bump(7, 1.3)]), pairs, rows, columns, 7, 1.0, plan=plan)
        assert {r["sub"] for r in foci.label(corr.select("sub", "kernel_id", "i", "j", "r", "log10_p")).collect()} == {want}


@pytest.mark.parametrize("name", ["xcorr_raw", "xcorr_box", "xcorr_box_separable"])
def test_windows_over_the_borders_are_put_out(spark, name):
    """Every window with a stored value, as in the SQL: also those that aren't whole."""
    import os

    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are absent")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    names = ["sub", "i", "j"]
    want = con.execute(f"select {', '.join(names)} from ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select(*names).collect()]
    assert sorted(got) == sorted(want) and min(i for _, i, _ in got) == 0
