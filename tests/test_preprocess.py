from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import balance, genome, preprocess
from gridloom.sources.contacts import BINS, chrom_offsets, cooccurrence, read_bed2d, read_bedgraph2, read_map, upper, write_map, write_weights
from gridloom.synth import synthetic_map


def local_frame(spark, rows):
    return spark.createDataFrame(rows, "sub int, i long, j long, v double")


def test_distance_law_and_its_smooth_form(spark):
    m = [[2, 3, 4]] * 3
    rows = local_frame(spark, [(0, i, j, float(m[i][j])) for i in range(3) for j in range(i, 3)])
    law = preprocess.distance_law(rows)
    assert [r.y for r in law.orderBy("d").collect()] == [3.0, 3.5, 4.0]
    assert [r.y for r in preprocess.smoothed(law).orderBy("d").collect()] == [3.5, 3.5, 3.5]
    assert [r.y for r in preprocess.distance_law(rows, 1, F.max).orderBy("d").collect()] == [4.0, 4.0]


def test_smoothing_never_rises_and_keeps_falling_curves(spark):
    rng = np.random.default_rng(0)
    y = rng.random(40)
    law = spark.createDataFrame([(0, d, float(v)) for d, v in enumerate(y)], "sub int, d long, y double")
    out = np.array([r.y for r in preprocess.smoothed(law).orderBy("d").collect()])
    assert (np.diff(out) <= 1e-12).all() and abs(out.mean() - y.mean()) < 1e-9


@pytest.mark.parametrize("part", [1, 7, 1000])
def test_smoothing_is_the_same_for_any_cut(spark, part):
    rng = np.random.default_rng(1)
    n = 50
    curves = [rng.random(n), np.linspace(0, 1, n), np.linspace(1, 0, n), np.linspace(1, 0, n) + rng.normal(0, 0.05, n), np.r_[np.linspace(1, 0.5, n - 1), 90.0], np.ones(n), np.r_[np.nan, rng.random(n - 1)]]
    rows = [(k, 3 * d, None if k == 0 and d == 5 else float(v)) for k, y in enumerate(curves) for d, v in enumerate(y)]
    got = {(r["sub"], r["d"]): r["y"] for r in preprocess.smoothed(spark.createDataFrame(rows, "sub int, d long, y double"), part).collect()}
    for k, y in enumerate(curves):
        y = np.nan_to_num(y)
        y[5] *= k > 0
        mean = lambda a, b, y=y: y[a : b + 1].mean()
        want = [min(max(mean(a, b) for b in range(d, n)) for a in range(d + 1)) for d in range(n)]
        assert np.allclose([got[k, 3 * d] for d in range(n)], want, atol=1e-9)
    assert not preprocess.smoothed(spark.createDataFrame([], "sub int, d long, y double"), part).count()


def test_detrend_sets_outliers_to_one(spark):
    rows = local_frame(spark, [(0, 0, 1, 50.0), (0, 1, 2, 1.0)])
    law = spark.createDataFrame([(0, 1, 2.0)], "sub int, d long, y double")
    assert sorted(r.v for r in preprocess.detrend(rows, law).collect()) == [0.5, 1.0]
    zero = spark.createDataFrame([(0, 1, 0.0)], "sub int, d long, y double")
    assert {r.v for r in preprocess.detrend(rows, zero).collect()} == {1.0}


def test_detectable_bins_drop_empty_ones(spark):
    rng = np.random.default_rng(1)
    pix = [(i, j, float(rng.integers(1, 9))) for i in range(60) for j in range(i, 60) if 10 not in (i, j)]
    bins = spark.createDataFrame([(b, "c", b, b + 1, None) for b in range(60)], BINS)
    got = {r.bin_id for r in preprocess.detectable_intra(spark.createDataFrame(pix, "bin1_id long, bin2_id long, count double"), bins).collect()}
    assert got == set(range(60)) - {10}


def test_marginals_are_those_of_the_symmetric_matrix(spark):
    rng = np.random.default_rng(2)
    m = np.triu(rng.integers(0, 5, (12, 12)))
    pix = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "bin1_id long, bin2_id long, count double")
    full = m + m.T - np.diag(np.diag(m))
    assert {r.bin_id: r.marginal for r in preprocess.marginals(pix).collect()} == {i: s for i, s in enumerate(full.sum(0)) if full[i].any()}


def test_subsample_is_exact_and_refuses_too_many(spark):
    pix = spark.createDataFrame([(i, i + 1, float(i + 1)) for i in range(30)], "bin1_id long, bin2_id long, count double")
    got = {(r.bin1_id, r.bin2_id): r["count"] for r in preprocess.subsample(pix, 100, 5).collect()}
    assert sum(got.values()) == 100 and all(v <= k[0] + 1 for k, v in got.items())
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in preprocess.subsample(pix.repartition(7), 100, 5).collect()} == got
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in preprocess.subsample(pix, 100, 6).collect()} != got
    assert sum(r["count"] for r in preprocess.subsample(pix, 465).collect()) == 465 and preprocess.subsample(pix, 0).count() == 0
    with pytest.raises(ValueError):
        preprocess.subsample(pix, 10**6)


def test_z_transform(spark):
    rows = preprocess.z_transform(local_frame(spark, [(0, 0, k, float(k)) for k in range(5)]))
    v = np.array([r.v for r in rows.collect()])
    assert abs(v.mean()) < 1e-12 and abs(v.std() - 1) < 1e-12


def test_ice_makes_marginals_equal(spark):
    cmap, _ = synthetic_map(spark, 60, loops=0, missing=(), reach=59)
    bins = balance.ice(cmap.pixels, cmap.bins, 60)
    kept = balance.usable_pixels(cmap.pixels, bins)
    m = [r.marginal for r in preprocess.marginals(preprocess.balanced(kept, bins), "v").collect()]
    assert np.std(m) < 0.02 and abs(np.mean(m) - 1) < 1e-6
    with pytest.raises(ValueError):
        balance.normalise(cmap, "other")


def test_coordinates(spark):
    bins = spark.createDataFrame([(b, "chr1" if b < 127 else "chr2", (b if b < 127 else b - 127) * 1000, 0, None) for b in range(200)], BINS)
    coords = spark.createDataFrame([("chr1", 150), ("chr2", 4000), ("x", 1)], "chrom string, pos long")
    assert {r.chrom: r.bin_id for r in genome.coords_to_bins(coords, bins, 1000).collect()} == {"chr1": 0, "chr2": 131, "x": None}
    chroms = chrom_offsets(bins)
    assert genome.sub_matrices(chroms).count() == 2 and genome.sub_matrices(chroms, True).count() == 3


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    bed = [("c%d" % rng.integers(2), int(s), int(s) + int(rng.integers(1, 300))) for s in rng.integers(0, 5000, 80)]
    want = sorted((a, b) for a in bed for b in bed if a[0] == b[0] and b[1] < a[2] + 400 and b[2] > a[1] - 400 and b[1] - a[1] >= 50)
    got = genome.interval_pairs(spark.createDataFrame(bed, "chrom string, start long, end long"), 400, 50).collect()
    assert sorted((tuple(r[:3]), tuple(r[3:])) for r in got) == want


def test_cooccurrence_and_map_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 2), (2, 1)], "k int, b long")
    assert {tuple(r) for r in cooccurrence(rows, "k", "b").collect()} == {(0, 0, 1.0), (0, 2, 2.0), (1, 2, 1.0)}
    both = spark.createDataFrame([(2, 1, 1.0), (1, 2, 2.0)], "bin1_id long, bin2_id long, count double")
    assert [tuple(r) for r in upper(both).collect()] == [(1, 2, 3.0)]
    cmap, _ = synthetic_map(spark, 30, loops=0, chroms=2)
    write_map(cmap, str(tmp_path / "m"))
    back = read_map(spark, str(tmp_path / "m"))
    assert back.bin_size == 1000 and back.pixels.count() == cmap.pixels.count()
    assert [(r.start_bin, r.end_bin) for r in back.chroms.orderBy("start_bin").collect()] == [(0, 30), (30, 60)]


def test_bed2d_header_and_swap(spark, tmp_path):
    body = "chr1\t500\t600\tchr1\t100\t150\textra\nchr1\t5\t6\tchr2\t1\t2\textra\n"
    for head in ("", "chrom1\tstart1\tend1\tchrom2\tstart2\tend2\tx\n"):
        path = tmp_path / "p.bed2d"
        path.write_text(head + body)
        got = {tuple(r) for r in read_bed2d(spark, str(path)).collect()}
        assert got == {("chr1", 100, 150, "chr1", 500, 600), ("chr1", 5, 6, "chr2", 1, 2)}


def test_bedgraph2(spark, tmp_path):
    path = tmp_path / "x.bg2"
    path.write_text("chr1\t0\t1000\tchr1\t2000\t3000\t3\nchr1\t2500\t2600\tchr1\t10\t20\t2\nchr1\t0\t9\tchr2\t1100\t1200\t1\nchr1\t90000\t90001\tchr1\t0\t1\t5\n")
    bins = spark.createDataFrame([(b, f"chr{b // 3 + 1}", b % 3 * 1000, b % 3 * 1000 + 1000, None) for b in range(6)], BINS)
    assert {tuple(r) for r in read_bedgraph2(spark, str(path), bins).collect()} == {(0, 2, 5.0), (0, 4, 1.0)}


def test_lower_pixels_are_folded_and_bins_checked(spark, tmp_path):
    bins = spark.createDataFrame([(b, "c", b * 10, b * 10 + 10, 1.0) for b in range(4)], BINS)
    bins.write.parquet(str(tmp_path / "m" / "bins"))
    spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (3, 2, 4.0), (2, 2, 1.0)], "bin1_id long, bin2_id long, count double").write.parquet(str(tmp_path / "m" / "pixels"))
    cmap = read_map(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in cmap.pixels.collect()} == {(0, 1, 2.0), (2, 3, 4.0), (2, 2, 1.0)}
    write_weights(replace(cmap, bins=bins.withColumn("weight", F.lit(0.5))), str(tmp_path / "m"))
    assert {r.weight for r in read_map(spark, str(tmp_path / "m")).bins.collect()} == {0.5}
    uneven = spark.createDataFrame([(0, "c", 0, 10, 1.0), (1, "c", 10, 15, 1.0), (2, "c", 15, 25, 1.0)], BINS)
    uneven.write.parquet(str(tmp_path / "u" / "bins"))
    cmap.pixels.limit(0).write.parquet(str(tmp_path / "u" / "pixels"))
    with pytest.raises(ValueError):
        read_map(spark, str(tmp_path / "u"))


def test_local_bins_in_a_genome_of_many_scaffolds(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.choice([1, 1, 2, 3, 400], 300)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    chroms = spark.createDataFrame([(f"s{k}", k, n, int(starts[k]), int(starts[k + 1])) for k, n in enumerate(sizes)], "chrom string, chrom_idx int, length long, start_bin long, end_bin long")
    pixels = [(int(min(a, b)), int(max(a, b)), 1.0) for a, b in rng.integers(0, starts[-1], (500, 2))]
    of = lambda b: int(np.searchsorted(starts, b, "right")) - 1
    want = sorted((of(a), of(b), a - int(starts[of(a)]), b - int(starts[of(b)])) for a, b, _ in pixels)
    got = genome.to_local(spark.createDataFrame(pixels, "bin1_id long, bin2_id long, count double"), chroms, inter=True)
    assert sorted((r.sub1, r.sub2, r.i, r.j) for r in got.collect()) == want
    assert genome.chrom_cells(chroms)[0].count() <= 2 * len(sizes)


@pytest.mark.parametrize("most", [100_000, 40])
def test_exact_medians(spark, most):
    """Groups of all kinds: even and odd, heavy tails, ties, negative and huge values, one value, nulls only."""
    from gridloom.functions.order_statistics import exact_median

    rng = np.random.default_rng(most)
    groups = {0: rng.lognormal(0, 6, 1001), 1: rng.lognormal(0, 6, 1000), 2: rng.integers(0, 3, 500).astype(float), 3: np.array([7.5]), 4: -rng.random(333) * 1e-300, 5: np.concatenate([np.full(300, 1.0), np.full(300, 2.0)]), 6: np.concatenate([rng.normal(0, 1, 400) * 4e307, [np.inf, np.inf, -np.inf]]), 9: rng.integers(0, 9, 300) * 5e-324, 7: np.array([1.0, 3.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(0, None), (8, None)]
    table = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r.g: r["median"] for r in exact_median(table, ["g"], "v", most).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k] == pytest.approx(float(np.median(x)), rel=1e-15), k
    one = exact_median(table.where("g = 0"), [], "v", most).collect()
    assert [r["median"] for r in one] == [np.median(groups[0])]


def test_a_large_group_is_never_gathered(spark):
    from gridloom.functions.order_statistics import exact_median

    table = spark.range(2_000_001).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 2_000_001).cast("double").alias("v"))
    assert exact_median(table, ["g"], "v").first()["median"] == 1_000_000.0


def test_draws_by_a_tree(spark):
    """Exact sums, bounds, the same on any layout, another seed another draw; shares near what is expected."""
    from gridloom.operators import sampling

    rng = np.random.default_rng(3)
    rows = sorted({(int(a), int(a + d)): float(n) for a, d, n in zip(rng.integers(0, 60, 900), rng.integers(0, 20, 900), rng.integers(0, 50, 900), strict=True)}.items())
    pix = spark.createDataFrame([(a, b, n) for (a, b), n in rows], "bin1_id long, bin2_id long, count double")
    has, total = {k: n for k, n in rows}, int(sum(n for _, n in rows))
    draw = lambda p, n, seed=1, leaf=40: {(r.bin1_id, r.bin2_id): r["count"] for r in sampling.draw_contacts(p, F.lit(n), seed, leaf=leaf).collect()}
    got = draw(pix.repartition(3), 5000)
    assert sum(got.values()) == 5000 and all(0 < n <= has[k] for k, n in got.items())
    assert draw(pix.repartition(7, "bin2_id"), 5000) == got and draw(pix, 5000, 2) != got
    off = np.array([got.get(k, 0) - n * 5000 / total for k, n in has.items() if n])
    spread = np.sqrt([n * (5000 / total) * (1 - 5000 / total) for n in has.values() if n])
    assert abs(off / spread).max() < 5 and 0.8 < (off / spread).std() < 1.2
    assert draw(pix, total) == {k: n for k, n in has.items() if n} and draw(pix, 0) == {}
    with pytest.raises(ValueError):
        sampling.draw_contacts(pix, F.lit(total + 1))


def test_splits_beyond_whole_contacts():
    """Far more contacts than could be rows."""
    from gridloom.operators import sampling

    rng = np.random.default_rng(0)
    counts = np.array([10**11, 3 * 10**11, 5, 10**10, 7 * 10**8])
    for n in (0, 7, 10**6, 2 * 10**11, int(counts.sum())):
        got = sampling.split(rng, counts, n)
        assert got.sum() == n and (got <= counts).all() and (got >= 0).all()
        assert abs(got[1] - n * (counts[1] / counts.sum())) <= 8 * (n * 0.25) ** 0.5
    drawn = [sampling.hypergeometric(rng, 6 * 10**8, 6 * 10**8, 1000) for _ in range(400)]
    assert abs(np.mean(drawn) - 500) < 5 and 12 < np.std(drawn) < 20


def test_a_round_of_balancing_leaves_pixels_in_place(spark, tmp_path):
    cmap, _ = synthetic_map(spark, 80)
    name = balance._both_ways(cmap.pixels, str(tmp_path / "both"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both, bias = spark.table(name), cmap.bins.select("bin_id", F.lit(2.0).alias("b"))
        step = balance.marginals_of(both, bias)
        text = step._sc._jvm.PythonSQLUtils.explainString(step._jdf.queryExecution(), "simple")
        # Exchanges: the bias by j, partial sums by i, the bias by its bin; none between the pixels and their join.
        above = text.split("SortMergeJoin [j#")[1].split("FileScan parquet")[0]
        assert "Bucketed: true" in text and "Exchange" not in above and text.count("FileScan parquet") == 1
        own = {r.bin_id: r.own for r in step.collect()}
        want = {r.bin_id: r.marginal * 4 for r in preprocess.marginals(cmap.pixels).collect()}
        assert {k: v for k, v in own.items() if v} == pytest.approx({k: v for k, v in want.items() if v})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")
