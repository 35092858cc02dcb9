"""Driver queries against DuckDB on the smallest tables."""

import importlib.util
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: One of each kind; the driver compares all of them.
CHOSEN = ["contact_pixels", "coords_to_bins", "bed2d_normalise", "bed_pairs_range_join", "bin_marginals", "detectable_intra", "detectable_inter", "ice_2iter", "detrended", "inter_median_scale", "ztransform", "sampled_contacts_hash", "normxcorr_masked", "normxcorr_tiled", "normxcorr_inter", "normxcorr_inter_tiled", "foci_labels", "window_validity", "footprint_bands", "nms_greedy", "fdr_bh", "best_kernel", "symmetric_map", "detect_full", "detect_kernels", "detect_windows", "normxcorr_tsvd", "detrended_smooth", "detrended_raw", "sampled_contacts_exact", "quantify_full", "sampled_share", "xcorr_box_separable", "ice_weights", "normxcorr_unmasked", "xcorr_box_wide", "stored_chromosome", "sampled_tree", "quantify_kernels"]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@needs_data
def test_suppression_over_all_points_equals_a_walk(spark):
    from gridloom.plans.queries import _points

    points = [tuple(r) for r in _points(spark, FOLDER).select("bin1", "bin2", "score").collect()]
    assert len(points) > 300
    kept = []
    for p in sorted(points, key=lambda p: (-p[2], p[0], p[1])):
        if not any(abs(p[0] - q[0]) < 5 and abs(p[1] - q[1]) < 5 for q in kept):
            kept.append(p)
    got = [tuple(r) for r in entry.queries()["nms_greedy"](spark, FOLDER).select("bin1", "bin2", "score").collect()]
    assert sorted(got) == sorted(kept)


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["sub", "i", "j", "r", "n_obs"]


def test_nothing_outside_imports_the_training_data_operators():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "gridloom")):
        for name in names:
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "gridloom.llm" not in open(os.path.join(folder, name)).read()
    if importlib.util.find_spec("gridloom.llm") is None:
        assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "pipeline" not in entry.queries()
