"""Tasks that don't grow with the map: rows are dealt out by their number, and pixels are made once."""

import re

from gridloom.operators import genome, preprocess
from gridloom.sources import contacts
from gridloom.sources.contacts import BINS, PIXELS, chrom_offsets, read_map, write_map
from gridloom.synth import synthetic_map


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_pairs_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(contacts, "KEYED", 50)
    rows = spark.createDataFrame([(k // 4, k % 7) for k in range(1000)], "o long, b long")
    got = contacts.cooccurrence(rows, "o", "b")
    assert set(re.findall(r"hashpartitioning\(k#\d+L, (\d+)\)", plan(got))) == {"20"}
    want = {}
    for o in range(250):
        own = [k % 7 for k in range(4 * o, 4 * o + 4)]
        for x in range(4):
            for y in range(x):
                pair = min(own[x], own[y]), max(own[x], own[y])
                want[pair] = want.get(pair, 0) + 1
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in got.collect()} == want


def test_pairs_are_added_up_in_tasks_of_bounded_pixels(spark, monkeypatch):
    monkeypatch.setattr(contacts, "PAIRED", 50, raising=False)
    rows = spark.createDataFrame([(k // 3, (k * k) % 1009) for k in range(999)] + [(None, 5), (None, 6), (7, None)], "o long, b long")
    got = contacts.cooccurrence(rows, "o", "b")
    (tasks,) = set(re.findall(r"hashpartitioning\(bin1_id#\d+L, bin2_id#\d+L, (\d+)\)", plan(got)))
    want = {}
    for o in range(333):
        own = [(k * k) % 1009 for k in range(3 * o, 3 * o + 3)]
        for x in range(3):
            for y in range(x):
                pair = min(own[x], own[y]), max(own[x], own[y])
                want[pair] = want.get(pair, 0) + 1
    assert {(r.bin1_id, r.bin2_id): r["count"] for r in got.collect()} == want
    assert len(want) / int(tasks) <= 50 < len(want) / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_stored_map_is_written_by_tasks_of_bounded_pixels(spark, tmp_path, monkeypatch):
    cmap, _ = synthetic_map(spark, 60, chroms=3)
    most = cmap.pixels.count() // 20
    monkeypatch.setattr(contacts, "WRITTEN", most)
    write_map(cmap, str(tmp_path / "map"))
    files = [spark.read.parquet(str(f)).count() for f in tmp_path.glob("map/pixels/part=*/trans=*/*.parquet")]
    assert sum(files) == cmap.pixels.count() and max(files) <= 3 * most
    rows = lambda p: sorted(tuple(r) for r in p.select("bin1_id", "bin2_id", "count").collect())
    assert rows(read_map(spark, str(tmp_path / "map")).pixels) == rows(cmap.pixels)


def test_degrees_are_made_once_and_shares_drawn_in_place(spark):
    bins = spark.createDataFrame([(b, "c", b * 10, b * 10 + 10, 1.0) for b in range(30)], BINS)
    pixels = spark.createDataFrame([(a, b, 2.0) for a in range(30) for b in range(a, 30) if (a * b) % 3], PIXELS)
    assert "ExistingRDD" not in plan(preprocess.detectable_intra(pixels, bins, 1.5))
    assert "ExistingRDD" not in plan(preprocess.median_mad(pixels, "count"))
    joins = [x for x in plan(preprocess.subsample_share(pixels, chrom_offsets(bins), 0.3)).splitlines() if "Join" in x]
    assert joins and not any("[bin1_id" in x for x in joins)


def test_pixels_stream_past_the_bins(spark):
    bins = spark.createDataFrame([(b, "c", b * 10, b * 10 + 10, None if b % 7 == 3 else 1.0 + b) for b in range(30)], BINS)
    pixels = spark.createDataFrame([(a, b, 2.0) for a in range(30) for b in range(a, 30)], PIXELS)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    coords = lambda: genome.bins_to_coords(pixels.toDF("bin1", "bin2", "count"), bins.drop("weight"))
    made = lambda: [preprocess.balanced(pixels, bins), preprocess.raw_values(pixels, bins), coords()]
    rows = lambda frames: [sorted(map(tuple, f.collect())) for f in frames]
    want = rows(made())
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64b")
        got = made()
        assert not any("SortMergeJoin" in plan(f) for f in got) and all("ShuffledHashJoin" in plan(f) for f in got)
        assert rows(got) == want and len(want[0]) == len(want[1]) == 26 * 27 // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
