"""Maps on disk: what a search of a laid-out map reads, and maps in other formats through the data source."""

import sys
import types

import numpy as np
import pytest

from gridloom.plans import pipeline
from gridloom.sources import datasource, kernels
from gridloom.sources.contacts import BINS, LAYOUT, PIXELS, ContactMap, chrom_offsets, near, of_chromosomes, read_map, write_map
from gridloom.synth import synthetic_map
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("maps") / "map")
    write_map(synthetic_map(spark, 150, chroms=3)[0], path)
    return path


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_a_stored_map_comes_back(spark, folder):
    cmap, _ = synthetic_map(spark, 150, chroms=3)
    back = read_map(spark, folder)
    assert set(LAYOUT) < set(back.pixels.columns)
    rows = lambda p: sorted(tuple(r) for r in p.select("bin1_id", "bin2_id", "count").collect())
    assert rows(back.pixels) == rows(cmap.pixels) and back.bin_size == cmap.bin_size
    assert rows(near(back.pixels, 10)) == [r for r in rows(cmap.pixels) if r[1] - r[0] <= 10 and r[0] // 150 == r[1] // 150]


def test_only_the_parts_of_a_chromosome_are_read(spark, folder):
    cmap = read_map(spark, folder)
    one = of_chromosomes(cmap, ["chr2"])
    signal = pipeline.prepared(one, 40, 7)[0]
    text = plan(signal)
    assert "PartitionFilters: [part" in text.replace("isnotnull(part#", "") or "(part#" in text.split("PartitionFilters:")[1].split("]")[0]
    assert "(trans#" in text.split("PartitionFilters:")[1].split("]")[0] and "LessThanOrEqual(apart,47)" in text
    files = {r[0] for r in near(one.pixels, 47).select(F.input_file_name()).distinct().collect()}
    assert files and all("/part=1/trans=0/" in f for f in files)
    # The same patterns as in the whole map, but for q-values.
    config = kernels.KernelConfig("t", [kernels.bump(7, 1.5)], 45_000, 2000, 1, 5000, 0.5, 1000, 30, 50)
    keys = [c for c in pipeline.DETECT if c not in ("qvalue", "score", "pvalue")]
    whole = pipeline.detect(cmap, config)[0].where("chrom1 = 'chr2'").select(*keys).collect()
    assert len(whole) > 3 and sorted(pipeline.detect(one, config)[0].select(*keys).collect()) == sorted(whole)
    with pytest.raises(ValueError):
        of_chromosomes(cmap, ["chr9"])


def test_chromosomes_of_a_plain_map(spark):
    cmap, _ = synthetic_map(spark, 60, chroms=3)
    one = of_chromosomes(cmap, ["chr1", "chr3"])
    assert {r[0] // 60 for r in one.pixels.select("bin1_id").distinct().collect()} == {0, 2} and one.bins.count() == 120


def test_both_triangles_are_folded_when_written(spark, tmp_path):
    bins = spark.createDataFrame([(k, "a" if k < 5 else "b", k % 5 * 10, k % 5 * 10 + 10, 1.0) for k in range(10)], BINS)
    pixels = spark.createDataFrame([(1, 7, 3.0), (7, 1, 3.0), (2, 2, 1.0), (4, 3, 5.0)], PIXELS)
    write_map(ContactMap(chrom_offsets(bins), bins, pixels, 10), str(tmp_path / "m"))
    got = read_map(spark, str(tmp_path / "m")).pixels
    assert sorted(tuple(r) for r in got.select("bin1_id", "bin2_id", "count", "trans", "apart").collect()) == [(1, 7, 3.0, 1, 6), (2, 2, 1.0, 0, 0), (3, 4, 5.0, 0, 1)]


def test_detection_goes_on_from_a_dump(spark, tmp_path):
    cmap, _ = synthetic_map(spark, 120)
    config = kernels.KernelConfig("t", [kernels.bump(7, 1.5)], 30_000, 2000, 1, 5000, 0.5, 1000, 30, 50)
    first = pipeline.detect(cmap, config, dump=str(tmp_path / "d"))[0].collect()
    blank = ContactMap(cmap.chroms, cmap.bins, cmap.pixels.where("false"), cmap.bin_size)
    assert first and sorted(pipeline.detect(blank, config, resume=str(tmp_path / "d"))[0].collect()) == sorted(first)


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_dumped_pixels_in_slices(spark, tmp_path, size):
    rows = [(k % 17, k % 17 + k % 5, float(k)) for k in range(200)]
    (tmp_path / "p.tsv").write_text("bin1_id\tbin2_id\tcount\n" + "".join(f"{a}\t{b}\t{n:g}\n" for a, b, n in rows))
    datasource.register(spark)
    table = spark.read.format("contactmap").options(path=str(tmp_path / "p.tsv"), bytes=size).load()
    assert sorted(map(tuple, table.collect())) == sorted(rows)
    some = table.where("bin1_id >= 4 AND bin1_id < 9 AND count > 20")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if 4 <= r[0] < 9 and r[2] > 20)
    assert size > 1000 or table.rdd.getNumPartitions() > 20
    with pytest.raises(Exception, match="table is"):
        spark.read.format("contactmap").options(path=str(tmp_path / "p.tsv"), table="x").load().collect()


class Group(dict):
    """Arrays by path, as an HDF5 group has them."""

    def __contains__(self, key):
        return any(k == key or k.startswith(key + "/") for k in self)

    def __getitem__(self, key):
        return dict.__getitem__(self, key) if dict.__contains__(self, key) else Group({k[len(key) + 1 :]: v for k, v in self.items() if k.startswith(key + "/")})

    def close(self):
        pass


def test_hdf5_maps_by_index(monkeypatch):
    """The library isn't here: a stand-in with the same access shows which rows are read."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

    rng = np.random.default_rng(1)
    pixels = sorted((int(a), int(a + d), int(n)) for a, d, n in zip(rng.integers(0, 8, 60), rng.integers(0, 3, 60), rng.integers(1, 9, 60), strict=True))
    first, second, count = (np.array(c) for c in zip(*pixels, strict=True))
    held = {"chroms/name": np.array([b"a", b"b"]), "bins/chrom": np.array([0] * 5 + [1] * 5), "bins/start": np.arange(10) % 5 * 10, "bins/end": np.arange(10) % 5 * 10 + 10, "bins/weight": np.array([0.5] * 9 + [np.nan])}
    held |= {"pixels/bin1_id": first, "pixels/bin2_id": second, "pixels/count": count, "indexes/bin1_offset": np.searchsorted(first, np.arange(11))}
    h5py = types.ModuleType("h5py")
    h5py.File = lambda name, mode: Group({f"resolutions/10/{k}": v for k, v in held.items()})
    monkeypatch.setitem(sys.modules, "h5py", h5py)

    def read(filters, table="pixels"):
        source = datasource.ContactMapSource({"path": "x.mcool::resolutions/10", "table": table, "rows": "7"})
        reader = source.reader(None)
        left = list(reader.pushFilters(filters))
        parts = reader.partitions()
        return [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()], left, parts

    assert [(a, b, int(n)) for a, b, n in read([])[0]] == pixels
    other = EqualTo(("count",), 3.0)
    for filters, keep in (([EqualTo(("bin1_id",), 4), other], lambda a: a == 4), ([GreaterThan(("bin1_id",), 2), LessThanOrEqual(("bin1_id",), 5)], lambda a: 2 < a <= 5), ([GreaterThanOrEqual(("bin1_id",), 6), LessThan(("bin1_id",), 100)], lambda a: a >= 6), ([LessThan(("bin1_id",), -3)], lambda a: False)):
        rows, left, parts = read(filters)
        assert [r[0] for r in rows] == [a for a in first if keep(a)] and left == [f for f in filters if f is other]
        assert sum(p.high - p.low for p in parts) == len(rows)  # no other row is touched
    bins = read([], "bins")[0]
    assert bins[0] == (0, "a", 0, 10, 0.5) and bins[9] == (9, "b", 40, 50, None) and len(bins) == 10
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError, match="h5py"):
        read([])
