import json

import pytest

from gridloom.cli import main
from gridloom.sources.contacts import read_map, write_map
from gridloom.streaming.contacts import start
from gridloom.synth import synthetic_map


def test_listing_and_configurations(tmp_path, capsys):
    assert main(["list-kernels", "--long", "--mat"]) == 0 and "loops_small" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main(["list-kernels", "--name", "none"])
    assert main(["generate-config", str(tmp_path / "k"), "--preset", "borders", "--win-size", "9"]) == 0
    assert len(json.loads((tmp_path / "k.json").read_text())["kernels"]) == 3


def test_detect_quantify_and_view(spark, tmp_path, capsys):
    cmap, places = synthetic_map(spark, 120, loops=4)
    write_map(cmap, str(tmp_path / "map"))
    common = ["--pattern", "loops_small", "--max-dist", "45000", "--min-dist", "2000", "--max-perc-zero", "30"]
    assert main(["detect", str(tmp_path / "map"), str(tmp_path / "out"), *common, "--subsample", "0.9", "--dump", str(tmp_path / "dump")]) == 0
    rows = (tmp_path / "out.tsv").read_text().splitlines()
    # One window a pattern, in the order of the table, and a drawing of their mean.
    shown = json.loads((tmp_path / "out.json").read_text())
    assert len(rows) > 3 and list(shown) == [str(k) for k in range(len(rows) - 1)] and len(shown["0"]) == 7
    assert (tmp_path / "out.svg").read_text().count("<rect") == 49
    assert {x.name for x in (tmp_path / "dump").iterdir()} >= {"00_subsampled", "00_balanced", "01_signal_0", "02_diag_trim", "02_distance_law", "03_normxcorr2_intra_0", "05_foci_intra_0"}
    bed = tmp_path / "p.bed2d"
    bed.write_text("".join("\t".join(("chr1", str(a * 1000), str(a * 1000 + 1000), "chr1", str(b * 1000), str(b * 1000 + 1000))) + "\n" for a, b in places))
    assert main(["quantify", str(tmp_path / "map"), str(bed), str(tmp_path / "q"), *common, "--win-fmt", "npy"]) == 0
    scores = [float(x.split("\t")[8]) for x in (tmp_path / "q.tsv").read_text().splitlines()[1:]]
    assert len(scores) == 4 and min(scores) > 0.4
    assert main(["generate-config", str(tmp_path / "own"), "--preset", "loops_small", "--map", str(tmp_path / "map"), "--positions", str(bed)]) == 0
    assert main(["detect", str(tmp_path / "map"), str(tmp_path / "out2"), "--kernel-config", str(tmp_path / "own.json"), "--max-dist", "45000", "--max-perc-zero", "30"]) == 0
    more = ["--tsvd", "--win-size", "9", "--iterations", "2", "--no-plotting", "--norm", "force", "--n-mads", "4", "--plan", "scatter"]
    assert main(["detect", str(tmp_path / "map"), str(tmp_path / "out3"), *common, *more]) == 0
    assert not (tmp_path / "out3.svg").exists() and len(json.loads((tmp_path / "out3.json").read_text())["0"]) == 9
    weights = [r.weight for r in read_map(spark, str(tmp_path / "map")).bins.collect()]
    assert None in weights and len({w for w in weights if w}) > 50  # written back
    assert main(["quantify", str(tmp_path / "map"), str(bed), str(tmp_path / "q2"), *common, "--tsvd", "--subsample", "0.5", "--win-size", "9"]) == 0
    assert len(json.loads((tmp_path / "q2.json").read_text())) == 4
    assert main(["generate-config", str(tmp_path / "own2"), "--preset", "loops_small", "--map", str(tmp_path / "map"), "--positions", str(bed), "--chroms", "chr1", "--norm", "raw"]) == 0
    with pytest.raises(OSError):
        main(["detect", str(tmp_path / "map"), str(tmp_path / "none" / "x"), *common])
    capsys.readouterr()
    assert main(["view", str(tmp_path / "map"), "--region", "chr1:0-30000", "--region2", "chr1:20000-60000", "--patterns", str(tmp_path / "out.tsv")]) == 0
    drawn = capsys.readouterr().out.splitlines()
    assert len(drawn) == 30 and len(drawn[0]) == 40 and any("X" in x for x in drawn)
    assert main(["view", str(tmp_path / "map"), "--region", "chr1:0-30000", "--log"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 30


def test_stream_of_contacts(spark, tmp_path):
    contacts = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "bin1_id long, bin2_id long")
    contacts.write.parquet(str(tmp_path / "in"))
    contacts.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    pixels = {}
    query = start(spark.readStream.schema(contacts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "state"), lambda batch, _: pixels.update({(r[0], r[1]): r[2] for r in batch.collect()}))
    query.processAllAvailable()
    query.stop()
    assert pixels in ({(1, 2): 3.0, (3, 3): 1.0}, {(1, 2): 2.0, (3, 3): 2.0})


def test_the_synthetic_map(capsys, spark):
    assert main(["test"]) == 0 and "detected" in capsys.readouterr().out
    with pytest.raises(SystemExit) as end:
        main(["--version"])
    assert end.value.code == 0 and capsys.readouterr().out.strip()


@pytest.mark.parametrize("header", [True, False])
def test_dumped_tables_become_a_map(spark, tmp_path, header):
    bins, pixels = tmp_path / "bins.tsv", tmp_path / "pixels.tsv"
    names = ("chrom\tstart\tend\tweight\n", "bin1_id\tbin2_id\tcount\n") if header else ("", "")
    bins.write_text(names[0] + "".join(f"chr{b // 5 + 1}\t{b % 5 * 1000}\t{b % 5 * 1000 + 1000}\t{'nan' if b == 3 else 0.5}\n" for b in range(10)))
    pixels.write_text(names[1] + "0\t0\t4\n0\t7\t2\n")
    assert main(["convert", str(bins), str(pixels), str(tmp_path / "map")]) == 0
    cmap = read_map(spark, str(tmp_path / "map"))
    rows = {r.bin_id: (r.chrom, r.start, r.weight) for r in cmap.bins.collect()}
    assert len(rows) == 10 and rows[3] == ("chr1", 3000, None) and rows[7] == ("chr2", 2000, 0.5) and cmap.bin_size == 1000
    assert {tuple(r) for r in cmap.pixels.select("bin1_id", "bin2_id", "count").collect()} == {(0, 0, 4.0), (0, 7, 2.0)}
