"""A map kept by increments, and windows written one at a time."""

import json
from collections import Counter

import numpy as np
import pytest

from gridloom.sources import sinks
from gridloom.streaming.store import MapStore


def folded(batches):
    total = Counter()
    for rows in batches:
        for a, b in rows:
            total[min(a, b), max(a, b)] += 1.0
    return total


def held(store):
    rows = store.pixels().collect()
    got = {(r.bin1_id, r.bin2_id): r["count"] for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame(rows, "bin1_id long, bin2_id long")


def test_batches_count_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = [[(int(a), int(b)) for a, b in rng.integers(0, 6, (40, 2))] for _ in range(5)]
    store = MapStore(spark, f"file://{tmp_path}/store")
    assert held(store) == {}
    for k, rows in enumerate(batches[:3]):
        store.add(frame(spark, rows), k)
    store.add(frame(spark, batches[1]), 1)  # run again
    assert held(store) == folded(batches[:3])
    parity = sorted(store.parity().collect())
    store.compact()
    assert held(store) == folded(batches[:3]) and sorted(store.parity().collect()) == parity
    assert sorted(p.name for p in (tmp_path / "store/deltas").iterdir()) == []
    store.add(frame(spark, batches[2]), 2)  # the base holds it
    for k in (3, 4):
        store.add(frame(spark, batches[k]), k)
    assert held(store) == folded(batches)
    store.compact(before=4)
    assert store.current() == {"base": "base/3", "upto": 3} and held(store) == folded(batches)
    assert [p.name for p in (tmp_path / "store/base").iterdir() if not p.name.startswith(".")] == ["3"]


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = MapStore(spark, f"file://{tmp_path}/store")
    store.add(frame(spark, [(1, 2), (2, 1), (3, 3)]), 0)
    store.compact()
    store.add(frame(spark, [(1, 2)]), 1)
    want = {(1, 2): 3.0, (3, 3): 1.0}
    monkeypatch.setattr(MapStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.compact()
    monkeypatch.undo()
    assert held(store) == want  # a base that no state names isn't read
    store.compact()
    assert held(store) == want


def test_a_stream_into_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [[(1, 2), (4, 4)], [(2, 1)], [(5, 1), (1, 2)]]
    store = MapStore(spark, f"file://{tmp_path}/store")
    for k, part in enumerate(rows):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("bin1_id long, bin2_id long").parquet(str(tmp_path / "in/*"))
        store.follow(stream, str(tmp_path / "checkpoint")).awaitTermination()
        if k == 1:
            store.compact()
    assert held(store) == folded(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_streamed_windows_have_the_bytes_of_whole_ones(tmp_path, n):
    w = np.random.default_rng(n).random((n, 5, 5))
    if n:
        w[0, 0, 0] = np.nan
    np.save(tmp_path / "whole.npy", w)
    text = json.dumps({str(i): x.tolist() for i, x in enumerate(w)}, indent=4)
    assert open(sinks.stream_windows(iter(w), n, (5, 5), str(tmp_path / "s")), "rb").read() == text.encode()
    assert open(sinks.stream_windows(iter(w), n, (5, 5), str(tmp_path / "s"), "npy"), "rb").read() == (tmp_path / "whole.npy").read_bytes()
    with pytest.raises(ValueError):
        sinks.stream_windows(iter(w), n + 1, (5, 5), str(tmp_path / "t"))
