import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import simhash, suffix_dedup
from gridloom.llm.common import Workspace
from gridloom.llm.components import connected_components
from gridloom.llm.exact_dedup import drop_copies, exact_dedup

SCHEMA = "doc_id long, text string, digest string, fp int, bucket string, copies int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


ODD = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (7, None), (8, ""), (1, "c"), (1, "c"), (None, "c"), (3, "long " * 5000), (4, "long " * 5000), (6, "a b"), (None, None)]


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(normal(t), []).append(d)
    out = []
    for ids in groups.values():
        first = min((d is None, d) for d in ids)[1] if any(d is not None for d in ids) else None
        taken = False
        for d in ids:
            kept = d == first and not taken
            taken |= kept
            out.append((d, first, len(ids), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = [r for r in ODD if not weak or r[0] is not None and r != (1, "c")] + [(20 + k, random.Random(k % 7).choice("xyz") * 3) for k in range(30)]
    digest = (lambda c: F.crc32(c.cast("binary")) % 3) if weak else None
    got = exact_dedup(docs(spark, rows), Workspace(spark, "t"), *([digest] if weak else []))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str)
    assert got == brute_exact(rows)


def test_dropping_copies_keeps_columns(spark):
    got = drop_copies(docs(spark, ODD), Workspace(spark, "t"))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "a\tb"), (7, None), (1, "c"), (3, "long " * 5000), (6, "a b")], key=str)
    assert drop_copies(docs(spark, []), Workspace(spark, "t")).count() == 0


def test_state_goes_on_over_batches(spark):
    rows = [(k, f"text {k % 5}") for k in range(200)]
    frame = docs(spark, rows).repartition(8)
    got = exact_dedup(frame, Workspace(spark, "t"), batches=4)
    assert {(r.keep_id, r.group_size) for r in got.collect()} == {(k, 40) for k in range(5)}


def test_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(200)]
    loose = [(2000 + rng.randrange(150), 2000 + rng.randrange(150)) for _ in range(90)]
    links = [x for x in chain + star + loose if x[0] != x[1]]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t")).collect()}
    assert set(got) == set(parent)
    groups = {}
    for x in parent:
        groups.setdefault(root(x), set()).add(got[x])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert connected_components(spark.createDataFrame([], "u long, v long"), Workspace(spark, "t")).count() == 0


def components(fps, radius=4):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("tile", "blocks"), [(4096, 5), (16, 5), (64, 6), (4096, 7)])
def test_near_links_lose_nothing(spark, tile, blocks):
    rng = np.random.default_rng(tile + blocks)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).view(np.uint64)
    fps = list(base)
    for x in base[:25]:
        for _ in range(rng.integers(1, 9)):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= np.uint64(1) << np.uint64(b)
            fps.append(y)
    hot = np.uint64(0xFFFF0000FFFF0000)
    fps += [hot ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(12) for b in range(a)]
    fps = np.unique(np.array(fps, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    work = Workspace(spark, "t")
    got = {r.node: r.label for r in connected_components(simhash.near_links(frame, work, tile=tile, blocks=blocks), work).collect()}
    got = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = components(fps)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want.tolist(), strict=True)))


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    import xxhash

    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(None, "x y"), (None, "x y"), (None, "other words"), (4, None), (3, ""), (2, " \t"), (1, "One"), (0, "one"), (9, "ÉTÉ Éé"), (9, "ÉTÉ Éé"), (70, "w " * 70_000)]
    for k in range(10, 40):
        text = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 300]))]
        rows.append((k, " ".join(text)))
        if k % 3 == 0:
            text[rng.randrange(len(text))] = "edit"
            rows.append((100 + k, "\n".join(text).upper()))
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs(spark, rows), Workspace(spark, "t")).collect()}
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    label = components(fps)
    least = {}
    for (d, _), c in zip(rows, label, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    assert got == {(d, int(f), least.get(c)) for (d, _), f, c in zip(rows, fps, label, strict=True)}
    kept = simhash.drop_near(docs(spark, rows), Workspace(spark, "t"))
    assert sorted(components(np.array([slow_fingerprint(r.text) for r in kept.collect()], np.uint64))) == list(range(len(set(label))))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert simhash.near_groups(docs(spark, []), Workspace(spark, "t")).count() == 0


def test_near_stage_drops_all_pairs_from_four_fifths_up(spark):
    """Word shingles of five, Jaccard similarity of 0.8: most such pairs differ in more than four fingerprint bits."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            copy = list(words)
            for k in rng.sample(range(len(words)), max(1, round(len(words) * rng.choice([0.01, 0.02, 0.03])))):
                copy[k] = "other"
            texts.append(" ".join(copy).upper())
    texts += ["", " \n", "one two", "One  Two", None]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := (t or "").lower().split()) else set() for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    kept = corpus_pipeline.near(spark, docs(spark, list(enumerate(texts))), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(i for i, x in enumerate(label) if x == y) for y in set(label))
    repeated = [(1, texts[0]), (1, texts[0]), (1, "quite another text of more words"), (None, "a b c")]
    assert corpus_pipeline.near(spark, docs(spark, repeated), "").count() == 3
    assert corpus_pipeline.near(spark, docs(spark, []), "").count() == 0


def test_near_stage_compares_fingerprints_by_tiles_without_any_band(spark, monkeypatch):
    """op2's search over all fingerprints is a step of its own: texts within four bits meet without a common minimum hash."""
    from pyspark.sql import functions as F

    from gridloom.llm import minhash

    real = minhash.mark
    monkeypatch.setattr(minhash, "mark", lambda rows, shingle: real(rows, shingle).withColumn("bands", F.array().cast("array<long>")))
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), ""]
    prints = [minhash.majority(minhash.shingle_set(t)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[2]).bit_count()
    kept = minhash.drop_similar(docs(spark, list(enumerate(texts))), Workspace(spark, "t"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


@pytest.mark.parametrize("chunk", [1 << 18, 7, 1])
def test_suffix_order_equals_sorting(chunk):
    rng = random.Random(1)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 9))]
        owner, size, common = suffix_dedup.suffix_order(strings, chunk)
        got = [strings[o][len(strings[o]) - n :] for o, n in zip(owner.tolist(), size.tolist(), strict=True)]
        assert list(zip(got, owner.tolist(), strict=True)) == sorted((s[i:], k) for k, s in enumerate(strings) for i in range(len(s)))
        for a, b, n in zip(got, got[1:], common[1:].tolist(), strict=False):
            assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])
    every = [bytes(range(256)), bytes(range(255, -1, -1))[:60]]
    owner, size, _ = suffix_dedup.suffix_order([s[:200] for s in every], max(chunk, 50))
    assert len(owner) == 260


def brute_removed(rows, length=50):
    first = {}
    last = np.iinfo(np.int64).max
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (last if d is None else d):
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def test_removed_bytes_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(30, 200))) for _ in range(6)]
    rows = [(k, rng.choice([None, "", "a" * rng.randrange(300), "ab" * 90, "é" * 80, rng.choice(base) + rng.choice(base), rng.choice(base)[5:]])) for k in range(50)]
    rows += [(7, base[0]), (7, base[0]), (None, base[0]), (None, base[1] + "z" * 60), (60, "".join(rng.choice("abcdefgh") for _ in range(150_000)) + base[0])]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs(spark, rows), Workspace(spark, "t")).collect()), key=str)
    assert got == brute_removed(rows)
    assert suffix_dedup.remove_repeats(docs(spark, []), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_across_groups_and_pieces(spark, hot):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(k, " ".join(rng.choice(words) for _ in range(300)) + (passage if k % 3 == 0 else "") + " ".join(rng.choice(words) for _ in range(200))) for k in range(30)]
    got = suffix_dedup.remove_repeats(docs(spark, rows), Workspace(spark, "t"), group_bytes=4000, hot=hot)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_removed(rows)
