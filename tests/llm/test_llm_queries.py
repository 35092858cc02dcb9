"""The registered queries and the pipeline on the smallest tables, against brute force, libraries and SQL."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import license_scan
from gridloom.llm.common import Workspace, tokenizer_file
from gridloom.llm.queries import ORACLE_SQL, QUERIES
from test_pairs_and_copies import brute_removed, components, normal, slow_fingerprint

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def shingles(text):
    """Sets of five neighbouring words, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_names():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_op1(spark, rows):
    counts = Counter(t for r in rows for t in set(license_scan.terms(r.text or "")))
    m = license_scan.Matcher(len(rows), counts)
    got = run(spark, "op1_license_scan")
    assert len(got) == len(rows) and {r.doc_id: (r.own_license, r.cosine) for r in got} == {r.doc_id: m.find(r.text or "")[:2] for r in rows}
    assert sum(r.own_license is not None for r in got) > 0
    for r in got:  # every planted line stands alone in its text
        text = next(x.text for x in rows if x.doc_id == r.doc_id)
        assert (r.own_license is not None) == any(t in text.split("\n") for _, t in license_scan.TEMPLATES)


def test_equal_texts_have_equal_scores(spark):
    from gridloom.llm.toxicity import score_toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text")).repartition(7)
    scores = defaultdict(set)
    rows = score_toxicity(more, spark.read.parquet(f"{FOLDER}/labels.parquet"), Workspace(spark, "t")).join(more, "doc_id").collect()
    for r in rows:
        scores[r.text].add((r.score, r.predicted))
    assert len(rows) == 400 and all(len(x) == 1 for x in scores.values())


def test_op2(spark, rows):
    fps = np.array([slow_fingerprint(r.text) for r in rows], np.uint64)
    label = components(fps)
    first = {c: min(r.doc_id for r, x in zip(rows, label, strict=True) if x == c) for c in set(label)}
    want = {(r.doc_id, f"{int(f):016x}", first[c]) for r, f, c in zip(rows, fps, label, strict=True)}
    assert {tuple(r) for r in run(spark, "op2_simhash_near_dedup")} == want


def test_op3(spark, rows):
    got = run(spark, "op3_source_mixing")
    assert Counter(map(tuple, got)) == Counter(map(tuple, run(spark, "op3_source_mixing")))
    size = {r.doc_id: len((r.text or "").encode().split()) for r in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    taken, squares, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = next(x.source for x in rows if x.doc_id == r.doc_id)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
        squares[source] += r["size"] ** 2
        target[source] = (r.target, r.source_size)
    assert abs(sum(t for t, _ in target.values()) - 1.5 * sum(size.values())) < 1e-3
    off = []
    for s, (t, n) in target.items():
        part = t / n - t // n
        spread = (part * (1 - part) * squares[s]) ** 0.5  # of independent draws, one a document
        assert t <= 2 * n + 1e-6 and abs(taken[s] - t) <= 3.5 * spread + 1e-6
        off.append(abs(taken[s] - t) / spread if spread else 0.0)
    assert np.mean(off) < 1.2


def test_op4(spark, rows):
    assert sorted((tuple(r) for r in run(spark, "op4_suffix_dedup")), key=str) == brute_removed([(r.doc_id, r.text) for r in rows])


@pytest.mark.parametrize(("name", "threshold"), [("op5_toxicity", 0.3), ("op9_quality_classifier", 0.7)])
def test_scores(spark, rows, name, threshold):
    got = run(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    if name.startswith("op9"):
        quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
        held = [r.predicted == quality[r.doc_id] for r in got if r.held_out and r.doc_id in quality]
        assert np.mean(held) > 0.9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the driver's larger tables are absent")
@pytest.mark.parametrize(("name", "label", "least", "most"), [("op5_toxicity", "toxic", 0.9, 0.03), ("op9_quality_classifier", "quality", 0.99, 0.05)])
def test_held_out_rows(spark, name, label, least, most):
    """Enough rows for shares: held-out rows with label 1 are found, few of those with label 0 are marked."""
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 1]) >= least
    assert np.mean([r.predicted for r in held if truth[r.doc_id] == 0]) <= most


def test_op6(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    n = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False)) for r in rows}
    assert {tuple(r) for r in run(spark, "op6_token_counts")} == {(r.doc_id, len((r.text or "").encode()), n[r.doc_id], n[r.doc_id] > 1024) for r in rows}


def test_op7(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op7_sentencepiece")}
    for r in rows:
        ids = model.encode(r.text or "")
        assert (got[r.doc_id].n_pieces, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert got[r.doc_id].round_trip and got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_op8(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op8_ogg_media")}
    for r in rows:
        raw = (r.text or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert x.media_bytes > len(p)


@pytest.mark.parametrize("name", ["op10_exact_dedup", "op11_warc", "op12_importance_resampling", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    want = Counter(con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())
    assert Counter(map(tuple, df.collect())) == want


def test_pipeline_stage_by_stage(spark, rows):
    import sentencepiece

    work, docs = Workspace(spark, "t"), spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, rows
    good = {r.doc_id for r in run(spark, "op9_quality_classifier") if r.predicted}
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, FOLDER), name)
        after = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
            assert set(after) <= set(before)
        if name == "quality":
            assert {r.doc_id for r in after} == good and len(after) == len(good)
        elif name == "exact":
            first = {}
            for r in before:
                k = normal(r.text)
                first[k] = min(first.get(k, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "near":
            sets = [shingles(r.text) for r in before]
            label = list(range(len(before)))
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    if a == b or len(a & b) >= 0.8 * len(a | b):
                        label = [label[j] if x == label[i] else x for x in label]
            first = {}
            for r, c in zip(before, label, strict=True):
                first[c] = min(first.get(c, r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        elif name == "mixing":
            words = lambda some: sum(len(r.text.encode().split()) for r in some)
            assert max(Counter(r.doc_id for r in after).values()) <= 2 and abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            assert all(r.decodes and r.piece_ids == model.encode(r.text) for r in after)
        before = after
    assert Counter(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(map(str, after))
