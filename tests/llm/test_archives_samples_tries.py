"""WARC archives, importance resampling and the prefix trie against brute force, on odd input too."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm import prefix_trie, resampling, warc
from gridloom.llm.common import Workspace

PAGES = "url string, page_id long, html string, row string, at int, digest string"


def page_rows():
    long = "<p>" + "x" * 120 + "é</p>"
    rows = [(f"http://a/{k}", k, long if k % 3 == 0 else f"<p>{k}</p>" * (k + 1)) for k in range(60)]
    rows += [(None, 70, None), ("http://b/\r\nX: 1 ", 71, ""), ("http://c", None, long), ("http://d", 2**60 + 1, long), ("http://d", 2**60 + 1, long)]
    rows += [("http://e", 80, "é" * 49 + "a"), ("http://e", 81, "é" * 49 + "a"), ("http://f", 82, "é" * 50), ("http://f", 83, "é" * 50)]
    rows += [("http://g", 90, "WARC/1.1\r\n\r\n" + warc.BETWEEN + "z" * 300), ("http://h", 91, "y" * 3_000_000)]
    return [(*r, "other", 1, "d") for r in rows]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    work = Workspace(spark, "t")
    folder = str(tmp_path / "archives")
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archive_pages(pages, work, folder).collect()
    bodies = defaultdict(list)
    for _, page_id, html, *_ in rows:
        bodies[html or ""].append(page_id)
    first = {b: min((i for i in ids if i is not None), default=None) for b, ids in bodies.items()}
    want = Counter()
    for body, ids in bodies.items():
        raw = body.encode()
        for n, page_id in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            revisit = len(raw) >= 100 and n > 0
            want[(page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert len({r.record_id for r in got}) == len(rows)
    responses = {r.record_id for r in got if r.record_type == "response"}
    assert {r.refers_to_record for r in got if r.record_type == "revisit"} <= responses
    # Payloads come back whole, those of revisits from their responses.
    whole = warc.resolved(warc.read_archives(spark, folder, payloads=True), work).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in whole) == Counter((r[1], (r[2] or "").encode()) for r in rows)
    # A plain decoder reads the archives frame by frame, with the dictionary of the first frame.
    import zstandard

    total = 0
    for file in (tmp_path / "archives").glob("part-*"):
        data = file.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY
        size = int.from_bytes(data[4:8], "little")
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        plain = decoder.stream_reader(data[8 + size :], read_across_frames=True).read()
        total += plain.count(b"WARC-Record-ID: ")
    assert total == len(rows) + len(list((tmp_path / "archives").glob("part-*")))


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(empty, Workspace(spark, "t")).collect() == []


def small_archive(dictionary=b"some common words of pages" * 8, compressed=False, sized=True):
    import zstandard

    page = {"payload": b"<html>common words</html>", "kind": "response", "url": "http://a", "record": "0" * 32, "page_id": 5}
    page["digest"] = hashlib.sha256(page["payload"]).hexdigest()
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=sized)
    held = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    raw = warc.page_record(page)
    if sized:
        frame = encoder.compress(raw)
    else:
        o = encoder.compressobj()
        frame = o.compress(raw) + o.flush()
    return warc._skippable(warc.DICTIONARY, held), frame, raw


@pytest.mark.parametrize(("compressed", "sized"), [(False, True), (True, True), (True, False), (False, False)])
def test_foreign_archives(compressed, sized):
    head, frame, raw = small_archive(compressed=compressed, sized=sized)
    assert [r for _, r in warc.records_of(head + frame + warc._skippable(0x184D2A51, b"note") + frame)] == [raw, raw]
    assert warc.parse_record(raw)["page_id"] == 5


def test_broken_archives_are_found():
    head, frame, raw = small_archive()
    trained = warc.train_dictionary([b"page %d of many with words %d" % (k, k * k) * 40 for k in range(400)])
    import zstandard

    other = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained)).compress(raw)
    for data in (head + frame[:-3], head[:5], b"none" + frame, head + frame + b"xy", head + other):
        with pytest.raises(warc.WarcError):
            list(warc.records_of(data))
    for bad in (raw[:-1], raw + b"\r\n", raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"common", b"commun"), raw.replace(b"WARC-Date", b"No-Date"), re.sub(rb"Content-Length: \d+", b"Content-Length: x", raw, count=1), raw.replace(b"WARC-Type: response", b"WARC-Type response")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# -- resampling ------------------------------------------------------------------------------------------------------
def brute_sample(docs, target, buckets=10_000, longest=1, share=10, least=20):
    def features(text):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return len(words), [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        n_words, own = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(f) % buckets for f in own)]
        weight = sum(gains) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for place, r in enumerate(fit[: len(fit) * share // 100]):
        r[4] = place + 1
    return Counter(tuple(r[:5]) for r in out)


ODD = [(None, "A b C d " * 10), (None, "A b C d " * 10), (1, None), (2, ""), (3, "!!! ---"), (2**60 + 1, "É é straße Ünïcode 日本 " * 9), (4, "word " * 50_000)]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("share", [10, 100])
def test_resampling_equals_brute_force(spark, longest, share):
    docs = ODD + [(k % 90, " ".join(f"w{(k * j) % 37}" for j in range(k % 45))) for k in range(200)] + [(7, "same text " * 12)] * 60
    rows = [(text, "rank", doc_id, 1.5) for doc_id, text in docs]
    table = spark.createDataFrame(rows, "text string, rank string, doc_id long, score double").repartition(5)
    target = [None, "", "w1 w2 w3 WORD same", "日本 w5"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table, goal, Workspace(spark, "t"), share=share, longest=longest)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == brute_sample(docs, target, longest=longest, share=share)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resampling.resample(none, some, Workspace(spark, "t")).collect() == []
    assert [r["rank"] for r in resampling.resample(some, none, Workspace(spark, "t"), share=100).collect()] == [1]
    with pytest.raises(ValueError):
        resampling.write_streams(some, Workspace(spark, "t"), "x", buckets=1 << 17)


# -- prefix trie -----------------------------------------------------------------------------------------------------
def brute_trie(rows):
    """rows (conv_id, turn, role, text)"""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        convs[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, v in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = (own.get(c - c % 100, [])[:h] if c is not None else []) + v[h:]
    rank = lambda c: (c is None, c)
    members = defaultdict(list)
    for c in sorted(rebuilt, key=rank):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in m if len(rebuilt[c]) == len(p))
        out[(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations():
    rows = []
    for c in range(0, 700):
        turns = ["hello", "hi é", f"q{c % 3}", f"a{c % 7}", f"z{c}", "end"][: 1 + c % 7]
        rows += [(c, k, "user" if k % 2 == 0 else None, t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", f"copy{k}") for c in range(1000, 1400) for k in range(12)]  # copies
    rows += [(5000, k, "user", f"t{k}") for k in range(200)] + [(5100, k, "user", f"t{k}") for k in range(190)]  # long ones
    rows += [(None, None, None, None), (None, 1, "a", None), (800, None, "b", "x"), (800, 0, "b", "y"), (800, 0, "b", "w"), (800, 0, "b", "w")]
    rows += [(901, 0, "user", "only"), (2**60 + 1, 0, "user", "hello"), (-5, 0, "user", "hello")]
    return rows


@pytest.mark.parametrize("most", [4096, 150])
def test_trie_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    table = spark.createDataFrame([(t, turn, role, c, "x", 1) for c, turn, role, t in rows], "text string, turn long, role string, conv_id long, gid string, depth int").repartition(4)
    got = prefix_trie.prefix_trie(table, Workspace(spark, "t"), most)
    assert Counter(map(tuple, got.collect())) == brute_trie(rows)


def test_tries_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema), Workspace(spark, "t")).collect() == []
    # No conversation has a turn left: only the root.
    rows = [(c, 0, "user", "a") for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema), Workspace(spark, "t")).collect()
    assert Counter(map(tuple, got)) == brute_trie(rows) and len(got) == 1 and got[0].n_leaves == 1
    rows = [(1, 0, "user", "a")] + [(c, 0, "ab" if c % 2 else "a", "c" if c % 2 else "bc") for c in range(200, 230)]
    assert Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, schema), Workspace(spark, "t"), 1).collect())) == brute_trie(rows)


def test_identifiers_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    ids = sorted({k * k % 9973 for k in range(3000)} | {-7})
    rows = [(bytearray(b"a"), 1, c) for c in ids] + [(bytearray(b"b"), d, 5) for d in range(50)]
    table = spark.createDataFrame(rows, "gid binary, depth long, c long").repartition(7)
    got = {(bytes(r.gid), r.depth): r.ends_sha256 for r in prefix_trie._digested(table).collect()}
    assert len(got) == 51 and got[(b"a", 1)] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[(b"b", 3)] == hashlib.sha256(b"5").hexdigest()
