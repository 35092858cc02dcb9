import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import license_scan, mixing, ogg, pu, quality, sentencepiece_codec, token_counts, toxicity
from gridloom.llm.common import Workspace, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, held_out string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 0, "x", "y", "z") for d, t, s in rows], SCHEMA)


# -- mixing --------------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_ = budget * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = {s for s in open_ if target[s] + share[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share[s]
            break
        # Fix the full ones at their caps and share the rest anew.
        for s in full:
            target[s] = most * sizes[s]
        open_ -= full
        left = budget * sum(sizes.values()) - sum(target[s] for s in order if s not in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_targets_equal_resharing_by_rounds(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 10, 100, 1000, 5000]) for s in ["b", "a", None, "é", "Z", "c", "d"]}
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        for s, t in brute_targets(sizes).items():
            assert abs(got[s] - t) < 1e-6, (sizes, got)


def test_mix(spark):
    rows = [(k, "w " * (k % 9 + 1), ["a", "b", None][k % 3]) for k in range(3000)] + [(None, None, "a"), (None, "", "e"), (1, "w w", "a"), (1, "w w", "a")]
    plan = mixing.mix_plan(docs(spark, rows), Workspace(spark, "t")).collect()
    again = mixing.mix_plan(docs(spark, rows), Workspace(spark, "t")).collect()
    assert Counter(map(tuple, plan)) == Counter(map(tuple, again)) and len(plan) == len(rows)
    taken, target = defaultdict(int), {}
    for r in plan:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.1 * t
    mixed = mixing.mix(docs(spark, rows), Workspace(spark, "t"))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(x for r in plan for x in [r.doc_id] * r.copies)
    assert mixing.mix_plan(docs(spark, []), Workspace(spark, "t")).count() == 0
    assert "Python" not in mixed._jdf.queryExecution().toString()


# -- token counts --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name, tmp_path, monkeypatch):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a<|endoftext|>b <s>"), (5, "hello world"), (None, "日本 é😀 \t x"), (1, "other"), (6, "word " * 30_000), (7, "hello  world")]
    frame = docs(spark, [(d, t, "s") for d, t in rows])
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count_tokens(frame, Workspace(spark, "t"), name, cache=cache).collect()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file(name))
        count = lambda t: len(tok.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        count = lambda t: len(model.encode(t))
    assert Counter(map(tuple, got)) == Counter((d, len((t or "").encode()), count(t or "")) for d, t in rows)
    # The second run finds every count in the cache; another version of the tokenizer would not.
    before = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count()
    assert before == len({t or "" for _, t in rows})
    token_counts.count_tokens(frame, Workspace(spark, "t"), name, cache=cache).collect()
    assert spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == before
    assert token_counts.count_tokens(docs(spark, []), Workspace(spark, "t"), name).count() == 0


# -- SentencePiece -------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library():
    import sentencepiece

    codec = sentencepiece_codec.codec()
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(3)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "▁", "<0x0A>", "<s>", "12", "aaaa", "\x00", "\xa0", "    ", "ſ", "</s>", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["ab" * 4000 + "xyz" * 2000, " " * 500]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == model.encode(text), text
        assert codec.decode(ids) == model.decode(ids)


def test_long_words_equal_the_library():
    """Texts without spaces: words of thousands of characters through the trie, whatever their neighbours in the order."""
    import sentencepiece

    codec = sentencepiece_codec.Codec(tokenizer_file("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeinstthré") for _ in range(rng.randrange(60, 3000))) for _ in range(60)]
    texts += ["".join(rng.choice(["日本", "語", "の", "ab", "e", "\n", "0", "==", "A"]) for _ in range(4000)), "a" * 5000, "the" * 3000, "=" * 700, texts[0] + "x", texts[0] + "xy"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == model.encode(text)


def test_viterbi_of_a_unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(5)
    model = pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0, type=kind)
    vocabulary = {"▁": -2.0, "a": -2.5, "b": -2.25, "c": -3.0} | {"".join(rng.choice("abc") for _ in range(n)): -rng.random() * 8 for n in (2, 2, 2, 3, 3, 4)} | {"▁ab": -1.5}
    for piece, score in vocabulary.items():
        model.pieces.add(piece=piece, score=score, type=1)
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    codec = sentencepiece_codec.Codec(str(path))

    def best(word):
        states = [(0.0, [])]
        for n in range(1, len(word) + 1):
            states.append(max((states[m][0] + vocabulary[word[m:n]], states[m][1] + [word[m:n]]) for m in range(n) if word[m:n] in vocabulary))
        return states[-1][0]

    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(200)]
    for ids, w in zip(codec.encode(words), words, strict=True):
        pieces = [codec.pieces[i] for i in ids]
        assert "".join(pieces) == "▁" + w and abs(sum(vocabulary[p] for p in pieces) - best("▁" + w)) < 1e-5


def test_piece_columns(spark):
    rows = [(1, "hello  world\n"), (2, None), (3, ""), (None, "é😀"), (1, "hello  world\n")]
    frame = docs(spark, [(d, t, "s") for d, t in rows])
    out = sentencepiece_codec.decode_column(sentencepiece_codec.encode_column(frame)).collect()
    assert Counter(r.decoded for r in out) == Counter(t or "" for _, t in rows)
    assert all(r.round_trip for r in sentencepiece_codec.digests(frame).collect())
    assert sentencepiece_codec.digests(docs(spark, [])).count() == 0


# -- Ogg -----------------------------------------------------------------------------------------------------------
def slow_checksum(data):
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


def test_checksum_and_round_trips():
    rng = random.Random(6)
    for n in (0, 1, 254, 255, 256, 64 * 255, 65_025, 65_026, 300_000):
        data = rng.randbytes(n)
        if n < 300:
            assert ogg.checksum(data) == slow_checksum(data)
        payload = ogg.pad(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        sound = ogg.decode(ogg.write(payload, n))
        assert sound.payload == payload and sound.note["n_bytes"] == str(n) and abs(sound.seconds - len(payload) / 8000) < 1e-9
    packets = [(rng.randbytes(n), k) for k, n in enumerate((0, 255, 510, 70_000, 3))]
    stream = ogg.read(b"".join(ogg.pages(7, packets)))[7]
    assert stream.packets == [p for p, _ in packets] and stream.granules[-1] == 4


def test_damage_is_found():
    media = ogg.write(ogg.pad(b"some text" * 2000), 18_000)
    for k in range(0, len(media), 997):
        broken = bytearray(media)
        broken[k] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(broken))
    for cut in (media[:-1], media[:20], media[27:]):
        with pytest.raises(ogg.OggError):
            ogg.decode(cut)


def test_media_rows(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (None, "é" * 40), (1, "abc")]
    got = ogg.describe_column(ogg.encode_column(docs(spark, [(d, t, "s") for d, t in rows]))).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows, strict=True):
        p = ogg.pad((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0][1:] == got[4][1:]


# -- classifiers ---------------------------------------------------------------------------------------------------
def test_non_negative_learning_finds_the_border():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (4000, 2)), rng.normal(-1.5, 1, (4000, 2))
    mixed = np.vstack([good[:1200], bad[:2800]])
    model = pu.train(good[1200:3000], mixed, 0.3)
    assert (model.logits(good[3000:]) > 0).mean() > 0.93 and (model.logits(bad[2800:]) < 0).mean() > 0.93


def labelled(spark, n=900):
    rng = random.Random(7)
    syllables = ["ta", "ko", "ri", "me", "su", "no", "la"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randrange(20, 90))]
        toxic, good = k % 6 == 0, k % 5 != 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vexgrub" + word(), "blarg"]))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((k, text, "s"))
        if k % 3:
            labels.append((k, int(good), int(toxic)))
        elif k % 2 == 0:
            labels.append((k, int(good), int(toxic)))
    rows += [(n, None, "s"), (n + 1, "", "s"), (None, "ta ko", "s"), (5, rows[5][1], "s")]
    return docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), labels[0]], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "label"), [(toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")])
def test_scores_of_held_out_rows(spark, score, label):
    frame, labels = labelled(spark)
    got = score(frame, labels, Workspace(spark, "t")).collect()
    assert len(got) == 904 and all(0 <= r.score <= 1 for r in got)
    truth = {k: (k % 6 == 0 if label == "toxic" else k % 5 != 0) for k in range(900)}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([(r.predicted == 1) == truth[r.doc_id] for r in held]) > 0.95
    # Labels of held-out rows are never read: turning them round changes nothing.
    turned = spark.createDataFrame([(r.doc_id, *((1 - r.quality, 1 - r.toxic) if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else (r.quality, r.toxic))) for r in labels.collect()], labels.schema)
    assert Counter(map(tuple, got)) == Counter(map(tuple, score(frame, turned, Workspace(spark, "t")).collect()))
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in score(frame, none, Workspace(spark, "t")).collect()} == {0.0 if label == "toxic" else 1.0}
    assert score(docs(spark, []), labels, Workspace(spark, "t")).count() == 0


def test_good_rows_stay(spark):
    frame, labels = labelled(spark)
    kept = quality.keep_good(frame, labels, Workspace(spark, "t"))
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {k for k in range(900) if k % 5}) > 700 and len(ids & {k for k in range(900) if k % 5 == 0}) < 10


# -- licenses ------------------------------------------------------------------------------------------------------
def brute_cosine(a, b, weight, rare):
    va, vb = ({t: n * weight.get(t, rare) for t, n in Counter(x).items()} for x in (a, b))
    dot = sum(x * vb[t] for t, x in va.items() if t in vb)
    return dot / math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))


def test_license_scores_equal_brute_force():
    rng = random.Random(9)
    vocabulary = [t for _, text in license_scan.TEMPLATES for t in license_scan.terms(text)] + ["foo", "bar", "baz"]
    m = license_scan.Matcher(1000, {"the": 900, "license": 40, "and": 800, "of": 700})
    for _ in range(300):
        line = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 15))] if rng.random() < 0.5 else license_scan.terms(rng.choice(license_scan.TEMPLATES)[1])[: rng.randrange(2, 30)]
        scores = [brute_cosine(line, license_scan.terms(t), m.weight, m.rare) for _, t in license_scan.TEMPLATES]
        found, cosine, _ = m.scan(" ".join(line))
        if max(scores) >= m.threshold + 1e-9:
            assert abs(cosine - max(scores)) < 1e-5 and found is not None
        elif max(scores) < m.threshold - 1e-9:
            assert found is None


def test_nearest_ancestor(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "LICENSE", mit), (2, "a/LICENSE", gpl), (3, "a/b/c/x.py", "code"), (4, "z/y.py", "code " + "w " * 500), (5, "a/b/h.py", "Licensed under CC BY-NC 4.0.\n" + "text " * 300), (6, None, "code"), (7, "a/b/n.py", None), (8, "a/LICENSE.2", gpl), (3, "a/b/c/x.py", "code"), (9, None, mit)]
    got = license_scan.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string"), Workspace(spark, "t")).collect()
    assert Counter((r.doc_id, r.license, r.origin, r.license_doc_id) for r in got) == Counter([(1, "MIT", "own", 1), (2, "GPL-3.0", "own", 2), (3, "GPL-3.0", "inherited", 2), (3, "GPL-3.0", "inherited", 2), (4, "MIT", "inherited", 1), (5, "CC-BY-NC-4.0", "own", 5), (6, None, "none", None), (7, "GPL-3.0", "inherited", 2), (8, "GPL-3.0", "own", 8), (9, "MIT", "own", 9)])
    empty = spark.createDataFrame([], "doc_id long, path string, text string")
    assert license_scan.scan_licenses(empty, Workspace(spark, "t")).count() == 0


def test_whole_license_texts_are_license_files():
    m = license_scan.Matcher(1000, {"the": 900, "of": 900, "and": 900})
    for name, text in license_scan.WHOLE_TEXTS:
        assert m.find("Copyright (c) 2020 Some Body\n\n" + text)[::2] == (name, True)
    mit = license_scan.WHOLE_TEXTS[0][1]
    assert not m.find(mit + " foo bar baz" * 300)[2]


def test_headers_inside_lines_and_over_line_breaks():
    m = license_scan.Matcher(1000, {"the": 900, "of": 900, "and": 900})
    prose = "foo bar baz qux quux corge grault".split()
    for name, header in license_scan.TEMPLATES:
        assert m.find(" ".join([*prose * 5, header, *prose * 5]))[0] == name
        wrapped = "\n".join(header.split())
        assert m.find("\n".join([*prose * 5, wrapped, *prose * 5]))[0] == name
        c = m.find(" ".join([*prose, header, *prose]))[1]
        assert abs(c - 1) < 1e-5
    assert m.find(" ".join(prose * 50)) == (None, 0.0, False)


def test_clean_text_has_no_license():
    m = license_scan.Matcher(1000, {"the": 900})
    for text in ("the version of the work under 3 conditions", "all of it is reserved for us", re.sub("License", "Lizenz", "Released under the MIT License") + " by others and many more words here"):
        assert m.scan(text)[0] is None


def test_inheritance_below_hot_directories(spark, monkeypatch):
    """Half of all files in one directory, and a root that speaks for hundreds of others."""
    from gridloom.llm import common, license_scan

    monkeypatch.setattr(common, "LEAST_HOT", 8)
    rows = [(0, "LICENSE", "MIT", 1.0, True), (1, "big/sub/COPYING", "GPL-3.0", 1.0, True)]
    rows += [(k, f"big/sub/f{k}", None, 0.0, False) for k in range(2, 600)]
    rows += [(k, f"d{k}/e/f", None, 0.0, False) for k in range(600, 1100)]
    rows += [(1100, None, None, 0.0, False), (1101, None, "MIT", 0.9, False), (1102, "d600/e/g", "BSD-3-Clause", 0.9, False)]
    own = spark.createDataFrame(rows, "doc_id long, path string, own_license string, cosine double, is_license_file boolean").repartition(6)
    got = {r.doc_id: (r.license, r.origin, r.license_doc_id) for r in license_scan.inherit(own).collect()}
    assert len(got) == len(rows)
    for k in range(2, 600):
        assert got[k] == ("GPL-3.0", "inherited", 1)
    for k in range(600, 1100):
        assert got[k] == ("MIT", "inherited", 0)
    assert got[0] == ("MIT", "own", 0) and got[1100] == (None, "none", None) and got[1101] == ("MIT", "own", 1101) and got[1102] == ("BSD-3-Clause", "own", 1102)
