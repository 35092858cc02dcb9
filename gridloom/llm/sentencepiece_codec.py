"""SentencePiece encoding and decoding by a forward pass over a trie of words.

A text becomes marked words: spaces turn into the mark U+2581, one is put in front, and each run of marks starts a
word. No piece of the vocabulary has a mark after another character, so words are encoded apart. The distinct words of
a batch are sorted, which is the depth-first order of their trie; a stack holds the forward state of each prefix, so
words with a common prefix share its states.

Forward state of a prefix: for unigram vocabularies the best score and its last piece (Viterbi). For merge (BPE)
vocabularies scores only rank merges and their sum means nothing, so the state is the last piece of the one encoding
of that prefix: an encoding is the result of merging exactly if each two neighbours in it are, which makes the last
piece unique, and a candidate is right if it and the last piece before it are the merge result of their own characters.
Characters outside the vocabulary become byte pieces, or the unknown piece without byte fallback.

Only models with identity normalisation, a dummy prefix and kept white space are taken; others raise ``ValueError``.

Words of any length go through the trie: a text without spaces is one word. The words that a process remembers are bounded
by number and by characters.

Defined results: null text is empty text, without pieces; texts of any length are taken as a whole; lone surrogates
can't occur in Spark strings; repeated rows stay rows; an empty table gives no rows; unknown ids in decoding raise.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches, texts_of, tokenizer_file, trim

MARK = "▁"
#: Words whose ids a process remembers between batches.
CACHED_WORDS = 280_000
#: Characters of the words that a process remembers.
CACHED_CHARACTERS = 16 * CACHED_WORDS

_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Codec:
    """A model file as tables, with encoding and decoding."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if norm.name != "identity" or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
            raise ValueError("a model with normalisation other than a dummy prefix")
        if trainer.model_type not in (1, 2) or any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("a model type or piece type that isn't supported")
        self.merges = trainer.model_type == 2
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.pieces = [p.piece for p in model.pieces]
        self.unknown = self.types.index(_UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE} if trainer.byte_fallback else {}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the border of words")
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self._characters = 0  # of the words in known
        plain = {_BYTE: lambda p: bytes([int(p[3:5], 16)]), _UNKNOWN: lambda p: " ⁇ ".encode(), _NORMAL: lambda p: p.replace(MARK, " ").encode()}
        self.raw = [plain[t](p) if t in plain else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        self._fits: dict[int, bool] = {}
        self._prepare()

    # -- merging ---------------------------------------------------------------------------------------------------
    def merged(self, word: str) -> list[str]:
        """The merge result: again and again the two neighbours whose union scores best, the leftmost of equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                union = self.ids.get(parts[i] + parts[i + 1])
                if union is not None and (best is None or self.scores[union] > best):
                    best, at = self.scores[union], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _prepare(self) -> None:
        """Candidates of the forward pass: pieces that merging their own characters gives, and how long they get by their last three characters."""
        self.candidates = {p: i for p, i in self.ids.items() if not self.merges or len(p) == 1 or self.merged(p) == [p]}
        self.reach: dict[str, int] = {}
        for p in self.candidates:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))

    def fits(self, one: int, two: int) -> bool:
        """Merging the characters of both pieces gives the two."""
        if len(self._fits) > 400_000:
            self._fits.clear()
        a, b = self.pieces[one], self.pieces[two]
        fit = self._fits[one << 32 | two] = self.merged(a + b) == [a, b]
        return fit

    # -- forward pass ----------------------------------------------------------------------------------------------
    def _extend(self, word: str, shared: int, sizes: list[int], states: list) -> None:
        """Append the states of the prefixes of ``word`` beyond ``shared`` characters (index 0: the empty prefix).

        ``sizes`` has the length of the last piece; ``states`` its id (-1 outside the vocabulary) or the best score.
        """
        candidates, reach, known, merges = self.candidates.get, self.reach.get, self._fits.get, self.merges
        for n in range(shared + 1, len(word) + 1):
            most = reach(word[n - 3 : n], 2) if n > 2 else 2
            size, state = 1, -1 if merges else -np.inf
            for start in range(max(0, n - most), n):
                piece = candidates(word[start:n])
                if piece is None:
                    if merges or start < n - 1:
                        continue
                    score = states[start] + self.unknown_score
                elif merges:
                    before = states[start]
                    if start and before >= 0:
                        fit = known(before << 32 | piece)
                        if not (self.fits(before, piece) if fit is None else fit):
                            continue
                    size, state = n - start, piece
                    break
                else:
                    score = states[start] + self.scores[piece]
                if score > state:
                    size, state = n - start, score
            sizes.append(size)
            states.append(state)

    def _to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            elif not out or out[-1] != self.unknown:  # unknown characters in a row are one piece
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of sorted distinct marked words: depth first through their trie."""
        sizes, states, before = [0], [-1 if self.merges else 0.0], ""
        for word in words:
            shared = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del sizes[shared + 1 :], states[shared + 1 :]
            self._extend(word, shared, sizes, states)
            before = word
            ends, n = [], len(word)
            while n:
                ends.append(n)
                n -= sizes[n]
            if self.merges and -1 not in (ids := [states[n] for n in reversed(ends)]):
                yield word, ids
            else:
                yield word, self._to_ids([word[n - sizes[n] : n] for n in reversed(ends)])

    def encode_arrays(self, texts: list[str], cached: int = CACHED_WORDS) -> list[np.ndarray]:
        split = [_MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set(chain.from_iterable(split))
        fresh = distinct - self.known.keys()
        size = sum(map(len, fresh))
        if len(self.known) + len(fresh) > cached or self._characters + size > CACHED_CHARACTERS:
            self.known = {}
            fresh = distinct
            self._characters, size = 0, sum(map(len, distinct))
        self._characters += size
        known = self.known
        for word, ids in self.encode_words(sorted(fresh)):
            known[word] = array("i", ids).tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]
        if not self.bytes:  # unknown characters of neighbouring words are one piece too
            out = [x[~np.concatenate([[False], (x[1:] == self.unknown) & (x[:-1] == self.unknown)])] if len(x) else x for x in out]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_arrays(texts)]

    # -- decoding --------------------------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(name: str = "piece_bpe_32k.model", folder: str | None = None) -> Codec:
    """One codec for each file in each process."""
    key = f"{folder}/{name}"
    if key not in _codecs:
        _codecs[key] = Codec(tokenizer_file(name, folder))
    return _codecs[key]


def _groups(texts: list[str], most: int = 3 << 20) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters, so that the ids held at once stay bounded."""
    from gridloom.llm.token_counts import batches

    return batches(texts, most)


def encode_column(docs: DataFrame, name: str = "piece_bpe_32k.model", folder: str | None = None, cached: int = CACHED_WORDS) -> DataFrame:
    """``docs`` and a column ``piece_ids`` (array of int); a column of that name is replaced. ``cached`` bounds the words remembered."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(name, folder)
        out = pd.Series([x for group in _groups(texts.fillna("").tolist()) for x in c.encode_arrays(group, cached)], dtype=object)
        trim()
        return out

    return docs.withColumn("piece_ids", ids(F.col("text").cast("string")))


def decoded(ids: Column | str, name: str = "piece_bpe_32k.model", folder: str | None = None) -> Column:
    """The texts of a column of ids; null ids give the empty text."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        c = codec(name, folder)
        return pd.Series([c.decode([] if x is None else x.tolist()) for x in column], dtype=object)

    return text(ids)


def decode_column(encoded: DataFrame, name: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """``encoded`` and a column ``decoded`` from ``piece_ids``; a column of that name is replaced."""
    return encoded.withColumn("decoded", decoded("piece_ids", name, folder))


def digests(docs: DataFrame, name: str = "piece_bpe_32k.model", folder: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256, round_trip."""

    def digested(batch) -> list:
        c = codec(name, folder)
        rows = []
        for group in _groups(texts_of(batch)):
            for text, ids in zip(group, c.encode_arrays(group), strict=True):
                back = c.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
        return list(zip(*rows, strict=True)) or [[]] * 4

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, ["doc_id"], "n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean", digested)
