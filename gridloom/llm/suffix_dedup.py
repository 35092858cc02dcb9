"""Removal of byte passages that another document has, by a column-wise suffix order of many strings.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller identifier. Plan:

1. Equal texts: all but the smallest identifier go as a whole (below ``LENGTH`` bytes nothing goes); one text of each
   group goes on, written once to a table bucketed by document groups, so that later reads of texts need no shuffle.
2. Each window of ``LENGTH`` bytes belongs to the smallest hash among its grams of ``GRAM`` bytes; equal windows have
   equal smallest hashes. Runs of windows with one smallest hash make a string of at most ``2 * LENGTH - GRAM`` bytes.
   Document groups exchange only hashes, as packed arrays, to learn which of them two documents have. That drops most
   of the text and never a repeat.
   A hash of more than ``HOT`` strings (the edge of a passage that very many documents have) would bring them all to
   one task: its strings are cut into single windows, each under a hash of all its bytes.
3. The strings of hashes that two documents have are exchanged, each distinct one once for a document group, and meet
   by hash. Where a hash has several strings, their suffixes are ordered by the column-wise construction: one symbol of
   every string a round, from the last to the first, placed by counting in the Burrows-Wheeler transform, which is
   kept with the lengths of common prefixes in external files, read and written in order. Neighbours with LENGTH common
   bytes are equal windows; the smallest identifier over them decides.
4. The answer for a string of a document group is one bit a window; each group marks its bytes and digests the rest.

The construction over whole corpora would take a round for each byte of the longest text, with a pass over all of
the transform each; over strings cut as above it takes a bounded number of rounds, 76 for 50 bytes, with equal results.

Defined results: null text is empty; null identifiers count as larger than any other; rows that repeat an identifier
don't remove each other's bytes; an empty table gives no rows; other columns are not read; equal identifiers with
different texts are judged one by one.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, located, spread_join, text_or_empty

LENGTH = 50
GRAM = 24
#: Bytes of text in a document group, and about what is exchanged by one part.
GROUP_BYTES = 4 << 20
#: Strings of one hash from which on they are exchanged as single windows: about a tenth of what a part gets.
HOT = 4096
#: Bytes of one text that are hashed at once.
PIECE = 1 << 16
LAST = np.iinfo(np.int64).max

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIXER
    return x ^ (x >> _HALF)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram, from hashes of its halves."""
    powers = [_mixed(data.astype(np.uint64) + np.uint64(1))]
    while 2 << len(powers) - 1 <= size:
        last, step = powers[-1], 1 << len(powers) - 1
        powers.append(_mixed(last[:-step] * _MULTIPLIER + last[step:]))
    n, out, at = len(data) - size + 1, None, 0
    for k in reversed(range(len(powers))):
        if size >> k & 1:
            part = powers[k][at : at + n]
            out, at = part if out is None else _mixed(out * _MULTIPLIER + part), at + (1 << k)
    return out


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        hashes, step = np.minimum(hashes[:-step], hashes[step:]), step * 2
    return hashes if step == width else np.minimum(hashes[: step - width], hashes[width - step :])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one smallest hash, text by text: text number, hash, first window, number of windows.

    A run has at most length - gram + 1 windows. Short texts are hashed together, long ones piece by piece.
    """
    found = []
    group: list[tuple[int, int, bytes]] = []  # text, place of the piece in it, bytes
    held = 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            piece = text[at : at + PIECE + length - 1]
            group.append((number, at, piece))
            held += len(piece)
            if held >= PIECE:
                found.append(_runs_of(group, length, gram))
                group, held = [], 0
    if group:
        found.append(_runs_of(group, length, gram))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs_of(group: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    most = length - gram + 1
    data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    ends = np.cumsum([len(x[2]) for x in group])
    least = smallest(gram_hashes(data, gram), most)
    inside = np.ones(len(least), bool)
    for end in ends[:-1].tolist():  # windows over the border of two texts
        inside[end - length + 1 : end] = False
    window = np.flatnonzero(inside)
    least = least[window]
    starts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1)]))
    sizes = np.diff(np.append(starts, len(least)))
    hashes, first = least[starts], window[starts]
    if (parts := -(-sizes // most)).max() > 1:  # texts with a short period have longer runs
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        hashes, first = np.repeat(hashes, parts), np.repeat(first, parts) + turn * most
        sizes = np.minimum(np.repeat(sizes, parts) - turn * most, most)
    of = np.searchsorted(ends, first, "right")
    base = np.array([at for _, at, _ in group]) - np.concatenate([[0], ends[:-1]])
    return np.array([number for number, _, _ in group])[of], hashes, first + base[of], sizes


# -- the column-wise construction ----------------------------------------------------------------------------------
def _range_least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of each values[start:end], start < end."""
    order = np.argsort(-start, kind="stable")  # descending: what lies between two ranges is then never read
    pairs = np.empty(2 * len(order), np.int64)
    pairs[::2], pairs[1::2] = start[order], end[order]
    out = np.empty(len(order), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values[-1:]), pairs)[::2]
    return out


#: Elements of the external files that are held at once.
CHUNK = 1 << 18


class _File:
    """One array of the construction in two external files: each round reads one from its beginning to its end and writes
    the other likewise."""

    def __init__(self, folder: str, name: str, start: np.ndarray):
        self.paths = [f"{folder}/{name}{k}" for k in (0, 1)]
        self.kind = start.dtype
        start.tofile(self.paths[0])
        self.reader = self.writer = None

    def open(self, write: bool = False) -> None:
        self.reader = open(self.paths[0], "rb")  # noqa: SIM115
        self.writer = open(self.paths[1], "wb") if write else None  # noqa: SIM115

    def read(self, n: int) -> np.ndarray:
        return np.fromfile(self.reader, self.kind, n)

    def close(self) -> None:
        self.reader.close()
        if self.writer:
            self.writer.close()
            self.paths.reverse()

    def all(self) -> np.ndarray:
        return np.fromfile(self.paths[0], self.kind)


class _Round:
    """The scan of a round: ranks of the active positions among equal symbols, and what they share with their neighbours."""

    def __init__(self, place: np.ndarray, n_symbols: int):
        self.place = place  # ascending
        self.symbol = np.zeros(len(place), np.int64)
        self.rank = np.zeros(len(place), np.int64)
        self.with_before = np.zeros(len(place), np.uint8)
        self.with_next = np.zeros(len(place), np.uint8)
        self.counts = np.zeros(n_symbols, np.int64)
        self.low = np.full(n_symbols, 255, np.uint8)  # least common prefix since the last of each symbol
        self.waiting = np.full(n_symbols, -1, np.int64)  # active position whose next equal symbol lies ahead
        self.done = 0

    def chunk(self, start: int, b: np.ndarray, lcp: np.ndarray) -> None:
        order = np.argsort(b, kind="stable")
        counts = np.bincount(b, minlength=len(self.counts))
        first = np.cumsum(counts) - counts
        turn = np.empty(len(b), np.int64)
        turn[order] = np.arange(len(b))
        end = int(np.searchsorted(self.place, start + len(b)))
        mine = np.arange(self.done, end)
        self.done = end
        p = self.place[mine] - start
        c = b[p].astype(np.int64)
        j = turn[p]
        inside = j - first[c]
        self.symbol[mine] = c
        self.rank[mine] = self.counts[c] + inside
        lowest = np.minimum.accumulate(lcp)
        k = np.flatnonzero(inside > 0)
        if len(k):
            self.with_before[mine[k]] = 1 + _range_least(lcp, order[j[k] - 1] + 1, p[k] + 1)
        k = np.flatnonzero((inside == 0) & (self.counts[c] > 0))
        if len(k):
            self.with_before[mine[k]] = 1 + np.minimum(self.low[c[k]], lowest[p[k]])
        k = np.flatnonzero(inside < counts[c] - 1)
        if len(k):
            self.with_next[mine[k]] = 1 + _range_least(lcp, p[k] + 1, order[j[k] + 1] + 1)
        # Symbols with an active position before: its next equal one is the first of this chunk.
        here = np.flatnonzero(counts > 0)
        ready = here[self.waiting[here] >= 0]
        if len(ready):
            self.with_next[self.waiting[ready]] = 1 + np.minimum(self.low[ready], lowest[order[first[ready]]])
            self.waiting[ready] = -1
        k = np.flatnonzero(inside == counts[c] - 1)
        self.waiting[c[k]] = mine[k]
        # What follows the last of each symbol, up to the end of the chunk.
        self.low = np.minimum(self.low, lowest[-1])
        after = np.minimum.accumulate(lcp[::-1])[::-1]
        last = order[first[here] + counts[here] - 1]
        self.low[here] = np.where(last + 1 < len(b), after[np.minimum(last + 1, len(b) - 1)], 255)
        self.counts += counts


def _merge(files: list[_File], at: np.ndarray, values: list[np.ndarray], with_next: np.ndarray, total: int, chunk: int) -> None:
    """New elements into the files (the common prefixes come second), read and written in order; ``at`` ascends."""
    for file in files:
        file.open(write=True)
    done = 0
    for start in range(0, total, chunk):
        n = min(chunk, total - start)
        end = int(np.searchsorted(at, start + n))
        here = at[done:end] - start
        rest = np.ones(n, bool)
        rest[here] = False
        for which, (file, own) in enumerate(zip(files, values, strict=True)):
            new = np.empty(n, file.kind)
            new[rest], new[here] = file.read(n - len(here)), own[done:end]
            if which == 1:
                behind = at + 1 - start
                k = np.flatnonzero((behind >= 0) & (behind < n)) if len(at) <= n else np.arange(*np.searchsorted(at, (start - 1, start + n - 1)))
                new[behind[k]] = with_next[k]
                if start == 0:
                    new[0] = 0
            new.tofile(file.writer)
        done = end
    for file in files:
        file.close()


def _names(b: np.ndarray, order: np.ndarray, sorted_last: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and length of each suffix, by walking the finished transform from the last symbols of all strings at once."""
    counts = np.bincount(b, minlength=len(ends))
    by_symbol = np.argsort(b, kind="stable")
    follow = np.empty(len(b), np.int64)  # where the suffix with the symbol before it stands
    starting = ends + counts
    starting[0] = 0
    base = np.cumsum(starting) - starting
    follow[by_symbol] = np.arange(len(b)) + np.repeat(base + ends - (np.cumsum(counts) - counts), counts)
    owner, size = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
    place = np.empty(len(order), np.int64)
    first = np.cumsum(ends) - ends
    place[order] = base[sorted_last] + np.arange(len(order)) - first[sorted_last]
    active = np.arange(len(order))
    for r in range(1, int(sizes.max()) + 1):
        owner[place], size[place] = active, r
        longer = sizes[active] > r
        active, place = active[longer], follow[place[longer]]
    return owner, size


def suffix_order(strings: list[bytes], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of all strings in order: string, length, and length of the common prefix with the one before.

    An end sorts before any byte; equal suffixes sort by their strings' ends, and so by string number. Round r inserts the
    suffix of length r + 1 of every string that has one: a scan of the transform and the common prefixes in order, then a
    merge that reads the files in order and writes new ones. The rounds hold some numbers a string and a chunk of each file.
    Before them the symbols of all strings are in memory once, and at the end the transform, the common prefixes and six
    64-bit numbers a suffix, as names come from a walk with random access: about 55 bytes a byte of strings, so 0.2 GB for
    the GROUP_BYTES that a call gets. That bounds a task; the external files don't make the strings of a call unbounded.
    """
    sizes = np.array([len(s) for s in strings])
    most, total = int(sizes.max()), len(strings)
    data = np.frombuffer(b"".join(strings), np.uint8)
    # Symbols: the bytes that occur, numbered in their order from 1; 0 is an end.
    occurs = np.zeros(256, bool)
    occurs[data] = True
    n_symbols = int(occurs.sum()) + 1
    code = np.cumsum(occurs).astype(np.uint8 if n_symbols <= 256 else np.uint16)
    folder = tempfile.mkdtemp(prefix="columns-")
    try:
        symbols = np.zeros((len(strings), most + 1), code.dtype)  # right-aligned
        symbols[np.arange(most + 1) > most - sizes[:, None]] = code[data]
        np.ascontiguousarray(symbols.T[::-1]).tofile(f"{folder}/symbols")
        del symbols
        column = lambda r: np.fromfile(f"{folder}/symbols", code.dtype, len(strings), offset=(r - 1) * len(strings) * code.dtype.itemsize) if r <= most + 1 else np.zeros(len(strings), code.dtype)  # noqa: E731  the r-th symbol from the right
        last = column(1)
        order = np.argsort(last, kind="stable")
        sorted_last = last[order]
        before = _File(folder, "transform", column(2)[order])
        common = _File(folder, "common", np.concatenate([[0], sorted_last[1:] == sorted_last[:-1]]).astype(np.uint8))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ends = np.bincount(last, minlength=n_symbols)
        for r in range(1, most):
            active = np.flatnonzero(sizes > r)
            active = active[np.argsort(place[active])]
            scan = _Round(place[active], n_symbols)
            before.open()
            common.open()
            for start in range(0, total, chunk):
                n = min(chunk, total - start)
                scan.chunk(start, before.read(n), common.read(n))
            before.close()
            common.close()
            c = scan.symbol
            starting = ends + scan.counts
            starting[0] = 0
            at = (np.cumsum(starting) - starting)[c] + ends[c] + scan.rank
            with_before = np.where(scan.with_before > 0, scan.with_before, ends[c] > 0).astype(np.uint8)
            place[active] = at
            total += len(active)
            turn = np.argsort(at)
            values = [column(r + 2)[active][turn], with_before[turn]]
            _merge([before, common], at[turn], values, scan.with_next[turn], total, chunk)
        return *_names(before.all(), order, sorted_last, ends, sizes), common.all()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def least_owner(strings: list[bytes], documents: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string and each of its windows: the smallest document of any string with an equal window."""
    owner, size, common = suffix_order(strings)
    document = np.where(size >= length, documents[owner], LAST)
    starts = np.flatnonzero(common < length)
    least = np.repeat(np.minimum.reduceat(document, starts), np.diff(np.append(starts, len(common))))
    out = [np.empty(max(0, len(s) - length + 1), np.int64) for s in strings]
    base = np.cumsum([0] + [len(x) for x in out])
    flat = np.empty(base[-1], np.int64)
    k = np.flatnonzero(size >= length)
    flat[base[owner[k]] + np.array([len(s) for s in strings])[owner[k]] - size[k]] = least[k]
    return [flat[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


# -- what document groups and parts do -----------------------------------------------------------------------------
class _Strings:
    """The strings of a document group whose hashes two documents have, in an order that depends on the group only."""

    def __init__(self, frame: pd.DataFrame, shared: np.ndarray, hot: np.ndarray, length: int, gram: int):
        """``shared``: hashes, ascending; ``hot``: which of them are hot."""
        self.index: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.least: list[int] = []
        self.texts = [t.encode("utf-8", "surrogatepass") for t in frame["text"]]
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in self.texts]
        docs = frame["doc"].tolist()
        numbers, hashes, starts, sizes = runs(self.texts, length, gram)
        at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        k = np.flatnonzero(shared[at] == hashes) if len(shared) else np.empty(0, np.int64)
        extra = length - 1
        for t, h, s, n, single in zip(numbers[k].tolist(), hashes[k].tolist(), starts[k].tolist(), sizes[k].tolist(), hot[at[k]].tolist(), strict=True):
            if single:
                for w in range(s, s + n):
                    content = self.texts[t][w : w + length]
                    self._add(t, content, None, docs[t], w, 1)
            else:
                self._add(t, self.texts[t][s : s + n + extra], h, docs[t], s, n)

    def _add(self, text: int, content: bytes, hashed: int | None, doc: int, start: int, n: int) -> None:
        index, least = self.index, self.least
        i = index.setdefault(content, len(least))
        if i == len(least):
            self.hashes.append(xxhash.xxh64_intdigest(content) if hashed is None else hashed)
            least.append(doc)
        elif doc < least[i]:
            least[i] = doc
        self.found[text].append((i, start, n))

    def by_part(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Parts and the numbers of their strings."""
        part = (np.array(self.hashes, np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for numbers in np.split(order, cuts) if len(order) else []:
            yield int(part[numbers[0]]), numbers


def _empty(columns: str) -> pd.DataFrame:
    kinds = {"long": "int64", "binary": object, "string": object}
    return pd.DataFrame({c.split()[0]: pd.Series(dtype=kinds[c.split()[1]]) for c in columns.split(", ")})


HASHES = "bucket long, part long, hashes binary, several binary, counts binary"
SHARED = "bucket long, part long, hashes binary, hot binary"
STRINGS = "bucket long, part long, hashes binary, docs binary, sizes binary, bytes binary"
ANSWERS = "bucket long, part long, bits binary"
MARKED = "doc long, digest binary, n_removed long, n_spans long, kept_sha256 string"


def _group_hashes(parts: int, length: int, gram: int):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, every, _, _ = runs([t.encode("utf-8", "surrogatepass") for t in frame["text"]], length, gram)
        if not len(every):
            return _empty(HASHES)
        order = np.argsort(every, kind="stable")  # within a hash by text
        numbers, every = numbers[order], every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        ends = np.append(starts[1:], len(every))
        hashes, several = every[starts], numbers[starts] != numbers[ends - 1]
        counts = np.minimum(ends - starts, 65_535).astype(np.uint16)
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        pieces = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
        return pd.DataFrame({"bucket": frame["bucket"].iloc[0], "part": [int(part[k[0]]) for k in pieces], "hashes": [hashes[k].tobytes() for k in pieces], "several": [np.packbits(several[k]).tobytes() for k in pieces], "counts": [counts[k].tobytes() for k in pieces]})

    return each


def _shared_hashes(most: int):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        return _shared(frame, most)

    return each


def _shared(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    own = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(frame["several"], own, strict=True)]
    every, of = np.unique(np.concatenate(own), return_inverse=True)
    strings = np.bincount(of, weights=np.concatenate([np.frombuffer(x, np.uint16) for x in frame["counts"]]), minlength=len(every))
    twice = np.bincount(of, weights=1 + np.concatenate(several), minlength=len(every)) > 1
    hot = strings > most
    cuts = np.cumsum([len(h) for h in own])[:-1]
    kept = [k[twice[k]] for k in np.split(of, cuts)]
    out = pd.DataFrame({"bucket": frame["bucket"], "part": frame["part"], "hashes": [every[k].tobytes() for k in kept], "hot": [hot[k].astype(np.uint8).tobytes() for k in kept]})
    return out[[len(k) > 0 for k in kept]]


def _joined(column: pd.Series, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in column] or [np.empty(0, dtype)])


def _known(shared: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shared hashes in ascending order, and which are hot."""
    hashes, hot = _joined(shared["hashes"], np.uint64), _joined(shared["hot"], np.uint8).astype(bool)
    order = np.argsort(hashes)
    return hashes[order], hot[order]


def _group_strings(parts: int, length: int, gram: int):
    def each(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(shared):
            return _empty(STRINGS)
        own = _Strings(frame, *_known(shared), length, gram)
        contents = list(own.index)
        hashes, least = np.array(own.hashes, np.uint64), np.array(own.least, np.int64)
        rows = []
        for part, k in own.by_part(parts):
            mine = [contents[i] for i in k.tolist()]
            rows.append((part, hashes[k].tobytes(), least[k].tobytes(), bytes(map(len, mine)), b"".join(mine)))
        out = pd.DataFrame(rows, columns=["part", "hashes", "docs", "sizes", "bytes"])
        out.insert(0, "bucket", frame["bucket"].iloc[0])
        return out

    return each


def _answers(length: int):
    def each(frame: pd.DataFrame) -> pd.DataFrame:
        index: dict[bytes, int] = {}
        least: list[int] = []
        hashes: list[int] = []
        asked = []
        for h, d, s, data in zip(frame["hashes"], frame["docs"], frame["sizes"], frame["bytes"], strict=True):
            docs = np.frombuffer(d, np.int64)
            numbers, at = [], 0
            for x, doc, size in zip(np.frombuffer(h, np.uint64).tolist(), docs.tolist(), s, strict=True):
                content = bytes(data[at : at + size])
                at += size
                i = index.setdefault(content, len(least))
                if i == len(least):
                    least.append(doc)
                    hashes.append(x)
                elif doc < least[i]:
                    least[i] = doc
                numbers.append(i)
            asked.append((docs, numbers))
        contents = list(index)
        first = np.array(least, np.int64)
        _, group, counts = np.unique(np.array(hashes, np.uint64), return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[group] > 1)
        windows: dict[int, np.ndarray] = {}
        if len(several):
            windows = dict(zip(several.tolist(), least_owner([contents[i] for i in several.tolist()], first[several], length), strict=True))
        powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
        out = []
        for docs, numbers in asked:
            bits = np.where(first[numbers] < docs, np.uint64(LAST), np.uint64(0))
            for k, (i, doc) in enumerate(zip(numbers, docs.tolist(), strict=True)):
                if (w := windows.get(i)) is not None:
                    bits[k] = powers[: len(w)][w < doc].sum()
            out.append(bits.tobytes())
        return pd.DataFrame({"bucket": frame["bucket"], "part": frame["part"], "bits": out})

    return each


def _group_marks(parts: int, length: int, gram: int):
    def each(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _empty(MARKED)
        answered = replies[replies["bits"].notna()]
        own = _Strings(frame, *_known(replies[replies["hashes"].notna()]), length, gram)
        bits = np.zeros(len(own.hashes), np.uint64)
        by_part = dict(zip(answered["part"].tolist(), answered["bits"], strict=True))
        for part, k in own.by_part(parts):
            bits[k] = np.frombuffer(by_part[part], np.uint64)
        least, masks = own.least, bits.tolist()
        rows = []
        for met, doc, text, digest in zip(own.found, frame["doc"].tolist(), own.texts, frame["digest"], strict=True):
            data = np.frombuffer(text, np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            whole = []
            for i, s, n in met:
                full = (1 << n) - 1
                # In the same group a smaller document has the string, or an answer for every window.
                if doc > least[i] or (mask := masks[i] & full) == full:
                    whole.append((s, s + n + length - 1))
                elif mask:
                    w = np.flatnonzero([mask >> b & 1 for b in range(n)]) + s
                    np.add.at(edge, w, 1)
                    np.add.at(edge, w + length, -1)
            if whole:
                sides = np.array(whole)
                np.add.at(edge, sides[:, 0], 1)
                np.add.at(edge, sides[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1]))
            rows.append((doc, digest, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MARKED.split(", ")])

    return each


def remove_repeats(docs: DataFrame, work: Workspace, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not 0 < length - gram < 64 or gram < 1 or 2 * length - gram > 255:
        raise ValueError("length and gram don't fit")
    spark = work.spark
    rows = located(docs, work)
    content = text_or_empty("row.text")
    doc_id = F.col("row.doc_id").cast("long")
    doc = F.coalesce(doc_id, F.lit(int(LAST)))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    sized = work.keep(rows.select(F.col("row.doc_id").alias("doc_id"), doc.alias("doc"), "at", digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    size = sized.agg(F.sum("n_bytes").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(8, -(-(size["n"] or 0) // group_bytes))
    bucket = F.pmod(F.xxhash64("at"), F.lit(groups)).alias("bucket")

    # 1. One document of each group of equal texts, of those that are long enough, in a table bucketed by document groups.
    long = sized.where(F.col("n_bytes") >= length)
    copies = work.keep(long.groupBy("digest").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).select("digest", "first.doc", "first.at", "n"), "copies")
    names = copies.select(bucket, "doc", "digest", F.col("at.file").alias("file"), F.col("at.n").alias("n"))

    def chosen(frame: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        keys = dict(zip(zip(wanted["file"], wanted["n"].tolist(), strict=True), zip(wanted["doc"].tolist(), wanted["digest"], strict=True), strict=True))
        found = []
        for b, file, n, t in zip(frame["bucket"], frame["file"], frame["n"].tolist(), frame["text"], strict=True):
            if (key := keys.get((file, n))) is not None:
                found.append((b, *key, t))
        return pd.DataFrame(found, columns=["bucket", "doc", "digest", "text"]) if found else _empty("bucket long, doc long, digest binary, text string")

    texts = rows.select(bucket, F.col("at.file").alias("file"), F.col("at.n").alias("n"), content.alias("text")).where(F.octet_length("text") >= length)
    picked = texts.groupBy("bucket").cogroup(names.groupBy("bucket")).applyInPandas(chosen, "bucket long, doc long, digest binary, text string")
    table, folder = f"gridloom_texts_{uuid.uuid4().hex}", work.sub("texts")
    # The table's buckets are files; a session bounds their number. Groups beyond it share files, which changes no result.
    files = min(groups, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    try:
        picked.write.option("path", folder).bucketBy(files, "bucket").sortBy("bucket", "doc").saveAsTable(table)
        grouped = lambda: spark.table(table).groupBy("bucket")

        # 2. Hashes that two documents have.
        hashes = grouped().applyInPandas(_group_hashes(groups, length, gram), HASHES)
        shared = work.keep(hashes.groupBy("part").applyInPandas(_shared_hashes(hot), SHARED), "shared")
        # 3. Their strings, to the smallest document of each window.
        strings = grouped().cogroup(shared.groupBy("bucket")).applyInPandas(_group_strings(groups, length, gram), STRINGS)
        answers = work.keep(strings.groupBy("part").applyInPandas(_answers(length), ANSWERS), "answers")
        # 4. Marks.
        nothing = F.lit(None).cast("binary")
        replies = shared.withColumn("bits", nothing).unionByName(answers.withColumns({"hashes": nothing, "hot": nothing}))
        marked = work.keep(grouped().cogroup(replies.groupBy("bucket")).applyInPandas(_group_marks(groups, length, gram), MARKED), "marked")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the catalog's entry
    work.drop(folder)
    work.forget(shared, answers)

    copy = F.col("doc") > F.col("first")
    of_text = marked.select("digest", F.col("doc").alias("first"), F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.col("kept_sha256").alias("k"))
    met = spread_join(long, of_text, "digest", hot_keys(copies, "digest", "n", size["rows"]), F.col("at")).select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("r")).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("s")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("k")).alias("kept_sha256"),
    )
    short = sized.where(F.col("n_bytes") < length)
    zero = F.lit(0).cast("long")
    return met.unionByName(short.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("digest")).alias("kept_sha256")))
