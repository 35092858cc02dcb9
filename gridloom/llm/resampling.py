"""Importance resampling towards a target distribution over hashed word runs.

External sort-count: each Arrow batch of texts becomes one row with its packed stream of 16-bit buckets and the offsets of
its documents, written to a work table. Counts come from the streams, one at a time: sort, run lengths, sums by bucket; a
task sends a row a bucket. Gains (a number a bucket, so bounded) go to the tasks; a second pass over the streams gathers
them and sums by document with ``np.add.reduceat``. Scores add a Gumbel draw hashed from the identifier, so that the
highest ones are a sample without replacement. The draw needs no global sort of all rows: counts by score say where it
ends, and only rows from there up are ordered, dealt out by range.

Defined results: null text is empty text; empty texts have no features and weight 0; null identifiers draw as empty text
and come last among equal scores; rows that repeat an identifier are rows of their own, whose rank among equal scores is
by number of features; an empty target gives gains that only follow the corpus; empty documents give no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, text_or_empty, trim
from gridloom.operators.ordering import numbered

BUCKETS = 10_000
#: Words of the longest run.
LONGEST = 1
#: Documents with fewer words aren't drawn.
LEAST_WORDS = 20
#: Of a hundred documents with enough words, so many are drawn.
SHARE = 10
SEED = 2024
#: Buckets of so many features are remembered in a task.
REMEMBERED = 1 << 20

#: A-Z in lower case; bytes of words stay, all others part words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

STREAMS = "ids array<bigint>, n_words array<int>, starts array<bigint>, stream binary"


class _Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def runs(words: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space."""
    yield from words
    for n in range(2, longest + 1):
        yield from map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))


def write_streams(docs: DataFrame, work: Workspace, name: str, id_column: str | None = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Packed bucket streams of the texts of ``docs``, a row an Arrow batch; without ``id_column`` identifiers are null."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")
    identifier = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")
    rows = docs.select(identifier.alias("id"), text_or_empty().cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            pieces, n_words, starts, at = [], [], [], 0
            for text in batch.column("text"):
                words = words_of(text.as_py())
                piece = np.fromiter(map(known.__getitem__, runs(words, longest)), np.uint16)
                pieces.append(piece)
                n_words.append(len(words))
                starts.append(at)
                at += len(piece)
            stream = np.concatenate([*pieces, np.empty(0, np.uint16)]).astype("<u2").tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n_words], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int64())), pa.array([stream], pa.binary())], ["ids", "n_words", "starts", "stream"])
        trim()

    return work.keep(rows.mapInArrow(each, STREAMS), name)


def count_streams(streams: DataFrame) -> DataFrame:
    """(bucket, n): each stream is sorted and cut into runs; a task sends its sums by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for packed in batch.column("stream"):
                stream = np.sort(np.frombuffer(packed.as_buffer(), "<u2"), kind="stable")
                first = np.flatnonzero(np.diff(stream, prepend=-1))  # where runs begin
                total[stream[first]] += np.diff(first, append=len(stream))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    return streams.select("stream").mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket, the floored thousandfold logarithm of the target's smoothed share over the source's. Counts have a row a
    bucket at most."""
    counts = []
    for counted in (source, target):
        n = np.zeros(buckets)
        for row in counted.collect():
            n[row["bucket"]] = row["n"]
        counts.append(n)
    s, t = counts
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features, 0 without any."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                ids, n_words, starts = (batch.column(c)[k].values for c in ("ids", "n_words", "starts"))
                if not len(ids):
                    continue
                stream = np.frombuffer(batch.column("stream")[k].as_buffer(), "<u2")
                at = starts.to_numpy()
                n = np.diff(at, append=len(stream))
                # A zero behind the end: documents without features may start there.
                sums = np.add.reduceat(np.append(gain[stream], 0), at)
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(each, "doc_id long, n_words int, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight and a Gumbel draw in thousandths, from 32 bits of a digest of seed and identifier."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + draw)


def draw_highest(rows: DataFrame, work: Workspace, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, 3, ... for the highest scores among documents with enough words, null for the others."""
    fit = F.col("n_words") >= least_words
    # Scores are thousandths of bounded logarithms: some ten thousand values, however many rows there are.
    counts = sorted(((r["score"], r["n"]) for r in rows.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * share // 100
    last, upto = None, 0
    for score, n in counts:
        if upto >= wanted:
            break
        last, upto = score, upto + n
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select("*", none)
    near = fit & (F.col("score") >= last)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_n")]
    # The last number only parts rows that are equal otherwise.
    top = numbered(rows.where(near).withColumn("_n", F.monotonically_increasing_id()), order, lambda x: work.keep(x, "order"), "rank").drop("_n")
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return top.select(*rows.columns, "rank").unionByName(rows.where(~near).select("*", none))


def resample(docs: DataFrame, target: DataFrame, work: Workspace, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_features, weight, score, rank."""
    streams = write_streams(docs, work, "streams", "doc_id", buckets, longest)
    wanted = write_streams(target, work, "target", None, buckets, longest)
    gain = gains(count_streams(streams), count_streams(wanted), buckets)
    return draw_highest(work.keep(scored(weigh(streams, gain), seed), "scores"), work, share, least_words)


def drawn(docs_scored: DataFrame) -> DataFrame:
    """The sample itself: identifiers in the order of their ranks."""
    return docs_scored.where("rank IS NOT NULL").select("doc_id", "rank")
