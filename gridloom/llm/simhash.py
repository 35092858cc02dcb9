"""SimHash near-duplicates.

A fingerprint bit is 1 if more than half of the hashes of a text's word shingles have it. Fingerprints at ``radius``
or fewer differing bits are linked; components of links are the groups.

Search: distinct fingerprints only. The 64 bits are cut into blocks; two fingerprints within the radius differ in at
most ``radius`` blocks, so with ``blocks`` blocks they agree on some choice of ``blocks - radius`` of them. Each choice
and value makes a bucket, each bucket is cut into tiles by population count, and tile pairs whose population counts
lie further apart than the radius are skipped. The other tile pairs are compared in full by exclusive-or and bit
counts. A tile pair gives a spanning forest of its links, never all pairs. The search is exact for any choice of
``blocks``; more blocks only make smaller buckets, so their number follows the count of fingerprints.

Defined results: null text is empty text; texts without words have fingerprint zero and are linked like any other;
a null identifier is ignored in the minimum unless a whole component has none; repeated rows stay rows; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, located, map_batches, spread_join, texts_of, unpacked
from gridloom.llm.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a tile: 2 MB for the exclusive-or of two tiles by rows of 64.
TILE = 4096
#: Hashes whose bits are unpacked at once: 4 MB.
CHUNK = 65_536


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle of the text with A-Z in lower case; a shorter text is one shingle, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes (unsigned 64-bit) as an unsigned integer; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(np.array(shingle_hashes(text, shingle, seed), np.uint64))


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows of ``located`` to at, doc_id, fp (the 64 bits as a signed long)."""

    def marked(batch: pa.RecordBatch) -> list:
        return [np.fromiter((fingerprint(t, shingle) for t in texts_of(batch)), np.uint64, batch.num_rows).view(np.int64)]

    texts = rows.select("at", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return map_batches(texts, ["at", "doc_id"], "fp long", marked)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose buckets hold about 4,096 of ``n`` evenly spread fingerprints; the result doesn't depend on it."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > 4096:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of ``blocks - radius`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in choice) for choice in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest: of ``a`` with itself, or of ``a`` and ``b`` together by links between the two."""
    points = a if b is None else np.concatenate([a, b])
    label = np.arange(len(points))
    out: list[tuple[int, int]] = []
    other, shift = (a, 0) if b is None else (b, len(a))
    for i in range(0, len(a), 64):
        near = np.bitwise_count(a[i : i + 64, None] ^ other[None, :]) <= radius
        if b is None:
            near = np.triu(near, i + 1)
        for x in np.flatnonzero(near.any(axis=1)).tolist():
            mine = np.flatnonzero(near[x]) + shift
            x += i
            while len(mine := mine[label[mine] != label[x]]):
                out.append((int(points[x]), int(points[mine[0]])))
                label[label == label[mine[0]]] = label[x]
    return out


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """rows (bucket, item, pc, weight) in buckets of at least two, cut into tiles of about ``tile`` in weight: bucket, tile,
    items (ascending), low, high (population counts), many (whether the bucket has other tiles).

    Tiles follow the population count; a count that fills more than a tile is dealt out by a hash. What a bucket's
    counts say is at most 65 rows a bucket, however many items it has.
    """
    cells = rows.groupBy("bucket", "pc").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("k"))
    bucket = Window.partitionBy("bucket")
    before = F.sum("n").over(bucket.orderBy("pc").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("*", F.sum("n").over(bucket).alias("all"), F.sum("k").over(bucket).alias("items"), before.alias("before")).where("items > 1")
    large = F.col("n") > tile
    part, own = F.floor(F.coalesce("before", F.lit(0)) / tile), F.when(large, F.col("pc")).otherwise(-1)
    cells = cells.select("bucket", "pc", part.alias("part"), own.alias("own"), F.ceil(F.col("n") / tile).alias("split"), (F.col("all") > tile).alias("many"), "k")
    salt = F.when(F.col("split") > 1, F.pmod(F.xxhash64("item"), F.col("split"))).otherwise(0)
    # Few cells make a hot bucket: where the rows of one meet its cells, they are dealt out.
    cells = cells.withColumn("key", F.xxhash64("bucket", "pc"))
    hot = hot_keys(cells.groupBy("key").agg(F.sum("k").alias("k")), "key", "k", rows.count())
    keyed = rows.select("item", F.col("pc").alias("own_pc"), F.col("bucket").alias("own_bucket"), F.xxhash64("bucket", "pc").alias("key"))
    placed = spread_join(keyed, cells.drop("k"), "key", hot, F.col("item")).where("bucket = own_bucket AND pc = own_pc")
    placed = placed.select("bucket", "item", "pc", "many", F.struct("part", "own", salt.cast("long").alias("salt")).alias("tile"))
    items = F.array_sort(F.collect_list("item")).alias("items")
    return placed.groupBy("bucket", "tile").agg(items, F.min("pc").alias("low"), F.max("pc").alias("high"), F.max("many").alias("many"))


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """Written tiles to the pairs to be compared: items, items2 (null for a tile with itself).

    Pairs whose population counts lie further apart than the radius are skipped. Pairs are found by their tiles' names
    and fetch their items by tile, so the pairs of one bucket don't meet in one task.
    """
    alone = tiles.select("items", F.lit(None).cast("array<long>").alias("items2"))
    names = tiles.where("many").select("bucket", "tile", "low", "high")
    second = names.select("bucket", F.col("tile").alias("tile2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = (F.col("tile") < F.col("tile2")) & (F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius)
    pairs = names.join(second, "bucket").where(near).select("bucket", "tile", "tile2")
    named = tiles.where("many").select("bucket", "tile", "items")
    pairs = pairs.join(named, ["bucket", "tile"]).select("bucket", F.col("tile2").alias("tile"), F.col("items").alias("one"))
    return alone.unionByName(pairs.join(named, ["bucket", "tile"]).select(F.col("one").alias("items"), F.col("items").alias("items2")))


def near_links(fps: DataFrame, work: Workspace, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """fps (fp long, distinct) to links (u, v) that connect exactly what links within the radius connect."""
    choice = masks(blocks or blocks_for(fps.count(), radius), radius)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(choice)]))
    rows = fps.select(keys.alias("bucket"), F.col("fp").alias("item"), F.bit_count("fp").alias("pc"), F.lit(1).alias("weight"))
    tiles = work.keep(tiled(rows, tile), "tiles")

    def compare(batch: pa.RecordBatch) -> list:
        links: list[tuple[int, int]] = []
        for one, two in zip(batch.column("items"), batch.column("items2"), strict=True):
            a, b = (None if x.values is None else x.values.to_numpy().view(np.uint64) for x in (one, two))
            links += forest(a, b, radius)
        return links

    return links_of(tile_pairs(tiles, radius), compare)


def links_of(pairs: DataFrame, compare) -> DataFrame:
    """What ``compare`` makes of batches of ``pairs``: links (u, v)."""

    def each(batches):
        for batch in batches:
            array = np.array(compare(batch), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(array[:, 0]), pa.array(array[:, 1])], ["u", "v"])

    return pairs.mapInArrow(each, "u long, v long")


def near_groups(docs: DataFrame, work: Workspace, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: at, doc_id, fp, component_id (the smallest doc_id of its component), label (a fingerprint of it)."""
    return groups_of(located(docs, work), work, radius, tile, blocks, shingle)


def groups_of(rows: DataFrame, work: Workspace, radius: int, tile: int, blocks: int | None, shingle: int) -> DataFrame:
    marked = work.keep(fingerprints(rows, shingle), "fingerprints")
    distinct = work.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = connected_components(near_links(distinct.select("fp"), work, radius, tile, blocks), work)
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    labelled = work.keep(labelled, "labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    by_fp = spread_join(labelled.drop("first", "n"), least.drop("fps"), "label", hot_keys(least, "label", "fps", distinct.count()), F.col("fp"))
    return spread_join(marked, by_fp, "fp", hot_keys(labelled, "fp", "n", marked.count()), F.col("at")).select("at", "doc_id", "fp", "component_id", "label")


def drop_near(docs: DataFrame, work: Workspace, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group: of its smallest doc_id (null last), the first of equals by place."""
    rows = located(docs, work)
    return one_of_each(rows, groups_of(rows, work, radius, TILE, None, shingle))


def first_row() -> Column:
    """The row of a group that stays."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at"))


def one_of_each(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows of ``located`` with one of each label of ``groups`` (at, doc_id, label), as the documents they were."""
    stay = groups.groupBy("label").agg(first_row().alias("r")).select("r.at")
    return unpacked(rows.join(stay, "at", "left_semi"))
