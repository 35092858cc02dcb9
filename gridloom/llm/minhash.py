"""Near-duplicate texts by word shingles: SimHash tiles inside buckets of minimum hashes, confirmed exactly.

Two texts are linked if the sets of their shingles of ``shingle`` words have a Jaccard similarity of at least ``least``;
components of links are the groups. Four bits of 64 only reach similarities of 0.95 and up, so buckets come from bands of
minimum hashes: at a similarity of 0.8 a pair misses all bands with probability (1 - 0.8^4)^32 = 5e-8. Texts with equal
sets are one node, with the SimHash of the set as its fingerprint.

1. Fingerprints within four bits are found as op2 finds them (``simhash.near_links``): tiles inside lossless buckets,
   compared in full by exclusive-or and bit counts. Their links hold where the shingles confirm them.
2. Each node meets the smallest leader of its buckets. That settles most groups with one comparison a node, also a group
   that holds a third of all texts: the leader's text is repeated and the group dealt out.
3. Buckets whose nodes aren't all in one component yet are cut into tiles by population count. Tile pairs are compared in
   full by exclusive-or and bit counts; pairs within ``RADIUS`` bits whose nodes aren't together yet are confirmed by
   their shingles. Equal tile pairs of several buckets are compared once.

Sets of similarity 0.8 differ in 15 to 19 % of the bits, about 12 of 64; more than 28 differ with probability 1e-6.

Defined results: null text is empty; texts without words have one set, the empty one; null identifiers sort last, of
equal ones the first by place stays; repeated rows are copies; an empty table gives no rows; other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, located, map_batches, spread_join, texts_of, unpacked
from gridloom.llm.components import connected_components
from gridloom.llm.simhash import first_row, links_of, majority, near_links, shingle_hashes, tile_pairs, tiled

SHINGLE = 5
LEAST = 0.8
RADIUS = 28
BANDS, ROWS = 32, 4
#: Bytes of the texts of a tile.
TILE = 1 << 18
_DEALT = np.random.default_rng(42).integers(0, 1 << 64, (3, BANDS * ROWS, 1), np.uint64)
#: Hashes whose products are held at once: 4 MB.
CHUNK = 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value for each band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[None, i : i + CHUNK] ^ _DEALT[0]) * (_DEALT[1] | np.uint64(1))).min(axis=1), out=least)
    values = (least * (_DEALT[2, :, 0] | np.uint64(1))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    # The band is part of the value: equal values of two bands are no bucket.
    return (values * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two ascending sets reaches ``least``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) / len(b) < least:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both) >= least


def mark(rows: DataFrame, shingle: int) -> DataFrame:
    """rows of ``located`` to at, doc_id, node (digest of the set), sim (its fingerprint), bands."""

    def marks(batch: pa.RecordBatch) -> list:
        sets = [shingle_set(t, shingle) for t in texts_of(batch)]
        longs = lambda f: np.fromiter(map(f, sets), np.uint64, len(sets)).view(np.int64)
        return [longs(set_digest), longs(majority), [bands(s) for s in sets]]

    texts = rows.select("at", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return map_batches(texts, ["at", "doc_id"], "node long, sim long, bands array<long>", marks)


def star_links(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """pairs (node, sim, text, leader, leader_sim, leader_text) to the links that hold."""

    def compare(batch: pa.RecordBatch) -> list:
        known, own, links = None, None, []
        columns = [batch.column(c).to_pylist() for c in ("node", "sim", "text", "leader", "leader_sim", "leader_text")]
        for node, sim, text, leader, leader_sim, leader_text in zip(*columns, strict=True):
            if ((sim ^ leader_sim) & (2**64 - 1)).bit_count() > RADIUS:
                continue
            if leader != known:
                known, own = leader, shingle_set(leader_text, shingle)
            if similar(shingle_set(text, shingle), own, least):
                links.append((node & (2**64 - 1), leader & (2**64 - 1)))
        return links

    return links_of(pairs, compare)


def pair_links(pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Tile pairs with their texts (texts: side, node, sim, label, text) to links between components."""

    def compare(batch: pa.RecordBatch) -> list:
        links = []
        for texts in batch.column("texts").to_pylist():
            sims = np.array([t["sim"] for t in texts], np.int64).view(np.uint64)
            side = np.array([t["side"] for t in texts])
            label = np.unique(np.array([t["label"] for t in texts], np.int64), return_inverse=True)[1]
            one = np.flatnonzero(side == 0)
            other = np.flatnonzero(side == 1) if (side == 1).any() else one
            near = np.bitwise_count(sims[one][:, None] ^ sims[other][None, :]) <= RADIUS
            near &= label[one][:, None] != label[other][None, :]
            if not near.any():
                continue
            sets = [shingle_set(t["text"], shingle) for t in texts]
            sizes = np.array([len(sets[k]) for k in other])
            flat, starts = np.concatenate([sets[k] for k in other]), np.cumsum(sizes) - sizes
            for i, a in enumerate(one.tolist()):
                hit = near[i] & (label[other] != label[a])
                if not hit.any():
                    continue
                own = sets[a]
                both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, starts, dtype=np.int64)
                hits = other[hit & (both / (len(own) + sizes - both) >= least)]
                while len(hits := hits[label[hits] != label[a]]):
                    links.append((texts[a]["node"] & (2**64 - 1), texts[int(hits[0])]["node"] & (2**64 - 1)))
                    label[label == label[hits[0]]] = label[a]
        return links

    return links_of(pairs, compare)


def similar_labels(rows: DataFrame, work: Workspace, shingle: int = SHINGLE, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """rows of ``located`` to (marked rows, labels: node, label)."""
    marked = work.keep(mark(rows, shingle), "marked")
    nodes = marked.groupBy("node").agg(F.min("at").alias("at"), F.first("sim").alias("sim"))
    # The bands of a node once, however many rows have it.
    members = marked.select("node", F.explode("bands").alias("bucket")).distinct()
    members = work.keep(members, "members")
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = work.keep(buckets, "buckets")
    multi = work.keep(spread_join(members, buckets.drop("n"), "bucket", hot_keys(buckets, "bucket", "n", members.count()), F.col("node")), "multi")
    work.forget(members)

    # Fingerprints within four bits: a node of each fingerprint, and the others of equal ones with it.
    heads = work.keep(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    tied = near_links(heads.select("fp"), work)
    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_node"))
    close = tied.join(head("u"), "u").join(head("v"), "v").select(F.col("u_node").alias("node"), F.col("v_node").alias("leader"))
    equal = nodes.join(heads.where("n > 1"), nodes["sim"] == heads["fp"]).where("node <> head").select("node", F.col("head").alias("leader"))
    close = work.keep(close.unionByName(equal), "close")

    # Texts of nodes that share a bucket with another or are close to it, once each.
    asked = multi.select("node").unionByName(close.select("node")).unionByName(close.select(F.col("leader").alias("node"))).distinct()
    wanted = nodes.join(asked, "node", "left_semi").select("node", "sim", F.col("at").alias("node_at"))
    texts = rows.select(F.col("at").alias("node_at"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text")).join(wanted, "node_at").drop("node_at")
    texts = work.keep(texts, "texts")
    # Close nodes are confirmed with the node that they were found by, all others with the smallest of their buckets.
    stars = multi.groupBy("node").agg(F.min("leader").alias("leader")).where("node <> leader")
    stars = work.keep(close.unionByName(stars).distinct(), "stars")
    led = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    leaders = texts.select(F.col("node").alias("leader"), F.col("sim").alias("leader_sim"), F.col("text").alias("leader_text"))
    pairs = spread_join(stars.join(texts, "node"), leaders, "leader", hot_keys(led, "leader", "n", stars.count()), F.col("node"))
    links = work.keep(star_links(pairs, shingle, least), "star-links")

    # Buckets with nodes of several components.
    first = connected_components(links, work)
    labelled = work.keep(multi.join(first, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    weighed = labelled.join(mixed, "bucket", "left_semi").join(texts.select("node", F.bit_count("sim").alias("pc"), F.octet_length("text").cast("long").alias("weight")), "node")
    tiles = work.keep(tiled(work.keep(weighed.select("bucket", F.col("node").alias("item"), "pc", "weight"), "weighed"), TILE), "tiles")
    compared = tile_pairs(tiles, RADIUS).distinct().withColumn("pair", F.xxhash64("items", "items2"))
    sides = [compared.select("pair", F.lit(k).alias("side"), F.explode(c).alias("node")) for k, c in ((0, "items"), (1, "items2"))]
    named = texts.join(first, "node", "left").select("node", "sim", F.coalesce("label", "node").alias("label"), "text")
    filled = sides[0].unionByName(sides[1]).join(named, "node").groupBy("pair").agg(F.collect_list(F.struct("side", "node", "sim", "label", "text")).alias("texts"))
    rest = work.keep(pair_links(filled, shingle, least), "links")
    labels = connected_components(links.unionByName(rest), work)
    work.forget(multi, texts, stars, labelled, tiles)
    return marked, labels


def drop_similar(docs: DataFrame, work: Workspace, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each group: of its smallest doc_id (null last), the first of equals by place."""
    rows = located(docs, work)
    marked, labels = similar_labels(rows, work, shingle, least)
    first = marked.groupBy("node").agg(first_row().alias("r"))
    stay = first.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("r").alias("r")).select("r.at")
    return unpacked(rows.join(stay, "at", "left_semi"))
