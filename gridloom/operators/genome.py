"""Coordinates: sub-matrices, bins and base pairs, local and global bins, range joins of intervals."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sub_matrices(chroms: DataFrame, inter: bool = False) -> DataFrame:
    """Chromosome pairs, the diagonal ones and with ``inter`` those above; one row a pair, few rows."""
    side = lambda k: chroms.select(F.col("chrom").alias(f"chr{k}"), F.col("chrom_idx").alias(f"idx{k}"), F.col("start_bin").alias(f"s{k}"), F.col("end_bin").alias(f"e{k}"))
    keep = F.col("idx1") <= F.col("idx2") if inter else F.col("idx1") == F.col("idx2")
    pairs = side(1).join(side(2), keep)
    return pairs.select("chr1", "chr2", "s1", "e1", "s2", "e2", (F.col("idx1") != F.col("idx2")).alias("inter"))


def coords_to_bins(coords: DataFrame, bins: DataFrame, bin_size: int) -> DataFrame:
    """coords (…, chrom, pos) and the bin that starts at the floor of pos; null where there is none."""
    at = (F.floor(F.col("pos") / bin_size) * bin_size).cast("long")
    known = bins.select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), "bin_id")
    return coords.join(known, (F.col("chrom") == F.col("_chrom")) & (at == F.col("_start")), "left").drop("_chrom", "_start")


#: Bytes of a column of a table of bins, at least.
NARROW = 4


def at_bins(pixels: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Pixels join ``side``, which has a row a bin at most.

    A side that Spark may broadcast is left to it. A larger one is hashed by partition and pixels stream past it: a merge
    would sort them, and a task's share of pixels grows with the map while its share of bins stays small.
    """
    limit = re.match(r"(-?\d+)([kmg]?)", pixels.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower())
    most = int(limit[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[limit[2]]
    return pixels.join(side.hint("shuffle_hash") if side.count() * len(side.columns) * NARROW > most else side, key, how)


def bins_to_coords(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """Adds chrom, start, end of both bins (columns bin1, bin2)."""
    for k in (1, 2):
        side = bins.select(F.col("bin_id").alias(f"bin{k}"), F.col("chrom").alias(f"chrom{k}"), F.col("start").alias(f"start{k}"), F.col("end").alias(f"end{k}"))
        pairs = at_bins(pairs, side, f"bin{k}")
    return pairs


def chrom_cells(chroms: DataFrame) -> tuple[DataFrame, int]:
    """Chromosomes by cells of a grid on the bins: cell, chrom_idx, first, last; and the bins of a cell.

    A cell is as long as a chromosome on average, so there are at most twice as many rows as chromosomes, and a bin finds
    its chromosome by an equi-join, in a genome of 10^5 scaffolds too.
    """
    ends = chroms.agg(F.max("end_bin").alias("n"), F.count(F.lit(1)).alias("k")).first()
    cell = max(1, -(-(ends["n"] or 1) // max(ends["k"], 1)))
    spans = chroms.where("end_bin > start_bin").select("chrom_idx", F.col("start_bin").alias("first"), (F.col("end_bin") - 1).alias("last"))
    at = F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))).alias("cell")
    return spans.select(at, "chrom_idx", "first", "last"), cell


def to_local(pixels: DataFrame, chroms: DataFrame, inter: bool = False) -> DataFrame:
    """Pixels by sub-matrix with local bins: sub1, sub2, i, j, and all other columns."""
    cells, width = chrom_cells(chroms)
    for k, local in ((1, "i"), (2, "j")):
        own = F.col(f"bin{k}_id")
        side = cells.select(F.col("cell").alias("_cell"), F.col("chrom_idx").alias(f"sub{k}"), F.col("first").alias("_first"), F.col("last").alias("_last"))
        # At most two rows a chromosome: a bounded side.
        met = pixels.withColumn("_cell", F.floor(own / width)).join(F.broadcast(side), "_cell").where((own >= F.col("_first")) & (own <= F.col("_last")))
        pixels = met.withColumn(local, own - F.col("_first")).drop("_cell", "_first", "_last")
    return pixels if inter else pixels.where("sub1 = sub2")


def to_global(local: DataFrame, chroms: DataFrame) -> DataFrame:
    """Local (sub, i, j) back to bin1, bin2 of the whole map."""
    start = chroms.select(F.col("chrom_idx").alias("sub"), "start_bin")
    return local.join(F.broadcast(start), "sub").withColumn("bin1", F.col("i") + F.col("start_bin")).withColumn("bin2", F.col("j") + F.col("start_bin")).drop("start_bin")


def interval_pairs(bed: DataFrame, within: int, least: int) -> DataFrame:
    """Ordered pairs of intervals of one chromosome: b.start < a.end + within, b.end > a.start - within, b.start - a.start >= least.

    A range join as an equi-join: each interval b lies in the bucket of its start, each a asks the buckets that its
    range reaches, so a bucket holds about ``within`` positions.
    """
    a = bed.select(*[F.col(c).alias(f"{c}1") for c in ("chrom", "start", "end")])
    b = bed.select(*[F.col(c).alias(f"{c}2") for c in ("chrom", "start", "end")])
    cell = lambda x: F.floor(x / within)
    asks = a.withColumn("_cell", F.explode(F.sequence(cell(F.col("start1") + least), F.greatest(cell(F.col("end1") + within), cell(F.col("start1") + least)))))
    lies = b.withColumn("_cell", cell(F.col("start2")))
    on = (F.col("chrom1") == F.col("chrom2")) & (asks["_cell"] == lies["_cell"])
    near = (F.col("start2") < F.col("end1") + within) & (F.col("end2") > F.col("start1") - within) & (F.col("start2") - F.col("start1") >= least)
    return asks.join(lies, on & near).select("chrom1", "start1", "end1", "chrom2", "start2", "end2")


def region(patterns: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Patterns with both anchors inside a region: start >= a and end < b."""
    side = lambda k: (F.col(f"chrom{k}") == chrom) & (F.col(f"start{k}") >= start) & (F.col(f"end{k}") < end)
    return patterns.where(side(1) & side(2))


def confirmed(clicks: DataFrame) -> DataFrame:
    """clicks (session, n, x, y): places that were chosen twice in a row, once each."""
    order = Window.partitionBy("session").orderBy("n")
    again = (F.lag("x").over(order) == F.col("x")) & (F.lag("y").over(order) == F.col("y"))
    return clicks.withColumn("_again", again).where("_again").select("session", "x", "y").distinct()
