"""Driver queries: each operator on maps derived from the driver's tables, and its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.stats import benjamini_hochberg, rank_glyphs
from gridloom.operators import balance, correlate, foci, genome, matrix, nms, preprocess, sampling, windows
from gridloom.plans import pipeline
from gridloom.plans.oracle import ALONE, BAND, BIN_PARTS, BIN_SIZE, EDGES, LEAST_BINS, MOST_MISSING, MOST_ZERO, SIZE, THRESHOLD, assemble, log10p, pieces
from gridloom.scratch import Scratch
from gridloom.sources.contacts import ContactMap, chrom_offsets, cooccurrence, of_chromosomes, read_map, self_pairs, swap_anchors, write_map
from gridloom.sources.kernels import KernelConfig, blocks, bump, factorise, kernel_frame, stripe

#: q-value over the columns that _LAST adds: number of p-values, and rank of the last of equal ones.
_BH = "least(1.0, min(pvalue * m / last) OVER (ORDER BY pvalue DESC RANGE UNBOUNDED PRECEDING))"
_LAST = "SELECT *, count(*) OVER () AS m, rank() OVER (ORDER BY pvalue) + count(*) OVER (PARTITION BY pvalue) - 1 AS last"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KERNEL = bump(SIZE, 1.3)
BLOCKS = pieces(KERNEL)
#: Detection leaves sub-matrices out that aren't larger than a kernel.
DETECT_BLOCKS = {**BLOCKS, "det": f"SELECT d.* FROM ({BLOCKS['det']}) d JOIN chroms c ON c.chrom_idx = d.sub WHERE c.n > {SIZE}"}
CONFIG = KernelConfig("query", [KERNEL], BAND * BIN_SIZE, 2000, 1, 5000, THRESHOLD, BIN_SIZE, MOST_ZERO, MOST_MISSING)


def query(sql: str | None = None, blocks: dict[str, str] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = assemble(sql, BLOCKS if blocks is None else blocks)
        return f

    return add


def six(c: str | Column) -> Column:
    """Six digits, and no negative zero: sums of fractions depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def six_compiled(c: str) -> Column:
    """``six`` of a finite value near one; ``round`` makes a decimal of each, which takes longer than the correlation."""
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Parts of a bin, and number of bins: no part falls off the map."""
    n = table(spark, sf_dir, "part").count()
    width = max(1, min(BIN_PARTS, n // LEAST_BINS))
    return width, -(-n // width)


def base_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = layout(spark, sf_dir)[1]
    b = F.col("id")
    name, start = F.lit(None).cast("string"), F.lit(None).cast("long")
    for k, (low, high) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
        inside = (b >= n * low // 100) & (b < n * high // 100)
        name, start = F.when(inside, f"chr{k + 1}").otherwise(name), F.when(inside, n * low // 100).otherwise(start)
    rows = spark.range(n).select(b.alias("bin_id"), name.alias("chrom"), (b - start).alias("local"))
    return rows.select("bin_id", "chrom", (F.col("local") * BIN_SIZE).alias("start"), ((F.col("local") + 1) * BIN_SIZE).alias("end"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are bought together, as pixels of bins of up to ten parts."""
    width = layout(spark, sf_dir)[0]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(f"l_partkey div {width}").alias("bin"))
    return cooccurrence(rows, "l_orderkey", "bin")


def base_map(spark: SparkSession, sf_dir: str) -> ContactMap:
    """The map of ``contacts`` in four chromosomes; weights from marginals, some missing. Pixels and bins are tables, as
    those of a map that is read."""
    scratch = Scratch(spark, "map")
    pixels = scratch.keep(contacts(spark, sf_dir), "pixels")
    bins = base_bins(spark, sf_dir)
    marg = preprocess.marginals(pixels)
    weight = F.when(F.col("bin_id") % 17 != 5, F.lit(10.0) / F.sqrt("marginal"))
    weighed = bins.join(marg, "bin_id", "left").select("bin_id", "chrom", "start", "end", weight.alias("weight"))
    return ContactMap(scratch.keep(chrom_offsets(bins), "chroms"), scratch.keep(weighed, "bins"), pixels, BIN_SIZE)


def stored_map(spark: SparkSession, sf_dir: str) -> ContactMap:
    folder = Scratch(spark, "stored").path
    write_map(base_map(spark, sf_dir), folder)
    return read_map(spark, folder)


def signal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pipeline.prepared(base_map(spark, sf_dir), BAND, SIZE)


def local(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base_map(spark, sf_dir)
    return genome.to_local(preprocess.balanced(m.pixels, m.bins), m.chroms).select(F.col("sub1").alias("sub"), "i", "j", "v")


def correlation(spark: SparkSession, sf_dir: str, parts: tuple | None = None) -> DataFrame:
    det, sizes, gone = parts or signal(spark, sf_dir)
    return correlate.normxcorr2(det, kernel_frame(spark, [KERNEL]), BAND, SIZE, sizes, gone, MOST_MISSING / 100)


def candidates(spark: SparkSession, sf_dir: str, parts: tuple | None = None) -> DataFrame:
    """The map is correlated once: its candidates are a table."""
    return Scratch(spark, "candidates").keep(foci.candidates(correlation(spark, sf_dir, parts), THRESHOLD), "candidates")


def labelled(spark: SparkSession, sf_dir: str, parts: tuple | None = None) -> DataFrame:
    return foci.label(candidates(spark, sf_dir, parts))


def picked(spark: SparkSession, sf_dir: str, parts: tuple | None = None) -> DataFrame:
    return foci.best_pixel(foci.sized(labelled(spark, sf_dir, parts))).withColumn("pid", F.struct("sub", "label"))


def window_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "windows")
    det, sizes, gone = signal(spark, sf_dir)
    parts = scratch.keep(det, "signal"), sizes, gone
    found = scratch.keep(picked(spark, sf_dir, parts), "picked")
    cells = windows.cells(found.select("pid", "sub", "i", "j"), *parts, SIZE)
    return found, cells, windows.validity(found, cells, sizes, MOST_ZERO, MOST_MISSING)


# -- sources and coordinates ---------------------------------------------------------------------------------------
@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr WHERE r >= 0.35")
def top_correlations(spark, sf_dir):
    return foci.candidates(correlation(spark, sf_dir), THRESHOLD).select("sub", "i", "j", six("r").alias("r"), "n_obs")


@query("SELECT bin1_id, bin2_id, count FROM pixels")
def contact_pixels(spark, sf_dir):
    return contacts(spark, sf_dir)


@query("SELECT chrom, chrom_idx, length, start_bin, end_bin FROM chroms")
def chrom_ranges(spark, sf_dir):
    return chrom_offsets(base_bins(spark, sf_dir))


@query('SELECT bin_id, chrom, start, "end", round(weight, 6) + 0.0 AS weight FROM bins')
def bins_table(spark, sf_dir):
    return base_map(spark, sf_dir).bins.withColumn("weight", six("weight"))


def _submats(inter: bool) -> str:
    return f"SELECT a.chrom AS chr1, b.chrom AS chr2, a.start_bin AS s1, a.end_bin AS e1, b.start_bin AS s2, b.end_bin AS e2, a.chrom <> b.chrom AS \"inter\" FROM chroms a JOIN chroms b ON a.chrom_idx {'<=' if inter else '='} b.chrom_idx"


@query(_submats(False))
def submats_cis(spark, sf_dir):
    return genome.sub_matrices(chrom_offsets(base_bins(spark, sf_dir)))


@query(_submats(True))
def submats_all(spark, sf_dir):
    return genome.sub_matrices(chrom_offsets(base_bins(spark, sf_dir)), True)


@query(f"SELECT o.o_orderkey AS k, o.chrom, o.pos, b.bin_id FROM (SELECT o_orderkey, 'chr' || (o_custkey % 5 + 1) AS chrom, (o_orderkey * 37) % 55000 AS pos FROM orders) o LEFT JOIN bins0 b ON b.chrom = o.chrom AND b.start = o.pos // {BIN_SIZE} * {BIN_SIZE}")
def coords_to_bins(spark, sf_dir):
    coords = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"), (F.col("o_orderkey") * 37 % 55000).alias("pos"))
    return genome.coords_to_bins(coords, base_bins(spark, sf_dir), BIN_SIZE)


@query('SELECT p.bin1_id AS bin1, p.bin2_id AS bin2, p.count, x.chrom AS chrom1, x.start AS start1, x."end" AS end1, y.chrom AS chrom2, y.start AS start2, y."end" AS end2 FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id')
def bins_to_coords(spark, sf_dir):
    m = base_map(spark, sf_dir)
    return genome.bins_to_coords(m.pixels.toDF("bin1", "bin2", "count"), m.bins.drop("weight"))


@query("SELECT x.chrom_idx AS sub1, y.chrom_idx AS sub2, x.local AS i, y.local AS j, p.count FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id")
def global_to_local(spark, sf_dir):
    m = base_map(spark, sf_dir)
    return genome.to_local(m.pixels, m.chroms, inter=True).select("sub1", "sub2", "i", "j", "count")


@query("SELECT sub, i, j, c.start_bin + i AS bin1, c.start_bin + j AS bin2 FROM loc JOIN chroms c ON c.chrom_idx = sub")
def local_to_global(spark, sf_dir):
    return genome.to_global(local(spark, sf_dir).drop("v"), chrom_offsets(base_bins(spark, sf_dir)))


_BED2 = "SELECT o_orderkey AS k, 'chr' || (o_custkey % 4 + 1) AS chrom1, (o_orderkey * 31) % 50000 AS start1, (o_orderkey * 31) % 50000 + 1000 AS end1, 'chr' || (o_custkey % 4 + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END) AS chrom2, (o_orderkey * 17) % 50000 AS start2, (o_orderkey * 17) % 50000 + 1500 AS end2 FROM orders"


@query(f"SELECT k, chrom1, CASE WHEN s THEN start2 ELSE start1 END AS start1, CASE WHEN s THEN end2 ELSE end1 END AS end1, chrom2, CASE WHEN s THEN start1 ELSE start2 END AS start2, CASE WHEN s THEN end1 ELSE end2 END AS end2 FROM (SELECT *, chrom1 = chrom2 AND start2 < start1 AS s FROM ({_BED2}))")
def bed2d_normalise(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    name = lambda n: F.concat(F.lit("chr"), n.cast("string"))
    a, b = k * 31 % 50000, k * 17 % 50000
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), name(c + 1).alias("chrom1"), a.alias("start1"), (a + 1000).alias("end1"), name(c + F.when(k % 3 == 0, 2).otherwise(1)).alias("chrom2"), b.alias("start2"), (b + 1500).alias("end2"))
    return swap_anchors(rows)


_BED = "SELECT DISTINCT event_type AS chrom, event_id * 13 AS start, event_id * 13 + 20 AS \"end\" FROM events"


def _bed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("chrom"), (F.col("event_id") * 13).alias("start"), (F.col("event_id") * 13 + 20).alias("end")).distinct()


@query('SELECT a.chrom AS chrom1, a.start AS start1, a."end" AS end1, b.chrom AS chrom2, b.start AS start2, b."end" AS end2 FROM bed a JOIN bed b ON a.chrom = b.chrom AND b.start < a."end" + 500 AND b."end" > a.start - 500 AND b.start - a.start >= 100', {"bed": _BED})
def bed_pairs_range_join(spark, sf_dir):
    return genome.interval_pairs(_bed(spark, sf_dir), 500, 100)


@query('SELECT chrom AS chrom1, start AS start1, "end" AS end1, chrom AS chrom2, start AS start2, "end" AS end2 FROM bed', {"bed": _BED})
def diag_pairs(spark, sf_dir):
    return self_pairs(_bed(spark, sf_dir))


# -- preprocessing -------------------------------------------------------------------------------------------------
@query(f"SELECT sub, i, j, round(v, 6) + 0.0 AS v FROM loc WHERE j - i BETWEEN 0 AND {BAND}")
def band_trim(spark, sf_dir):
    return preprocess.diag_trim(local(spark, sf_dir), BAND).withColumn("v", six("v"))


@query("SELECT bin_id, marginal FROM marg")
def bin_marginals(spark, sf_dir):
    return preprocess.marginals(contacts(spark, sf_dir))


@query("SELECT bin_id, degree FROM degree")
def bin_degree(spark, sf_dir):
    return preprocess.degrees(contacts(spark, sf_dir), base_bins(spark, sf_dir))


@query("SELECT median(degree) AS median, (SELECT median(abs(degree - (SELECT median(degree) FROM degree))) FROM degree) AS mad FROM degree")
def median_mad(spark, sf_dir):
    return preprocess.median_mad(bin_degree(spark, sf_dir), "degree")


_DETECTABLE = "SELECT bin_id FROM degree WHERE degree >= greatest(1.0, (SELECT median(degree) FROM degree) - 1.5 * (SELECT median(abs(degree - (SELECT median(degree) FROM degree))) FROM degree))"


@query(_DETECTABLE)
def detectable_intra(spark, sf_dir):
    return preprocess.detectable_intra(contacts(spark, sf_dir), base_bins(spark, sf_dir), 1.5)


@query(f"SELECT bin_id FROM bins0 WHERE bin_id NOT IN ({_DETECTABLE})")
def missing_bins(spark, sf_dir):
    return preprocess.missing_bins(base_bins(spark, sf_dir), detectable_intra(spark, sf_dir))


@query(f"SELECT bin1_id, bin2_id, count FROM pixels WHERE bin1_id IN ({_DETECTABLE}) AND bin2_id IN ({_DETECTABLE})")
def erase_missing(spark, sf_dir):
    pixels = Scratch(spark, "map").keep(contacts(spark, sf_dir), "pixels")
    return preprocess.erase_missing(pixels, preprocess.detectable_intra(pixels, base_bins(spark, sf_dir), 1.5))


_RECT = "SELECT (l_partkey // (SELECT w FROM width))::BIGINT AS row_id, l_suppkey % 40 AS col_id, count(*)::DOUBLE AS count FROM lineitem GROUP BY 1, 2"


def _rect(spark, sf_dir):
    width = layout(spark, sf_dir)[0]
    return table(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_partkey div {width}").alias("row_id"), (F.col("l_suppkey") % 40).alias("col_id")).agg(F.count(F.lit(1)).cast("double").alias("count"))


def _rect_side(axis: str) -> str:
    s = f"(SELECT {axis}_id AS b, sum(count) AS t FROM rect GROUP BY 1)"
    return f"SELECT '{axis}' AS axis, b AS bin_id FROM {s} WHERE t > (SELECT median(t) FROM {s}) - 2 * (SELECT median(abs(t - (SELECT median(t) FROM {s}))) FROM {s})"


@query(f"{_rect_side('row')} UNION ALL {_rect_side('col')}", {"width": BLOCKS["width"], "rect": _RECT})
def detectable_inter(spark, sf_dir):
    return preprocess.detectable_inter(_rect(spark, sf_dir), 2.0)


@query("SELECT row_id, col_id, count FROM rect", {"width": BLOCKS["width"], "rect": _RECT})
def rectangular_map(spark, sf_dir):
    return _rect(spark, sf_dir)


@query("SELECT bin1_id, bin2_id, round(v, 6) + 0.0 AS v FROM bal")
def balanced_pixels(spark, sf_dir):
    m = base_map(spark, sf_dir)
    return preprocess.balanced(m.pixels, m.bins).select("bin1_id", "bin2_id", six("v").alias("v"))


def _ice(rounds: int) -> tuple[str, dict[str, str]]:
    blocks = {k: BLOCKS[k] for k in ("width", "occ", "pixels", "chroms", "bins0")}
    blocks["cis"] = "SELECT p.bin1_id, p.bin2_id, p.count FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id WHERE x.chrom = y.chrom AND p.bin2_id - p.bin1_id >= 2"
    blocks["bias0"] = "SELECT bin_id, 1.0::DOUBLE AS b FROM bins0"
    for k in range(1, rounds + 1):
        blocks[f"w{k}"] = f"SELECT c.bin1_id, c.bin2_id, x.b * y.b * c.count AS v FROM cis c JOIN bias{k - 1} x ON x.bin_id = c.bin1_id JOIN bias{k - 1} y ON y.bin_id = c.bin2_id"
        blocks[f"m{k}"] = f"SELECT bin_id, sum(v) AS m FROM (SELECT bin1_id AS bin_id, v FROM w{k} UNION ALL SELECT bin2_id, v FROM w{k} WHERE bin1_id <> bin2_id) GROUP BY 1"
        blocks[f"bias{k}"] = f"SELECT b.bin_id, b.b / coalesce(nullif(m.m / (SELECT avg(m) FROM m{k} WHERE m <> 0), 0), 1) AS b FROM bias{k - 1} b LEFT JOIN m{k} m USING (bin_id)"
    return f"SELECT bin_id, round(b, 6) + 0.0 AS b FROM bias{rounds}", blocks


def _ice_rounds(spark, sf_dir, rounds):
    m = base_map(spark, sf_dir)
    kept = balance.usable_pixels(m.pixels, m.bins)
    bias = reduce(lambda b, _: balance.correction_round(kept, b).select("bin_id", "b"), range(rounds), base_bins(spark, sf_dir).select("bin_id", F.lit(1.0).alias("b")))
    return bias.withColumn("b", six("b"))


@query(*_ice(1))
def ice_1iter(spark, sf_dir):
    return _ice_rounds(spark, sf_dir, 1)


@query(*_ice(2))
def ice_2iter(spark, sf_dir):
    return _ice_rounds(spark, sf_dir, 2)


def _balanced_blocks(rounds: int) -> dict[str, str]:
    """All of balancing: bins with ten filled pixels and a log marginal not far below the median, rounds, final scale."""
    plain = _ice(rounds)[1]
    blocks = {k: plain[k] for k in ("width", "occ", "pixels", "chroms", "bins0", "cis")}
    both = lambda table, value: f"SELECT bin1_id AS bin_id, {value} AS v FROM {table} UNION ALL SELECT bin2_id, {value} FROM {table} WHERE bin1_id <> bin2_id"
    blocks["logs"] = f"SELECT bin_id, ln(sum(v)) AS log FROM ({both('cis', 'count')}) GROUP BY 1 HAVING count(*) >= 10 AND sum(v) > 0"
    blocks["good"] = "SELECT bin_id FROM logs WHERE log >= (SELECT median(log) FROM logs) - 5 * (SELECT median(abs(log - (SELECT median(log) FROM logs))) FROM logs)"
    blocks["usable"] = "SELECT * FROM cis WHERE bin1_id IN (SELECT bin_id FROM good) AND bin2_id IN (SELECT bin_id FROM good)"
    blocks["bias0"] = "SELECT bin_id, 1.0::DOUBLE AS b FROM good"
    for k in range(1, rounds + 1):
        blocks |= {f"w{k}": plain[f"w{k}"].replace("FROM cis c", "FROM usable c"), f"m{k}": plain[f"m{k}"], f"bias{k}": plain[f"bias{k}"]}
    blocks["scaled"] = f"SELECT c.bin1_id, c.bin2_id, x.b * y.b * c.count AS v FROM usable c JOIN bias{rounds} x ON x.bin_id = c.bin1_id JOIN bias{rounds} y ON y.bin_id = c.bin2_id"
    blocks["level"] = f"SELECT avg(m) AS a FROM (SELECT bin_id, sum(v) AS m FROM ({both('scaled', 'v')}) GROUP BY 1) WHERE m <> 0"
    return blocks


@query("SELECT z.bin_id, round(b.b / sqrt((SELECT a FROM level)), 6) + 0.0 AS weight FROM bins0 z LEFT JOIN bias3 b USING (bin_id)", _balanced_blocks(3))
def ice_weights(spark, sf_dir):
    bins = base_bins(spark, sf_dir).withColumn("weight", F.lit(None).cast("double"))
    pixels = Scratch(spark, "map").keep(contacts(spark, sf_dir), "pixels")
    return balance.ice(pixels, bins, 3, tolerance=0.0).select("bin_id", six("weight").alias("weight"))


@query("SELECT sub, d, round(y, 6) + 0.0 AS y FROM law")
def distance_law(spark, sf_dir):
    return preprocess.distance_law(preprocess.diag_trim(local(spark, sf_dir), BAND + SIZE)).withColumn("y", six("y"))


@query("SELECT sub, j - i AS d, round(median(v), 6) + 0.0 AS y FROM loc WHERE v > 0 GROUP BY 1, 2")
def distance_law_median(spark, sf_dir):
    return preprocess.distance_law(local(spark, sf_dir), fun=F.median).withColumn("y", six("y"))


_POOLED = {
    **{k: BLOCKS[k] for k in ("width", "occ", "pixels", "chroms", "bins0", "ends", "marg", "bins", "bal", "loc")},
    "curve": "SELECT sub, j - i AS d, avg(v) AS y FROM loc WHERE v > 0 GROUP BY 1, 2",
    "ordered": "SELECT *, row_number() OVER w AS k, sum(y) OVER w AS upto FROM curve WINDOW w AS (PARTITION BY sub ORDER BY d)",
    "spans": "SELECT p.sub, p.d, a.k AS first, max((b.upto - a.upto + a.y) / (b.k - a.k + 1)) AS best FROM ordered p JOIN ordered a ON a.sub = p.sub AND a.k <= p.k JOIN ordered b ON b.sub = p.sub AND b.k >= p.k GROUP BY 1, 2, 3",
}


@query("SELECT sub, d, round(min(best), 6) + 0.0 AS y FROM spans GROUP BY 1, 2", _POOLED)
def isotonic_trend(spark, sf_dir):
    return preprocess.smoothed(preprocess.distance_law(local(spark, sf_dir))).withColumn("y", six("y"))


@query("SELECT sub, i, j, round(v, 6) + 0.0 AS v FROM det")
def detrended(spark, sf_dir):
    return signal(spark, sf_dir)[0].withColumn("v", six("v"))


@query("SELECT bin1_id, bin2_id, count, CASE WHEN x.chrom_idx = y.chrom_idx THEN 0 ELSE 1 END::INTEGER AS trans FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id")
def stored_pixels(spark, sf_dir):
    """A map written by chromosome and distance, read back whole."""
    return stored_map(spark, sf_dir).pixels.select("bin1_id", "bin2_id", "count", "trans")


@query("SELECT i, j, round(v, 6) + 0.0 AS v FROM det WHERE sub = 1")
def stored_chromosome(spark, sf_dir):
    """One chromosome of a stored map: other folders and far pixels aren't read."""
    one = of_chromosomes(stored_map(spark, sf_dir), ["chr2"])
    return pipeline.prepared(one, BAND, SIZE)[0].select("i", "j", six("v").alias("v"))


@query("SELECT b.sub, b.i, b.j, round(b.v / l.y, 6) + 0.0 AS v FROM banded b JOIN law l ON l.sub = b.sub AND l.d = b.j - b.i WHERE b.v <> 0")
def detrended_uncut(spark, sf_dir):
    band = preprocess.diag_trim(local(spark, sf_dir), BAND + SIZE)
    return preprocess.detrend(band, preprocess.distance_law(band), None).withColumn("v", six("v"))


_RAW = {**BLOCKS, "bal": BLOCKS["bal"].replace("x.weight * y.weight * p.count AS v", "p.count AS v")}


@query("SELECT b.sub, b.i, b.j, round(b.v / l.y, 6) + 0.0 AS v FROM banded b JOIN law l ON l.sub = b.sub AND l.d = b.j - b.i WHERE b.v <> 0", _RAW)
def detrended_raw(spark, sf_dir):
    return pipeline.prepared(base_map(spark, sf_dir), BAND, SIZE, raw=True)[0].withColumn("v", six("v"))


_SMOOTH = {
    **BLOCKS,
    "steps": "SELECT *, row_number() OVER w AS k, sum(y) OVER w AS upto FROM law WINDOW w AS (PARTITION BY sub ORDER BY d)",
    "runs": "SELECT p.sub, p.d, a.k AS first, max((b.upto - a.upto + a.y) / (b.k - a.k + 1)) AS best FROM steps p JOIN steps a ON a.sub = p.sub AND a.k <= p.k JOIN steps b ON b.sub = p.sub AND b.k >= p.k GROUP BY 1, 2, 3",
    "fallen": "SELECT sub, d, min(best) AS y FROM runs GROUP BY 1, 2",
}


@query("SELECT b.sub, b.i, b.j, round(CASE WHEN coalesce(b.v / nullif(l.y, 0), 1e300) >= 10 THEN 1.0::DOUBLE ELSE b.v / l.y END, 6) + 0.0 AS v FROM banded b JOIN fallen l ON l.sub = b.sub AND l.d = b.j - b.i WHERE b.v <> 0", _SMOOTH)
def detrended_smooth(spark, sf_dir):
    return pipeline.prepared(base_map(spark, sf_dir), BAND, SIZE, smooth=True)[0].withColumn("v", six("v"))


@query("SELECT sub1, sub2, bin1_id, bin2_id, round(v / median(v) OVER (PARTITION BY sub1, sub2), 6) + 0.0 AS v FROM bal WHERE sub1 <> sub2")
def inter_median_scale(spark, sf_dir):
    m = base_map(spark, sf_dir)
    rows = genome.to_local(preprocess.balanced(m.pixels, m.bins), m.chroms, inter=True).where("sub1 <> sub2")
    return preprocess.inter_scale(rows).select("sub1", "sub2", "bin1_id", "bin2_id", six("v").alias("v"))


@query("SELECT l.sub, l.i, l.j, round((l.v - s.m) / s.d, 6) + 0.0 AS v FROM loc l JOIN (SELECT sub, avg(v) AS m, stddev_pop(v) AS d FROM loc GROUP BY 1) s USING (sub)")
def ztransform(spark, sf_dir):
    return preprocess.z_transform(local(spark, sf_dir)).withColumn("v", six("v"))


@query("SELECT bin1_id, bin2_id, count(*)::DOUBLE AS count FROM (SELECT bin1_id, bin2_id, unnest(range(1, count::BIGINT + 1)) AS n FROM pixels) WHERE ('0x' || substr(md5('0:' || bin1_id || ':' || bin2_id || ':' || n), 1, 8))::BIGINT < (0.25 * 4294967296)::BIGINT GROUP BY 1, 2")
def sampled_contacts_hash(spark, sf_dir):
    return preprocess.sample_by_hash(contacts(spark, sf_dir), 0.25)


@query("SELECT bin1_id, bin2_id, count(*)::DOUBLE AS count FROM (SELECT bin1_id, bin2_id FROM (SELECT bin1_id, bin2_id, unnest(range(1, count::BIGINT + 1)) AS n FROM pixels) ORDER BY ('0x' || substr(md5('0:' || bin1_id || ':' || bin2_id || ':' || n), 1, 8))::BIGINT, bin1_id, bin2_id, n LIMIT 1000) GROUP BY 1, 2")
def sampled_contacts_exact(spark, sf_dir):
    return preprocess.subsample(base_map(spark, sf_dir).pixels, 1000)


@query("SELECT bin1_id, bin2_id, count(*)::DOUBLE AS count FROM (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY ('0x' || substr(md5('0:' || bin1_id || ':' || bin2_id || ':' || n), 1, 8))::BIGINT, bin1_id, bin2_id, n) AS place, count(*) OVER (PARTITION BY s1, s2) AS total FROM (SELECT p.bin1_id, p.bin2_id, x.chrom_idx AS s1, y.chrom_idx AS s2, unnest(range(1, p.count::BIGINT + 1)) AS n FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id)) WHERE place <= floor(total * 0.3::DOUBLE) GROUP BY 1, 2")
def sampled_share(spark, sf_dir):
    m = base_map(spark, sf_dir)
    return preprocess.subsample_share(m.pixels, m.chroms, 0.3)


@query("SELECT c.chrom_idx AS sub1, d.chrom_idx AS sub2, floor(sum(p.count) * 0.3::DOUBLE)::DOUBLE AS total, true AS bounded FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id JOIN chroms c ON c.chrom_idx = x.chrom_idx JOIN chroms d ON d.chrom_idx = y.chrom_idx GROUP BY 1, 2")
def sampled_tree(spark, sf_dir):
    """What is fixed of a random draw: its sum in each sub-matrix, and that no pixel gives more than it has."""
    m = base_map(spark, sf_dir)
    drawn = sampling.draw_share(m.pixels, m.chroms, 0.3).withColumnRenamed("count", "drawn")
    rows = genome.to_local(m.pixels.join(drawn, ["bin1_id", "bin2_id"], "left"), m.chroms, inter=True)
    return rows.groupBy("sub1", "sub2").agg(F.sum("drawn").alias("total"), F.bool_and(F.coalesce(F.col("drawn") <= F.col("count"), F.lit(True))).alias("bounded"))


@query("SELECT count(*) AS nnz, sum(count) AS total, max(bin2_id - bin1_id) AS widest, max(count) AS largest FROM pixels")
def map_reductions(spark, sf_dir):
    return contacts(spark, sf_dir).agg(F.count(F.lit(1)).alias("nnz"), F.sum("count").alias("total"), F.max(F.col("bin2_id") - F.col("bin1_id")).alias("widest"), F.max("count").alias("largest"))


# -- correlation ---------------------------------------------------------------------------------------------------
#: Windows that lie whole inside the matrix.
_WHOLE = f"i >= {SIZE // 2} AND j >= {SIZE // 2} AND i < n - {SIZE // 2} AND j < n - {SIZE // 2}"


@query("SELECT sub, i, j, round(vk, 6) + 0.0 AS x FROM sums WHERE abs(vk) >= 0.0001")
def xcorr_raw(spark, sf_dir):
    """Every window with a stored value, as are the two below: those that hang over a border too."""
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.xcorr2(det, kernel_frame(spark, [KERNEL]), sizes, SIZE, BAND, whole=False)
    return rows.select("sub", "i", "j", six("x").alias("x"))


@query("SELECT sub, i, j, round(v1, 6) + 0.0 AS v1, round(v2, 6) + 0.0 AS v2 FROM sums")
def xcorr_box(spark, sf_dir):
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.centred_windows(correlate.scatter_sums(det, kernel_frame(spark, [KERNEL]), BAND), sizes)
    return rows.select("sub", "i", "j", six("v1").alias("v1"), six("v2").alias("v2"))


@query("SELECT sub, i, j, round(vk, 6) + 0.0 AS vk, round(v1, 6) + 0.0 AS v1, round(v2, 6) + 0.0 AS v2 FROM sums")
def xcorr_box_separable(spark, sf_dir):
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.centred_windows(correlate.factored_sums(det, [factorise(KERNEL, 1 - 1e-13)], BAND), sizes)
    return rows.select("sub", "i", "j", six("vk").alias("vk"), six("v1").alias("v1"), six("v2").alias("v2"))


def _sliding(spark, sf_dir, size: int) -> DataFrame:
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.box_sums(det, sizes, size, BAND)
    return rows.select("sub", "i", "j", six("v1").alias("v1"), six("v2").alias("v2"))


@query("SELECT sub, i, j, round(v1, 6) + 0.0 AS v1, round(v2, 6) + 0.0 AS v2 FROM sums")
def xcorr_box_sliding(spark, sf_dir):
    """Windows may hang over the borders here: the masked correlation's sums."""
    return _sliding(spark, sf_dir, SIZE)


_WIDE = 31


@query("SELECT sub, i, j, round(v1, 6) + 0.0 AS v1, round(v2, 6) + 0.0 AS v2 FROM sums", {**BLOCKS, "kern": f"SELECT a.range - {_WIDE // 2} AS di, b.range - {_WIDE // 2} AS dj, 1.0::DOUBLE AS w FROM range({_WIDE}) a CROSS JOIN range({_WIDE}) b"})
def xcorr_box_wide(spark, sf_dir):
    return _sliding(spark, sf_dir, _WIDE)


_STRIPE = stripe(SIZE, True)
_RANK1 = pieces(_STRIPE)


@query(f"SELECT sub, i, j, round(vk, 6) + 0.0 AS x FROM sums WHERE abs(vk) >= 0.0001 AND {_WHOLE}", _RANK1)
def xcorr_tsvd_rank1(spark, sf_dir):
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.xcorr2_factored(det, *factorise(_STRIPE), sizes, BAND)
    return rows.select("sub", "i", "j", six("x").alias("x"))


@query("SELECT sub, i, j, m0, round(mk, 6) + 0.0 AS mk, round(mkk, 6) + 0.0 AS mkk FROM masked")
def mask_sums(spark, sf_dir):
    det, sizes, gone = signal(spark, sf_dir)
    kernel = kernel_frame(spark, [KERNEL])
    outputs = correlate.scatter_sums(det, kernel, BAND).join(F.broadcast(sizes), "sub").where("i < n AND j < n").drop("n")
    rows = correlate.mask_sums(outputs, kernel, sizes, gone, BAND, SIZE)
    return rows.select("sub", "i", "j", "m0", six("mk").alias("mk"), six("mkk").alias("mkk"))


_PLAIN = {**BLOCKS, "terms": BLOCKS["terms"] + f" WHERE {_WHOLE}", "masked": "SELECT 0 AS sub, 0::BIGINT AS i, 0::BIGINT AS j, 0 AS m0, 0.0::DOUBLE AS mk, 0.0::DOUBLE AS mkk WHERE false"}


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr", _PLAIN)
def normxcorr_unmasked(spark, sf_dir):
    det, sizes, _ = signal(spark, sf_dir)
    rows = correlate.normxcorr2(det, kernel_frame(spark, [KERNEL]), BAND, SIZE, sizes)
    return rows.select("sub", "i", "j", six("r").alias("r"), "n_obs")


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr")
def normxcorr_masked(spark, sf_dir):
    return correlation(spark, sf_dir).select("sub", "i", "j", six("r").alias("r"), "n_obs")


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr")
def normxcorr_tiled(spark, sf_dir):
    det, sizes, gone = signal(spark, sf_dir)
    rows = correlate.normxcorr2(det, kernel_frame(spark, [KERNEL]), BAND, SIZE, sizes, gone, MOST_MISSING / 100, plan="tile")
    return rows.select("sub", "i", "j", six("r").alias("r"), "n_obs")


_FACTORS = [factorise(KERNEL, 0.999)]
_TRUNCATED = pieces(np.matmul(*_FACTORS[0]))


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr", _TRUNCATED)
def normxcorr_tsvd(spark, sf_dir):
    det, sizes, gone = signal(spark, sf_dir)
    kernel = kernel_frame(spark, [np.matmul(*_FACTORS[0])])
    rows = correlate.normxcorr2(det, kernel, BAND, SIZE, sizes, gone, MOST_MISSING / 100, factors=_FACTORS)
    return rows.select("sub", "i", "j", six("r").alias("r"), "n_obs")


@query(f"SELECT sub, i, j, round({log10p('r', 'n_obs')}, 5) + 0.0 AS log10_p FROM corr")
def corr_pvalues(spark, sf_dir):
    return correlation(spark, sf_dir).select("sub", "i", "j", (F.round("log10_p", 5) + 0.0).alias("log10_p"))


def _inter_blocks() -> dict[str, str]:
    blocks = dict(BLOCKS)
    blocks["det"] = "SELECT sub1 * 4 + sub2 AS sub, i, j, v / median(v) OVER (PARTITION BY sub1, sub2) AS v FROM bal WHERE sub1 <> sub2"
    blocks["sums"] = "SELECT sub, i - di AS i, j - dj AS j, a.n AS n, b.n AS m, sum(v * w) AS vk, sum(v) AS v1, sum(v * v) AS v2 FROM det e JOIN chroms a ON a.chrom_idx = e.sub // 4 JOIN chroms b ON b.chrom_idx = e.sub % 4 CROSS JOIN kern WHERE i - di >= 0 AND j - dj >= 0 AND i - di < a.n AND j - dj < b.n GROUP BY 1, 2, 3, 4, 5"
    blocks["cells"] = "SELECT s.sub, s.i, s.j, s.n, s.m, k.w, s.i + k.di AS x, s.j + k.dj AS y, a.bin IS NOT NULL AS mx, b.bin IS NOT NULL AS my FROM sums s CROSS JOIN kern k LEFT JOIN lost a ON a.sub = s.sub // 4 AND a.bin = s.i + k.di LEFT JOIN lost b ON b.sub = s.sub % 4 AND b.bin = s.j + k.dj"
    blocks["masked"] = "SELECT sub, i, j, count(*) AS m0, sum(w) AS mk, sum(w * w) AS mkk FROM cells WHERE x < 0 OR y < 0 OR x >= n OR y >= m OR mx OR my GROUP BY 1, 2, 3"
    return blocks


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr", _inter_blocks())
def normxcorr_inter(spark, sf_dir):
    across, sizes, rows, columns = pipeline.prepared_inter(base_map(spark, sf_dir))
    got = correlate.normxcorr2_inter(across, kernel_frame(spark, [KERNEL]), sizes, rows, columns, SIZE, MOST_MISSING / 100)
    return got.select(F.col("sub").cast("int").alias("sub"), "i", "j", six_compiled("r").alias("r"), "n_obs")


@query("SELECT sub, i, j, round(r, 6) + 0.0 AS r, n_obs FROM corr", _inter_blocks())
def normxcorr_inter_tiled(spark, sf_dir):
    across, sizes, rows, columns = pipeline.prepared_inter(base_map(spark, sf_dir))
    got = correlate.normxcorr2_inter(across, kernel_frame(spark, [KERNEL]), sizes, rows, columns, SIZE, MOST_MISSING / 100, plan="tile")
    return got.select(F.col("sub").cast("int").alias("sub"), "i", "j", six_compiled("r").alias("r"), "n_obs")


_ACROSS = ("det", "sums", "cells", "masked", "terms", "moments", "dens", "corr", "cand", "reach", "labels", "foci", "best", "wcells", "wstats", "checked")


def _detect_inter_blocks() -> dict[str, str]:
    """The blocks within chromosomes, those between under other names, and the patterns of both."""
    inter, out = _inter_blocks(), {}
    lower = f" OR (p.j + g.b) - (p.i + g.a) BETWEEN -{SIZE} AND -1"
    inter["det"] = f"SELECT d.* FROM ({inter['det']}) d JOIN chroms a ON a.chrom_idx = d.sub // 4 JOIN chroms b ON b.chrom_idx = d.sub % 4 WHERE a.n > {SIZE} AND b.n > {SIZE}"
    wcells = inter["wcells"].replace(lower, "").replace("x.sub = p.sub AND", "x.sub = p.sub // 4 AND").replace("y.sub = p.sub AND", "y.sub = p.sub % 4 AND")
    sides = "JOIN chroms c ON c.chrom_idx = p.sub // 4 JOIN chroms d2 ON d2.chrom_idx = p.sub % 4"
    inter["wcells"] = wcells.replace(f"p.j + g.b - {SIZE // 2} >= c.n", f"p.j + g.b - {SIZE // 2} >= d2.n").replace("JOIN chroms c ON c.chrom_idx = p.sub", sides)
    inter["checked"] = inter["checked"].replace("p.j < c.n - 1", "p.j < d2.n - 1").replace("JOIN chroms c ON c.chrom_idx = p.sub", sides)
    renamed = lambda text: re.sub(rf"\b({'|'.join(_ACROSS)})\b(?!\.)", r"across_\1", text)
    for name, text in DETECT_BLOCKS.items():
        out[name] = text
        if name in _ACROSS:
            out[f"across_{name}"] = renamed(inter[name])
    p = f"coalesce(pow(10.0::DOUBLE, {log10p('r', 'n_obs')}), 1.0::DOUBLE)"
    across = f"SELECT c.start_bin + i, d.start_bin + j, r, {p} FROM across_checked JOIN chroms c ON c.chrom_idx = sub // 4 JOIN chroms d ON d.chrom_idx = sub % 4 WHERE valid"
    out["found"] = f"{out['found']} UNION ALL {across}"
    return out


@query(f"SELECT chrom1, start1, end1, chrom2, start2, end2, bin1, bin2, 0::INTEGER AS kernel_id, 0::INTEGER AS iteration, round(score, 6) + 0.0 AS score, round(pvalue, 6) + 0.0 AS pvalue, round({_BH}, 6) + 0.0 AS qvalue FROM ({_LAST} FROM placed)", _detect_inter_blocks())
def detect_inter(spark, sf_dir):
    patterns, _ = pipeline.detect(base_map(spark, sf_dir), CONFIG, inter=True)
    return patterns.withColumns({c: six(c) for c in ("score", "pvalue", "qvalue")})


# -- plain matrix operations ---------------------------------------------------------------------------------------
@query("SELECT sub, i + 3 AS i, j + 5 AS j, round(v, 6) + 0.0 AS v FROM loc")
def zero_pad(spark, sf_dir):
    return matrix.zero_pad(local(spark, sf_dir), 3, 5).withColumn("v", six("v"))


@query("SELECT sub, i, j, round(v, 6) + 0.0 AS v FROM loc WHERE j - i <> 2 UNION ALL SELECT sub, k, k + 2, 7.5::DOUBLE FROM (SELECT chrom_idx AS sub, unnest(range(n - 2)) AS k FROM chroms)")
def set_diagonal(spark, sf_dir):
    chroms = chrom_offsets(base_bins(spark, sf_dir))
    sizes = chroms.select(F.col("chrom_idx").alias("sub"), (F.col("end_bin") - F.col("start_bin")).alias("n"))
    return matrix.set_diagonal(local(spark, sf_dir), sizes, 2, 7.5).withColumn("v", six("v"))


@query("SELECT bin1_id, bin2_id, round(v, 6) + 0.0 AS v FROM bal")
def gathered(spark, sf_dir):
    m = base_map(spark, sf_dir)
    rows = genome.to_local(preprocess.balanced(m.pixels, m.bins), m.chroms, inter=True)
    return matrix.gather(rows.select("sub1", "sub2", "i", "j", "v"), m.chroms).withColumn("v", six("v"))


@query("SELECT sub, i, j, round(v, 6) + 0.0 AS v FROM loc UNION ALL SELECT sub, j, i, round(v, 6) + 0.0 FROM loc WHERE i <> j")
def symmetric_map(spark, sf_dir):
    return matrix.symmetric(local(spark, sf_dir)).withColumn("v", six("v"))


@query("SELECT bin1_id, bin2_id, round(ln(count), 6) + 0.0 AS count FROM pixels WHERE bin1_id > 20 AND bin1_id < 60 AND bin2_id > 20 AND bin2_id < 60")
def region_view(spark, sf_dir):
    return matrix.inside_region(contacts(spark, sf_dir), 20, 60, "count", log=True).withColumn("count", six("count"))


_TIME = {"slot": "SELECT user_id AS u, (epoch_us(ts) // 1000000 // 3600 % 200)::BIGINT AS b, count(*) AS c FROM events GROUP BY 1, 2"}


@query("SELECT x.b AS bin1_id, y.b AS bin2_id, sum(CASE WHEN x.b = y.b THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END)::DOUBLE AS count FROM slot x JOIN slot y ON x.u = y.u AND x.b <= y.b GROUP BY 1, 2 HAVING sum(CASE WHEN x.b = y.b THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END) > 0", _TIME)
def time_map(spark, sf_dir):
    slot = F.expr("unix_micros(cast(ts as timestamp)) div 1000000 div 3600 % 200")
    return cooccurrence(table(spark, sf_dir, "events").select("user_id", slot.alias("b")), "user_id", "b")


_CLICKS = {"clicks": "SELECT user_id AS session, event_id AS n, event_id // 3 % 4 AS x, event_id // 2 % 3 AS y FROM events"}


@query("SELECT DISTINCT session, x, y FROM (SELECT *, lag(x) OVER (PARTITION BY session ORDER BY n) AS px, lag(y) OVER (PARTITION BY session ORDER BY n) AS py FROM clicks) WHERE px = x AND py = y", _CLICKS)
def confirmed_clicks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), F.expr("event_id div 3 % 4").alias("x"), F.expr("event_id div 2 % 3").alias("y"))
    return genome.confirmed(clicks)


# -- foci and windows ----------------------------------------------------------------------------------------------
@query("SELECT sub, i, j, i AS i2, j + 1 AS j2 FROM cand c WHERE EXISTS (SELECT 1 FROM cand d WHERE d.sub = c.sub AND d.i = c.i AND d.j = c.j + 1) UNION ALL SELECT sub, i, j, i + 1, j FROM cand c WHERE EXISTS (SELECT 1 FROM cand d WHERE d.sub = c.sub AND d.i = c.i + 1 AND d.j = c.j)")
def adjacency_edges(spark, sf_dir):
    return foci.adjacency(candidates(spark, sf_dir)).select("sub", "i", "j", "i2", "j2")


@query("SELECT sub, i, j, label FROM labels")
def foci_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("sub", "i", "j", "label")


@query("SELECT sub, label, i, j, size FROM foci")
def foci_filtered(spark, sf_dir):
    return foci.sized(labelled(spark, sf_dir)).select("sub", "label", "i", "j", "size")


@query("SELECT sub, label, i, j, round(r, 6) + 0.0 AS r FROM best")
def foci_argmax(spark, sf_dir):
    return picked(spark, sf_dir).select("sub", "label", "i", "j", six("r").alias("r"))


@query("SELECT sub, label, j AS i, j FROM best")
def diag_snap(spark, sf_dir):
    return foci.snap_to_diagonal(picked(spark, sf_dir), 0).select("sub", "label", "i", "j")


@query("SELECT sub, label, a, b, round(v, 6) + 0.0 AS v FROM wcells")
def window_cells(spark, sf_dir):
    return window_parts(spark, sf_dir)[1].select("sub", "pid.label", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), six("v").alias("v"))


@query("SELECT sub, label, round(undetected, 6) AS undetected, round(zero, 6) AS zero, valid FROM checked")
def window_validity(spark, sf_dir):
    return window_parts(spark, sf_dir)[2].select("sub", "label", six("undetected").alias("undetected"), six("zero").alias("zero"), "valid")


def _pile(spark, sf_dir):
    _, cells, checked = window_parts(spark, sf_dir)
    return windows.pileup(cells.join(checked.where("valid").select("pid"), "pid", "left_semi")).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "mean")


@query("SELECT a, b, round(mean, 6) + 0.0 AS mean FROM pile")
def pileup(spark, sf_dir):
    return _pile(spark, sf_dir).withColumn("mean", six("mean"))


@query("SELECT p.a, p.b, round(CASE WHEN p.a = p.b THEN coalesce(p.mean, 0) ELSE coalesce(p.mean, 0) + coalesce(q.mean, 0) END, 6) + 0.0 AS mean FROM pile p JOIN pile q ON q.a = p.b AND q.b = p.a")
def pileup_sym(spark, sf_dir):
    return windows.symmetric(_pile(spark, sf_dir)).withColumn("mean", six("mean"))


@query("SELECT sub, label, round(avg(v) FILTER (WHERE a BETWEEN 2 AND 4 AND b BETWEEN 2 AND 4) - avg(v) FILTER (WHERE a < 2 AND b >= 5), 6) + 0.0 AS score FROM wcells GROUP BY 1, 2")
def corner_scores(spark, sf_dir):
    return windows.corner_score(window_parts(spark, sf_dir)[1], SIZE).select("pid.sub", "pid.label", six("score").alias("score"))


@query("SELECT r.sub, r.label, r.k, round((r.z + c.z) / 2, 6) + 0.0 AS band FROM (SELECT sub, label, a AS k, sum(v - m) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY sub, label) AS m FROM wcells) GROUP BY 1, 2, 3) r JOIN (SELECT sub, label, b AS k, sum(v - m) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY sub, label) AS m FROM wcells) GROUP BY 1, 2, 3) c USING (sub, label, k)")
def footprint_bands(spark, sf_dir):
    return windows.bands(window_parts(spark, sf_dir)[1]).select("pid.sub", "pid.label", F.col("k").cast("long").alias("k"), six("band").alias("band"))


@query("SELECT a, b, floor((rank() OVER (ORDER BY mean) - 1) * 10 / count(*) OVER ())::INTEGER AS level, substr(' .:-=+*#%@', floor((rank() OVER (ORDER BY mean) - 1) * 10 / count(*) OVER ())::INTEGER + 1, 1) AS glyph FROM (SELECT a, b, round(mean, 6) + 0.0 AS mean FROM pile)")
def ascii_glyphs(spark, sf_dir):
    return rank_glyphs(pileup(spark, sf_dir), "mean").select("a", "b", "level", "glyph")


# -- patterns ------------------------------------------------------------------------------------------------------
_POINTS = {"width": BLOCKS["width"], "found": "SELECT (l_partkey // (SELECT w FROM width))::BIGINT AS bin1, l_suppkey::BIGINT AS bin2, round(sum(l_extendedprice)) AS score FROM lineitem GROUP BY 1, 2", **ALONE}


def _points(spark, sf_dir):
    width = layout(spark, sf_dir)[0]
    return table(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_partkey div {width}").alias("bin1"), F.col("l_suppkey").cast("long").alias("bin2")).agg(F.round(F.sum("l_extendedprice")).alias("score"))


@query("SELECT bin1, bin2, score FROM alone", _POINTS)
def nms_greedy(spark, sf_dir):
    return nms.remove_neighbours(_points(spark, sf_dir), 5)


@query("SELECT * FROM placed WHERE false OR true", {**BLOCKS, "placed": BLOCKS["placed"].replace("p.score, p.pvalue", "round(p.score, 6) + 0.0 AS score")})
def min_dist_filter(spark, sf_dir):
    found, _, checked = window_parts(spark, sf_dir)
    rows = genome.to_global(checked.where("valid").withColumnRenamed("r", "score").select("sub", "i", "j", "score"), chrom_offsets(base_bins(spark, sf_dir)))
    kept = nms.remove_neighbours(rows.select("bin1", "bin2", "score"), 5)
    out = nms.farther_than(genome.bins_to_coords(kept, base_bins(spark, sf_dir)), 2000)
    return out.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "bin1", "bin2", six("score").alias("score"))


_P = {"ps": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN round(1.0 / (1.0 + o_totalprice / 1000.0), 4) END AS p FROM orders"}


@query("SELECT k, p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / last) OVER (PARTITION BY p IS NULL ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) END, 6) AS q FROM (SELECT *, count(p) OVER () AS m, rank() OVER (PARTITION BY p IS NULL ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS last FROM ps)", _P)
def fdr_bh(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 11 != 0, F.round(F.lit(1.0) / (F.lit(1.0) + F.col("o_totalprice") / F.lit(1000.0)), 4))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), p.alias("p"))
    return benjamini_hochberg(rows, "p", "q").withColumn("q", six("q"))


@query("SELECT bin1, bin2, kernel_id, score FROM (SELECT *, row_number() OVER (PARTITION BY bin1, bin2 ORDER BY score DESC NULLS LAST, kernel_id) AS p FROM (SELECT o_custkey % 40 AS bin1, o_orderkey % 50 AS bin2, (o_orderkey % 3)::INTEGER AS kernel_id, max(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) AS score FROM orders GROUP BY 1, 2, 3)) WHERE p = 1")
def best_kernel(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("bin1"), (F.col("o_orderkey") % 50).alias("bin2"), (F.col("o_orderkey") % 3).cast("int").alias("kernel_id")).agg(F.max(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).alias("score"))
    return nms.best_kernel(rows, ["bin1", "bin2"])


@query("SELECT floor(r * 20)::BIGINT AS bucket, count(*) AS n FROM (SELECT round(r, 6) AS r FROM corr) GROUP BY 1")
def score_histogram(spark, sf_dir):
    return correlation(spark, sf_dir).groupBy(F.floor(F.round("r", 6) * 20).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (SELECT p.bin1_id AS bin1, p.bin2_id AS bin2, p.count, x.chrom AS chrom1, x.start AS start1, x.\"end\" AS end1, y.chrom AS chrom2, y.start AS start2, y.\"end\" AS end2 FROM pixels p JOIN bins0 x ON x.bin_id = p.bin1_id JOIN bins0 y ON y.bin_id = p.bin2_id) WHERE chrom1 = 'chr2' AND chrom2 = 'chr2' AND start1 >= 10000 AND start2 >= 10000 AND end1 < 30000 AND end2 < 30000")
def region_subset(spark, sf_dir):
    return genome.region(bins_to_coords(spark, sf_dir), "chr2", 10000, 30000)


@query("SELECT sub, i, j, place FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY r DESC, i, j) AS place FROM corr) WHERE place <= 5")
def topn_windows(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("sub").orderBy(F.desc("r"), "i", "j")).cast("long")
    return correlation(spark, sf_dir).withColumn("place", place).where("place <= 5").select("sub", "i", "j", "place")


@query(f"SELECT chrom1, start1, end1, chrom2, start2, end2, bin1, bin2, 0::INTEGER AS kernel_id, 0::INTEGER AS iteration, round(score, 6) + 0.0 AS score, round(pvalue, 6) + 0.0 AS pvalue, round({_BH}, 6) + 0.0 AS qvalue FROM ({_LAST} FROM placed)", DETECT_BLOCKS)
def detect_full(spark, sf_dir):
    patterns, _ = pipeline.detect(base_map(spark, sf_dir), CONFIG)
    return patterns.withColumns({c: six(c) for c in ("score", "pvalue", "qvalue")})


@query("SELECT p.bin1, p.bin2, w.a, w.b, round(w.v, 6) + 0.0 AS v FROM placed p JOIN (SELECT k.sub, k.label, c.start_bin + k.i AS bin1, c.start_bin + k.j AS bin2 FROM checked k JOIN chroms c ON c.chrom_idx = k.sub WHERE k.valid) b USING (bin1, bin2) JOIN wcells w ON w.sub = b.sub AND w.label = b.label", DETECT_BLOCKS)
def detect_windows(spark, sf_dir):
    patterns, _ = pipeline.detect(base_map(spark, sf_dir), CONFIG, with_windows=True)
    rows = patterns.select("bin1", "bin2", F.posexplode("window").alias("a", "row"))
    cells = rows.select("bin1", "bin2", F.col("a").cast("long").alias("a"), F.posexplode("row").alias("b", "v"))
    return cells.withColumn("b", F.col("b").cast("long")).withColumn("v", six("v"))


#: Blocks that depend on the kernel: each kernel and iteration has its own.
_OWN = ("kern", "sums", "cells", "masked", "terms", "moments", "dens", "corr", "cand", "reach", "labels", "foci", "best", "wcells", "wstats", "checked", "pile")
_KERNELS = [KERNEL, blocks(SIZE)]


def _kernels_blocks(turns: int) -> dict[str, str]:
    """Blocks of ``_KERNELS`` over several iterations; from the second on, a kernel is the mean window of the one before."""
    owned = lambda text, own: re.sub(rf"\b({'|'.join(_OWN)})\b(?!\.)", rf"\1_{own}", text)
    out = {k: v for k, v in DETECT_BLOCKS.items() if k not in _OWN and k not in ALONE and k not in ("found", "placed")}
    found = []
    for turn in range(turns):
        for k, kernel in enumerate(_KERNELS):
            own = pieces(kernel, learned=turn > 0)
            if turn:
                own["kern"] = f"SELECT a - {SIZE // 2} AS di, b - {SIZE // 2} AS dj, coalesce(mean, 0.0::DOUBLE) AS w FROM pile_{k}{turn - 1}"
            for name in _OWN:
                out[f"{name}_{k}{turn}"] = own[name] if name == "kern" else owned(own[name], f"{k}{turn}")
            found.append(owned(own["found"], f"{k}{turn}").replace("SELECT", f"SELECT {k}::INTEGER AS kernel_id, {turn}::INTEGER AS iteration,", 1))
    out["found"] = " UNION ALL ".join(found)
    out |= ALONE
    out["ranked"] = "SELECT *, row_number() OVER (ORDER BY score DESC, bin1, bin2, kernel_id, iteration) AS place FROM found"
    out["placed"] = BLOCKS["placed"].replace("p.score, p.pvalue", "p.kernel_id, p.iteration, p.score, p.pvalue")
    return out


@query(f"SELECT chrom1, start1, end1, chrom2, start2, end2, bin1, bin2, kernel_id, iteration, round(score, 6) + 0.0 AS score, round(pvalue, 6) + 0.0 AS pvalue, round({_BH}, 6) + 0.0 AS qvalue FROM ({_LAST} FROM placed)", _kernels_blocks(2))
def detect_kernels(spark, sf_dir):
    """Two kernels, two iterations."""
    patterns, _ = pipeline.detect(base_map(spark, sf_dir), replace(CONFIG, kernels=_KERNELS, max_iterations=2))
    return patterns.withColumns({c: six(c) for c in ("score", "pvalue", "qvalue")})


_QUANTIFY = {
    **{k: v for k, v in BLOCKS.items() if k not in ("cand", "reach", "labels", "foci")},
    "best": "SELECT DISTINCT sub, i * 1000 + j - i AS label, i, j FROM (SELECT c.chrom_idx AS sub, c.n, o_orderkey * 7 % c.n AS i, o_orderkey * 7 % c.n + o_orderkey % 20 AS j FROM orders JOIN chroms c ON c.chrom_idx = o_custkey % 4) WHERE j < n",
    "scored": f"SELECT k.sub, k.i, k.j, CASE WHEN k.valid THEN coalesce(c.r, 0.0::DOUBLE) END AS score, CASE WHEN k.valid THEN coalesce(pow(10.0::DOUBLE, {log10p('c.r', 'c.n_obs')}), 1.0::DOUBLE) END AS pvalue FROM checked k LEFT JOIN corr c ON c.sub = k.sub AND c.i = k.i AND c.j = k.j",
    "tested": f"SELECT *, {_BH} AS qvalue FROM ({_LAST} FROM (SELECT * FROM scored WHERE pvalue IS NOT NULL))",
}


def _quantify_kernels_blocks() -> dict[str, str]:
    """Each kernel's own correlation; windows and their validity don't depend on the kernel."""
    own = ("kern", "sums", "cells", "masked", "terms", "moments", "dens", "corr")
    out = {k: v for k, v in _QUANTIFY.items() if k not in own}
    for k, kernel in enumerate(_KERNELS):
        of_kernel = pieces(kernel)
        for name in own:
            out[f"{name}_{k}"] = of_kernel[name] if name == "kern" else re.sub(rf"\b({'|'.join(own)})\b(?!\.)", rf"\1_{k}", of_kernel[name])
    each = " UNION ALL ".join(f"SELECT {k} AS kernel_id, k.sub, k.i, k.j, CASE WHEN k.valid THEN coalesce(c.r, 0.0::DOUBLE) END AS score, CASE WHEN k.valid THEN coalesce(pow(10.0::DOUBLE, {log10p('c.r', 'c.n_obs')}), 1.0::DOUBLE) END AS pvalue FROM checked k LEFT JOIN corr_{k} c ON c.sub = k.sub AND c.i = k.i AND c.j = k.j" for k in range(len(_KERNELS)))
    out["scored"] = f"SELECT sub, i, j, score, pvalue FROM (SELECT *, row_number() OVER (PARTITION BY sub, i, j ORDER BY score DESC NULLS LAST, kernel_id) AS first FROM ({each})) WHERE first = 1"
    order = [*[k for k in out if k not in ("scored", "tested")], "scored", "tested"]
    return {k: out[k] for k in order}


_SCORED = f"SELECT 'chr' || (s.sub + 1) AS chrom1, s.i * {BIN_SIZE} AS start1, (s.i + 1) * {BIN_SIZE} AS end1, 'chr' || (s.sub + 1) AS chrom2, s.j * {BIN_SIZE} AS start2, (s.j + 1) * {BIN_SIZE} AS end2, c.start_bin + s.i AS bin1, c.start_bin + s.j AS bin2, round(s.score, 6) + 0.0 AS score, round(s.pvalue, 6) + 0.0 AS pvalue, round(t.qvalue, 6) + 0.0 AS qvalue FROM scored s JOIN chroms c ON c.chrom_idx = s.sub LEFT JOIN tested t USING (sub, i, j)"


@query(_SCORED, _quantify_kernels_blocks())
def quantify_kernels(spark, sf_dir):
    """Two kernels: each position has the score of the better one."""
    return _quantified(spark, sf_dir, replace(CONFIG, pearson=0.0, kernels=_KERNELS))


@query(f"SELECT 'chr' || (s.sub + 1) AS chrom1, s.i * {BIN_SIZE} AS start1, (s.i + 1) * {BIN_SIZE} AS end1, 'chr' || (s.sub + 1) AS chrom2, s.j * {BIN_SIZE} AS start2, (s.j + 1) * {BIN_SIZE} AS end2, c.start_bin + s.i AS bin1, c.start_bin + s.j AS bin2, round(s.score, 6) + 0.0 AS score, round(s.pvalue, 6) + 0.0 AS pvalue, round(t.qvalue, 6) + 0.0 AS qvalue FROM scored s JOIN chroms c ON c.chrom_idx = s.sub LEFT JOIN tested t USING (sub, i, j)", _QUANTIFY)
def quantify_full(spark, sf_dir):
    return _quantified(spark, sf_dir, replace(CONFIG, pearson=0.0))


def _quantified(spark, sf_dir, config):
    m = base_map(spark, sf_dir)
    side = m.chroms.select("chrom", F.col("chrom_idx").alias("sub"), (F.col("end_bin") - F.col("start_bin")).alias("n"))
    k = F.col("o_orderkey")
    at = table(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 4).alias("sub")).join(F.broadcast(side), "sub")
    at = at.select("chrom", (k * 7 % F.col("n")).alias("i"), (k % 20).alias("d"), "n").where("i + d < n")
    a, b = F.col("i") * BIN_SIZE, (F.col("i") + F.col("d")) * BIN_SIZE
    positions = at.select(F.col("chrom").alias("chrom1"), a.alias("start1"), (a + BIN_SIZE).alias("end1"), F.col("chrom").alias("chrom2"), b.alias("start2"), (b + BIN_SIZE).alias("end2"))
    rows = pipeline.quantify(m, config, positions)
    return rows.drop("window").withColumns({x: six(x) for x in ("score", "pvalue", "qvalue")})
