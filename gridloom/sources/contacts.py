"""Contact maps as DataFrames: reading, building from co-occurrence, and the handle that operators share."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.scratch import Scratch

CHROMS = "chrom string, chrom_idx int, length bigint, start_bin bigint, end_bin bigint"
BINS = "bin_id bigint, chrom string, start bigint, end bigint, weight double"
PIXELS = "bin1_id bigint, bin2_id bigint, count double"
BED2D = "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint"


@dataclass(frozen=True)
class ContactMap:
    """chroms, bins and upper-triangle pixels; lazy until an operator runs."""

    chroms: DataFrame
    bins: DataFrame
    pixels: DataFrame
    bin_size: int


def chrom_offsets(bins: DataFrame) -> DataFrame:
    """Chromosomes with half-open ranges of bins. The window runs over chromosomes, not bins."""
    per = bins.groupBy("chrom").agg(F.min("bin_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("end").alias("length"))
    order = Window.orderBy("first")
    end = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return per.select(
        "chrom", (F.row_number().over(order) - 1).alias("chrom_idx"), "length", (end - F.col("n")).alias("start_bin"), end.alias("end_bin")
    )


def chrom_table(bins: DataFrame) -> DataFrame:
    """``chrom_offsets`` as a written table: a row a chromosome that every operator reads, made by one pass over the bins."""
    return Scratch(bins.sparkSession, "chroms").keep(chrom_offsets(bins), "chroms")


def upper(pixels: DataFrame) -> DataFrame:
    """Pixels with bin1_id <= bin2_id, both orders summed."""
    return (
        pixels.select(F.least("bin1_id", "bin2_id").alias("bin1_id"), F.greatest("bin1_id", "bin2_id").alias("bin2_id"), F.col("count").cast("double").alias("count"))
        .groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))
    )


#: A stored map lies in so many parts by chromosome of the first anchor, each split in pixels of one chromosome and of two.
PARTS = 1024
#: Pixels of a run of first anchors that one task writes, on average; bins of a run at most; bins of a step of distance that files are sorted by, and bytes of a
#: row group, the least that a search by distance reads.
WRITTEN, RUN, STEP, ROW_GROUP = 1 << 20, 1 << 16, 64, 4 << 20
#: What a stored map knows of its pixels besides: part and kind (its folders), chromosomes of the anchors, distance in bins.
LAYOUT = ["part", "trans", "of1", "of2", "apart"]


def folded(pixels: DataFrame) -> DataFrame:
    """A map with both triangles has each pixel twice; one with pixels in either order is folded."""
    lower = pixels.where("bin1_id > bin2_id")
    if lower.isEmpty():
        return pixels
    turned = lower.select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    above = pixels.where("bin1_id <= bin2_id").select("bin1_id", "bin2_id", "count")
    return above.unionByName(turned.join(above.select("bin1_id", "bin2_id"), ["bin1_id", "bin2_id"], "left_anti"))


def read_map(spark: SparkSession, folder: str) -> ContactMap:
    """``bins`` and ``pixels`` Parquet below a folder; bins of a chromosome must have one size, the last may be shorter.

    Pixels that ``write_map`` laid out keep the columns LAYOUT, by which ``near`` and ``of_chromosomes`` prune; others are
    looked through for pixels below the diagonal.
    """
    bins, pixels = spark.read.parquet(f"{folder}/bins"), spark.read.parquet(f"{folder}/pixels")
    if "weight" not in bins.columns:
        bins = bins.withColumn("weight", F.lit(None).cast("double"))
    size = bins.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    last = F.max("end").over(Window.partitionBy("chrom"))
    if not bins.withColumn("last", last).where((F.col("end") - F.col("start") != size) & (F.col("end") != F.col("last"))).isEmpty():
        raise ValueError("bins of different sizes")
    return ContactMap(chrom_table(bins), bins, pixels if laid_out(pixels) else folded(pixels), int(size))


def laid_out(pixels: DataFrame) -> bool:
    return set(LAYOUT) <= set(pixels.columns)


def near(pixels: DataFrame, most: int) -> DataFrame:
    """Pixels whose bins are at most ``most`` apart; of a laid-out map only files of one chromosome's pixels are read, and
    of those only row groups that hold such distances. All pixels of one chromosome within that distance are among them."""
    if laid_out(pixels):
        return pixels.where((F.col("trans") == 0) & (F.col("apart") <= most))
    return pixels.where(F.col("bin2_id") - F.col("bin1_id") <= most)


def of_chromosomes(cmap: ContactMap, names: list[str]) -> ContactMap:
    """The map of some chromosomes, bins numbered as before. Of a laid-out map only their parts are read."""
    chroms = cmap.chroms.where(F.col("chrom").isin(names))
    known = chroms.select("chrom", "chrom_idx", "start_bin", "end_bin").collect()  # as many as names
    if lost := sorted(set(names) - {r["chrom"] for r in known}):
        raise ValueError(f"no chromosomes {lost}")
    if laid_out(cmap.pixels):
        ids = [r["chrom_idx"] for r in known]
        inside = F.col("part").isin(sorted({i % PARTS for i in ids})) & F.col("of1").isin(ids) & F.col("of2").isin(ids)
    else:
        side = lambda c: reduce(or_, [F.col(c).between(r["start_bin"], r["end_bin"] - 1) for r in known])
        inside = side("bin1_id") & side("bin2_id")
    return replace(cmap, chroms=chroms, bins=cmap.bins.where(F.col("chrom").isin(names)), pixels=cmap.pixels.where(inside))


def read_dump(spark: SparkSession, bins_path: str, pixels_path: str) -> ContactMap:
    """A map from two tab-separated tables, as dumping an HDF5 map gives them: bins (chrom, start, end and perhaps weight,
    in order) and pixels (bin1_id, bin2_id, count), with or without header lines. Bins are numbered in the order of lines."""
    lines = spark.read.text(bins_path).rdd.map(lambda r: r[0].split("\t"))
    # The number of a line is its bin: a dimension table, numbered partition by partition.
    numbered = lines.filter(lambda f: len(f) > 2 and f[1].lstrip("-").isdigit()).zipWithIndex()
    rows = numbered.map(lambda x: (x[1], x[0][0], int(x[0][1]), int(x[0][2]), float(x[0][3]) if len(x[0]) > 3 and x[0][3] not in ("", "nan", "NaN") else None))
    bins = spark.createDataFrame(rows, BINS)
    raw = spark.read.csv(pixels_path, sep="\t").select(*[F.expr(f"try_cast(_c{k} AS {kind})").alias(c) for k, (c, kind) in enumerate((("bin1_id", "bigint"), ("bin2_id", "bigint"), ("count", "double")))])
    size = bins.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    return ContactMap(chrom_table(bins), bins, raw.where("bin1_id IS NOT NULL AND bin2_id IS NOT NULL"), int(size))


def write_map(cmap: ContactMap, folder: str) -> None:
    """Bins (with weights) and pixels as Parquet; a source is never changed in place.

    Pixels lie in folders by part (a chromosome, or several of a genome of more than PARTS) and by whether both anchors are
    of one chromosome, in files by runs of first anchors, so a long chromosome has many; files are in order of distance.
    Runs are as long as the number of pixels allows, so a task writes about WRITTEN of them in a map of any size.
    """
    from gridloom.operators.genome import to_local

    cmap.bins.write.parquet(f"{folder}/bins")
    rows = to_local(folded(cmap.pixels.select("bin1_id", "bin2_id", F.col("count").cast("double").alias("count"))), cmap.chroms, inter=True)
    trans = (F.col("sub1") != F.col("sub2")).cast("int")
    rows = rows.select("bin1_id", "bin2_id", "count", F.col("sub1").alias("of1"), F.col("sub2").alias("of2"), (F.col("bin2_id") - F.col("bin1_id")).alias("apart"), (F.col("sub1") % PARTS).alias("part"), trans.alias("trans"))
    tasks = max(1, -(-cmap.pixels.count() // WRITTEN))
    run = max(1, min(RUN, (cmap.bins.agg(F.max("bin_id")).first()[0] or 0) // tasks))
    dealt = rows.repartition(tasks, "part", "trans", F.floor(F.col("bin1_id") / run)).sortWithinPartitions("part", "trans", F.floor(F.col("apart") / STEP), "bin1_id")
    dealt.write.option("parquet.block.size", ROW_GROUP).partitionBy("part", "trans").parquet(f"{folder}/pixels")


def write_weights(cmap: ContactMap, folder: str) -> None:
    """The bins of a map folder with new weights; the old ones are replaced once the new ones are complete."""
    spark = cmap.bins.sparkSession
    cmap.bins.write.mode("overwrite").parquet(f"{folder}/bins_new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.rename(path(f"{folder}/bins"), path(f"{folder}/bins_old"))
    fs.rename(path(f"{folder}/bins_new"), path(f"{folder}/bins"))
    fs.delete(path(f"{folder}/bins_old"), True)


#: Rows of a task that makes pairs, and pixels of a task that adds them up.
KEYED, PAIRED = 250_000, 1 << 20


def cooccurrence(rows: DataFrame, key: str, bin_id: str) -> DataFrame:
    """Upper-triangle pixels: pairs of rows with one key, by their bins.

    Rows are counted by (key, bin) first, so a key gives at most a pixel for each pair of its bins, however many rows
    it has. They are dealt out by key once, which serves the count and both sides of the join, and to as many tasks as
    their number asks for: a task holds the pairs of about KEYED rows. Pairs are added up by as many tasks as there can be
    pixels for, PAIRED each: if these are more than the session's, pairs are dealt out by pixel as they are, else added up
    before their shuffle as well.
    """
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // KEYED))
    known = rows.select(F.col(key).alias("k"), F.col(bin_id).alias("b")).where("k IS NOT NULL AND b IS NOT NULL")
    counts = known.repartition(n, "k").groupBy("k", "b").agg(F.count(F.lit(1)).alias("c"))
    one, two = counts.toDF("k", "bin1_id", "c1"), counts.toDF("k", "bin2_id", "c2")
    met = F.when(F.col("bin1_id") == F.col("bin2_id"), F.expr("c1 * (c1 - 1) div 2")).otherwise(F.col("c1") * F.col("c2"))
    pairs = one.join(two, "k").where("bin1_id <= bin2_id")
    tasks = -(-_most_pixels(counts) // PAIRED)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        pairs = pairs.select("bin1_id", "bin2_id", met.alias("met")).where("met > 0").repartition(max(n, tasks), "bin1_id", "bin2_id")
        met = F.col("met")
    return pairs.groupBy("bin1_id", "bin2_id").agg(F.sum(met).cast("double").alias("count")).where("count > 0")


def _most_pixels(counts: DataFrame) -> int:
    """Pixels at most of rows (k, b): pairs of bins of one key, or cells of the triangle of all bins if these are fewer."""
    own = counts.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("b").alias("low"), F.max("b").alias("high"))
    found = own.agg(F.sum(F.expr("n * (n + 1) / 2")).alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if found["pairs"] is None:
        return 0
    width = found["high"] - found["low"] + 1
    return min(int(found["pairs"]), width * (width + 1) // 2)


def read_bedgraph2(spark: SparkSession, path: str, bins: DataFrame) -> DataFrame:
    """Seven columns (two intervals and a count) to pixels, by the bins that hold their starts; contacts outside the bins go."""
    raw = spark.read.csv(path, sep="\t", schema=f"{BED2D}, count double")
    size = bins.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    for k in (1, 2):
        raw = raw.withColumn(f"start{k}", (F.floor(F.col(f"start{k}") / size) * size).cast("long"))
    keys = lambda k: bins.select(F.col("chrom").alias(f"chrom{k}"), F.col("start").alias(f"start{k}"), F.col("bin_id").alias(f"bin{k}_id"))
    return upper(raw.join(keys(1), ["chrom1", "start1"]).join(keys(2), ["chrom2", "start2"]))


def swap_anchors(positions: DataFrame) -> DataFrame:
    """On one chromosome the anchor with the smaller start comes first; starts and ends swap together."""
    swap = (F.col("chrom1") == F.col("chrom2")) & (F.col("start2") < F.col("start1"))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    fixed = {"start1": pick("start1", "start2"), "end1": pick("end1", "end2"), "start2": pick("start2", "start1"), "end2": pick("end2", "end1")}
    return positions.withColumns(fixed)


def read_bed2d(spark: SparkSession, path: str) -> DataFrame:
    """First six columns of a tab-separated file, with or without a header line."""
    lines = spark.read.text(path)
    head = lines.first()
    has_header = head is not None and not (f := head[0].split("\t"))[1:2] == [] and not f[1].strip().lstrip("-").isdigit()
    raw = spark.read.csv(path, sep="\t", header=has_header).toDF(*[f"c{i}" for i in range(len(head[0].split("\t")) if head else 6)])
    names = [x.split() for x in BED2D.split(", ")]
    return swap_anchors(raw.select(*[F.expr(f"try_cast(c{i} as {kind})").alias(name) for i, (name, kind) in enumerate(names)]))


def self_pairs(bed: DataFrame) -> DataFrame:
    """Intervals paired with themselves: positions on the diagonal."""
    return bed.select(*[F.col(c).alias(f"{c}{k}") for k in (1, 2) for c in ("chrom", "start", "end")])


def chrom_name(bin_id: Column, per_chrom: int) -> Column:
    return F.concat(F.lit("chr"), (F.floor(bin_id / per_chrom) + 1).cast("string"))
