"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words. Each source gets a share of the budget by weight, never more than ``most`` times its size; what a
full source can't take goes to the others by weight. The limit of that resharing has a closed form: with sources in
order of ``cap / weight``, those before the first whose level fits are full, the rest get ``level * weight``. A source's
repetition rate is target / size; each document is emitted floor(rate) times, plus once more if a hash of the seed and
its identifier, as a number in [0, 1), is below the fraction: one draw a document, with the fraction as its probability.
The draws need no shuffle of documents. The words taken scatter about the target with a standard deviation of
``sqrt(f * (1 - f) * sum(size^2))``, so a source whose words lie in a few long documents may miss it by one of those.

Defined results: null text has size 0; a null source is a source of its own and sorts last; sources of size 0 have
target 0; rows that repeat an identifier share its draw (null identifiers draw as the empty text); an empty table gives no rows;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, Workspace, packed, text_or_empty, unpacked

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
SEED = 42


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def draw(identifier: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the identifier and the seed only: 52 bits of an MD5 digest, as any engine has it."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes (source, size) to one row a source: source, source_size, target. Windows run over sources, not documents."""
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    weighed = total.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = (shared - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    # Of sources with equal cap / w, the first has the level with none of them full.
    fits = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("at"), (-F.col("level")).alias("less")))).over(everything)
    return levelled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(-fits["less"] * F.col("w"), F.col("cap"))).alias("target"))


def copies(rate: Column, identifier: Column, seed: int = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(identifier, seed) < rate - whole, 1).otherwise(0)).cast("long")


def source_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes (source, size) to one row a source: source, source_size, target, rate."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return source_targets(sizes, weights, budget, most).withColumn("rate", rate)


def mix_plan(docs: DataFrame, work: Workspace, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies."""
    sizes = work.keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size")), "sizes")
    plan = work.keep(source_plan(sizes, weights, budget, most), "plan").withColumnRenamed("source", "of_source")
    planned = sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    return planned.select("doc_id", "source", "size", "source_size", "target", copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def mix(docs: DataFrame, work: Workspace, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with its columns as they are."""
    rows = packed(docs)
    sizes = rows.select(F.col("row.source").cast("string").alias("source"), n_words("row.text").alias("size"))
    plan = work.keep(source_plan(sizes, weights, budget, most), "plan").select(F.col("source").alias("of_source"), "rate")
    rated = rows.join(plan, F.col("row.source").cast("string").eqNullSafe(F.col("of_source")))
    times = copies(F.col("rate"), F.col("row.doc_id"), seed).cast("int")
    return unpacked(rated.select("row", F.explode(F.array_repeat(F.lit(1), times))))
