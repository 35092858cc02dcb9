"""Connected components of links of any number, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.scratch import Scratch


def component_of(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a, b) of any one type to (node, head): nodes of one component share a head, one of them.

    Each round a node joins that of its neighbours, or itself, that comes first in an order drawn anew by hashing; joined
    nodes become one and links inside it go. A share of the nodes goes each round whatever the shape, so rounds grow with the
    logarithm of the nodes.
    """
    left = scratch.keep(links.where("a <> b").distinct(), "links")
    heads = scratch.keep(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select("node", F.col("node").alias("head")), "heads")
    turn = 0
    while not left.isEmpty():
        turn += 1
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("node"), drawn("b").alias("x")).union(left.select(F.col("b").alias("node"), drawn("a").alias("x")))
        joins = ends.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least(drawn("node"), F.col("x"))["to"].alias("to"))
        joins = scratch.keep(joins, "joins")
        heads = scratch.keep(heads.join(joins.withColumnRenamed("node", "head"), "head", "left").select("node", F.coalesce("to", "head").alias("head")), "heads")
        for c in ("a", "b"):
            left = left.join(joins.select(F.col("node").alias(c), F.col("to").alias(f"new_{c}")), c)
        left = scratch.keep(left.select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).where("a <> b").distinct(), "links")
    return heads
