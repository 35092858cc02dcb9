"""Connected components of a graph given by its links, as distributed contraction.

Each round every node points to the neighbour (or itself) with the smallest hashed priority and the graph shrinks to
the nodes pointed to; hashed priorities, new in each round, make the number of rounds logarithmic for any shape
(sorted chains and stars included). Links only ever live in tables below the shared folder; no round brings them to
the driver. Minima are combined before the shuffle, so a hub with a third of all links costs each task one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace


def connected_components(links: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """links (u long, v long; u <> v) to (node, label): nodes of one component share a label. Nodes without links are absent."""
    edges = work.keep(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    labels: DataFrame | None = None
    for turn in range(most_rounds):
        if edges.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))
        both = edges.select(F.col("u").alias("node"), order("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), order("u").alias("near")))
        step = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least(order("node"), F.col("near"))["x"].alias("to"))
        step = work.keep(step, f"step{turn}")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = work.keep(labels, f"labels{turn}")
        head = step.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        tail = step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        shrunk = edges.join(head, "u").join(tail, "v").where("u2 <> v2")
        edges = work.keep(shrunk.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), f"links{turn}")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
