"""Learning from positive and unlabelled rows with the non-negative risk estimator.

With class prior p, the risk of a score g is ``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])``: the second term is
what the unlabelled rows say about negatives, corrected for the positives among them, and never below zero. Where a
batch makes it negative, the step goes the other way, so that the model doesn't fit the labelled positives by heart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, held_out, map_batches, texts_of

#: Bounds of the training sample: rows with the smallest hashed identifiers. Rows beyond them only make it sharper.
MOST_POSITIVE = 3000
MOST_UNLABELLED = 9000


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 1500, rate: float = 0.05, batch: int = 1024, seed: int = 7, thinned: bool = False) -> Linear:
    """Logistic loss, linear score, Adam over seeded batches. ``thinned``: rows lose a random share of their features,
    as short texts do, so that one feature alone gets its weight too."""
    n = positive.shape[1]
    theta = np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    one, two = np.zeros(n + 1), np.zeros(n + 1)
    rng = np.random.default_rng(seed)
    with_bias = lambda x: np.hstack([x, np.ones((len(x), 1))])
    xp, xu = with_bias(positive), with_bias(unlabelled)
    for t in range(1, steps + 1):
        p = xp[rng.integers(0, len(xp), min(batch, len(xp)))]
        u = xu[rng.integers(0, len(xu), min(batch, len(xu)))]
        if thinned:
            p, u = (x * np.hstack([rng.random((len(x), n)) < rng.uniform(0.1, 1, (len(x), 1)), np.ones((len(x), 1))]) for x in (p, u))
        gp, gu = p @ theta, u @ theta
        # l(z) = log(1 + exp(-z)); its derivative is -sigmoid(-z).
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        if negative >= 0:
            gradient = d_negative - prior * (p.T @ sigmoid(-gp)) / len(p)
        else:
            gradient = -d_negative
        gradient[:n] += l2 * theta[:n]
        one = 0.9 * one + 0.1 * gradient
        two = 0.999 * two + 0.001 * gradient**2
        step = rate * (1 if t <= steps // 2 else 2 * (1 - t / (steps + 1)))
        theta -= step * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    return Linear(theta[:n], float(theta[n]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, **training) -> float:
    """The share of positives among unlabelled rows, from features of positives and unlabelled rows alone.

    A first model tells positives from unlabelled rows on one half of both. On the other half, the share of unlabelled
    rows over a cut by the share of positives over it bounds the prior from above; the cut with the least upper
    confidence bound gives the estimate.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    first = train(positive[::2], unlabelled[::2], 0.5, **training)
    p, u = np.sort(first.logits(positive[1::2])), np.sort(first.logits(unlabelled[1::2]))
    over = lambda x: 1 - np.searchsorted(x, p, "left") / len(x)
    spread = sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (p, u))
    at = np.argmin((over(u) + spread) / over(p))
    return float(min(max((over(u) / over(p))[at], 0.001), 0.999))


def sample(docs: DataFrame, labels: DataFrame, label: str, work: Workspace, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[DataFrame, float | None]:
    """Training rows (doc_id, text, positive, unlabelled), written, and the class prior: the share of positives among all labels that may be learned from.

    Labels of held-out rows are never read. An identifier labelled twice counts as positive if either label is; of an
    identifier with several texts, the smallest text is taken. The prior is None without labels.
    """
    marks = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    prior = marks.agg(F.avg("y").alias("p")).first()["p"]
    first = lambda df, n: df.orderBy(F.xxhash64(F.lit(label), F.col("doc_id")), "doc_id").limit(n).select("doc_id")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = known.where("doc_id IS NOT NULL").where(~held_out())
    positive = first(marks.where("y = 1").select(F.col("doc_id").cast("long").alias("doc_id")), most_positive).withColumn("positive", F.lit(1)).withColumn("unlabelled", F.lit(0))
    unlabelled = first(ids, most_unlabelled).withColumn("positive", F.lit(0)).withColumn("unlabelled", F.lit(1))
    # At most most_positive + most_unlabelled short rows: a proven bound for the broadcast.
    chosen = positive.unionByName(unlabelled).groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("positive").alias("positive"), F.first("unlabelled").alias("unlabelled"))
    return work.keep(found, f"{label}-sample"), prior


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ``score`` maps a list of texts to scores."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = map_batches(rows, ["doc_id", "held_out"], "score double", lambda batch: [score(texts_of(batch))])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
