"""Toxicity by non-negative positive-unlabelled learning.

Features are boundary-marked pieces of words: the whole word, its runs of five characters and its beginnings. The
``PIECES`` pieces (a parameter of the model) whose share in confirmed toxic documents lies most standard errors above
that in unlabelled ones are its vocabulary; a linear model over which of them a text has, in one distinct word or in
several, is trained in numpy. The vocabulary and the weights come from a bounded sample of rows (``pu``); every text
is scored as a whole, in one pass, with a bounded memory of words seen.

Defined results: null and empty texts get the score of a text without toxic pieces; without labels or positives every
score is 0; repeated rows get equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pu
from gridloom.llm.common import Workspace

THRESHOLD = 0.3
PIECES = 512
RUN = 5
BEGINNINGS = range(4, 10)
#: A piece is chosen if its share in positives lies so many standard errors above its share in unlabelled rows.
LEAST_Z = 6.0
#: Pieces in fewer positives say nothing.
LEAST_ROWS = 5
#: A piece in so many distinct words of a text counts once more: ordinary words have rare pieces by chance, one at a time.
SEVERAL = 2
CACHED_WORDS = 1 << 18

_WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def pieces(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked, *(marked[i : i + RUN] for i in range(len(marked) - RUN + 1)), *(marked[:n] for n in BEGINNINGS if n < len(marked))}


def choose(rows: DataFrame, n_positive: int, n_unlabelled: int, most: int = PIECES) -> list[str]:
    """The pieces with the largest excess in positive rows; counts are combined on the executors."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inside, outside = Counter(), Counter()
            for text, positive, unlabelled in zip(frame["text"], frame["positive"], frame["unlabelled"], strict=True):
                found = {p for w in words(text) for p in pieces(w)}
                if positive:
                    inside.update(found)
                if unlabelled:
                    outside.update(found)
            keys = list(inside)  # a piece without positives can't be chosen, but others may have its positives
            keys += [k for k in outside if k not in inside]
            yield pd.DataFrame({"piece": keys, "p": [inside[k] for k in keys], "u": [outside[k] for k in keys]})

    counted = rows.select("text", "positive", "unlabelled").mapInPandas(count, "piece string, p long, u long")
    p, u = F.col("p") / n_positive, (F.col("u") + 1) / (n_unlabelled + 1)
    z = (p - u) / F.sqrt(u / n_positive)
    best = counted.groupBy("piece").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST_ROWS).withColumn("z", z).where(F.col("z") >= LEAST_Z)
    return [r["piece"] for r in best.orderBy(F.desc("z"), "piece").limit(most).select("piece").collect()]


def features(chosen: list[str]) -> list[tuple[int, str]]:
    return [(level, p) for level in (1, SEVERAL) for p in chosen]


def levels(counts: Counter[str]) -> Iterator[tuple[int, str]]:
    """The features of a text whose distinct words have the pieces so often."""
    for p, n in counts.items():
        yield 1, p
        if n >= SEVERAL:
            yield SEVERAL, p


def vectors(rows: DataFrame, chosen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the sample, positives and unlabelled: as many rows as the sample's bounds, two columns a piece."""
    place = {key: i for i, key in enumerate(features(chosen))}
    chosen_set = set(chosen)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [sorted(place[level, p] for level, p in levels(Counter(p for w in words(text) for p in pieces(w) if p in chosen_set))) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "positive": frame["positive"], "unlabelled": frame["unlabelled"], "at": out})

    got = rows.mapInPandas(each, "doc_id long, positive int, unlabelled int, at array<int>").orderBy("doc_id").toPandas()
    x = np.zeros((len(got), len(place)), np.float64)
    for i, at in enumerate(got["at"]):
        x[i, np.asarray(at, np.int64)] = 1
    return x[got["positive"].to_numpy() == 1], x[got["unlabelled"].to_numpy() == 1]


def fit(docs: DataFrame, labels: DataFrame, work: Workspace) -> tuple[dict[tuple[int, str], float], float]:
    """Weights of features and the bias."""
    rows, prior = pu.sample(docs, labels, "toxic", work)
    sizes = rows.agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u")).first()
    if not prior or not sizes["p"] or not sizes["u"]:
        return {}, -40.0
    prior = min(max(prior, 0.001), 0.999)
    chosen = choose(rows, sizes["p"], sizes["u"])
    if not chosen:
        return {}, float(np.log(prior / (1 - prior)))
    x, u = vectors(rows, chosen)
    model = pu.train(x, u, prior, l2=1e-4, thinned=True)
    return dict(zip(features(chosen), model.weights.tolist(), strict=True)), model.bias


def scorer(weights: dict[tuple[int, str], float], bias: float) -> Callable[[list[str]], np.ndarray]:
    chosen = {p for _, p in weights}
    known: dict[str, tuple[str, ...]] = {}
    nothing: tuple[str, ...] = ()

    def score(texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            met: Counter[str] = Counter()
            for w in words(text):
                found = known.get(w)
                if found is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    found = known[w] = tuple(pieces(w) & chosen) or nothing
                if found:
                    met.update(found)
            out[i] = bias + sum(weights[f] for f in sorted(levels(met)))  # in one order, so that equal texts give equal sums
        return np.round(pu.sigmoid(out), 9)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return pu.scored(docs, scorer(*fit(docs, labels, work)), threshold)
