"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text is unlabelled, labels of bad documents are not used. The
features of a text are the shares of its trigrams of character classes (letters, capitals, digits, blanks, line ends,
other signs), and shares and lengths of its words and lines; never its language, source or id. The class prior is
estimated from the positives and the unlabelled rows; the non-negative risk is minimised in numpy on a bounded sample.

Defined results: null and empty texts are scored by their features (all zero); without labels or positives every
score is 1, so that a filter keeps everything; repeated rows get equal scores; an empty table gives no rows; other
columns are not read, and stay as they are when a filter drops rows, whatever their names.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pu
from gridloom.llm.common import Workspace, packed, unpacked

THRESHOLD = 0.7
CLASSES = 6
_LETTER, _CAPITAL, _DIGIT, _BLANK, _LINE, _SIGN = range(CLASSES)


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte > 127 or c.islower():
        return _LETTER
    if c.isupper():
        return _CAPITAL
    if c.isdigit():
        return _DIGIT
    return _LINE if c == "\n" else _BLANK if c.isspace() else _SIGN


_CLASS_OF = np.array([_class_of(b) for b in range(256)], np.uint8)
#: Bytes whose trigrams are counted at once.
CHUNK = 1 << 20
N_FEATURES = CLASSES**3 + 8
#: Scaled features are cut here: one odd text can't outweigh the rest.
MOST = 8.0


def trigrams(data: bytes) -> np.ndarray:
    """Shares of the trigrams of character classes."""
    counts = np.zeros(CLASSES**3, np.int64)
    for at in range(0, len(data) - 2, CHUNK):
        c = _CLASS_OF[np.frombuffer(data[at : at + CHUNK + 2], np.uint8)]
        counts += np.bincount(c[:-2] * np.uint8(CLASSES**2) + c[1:-1] * np.uint8(CLASSES) + c[2:], minlength=CLASSES**3)
    return counts / max(1, len(data) - 2)


def describe(text: str) -> np.ndarray:
    """Square roots of shares, so that rare features count too."""
    data, words = text.encode("utf-8", "surrogatepass"), text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(N_FEATURES)
    lines = text.split("\n")
    more = [
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(w) == 1 for w in words) / n,
        np.log1p(n) / 10,
        len(text) / n / 10,
        max(map(len, words)) ** 0.5 / 10,
        len(zlib.compress(data, 1)) / len(data),
    ]
    return np.sqrt(np.concatenate([trigrams(data), more]))


def fit(docs: DataFrame, labels: DataFrame, work: Workspace) -> tuple[np.ndarray, np.ndarray, pu.Linear] | None:
    """Mean and spread of the features, and the model; None without positives."""
    rows, _ = pu.sample(docs, labels, "quality", work)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "positive": frame["positive"], "unlabelled": frame["unlabelled"], "x": [describe(t).astype(np.float32) for t in frame["text"]]})

    # As many rows as the sample's bounds.
    got = rows.mapInPandas(each, "doc_id long, positive int, unlabelled int, x array<float>").orderBy("doc_id").toPandas()
    if not len(got) or not got["positive"].any() or not got["unlabelled"].any():
        return None
    x = np.array(got["x"].tolist(), np.float64)
    positive, unlabelled = x[got["positive"].to_numpy() == 1], x[got["unlabelled"].to_numpy() == 1]
    mean, spread = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3)
    scaled = lambda y: np.clip((y - mean) / spread, -MOST, MOST)
    positive, unlabelled = scaled(positive), scaled(unlabelled)
    prior = pu.estimate_prior(positive, unlabelled, l2=1e-3, steps=600)
    model = pu.train(positive, unlabelled, prior, l2=1e-2)
    return mean, spread, model


def scorer(fitted: tuple[np.ndarray, np.ndarray, pu.Linear] | None) -> Callable[[list[str]], np.ndarray]:
    def score(texts: list[str]) -> np.ndarray:
        if fitted is None or not texts:
            return np.ones(len(texts))
        mean, spread, model = fitted
        x = np.clip((np.array([describe(t) for t in texts]) - mean) / spread, -MOST, MOST)
        return np.round(pu.sigmoid((x * model.weights).sum(axis=1) + model.bias), 9)

    return score


def score_quality(docs: DataFrame, labels: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return pu.scored(docs, scorer(fit(docs, labels, work)), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they are."""
    score = scorer(fit(docs, labels, work))

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series(score(text.fillna("").tolist()), dtype="float64")

    return unpacked(packed(docs).where(of(F.col("row.text").cast("string")) >= threshold))
