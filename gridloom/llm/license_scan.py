"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Segments of a text are its lines, its runs of neighbouring lines that hold license terms, and windows of each template's
number of terms, inside lines and over line breaks, so a header is found wherever it stands in the text. Terms are weighed by their document frequency over the whole corpus; terms outside the
templates weigh as much as a term of no document and only lengthen a segment. A segment's license is the template with
the largest cosine of at least ``threshold``; a text's license is that of its best segment. Segments are looked at only
if they hold one of the heaviest terms of a template without which no cosine can reach the threshold, which drops no
match.

A text whose best segment has at least half of its terms is a license file and speaks for its directory; so is a text
that as a whole has a cosine of at least ``WHOLE`` (logarithmic term counts) to one of the whole license texts. Files without
a license of their own take that of the nearest directory above them (their own first) that has one.

Defined results: null and empty texts have no license; ties between templates go to the first, between segments to the
earlier, between license files of a directory to the larger cosine and then the smaller identifier; a null path
inherits nothing and speaks for nothing; repeated rows stay rows; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, hot_keys, map_batches, spread_join, texts_of
from gridloom.llm.license_texts import WHOLE_TEXTS

THRESHOLD = 0.6
WHOLE = 0.8

#: License identifiers and the wording of headers and opening clauses.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
]

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Templates as unit vectors under given document frequencies."""

    def __init__(self, n_docs: int, frequency: dict[str, int], threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None):
        self.threshold = threshold
        self.templates = TEMPLATES if templates is None else templates
        self.weight = {t: math.log((1 + n_docs) / (1 + frequency.get(t, 0))) + 1 for _, text in self.templates for t in terms(text)}
        self.rare = math.log(1 + n_docs) + 1
        self.vectors: list[dict[str, float]] = []
        self.heavy: list[frozenset[str]] = []
        self.lengths = [len(terms(text)) for _, text in self.templates]
        for _, text in self.templates:
            v = {t: n * self.weight[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {t: x / norm for t, x in v.items()}
            self.vectors.append(v)
            # By Cauchy and Schwarz, a segment without the heaviest terms has at most the norm of the rest as cosine.
            rest, needed = 1.0, set()
            for t, x in sorted(v.items(), key=lambda y: (-y[1], y[0])):
                if math.sqrt(max(rest, 0.0)) < threshold:
                    break
                needed.add(t)
                rest -= x * x
            self.heavy.append(frozenset(needed))
        self.needed = frozenset().union(*self.heavy)
        self.idf = {t: math.log((1 + n_docs) / (1 + frequency.get(t, 0))) + 1 for _, text in WHOLE_TEXTS for t in terms(text)}
        self.wholes = [self._logarithmic(terms(text)) for _, text in WHOLE_TEXTS]

    def _logarithmic(self, every: list[str]) -> dict[str, float]:
        """Unit vector of a whole text."""
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.rare) for t, n in Counter(every).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def whole(self, text: str) -> tuple[str | None, float]:
        """The license whose whole text this is, and the cosine."""
        every = terms(text)
        if self.needed.isdisjoint(every):
            return None, 0.0
        own = self._logarithmic(every)
        best, which = max((sum(x * own[t] for t, x in v.items() if t in own), -k) for k, v in enumerate(self.wholes))
        return (WHOLE_TEXTS[-which][0], round(best, 6)) if best >= WHOLE else (None, 0.0)

    def window(self, every: list[str], above: float) -> tuple[float, int]:
        """The largest cosine over ``above`` of a window of a template's length around its heaviest terms, and the template."""
        best, which = above, -1
        for k, v in enumerate(self.vectors):
            length = min(self.lengths[k], len(every))
            starts = {a for i in self._places(every, k) for a in range(max(0, i - length + 1), min(i, len(every) - length) + 1)}
            last, counts, dot, square = -2, Counter(), 0.0, 0.0
            for a in sorted(starts):
                if a != last + 1:  # else the window moves on by one term
                    counts = Counter(every[a : a + length])
                    own = {t: n * self.weight.get(t, self.rare) for t, n in counts.items()}
                    dot, square = sum(v.get(t, 0.0) * x for t, x in own.items()), sum(x * x for x in own.values())
                else:
                    for t, step in ((every[a - 1], -1), (every[a + length - 1], 1)):
                        w, n = self.weight.get(t, self.rare), counts[t]
                        dot, square = dot + step * w * v.get(t, 0.0), square + w * w * ((n + step) ** 2 - n * n)
                        counts[t] = n + step
                last = a
                if dot / math.sqrt(square) > best + 1e-9:
                    best, which = dot / math.sqrt(square), k
        return best, which

    def _places(self, every: list[str], k: int) -> list[int]:
        heavy = self.heavy[k]
        return [i for i, t in enumerate(every) if t in heavy]

    def find(self, text: str) -> tuple[str | None, float, bool]:
        """As ``scan``, with headers inside lines and over line breaks; a whole license text is a license file."""
        license, cosine = self.whole(text)
        if license:
            return license, cosine, True
        license, cosine, speaks = self.scan(text)
        every = terms(text)
        if cosine > 1 - 1e-6 or self.needed.isdisjoint(every):
            return license, cosine, speaks
        best, which = self.window(every, max(cosine, self.threshold - 2e-9))
        if which < 0:
            return license, cosine, speaks
        return self.templates[which][0], round(best, 6), speaks or 2 * self.lengths[which] >= len(every)

    def score(self, segment: list[str]) -> tuple[float, int]:
        """The largest cosine and its template."""
        counts = Counter(segment)
        own = {t: n * self.weight.get(t, self.rare) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in own.values()))
        best, which = 0.0, -1
        for k, v in enumerate(self.vectors):
            c = sum(x * own[t] for t, x in v.items() if t in own) / norm
            if c > best + 1e-12:
                best, which = c, k
        return best, which

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """License, cosine, and whether the text is a license file."""
        every = terms(text)
        if self.needed.isdisjoint(every):
            return None, 0.0, False
        lines = [None if self.needed.isdisjoint(t) else t for t in map(terms, text.split("\n"))]
        segments, run = [], []
        for line in [*lines, None]:
            if line:
                segments.append(line)
                run.append(line)
            else:
                if len(run) > 1:
                    segments.append([t for x in run for t in x])
                run = []
        best, which, size = 0.0, -1, 0
        for s in segments:
            c, k = self.score(s)
            if c >= self.threshold and c > best + 1e-12:
                best, which, size = c, k, len(s)
        if which < 0:
            return None, 0.0, False
        return self.templates[which][0], round(best, 6), 2 * size >= len(every)


def frequencies(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each term of the templates: as many rows as the templates and whole texts have terms."""
    vocabulary = {t for _, text in [*(TEMPLATES if templates is None else templates), *WHOLE_TEXTS] for t in terms(text)}

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for frame in frames:
            for text in frame["text"]:
                counts.update(vocabulary.intersection(terms(text)))
            counts[""] += len(frame)
        if counts:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInPandas(each, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in found}
    return counts.pop("", 0), counts


def own_licenses(files: DataFrame, matcher: Matcher) -> DataFrame:
    """files (doc_id, path, text) to doc_id, path, own_license, cosine, is_license_file."""

    def scanned(batch) -> list:
        return list(zip(*[matcher.find(t or "") for t in texts_of(batch)], strict=True)) or [[]] * 3

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, ["doc_id", "path"], "own_license string, cosine double, is_license_file boolean", scanned)


def directory(path: Column) -> Column:
    """All before the last slash; the root is the empty text."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(own: DataFrame) -> DataFrame:
    """Adds license, origin (own, inherited, none) and license_doc_id. Paths are joined once for each directory.

    A directory above many others (the root is above all) and one with many files are dealt out: no task meets them whole.
    """
    placed = own.withColumn("dir", directory(F.col("path")))
    rank = F.struct(-F.col("cosine"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("own_license"))
    speaking = placed.where("is_license_file AND dir IS NOT NULL").groupBy("dir").agg(F.min_by(F.struct("own_license", "doc_id"), rank).alias("says"))
    total = own.count()
    dirs = placed.where("dir IS NOT NULL").groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("dir", "/")
    above = F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))), F.when(F.col("dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).otherwise(F.array())))
    chain = dirs.select("dir", above.alias("a")).select("dir", "a.depth", "a.above")
    high = hot_keys(chain.groupBy("above").agg(F.count(F.lit(1)).alias("n")), "above", "n", total)
    nearest = spread_join(chain, speaking.withColumnRenamed("dir", "above"), "above", high, F.col("dir")).groupBy("dir").agg(F.max_by("says", "depth").alias("says"))
    nearest = dirs.select("dir").join(nearest, "dir", "left")
    full = hot_keys(dirs, "dir", "n", total)
    joined = spread_join(placed.where("dir IS NOT NULL"), nearest, "dir", full, F.struct("path", "doc_id"))
    nowhere = placed.where("dir IS NULL").join(nearest, "dir", "left")
    joined = joined.unionByName(nowhere)
    return joined.select(
        "doc_id", "path", "own_license", "cosine", "is_license_file",
        F.coalesce("own_license", "says.own_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(F.col("says").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own_license").isNotNull(), F.col("doc_id")).otherwise(F.col("says.doc_id")).alias("license_doc_id"),
    )


def scan_licenses(files: DataFrame, work: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """files (doc_id, path, text) to one row a file with its license and where it comes from."""
    return inherit(work.keep(own_licenses(files, Matcher(*frequencies(files), threshold)), "own"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: source/lang/thousands of the id/id."""
    folder = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat_ws("/", folder("source"), folder("lang"), F.expr("cast(doc_id div 1000 as string)"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", path.alias("path"), "text")
