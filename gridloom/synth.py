"""A synthetic contact map with known patterns, for tests and demonstrations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from gridloom.sources.contacts import BINS, PIXELS, ContactMap, chrom_offsets


def synthetic_map(spark: SparkSession, n_bins: int = 200, bin_size: int = 1000, chroms: int = 1, loops: int = 6, missing: tuple[int, ...] = (50, 51), seed: int = 3, reach: int = 60) -> tuple[ContactMap, list[tuple[int, int]]]:
    """A decay by distance, Gaussian loops at the returned places (global bins), and bins without weight."""
    rng = np.random.default_rng(seed)
    pixels, bins, places = [], [], []
    for c in range(chroms):
        base = c * n_bins
        i, j = np.triu_indices(n_bins)
        keep = j - i <= reach
        i, j = i[keep], j[keep]
        mean = 300.0 / (1 + (j - i)) ** 0.8
        own = [(x, x + 20 + 3 * (k % 4)) for k, x in enumerate(np.linspace(15, n_bins - 60, loops).astype(int))]
        for a, b in own:
            mean = mean * (1 + 3 * np.exp(-((i - a) ** 2 + (j - b) ** 2) / 4.5))
            places.append((base + int(a), base + int(b)))
        count = rng.poisson(mean)
        pixels += [(int(base + a), int(base + b), float(v)) for a, b, v in zip(i, j, count, strict=True) if v]
        bins += [(base + k, f"chr{c + 1}", k * bin_size, (k + 1) * bin_size, None if k in missing else 1.0) for k in range(n_bins)]
    b = spark.createDataFrame(bins, BINS)
    return ContactMap(chrom_offsets(b), b, spark.createDataFrame(pixels, PIXELS), bin_size), places
