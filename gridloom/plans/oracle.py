"""SQL building blocks for the driver's comparison: named common table expressions that pull in what they use."""

from __future__ import annotations

import re

import numpy as np

from gridloom.functions.stats import ERFC

#: Parts of a bin at most; fewer where the table would give less than LEAST_BINS bins.
BIN_PARTS = 10
LEAST_BINS = 200
#: Ends of the chromosomes, in hundredths of the bins: of four sizes, the last one about as small as a kernel.
EDGES = (0, 40, 72, 97, 100)
BIN_SIZE = 1000
BAND = 20
SIZE = 7
THRESHOLD = 0.35
MOST_ZERO = 60.0
MOST_MISSING = 50.0


#: Greedy suppression in rounds: who has no undecided better rival stays, and its rivals go.
ALONE = {
    "ranked": "SELECT *, row_number() OVER (ORDER BY score DESC, bin1, bin2) AS place FROM found",
    "around": "SELECT * FROM (VALUES (-1), (0), (1)) t(o)",
    "rivals": "SELECT a.place, b.place AS better FROM ranked a CROSS JOIN around x CROSS JOIN around y JOIN ranked b ON b.bin1 // 5 = a.bin1 // 5 + x.o AND b.bin2 // 5 = a.bin2 // 5 + y.o WHERE b.place < a.place AND abs(a.bin1 - b.bin1) < 5 AND abs(a.bin2 - b.bin2) < 5",
    "rounds": "SELECT place, false AS stays FROM ranked UNION ALL (WITH u AS (SELECT place FROM rounds WHERE NOT stays), stay AS (SELECT place FROM u WHERE place NOT IN (SELECT r.place FROM rivals r JOIN u b ON b.place = r.better)) SELECT place, true FROM stay UNION ALL SELECT place, false FROM u WHERE place NOT IN (SELECT place FROM stay) AND place NOT IN (SELECT r.place FROM rivals r JOIN stay s ON s.place = r.better))",
    "alone": "SELECT * FROM ranked WHERE place IN (SELECT place FROM rounds WHERE stays)",
}


def kernel_values(kernel: np.ndarray) -> str:
    h = kernel.shape[0] // 2
    return ", ".join(f"({i - h}::BIGINT, {j - h}::BIGINT, {float(w)!r}::DOUBLE)" for (i, j), w in np.ndenumerate(kernel))


def log10p(r: str, n: str) -> str:
    x = f"(abs(atanh(greatest(least({r}, {1 - 1e-12!r}::DOUBLE), {-1 + 1e-12!r}::DOUBLE)) * sqrt({n} - 3)) / {2**0.5!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {x}))"
    poly = f"({ERFC[-1]!r}::DOUBLE)"
    for c in reversed(ERFC[:-1]):
        poly = f"({poly} * {t} + ({c!r}::DOUBLE))"
    return f"CASE WHEN {n} > 3 THEN (ln({t}) - {x} * {x} + {poly}) / 2.302585092994046::DOUBLE END"


def snap(x: str) -> str:
    return f"CASE WHEN abs({x}) < 0.0001 THEN 0.0::DOUBLE ELSE {x} END"


def pieces(kernel: np.ndarray, band: int = BAND, learned: bool = False) -> dict[str, str]:
    """All blocks for one kernel; the sums of a ``learned`` one are taken from its block ``kern``."""
    size, K = kernel.shape[0], kernel.size
    k1, k2 = (repr(float(sum(float(x) ** p for x in kernel.flat))) + "::DOUBLE" for p in (1, 2))
    if learned:
        k1, k2 = "(SELECT sum(w) FROM kern)", "(SELECT sum(w * w) FROM kern)"
    keep = band + size
    return {
        "width": f"SELECT w, ((n + w - 1) // w)::BIGINT AS n FROM (SELECT count(*) AS n, greatest(1, least({BIN_PARTS}, count(*) // {LEAST_BINS})) AS w FROM part)",
        "occ": "SELECT l_orderkey AS o, (l_partkey // (SELECT w FROM width))::BIGINT AS b, count(*) AS c FROM lineitem GROUP BY 1, 2",
        "pixels": "SELECT x.b AS bin1_id, y.b AS bin2_id, sum(CASE WHEN x.b = y.b THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END)::DOUBLE AS count FROM occ x JOIN occ y ON x.o = y.o AND x.b <= y.b GROUP BY 1, 2 HAVING sum(CASE WHEN x.b = y.b THEN x.c * (x.c - 1) // 2 ELSE x.c * y.c END) > 0",
        "chroms": f"SELECT 'chr' || (k + 1) AS chrom, k::INTEGER AS chrom_idx, (b - a) * {BIN_SIZE} AS length, a AS start_bin, b AS end_bin, b - a AS n FROM (SELECT k, n * lo // 100 AS a, n * hi // 100 AS b FROM width CROSS JOIN (VALUES {', '.join(f'({k}, {lo}, {hi})' for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:], strict=False)))}) t(k, lo, hi)) WHERE b > a",
        "bins0": f"SELECT g.bin_id, c.chrom, c.chrom_idx, g.bin_id - c.start_bin AS local, (g.bin_id - c.start_bin) * {BIN_SIZE} AS start, (g.bin_id - c.start_bin + 1) * {BIN_SIZE} AS \"end\" FROM (SELECT unnest(range(n)) AS bin_id FROM width) g JOIN chroms c ON g.bin_id >= c.start_bin AND g.bin_id < c.end_bin",
        "ends": "SELECT bin1_id AS bin_id, count FROM pixels UNION ALL SELECT bin2_id, count FROM pixels WHERE bin1_id <> bin2_id",
        "marg": "SELECT bin_id, sum(count) AS marginal FROM ends GROUP BY 1",
        "bins": "SELECT b.*, CASE WHEN b.bin_id % 17 <> 5 THEN 10.0::DOUBLE / sqrt(m.marginal) END AS weight FROM bins0 b LEFT JOIN marg m USING (bin_id)",
        "degree": "SELECT b.bin_id, count(e.bin_id) AS degree FROM bins0 b LEFT JOIN ends e USING (bin_id) GROUP BY 1",
        "bal": "SELECT p.bin1_id, p.bin2_id, x.weight * y.weight * p.count AS v, x.chrom_idx AS sub1, y.chrom_idx AS sub2, x.local AS i, y.local AS j FROM pixels p JOIN bins x ON x.bin_id = p.bin1_id JOIN bins y ON y.bin_id = p.bin2_id WHERE x.weight IS NOT NULL AND y.weight IS NOT NULL",
        "loc": "SELECT sub1 AS sub, i, j, v FROM bal WHERE sub1 = sub2",
        "banded": f"SELECT * FROM loc WHERE j - i BETWEEN 0 AND {keep}",
        "law": "SELECT sub, j - i AS d, avg(v) AS y FROM banded WHERE v > 0 GROUP BY 1, 2",
        "det": "SELECT b.sub, b.i, b.j, CASE WHEN coalesce(b.v / nullif(l.y, 0), 1e300) >= 10 THEN 1.0::DOUBLE ELSE b.v / nullif(l.y, 0) END AS v FROM banded b JOIN law l ON l.sub = b.sub AND l.d = b.j - b.i WHERE b.v <> 0",
        "kern": f"SELECT * FROM (VALUES {kernel_values(kernel)}) t(di, dj, w)",
        "sums": f"SELECT sub, i - di AS i, j - dj AS j, n, sum(v * w) AS vk, sum(v) AS v1, sum(v * v) AS v2 FROM det JOIN chroms c ON c.chrom_idx = det.sub CROSS JOIN kern WHERE i - di >= 0 AND j - dj >= i - di AND (j - dj) - (i - di) <= {band} AND i - di < n AND j - dj < n GROUP BY 1, 2, 3, 4",
        "lost": "SELECT chrom_idx AS sub, local AS bin FROM bins WHERE weight IS NULL",
        "cells": "SELECT s.sub, s.i, s.j, s.n, k.w, s.i + k.di AS x, s.j + k.dj AS y, a.bin IS NOT NULL AS mx, b.bin IS NOT NULL AS my FROM sums s CROSS JOIN kern k LEFT JOIN lost a ON a.sub = s.sub AND a.bin = s.i + k.di LEFT JOIN lost b ON b.sub = s.sub AND b.bin = s.j + k.dj",
        "masked": f"SELECT sub, i, j, count(*) AS m0, sum(w) AS mk, sum(w * w) AS mkk FROM cells WHERE (x >= 0 AND x <= y AND y < n AND y - x <= {band} AND (mx OR my)) OR (x < 0 AND y >= 0 AND y < {band + size}) OR (x < 0 AND y < 0) OR (y >= n AND x >= n - {band + 2}) OR (y - x BETWEEN -{size} AND -1) GROUP BY 1, 2, 3",
        "terms": f"SELECT s.sub, s.i, s.j, s.vk, s.v1, s.v2, {K}.0::DOUBLE - coalesce(m.m0, 0) AS n_obs, coalesce(m.mk, 0.0::DOUBLE) AS mk, coalesce(m.mkk, 0.0::DOUBLE) AS mkk FROM sums s LEFT JOIN masked m USING (sub, i, j)",
        "moments": f"SELECT sub, i, j, vk, n_obs, ({k1} - mk) / n_obs AS km, ({k2} - mkk) / n_obs AS k2m, ({snap(f'v1 / {K}.0::DOUBLE')}) * {K} / n_obs AS sm, ({snap(f'v2 / {K}.0::DOUBLE')}) * {K} / n_obs AS s2 FROM terms WHERE n_obs > 0",
        "dens": f"SELECT *, CASE WHEN n_obs < floor({1 - MOST_MISSING / 100!r} * {K}) THEN 0 ELSE sqrt(greatest((s2 - sm * sm) * (k2m - km * km), 0)) END AS den, (({snap(f'vk / {K}.0::DOUBLE')}) - sm * km * n_obs / {K}) * {K} / n_obs AS num FROM moments",
        "corr": "SELECT sub, i, j, greatest(least(num / den, 1.0::DOUBLE), -1.0::DOUBLE) AS r, n_obs FROM dens WHERE den >= 1e-10 AND num <> 0",
        "cand": f"SELECT * FROM corr WHERE r >= {THRESHOLD}",
        "reach": "SELECT sub, i, j, i * 1000000 + j AS l FROM cand UNION SELECT c.sub, c.i, c.j, r.l FROM reach r JOIN cand c ON c.sub = r.sub AND abs(c.i - r.i) + abs(c.j - r.j) = 1",
        "labels": "SELECT c.sub, c.i, c.j, c.r, c.n_obs, dense_rank() OVER (PARTITION BY c.sub ORDER BY m.l) AS label FROM cand c JOIN (SELECT sub, i, j, min(l) AS l FROM reach GROUP BY 1, 2, 3) m USING (sub, i, j)",
        "foci": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sub, label) AS size FROM labels) WHERE size >= 2",
        "best": "SELECT sub, label, i, j, r, n_obs, size FROM (SELECT *, row_number() OVER (PARTITION BY sub, label ORDER BY r DESC, i, j) AS p FROM foci) WHERE p = 1",
        "grid": f"SELECT a.range AS a, b.range AS b FROM range({size}) a CROSS JOIN range({size}) b",
        "wcells": f"SELECT p.sub, p.label, g.a, g.b, CASE WHEN p.i + g.a - {size // 2} < 0 OR p.j + g.b - {size // 2} < 0 OR p.i + g.a - {size // 2} >= c.n OR p.j + g.b - {size // 2} >= c.n OR x.bin IS NOT NULL OR y.bin IS NOT NULL OR (p.j + g.b) - (p.i + g.a) BETWEEN -{size} AND -1 THEN NULL ELSE coalesce(d.v, 0.0::DOUBLE) END AS v FROM best p JOIN chroms c ON c.chrom_idx = p.sub CROSS JOIN grid g LEFT JOIN lost x ON x.sub = p.sub AND x.bin = p.i + g.a - {size // 2} LEFT JOIN lost y ON y.sub = p.sub AND y.bin = p.j + g.b - {size // 2} LEFT JOIN det d ON d.sub = p.sub AND d.i = p.i + g.a - {size // 2} AND d.j = p.j + g.b - {size // 2}",
        "wstats": "SELECT sub, label, (count(*) - count(v)) / count(*)::DOUBLE AS undetected, count(*) FILTER (WHERE v = 0) / nullif(count(v), 0)::DOUBLE AS zero FROM wcells GROUP BY 1, 2",
        "checked": f"SELECT p.*, s.undetected, s.zero, (p.i < c.n - 1 AND p.j < c.n - 1 AND s.undetected < {MOST_MISSING / 100} AND coalesce(s.zero < {MOST_ZERO / 100}, false)) AS valid FROM best p JOIN chroms c ON c.chrom_idx = p.sub JOIN wstats s USING (sub, label)",
        "pile": "SELECT w.a, w.b, avg(w.v) AS mean FROM wcells w JOIN checked c USING (sub, label) WHERE c.valid GROUP BY 1, 2",
        "found": f"SELECT c.start_bin + i AS bin1, c.start_bin + j AS bin2, r AS score, coalesce(pow(10.0::DOUBLE, {log10p('r', 'n_obs')}), 1.0::DOUBLE) AS pvalue FROM checked JOIN chroms c ON c.chrom_idx = sub WHERE valid",
        **ALONE,
        "placed": "SELECT x.chrom AS chrom1, x.start AS start1, x.\"end\" AS end1, y.chrom AS chrom2, y.start AS start2, y.\"end\" AS end2, p.bin1, p.bin2, p.score, p.pvalue FROM alone p JOIN bins0 x ON x.bin_id = p.bin1 JOIN bins0 y ON y.bin_id = p.bin2 WHERE x.chrom <> y.chrom OR abs(y.start - x.start) >= 2000",
    }


def assemble(body: str, blocks: dict[str, str]) -> str:
    """A query with the blocks that it needs, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in blocks:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(blocks[name])
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in blocks.items() if n in needed) + "\n" + body
