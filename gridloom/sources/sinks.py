"""Writers: pattern tables, windows, stage dumps, kernel configurations."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_prefix(prefix: str) -> None:
    """The folder of an output prefix must exist."""
    folder = os.path.dirname(prefix)
    if folder and not os.path.isdir(folder):
        raise OSError(f"no folder {folder}")


def write_patterns(patterns: DataFrame, prefix: str, decimals: int = 10, order: list[str] | None = None) -> str:
    """One tab-separated file with a header, fractions with ``decimals`` digits; patterns are few (one per focus).

    A struct column only serves to order."""
    check_prefix(prefix)
    path = f"{prefix}.tsv"
    rows = patterns.orderBy(*order) if order else patterns
    patterns = patterns.drop(*[c for c, kind in patterns.dtypes if kind.startswith("struct")])
    shown = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if kind == "double" else F.col(c).cast("string").alias(c) for c, kind in patterns.dtypes]
    with open(path, "w") as out:
        out.write("\t".join(patterns.columns) + "\n")
        for row in rows.select(*[F.coalesce(x, F.lit("")) for x in shown]).toLocalIterator():
            out.write("\t".join(row) + "\n")
    return path


def stream_windows(windows: Iterable[np.ndarray], n: int, shape: tuple[int, int], prefix: str, kind: str = "json") -> str:
    """``n`` windows of one shape, one at a time, as a JSON object by number or as an array file."""
    check_prefix(prefix)
    if kind not in ("json", "npy"):
        raise ValueError(f"unknown format {kind}: use json or npy")
    path, written = f"{prefix}.{kind}", 0
    with open(path, "wb") as out:
        if kind == "npy":
            np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(float)), "fortran_order": False, "shape": (n, *shape)})
        for written, w in enumerate(windows, 1):
            if w.shape != tuple(shape):
                raise ValueError(f"a window of {w.shape} among those of {tuple(shape)}")
            if kind == "npy":
                out.write(np.ascontiguousarray(w, float).tobytes())
            else:
                item = json.dumps({str(written - 1): w.tolist()}, indent=4)
                out.write((("{" if written == 1 else ",") + item[1:-2]).encode())
        if kind == "json":
            out.write(b"\n}" if written else b"{}")
    if written != n:
        raise ValueError(f"{written} windows where {n} were announced")
    return path


def save_windows(windows: np.ndarray, prefix: str, kind: str = "json") -> str:
    """Windows (n, height, width) as a JSON object by number, or as an array file."""
    return stream_windows(iter(windows), len(windows), windows.shape[1:], prefix, kind)


def save_pileup(pile: np.ndarray, prefix: str, title: str) -> str:
    """The mean window as a drawing: blue below 1, red above, from 0 to 2; missing cells are grey."""
    check_prefix(prefix)
    cell, (height, width) = 16, pile.shape
    fade = lambda x: round(255 * (1 - abs(min(max(x, 0.0), 2.0) - 1)))
    colour = lambda x: "#999999" if np.isnan(x) else f"rgb(255,{fade(x)},{fade(x)})" if x > 1 else f"rgb({fade(x)},{fade(x)},255)"
    body = [f'<rect x="{b * cell}" y="{(a + 2) * cell}" width="{cell}" height="{cell}" fill="{colour(x)}"><title>{x:.4f}</title></rect>' for (a, b), x in np.ndenumerate(pile)]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{max(width * cell, 260)}" height="{(height + 2) * cell}"><text x="2" y="{cell}" font-size="13">{escape(title)}</text>'
    Path(f"{prefix}.svg").write_text("\n".join([head, *body, "</svg>"]))
    return f"{prefix}.svg"


def dump_stage(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Write a stage below ``folder`` and go on from what was written; without a folder nothing happens."""
    if not folder:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def write_config(config: dict, kernels: list[np.ndarray], prefix: str) -> str:
    """Kernels as text files beside a JSON configuration that names them."""
    check_prefix(prefix)
    names = []
    for i, k in enumerate(kernels):
        np.savetxt(f"{prefix}.{i}.txt", k)
        names.append(os.path.basename(f"{prefix}.{i}.txt"))
    Path(f"{prefix}.json").write_text(json.dumps({**config, "kernels": names}, indent=4))
    return f"{prefix}.json"
