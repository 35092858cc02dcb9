"""Kernel configurations: presets with kernels drawn from formulas, files of one's own, and changes of size."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class KernelConfig:
    name: str
    kernels: list[np.ndarray] = field(repr=False)
    max_dist: float
    min_dist: float
    max_iterations: int
    min_separation: float
    pearson: float
    resolution: float
    max_perc_zero: float = 10.0
    max_perc_undetected: float = 50.0


def bump(size: int, spread: float, height: float = 1.0, base: float = 1.0) -> np.ndarray:
    """A Gaussian bump over a flat base: a loop."""
    x = np.arange(size) - size // 2
    return base + height * np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / (2 * spread**2))


def blocks(size: int, before: bool = True, after: bool = True, inside: float = 1.5, outside: float = 0.5) -> np.ndarray:
    """Dense blocks up-left (``before``) and down-right (``after``) of a corner on the diagonal: a border between
    domains, or the end or the beginning of one. The centre belongs to the block after it."""
    late = np.arange(size) >= size // 2
    dense = (before & ~late[:, None] & ~late[None, :]) | (after & late[:, None] & late[None, :])
    return np.where(dense, inside, outside).astype(float)


def anti_diagonal(size: int, height: float = 1.25, base: float = 0.5) -> np.ndarray:
    """A ridge of five cells across the diagonal, one before the centre's anti-diagonal and three behind it: a hairpin."""
    x = np.arange(size) - size // 2
    along = x[:, None] + x[None, :]
    return base + height * ((along >= -1) & (along <= 3))


def stripe(size: int, left: bool) -> np.ndarray:
    """A line of one pixel through the centre: along the row (left: the bin of the row contacts all) or the column."""
    k = np.zeros((size, size))
    k[size // 2] = 1.0
    return k if left else k.T


def cross(size: int, height: float = 1.0) -> np.ndarray:
    """A plaid crossing: a centromere."""
    x = np.abs(np.arange(size) - size // 2)
    return 1.0 + height * np.exp(-np.minimum(x[:, None], x[None, :]) / 2.0)


def _preset(name, kernels, max_dist, min_dist, pearson, zero, undetected, separation, resolution) -> KernelConfig:
    return KernelConfig(name, kernels, max_dist, min_dist, 1, separation, pearson, resolution, zero, undetected)


#: The parameters of the presets.
PRESETS = {
    "loops": lambda: _preset("loops", [bump(17, 2.5)], 2_000_000, 20_000, 0.3, 10, 50, 5000, 2000),
    "loops_small": lambda: _preset("loops_small", [bump(7, 1.3)], 2_000_000, 20_000, 0.5, 10, 50, 5000, 2000),
    "borders": lambda: _preset("borders", [blocks(17), blocks(17, after=False), blocks(17, before=False)], 0, 0, 0.15, 10, 75, 5000, 5000),
    "hairpins": lambda: _preset("hairpins", [anti_diagonal(15)], 0, 0, 0.1, 10, 75, 5000, 10_000),
    "centromeres": lambda: _preset("centromeres", [cross(17)], 0, 0, 0.5, 30, 50, 100_000, 2000),
    "stripes_left": lambda: _preset("stripes_left", [stripe(31, True)], 2_000_000, 60_000, 0.17, 80, 50, 40_000, 10_000),
    "stripes_right": lambda: _preset("stripes_right", [stripe(31, False)], 2_000_000, 60_000, 0.17, 80, 50, 40_000, 10_000),
}
_REQUIRED = ("name", "kernels", "max_dist", "min_dist", "max_iterations", "min_separation", "pearson", "resolution")
_LEAST = {"max_dist": 0, "min_dist": 0, "max_iterations": 1, "min_separation": 0, "resolution": 0, "max_perc_zero": 0, "max_perc_undetected": 0}


def load_config(name_or_path: str, custom: bool = False) -> KernelConfig:
    """A preset by name, or a JSON file whose kernels lie beside it."""
    if not custom:
        if name_or_path not in PRESETS:
            raise ValueError(f"no preset {name_or_path}: {', '.join(sorted(PRESETS))}")
        return PRESETS[name_or_path]()
    raw = json.loads(Path(name_or_path).read_text())
    validate(raw)
    kernels = [np.loadtxt(Path(name_or_path).parent / k) for k in raw["kernels"]]
    for k in kernels:
        if k.ndim != 2 or not all(x % 2 for x in k.shape):
            raise ValueError("kernels must have odd numbers of rows and columns")
    return KernelConfig(**{**{k: raw[k] for k in _REQUIRED}, "kernels": kernels, **{k: raw[k] for k in ("max_perc_zero", "max_perc_undetected") if k in raw}})


def validate(raw: dict) -> None:
    for key in _REQUIRED:
        if key not in raw:
            raise ValueError(f"the configuration lacks {key}")
    if not isinstance(raw["name"], str) or not isinstance(raw["kernels"], list) or not all(isinstance(k, str) for k in raw["kernels"]):
        raise ValueError("name must be text, kernels a list of file names")
    for key in (*_LEAST, "pearson"):
        if key in raw and (isinstance(raw[key], bool) or not isinstance(raw[key], (int, float))):
            raise ValueError(f"{key} must be a number")
        if key in _LEAST and key in raw and raw[key] < _LEAST[key]:
            raise ValueError(f"{key} must be at least {_LEAST[key]}")


def overridden(config: KernelConfig, **values: str | float | None) -> KernelConfig:
    """'auto' or None keeps what the configuration has."""
    kinds = {"max_iterations": int}
    chosen = {k: kinds.get(k, float)(v) for k, v in values.items() if v not in (None, "auto")}
    return replace(config, **chosen)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few thousand rows of numbers at most, as a local relation: of known size, and without Python workers."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [tuple(c.split()) for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)}))


def kernel_frame(spark: SparkSession, kernels: list[np.ndarray]) -> DataFrame:
    """Kernels as rows (kernel_id, di, dj, w), offsets from the centre."""
    rows = [(k, i - m.shape[0] // 2, j - m.shape[1] // 2, float(w)) for k, m in enumerate(kernels) for (i, j), w in np.ndenumerate(m)]
    return small_frame(spark, rows, "kernel_id int, di int, dj int, w double")


def resize(kernel: np.ndarray, factor: float | None = None, kernel_res: float | None = None, signal_res: float | None = None, min_size: int = 7) -> np.ndarray:
    """Bilinear change of size on a grid that keeps the corners; an even result loses a row and a column."""
    if kernel.ndim != 2 or kernel.shape[0] != kernel.shape[1] or kernel.shape[0] % 2 == 0:
        raise ValueError("only square kernels of odd size can be resized")
    if factor is None:
        if kernel_res is None or signal_res is None:
            raise ValueError("give a factor, or both resolutions")
        factor = kernel_res / signal_res
    size = kernel.shape[0]
    out = int(round(size * factor))
    if out < min_size:
        out = min_size
    if out % 2 == 0:
        out -= 1
    at = np.linspace(0, size - 1, out)
    low = np.minimum(at.astype(int), max(size - 2, 0))
    part = at - low
    high = np.minimum(low + 1, size - 1)
    rows = kernel[low] * (1 - part)[:, None] + kernel[high] * part[:, None]
    return rows[:, low] * (1 - part) + rows[:, high] * part


def crop(kernel: np.ndarray, target: int) -> np.ndarray:
    """The centre of a kernel; an even target grows by one."""
    if any(s % 2 == 0 for s in kernel.shape):
        raise ValueError("kernels must have odd sizes")
    target += 1 - target % 2
    if target > min(kernel.shape):
        raise ValueError("the kernel is smaller than the target")
    a, b = ((s - target) // 2 for s in kernel.shape)
    return kernel[a : a + target, b : b + target]


def factorise(kernel: np.ndarray, share: float = 0.999) -> tuple[np.ndarray, np.ndarray]:
    """The fewest singular factors with more than ``share`` of the energy; U and V each carry root singular values."""
    u, s, v = np.linalg.svd(kernel)
    energy = np.cumsum(s**2) / (s**2).sum()
    k = int(np.argmax(energy > share)) + 1
    if k > min(kernel.shape) // 2:
        warnings.warn(f"{k} factors are kept: the kernel has no low rank", stacklevel=2)
    root = np.sqrt(s[:k])
    return u[:, :k] * root, (v[:k].T * root).T


def blur(window: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian blur by rows and columns, mirrored at the edges, cut at four sigmas."""
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    padded = np.pad(window, reach, mode="symmetric")
    rows = sum(w[k] * padded[k : k + window.shape[0]] for k in range(len(w)))
    return sum(w[k] * rows[:, k : k + window.shape[1]] for k in range(len(w)))
