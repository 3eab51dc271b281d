"""Pixel statistics of image tiles, many tiles at once, as an Arrow UDF; numpy only.

A tile is raw RGB of side x side pixels, one byte a channel. The 68 values of a tile describe its channels, its
noise, its spectrum and traces of sensor and compression grids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
BANDS = 16
GRID = 8
GREY = np.array([0.299, 0.587, 0.114], dtype=np.float32)
# Exchanges that bring the median of nine values to the middle.
MEDIAN_OF_9 = ((1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2))
GROUPS = (("channel", 12), ("cross", 6), ("cfa", 6), ("noise", 8), ("spectrum", 18), ("variance", 8), ("grid", 2), ("colour", 8))


def feature_names() -> list[str]:
    return [f"{g}_{i}" for g, n in GROUPS for i in range(n)]


def centre_crop(rgb: np.ndarray, side: int) -> np.ndarray:
    """The middle side x side pixels at native size; a smaller picture is mirrored on at its right and lower edge."""
    h, w = rgb.shape[:2]
    if h < side or w < side:
        return np.pad(rgb, ((0, max(0, side - h)), (0, max(0, side - w)), (0, 0)), mode="reflect")[:side, :side]
    y, x = (h - side) // 2, (w - side) // 2
    return rgb[y : y + side, x : x + side]


def moments(x: np.ndarray) -> np.ndarray:
    """(n, 4): mean, deviation, skewness, kurtosis (not excess) of each row of values."""
    x = x.reshape(len(x), -1).astype(np.float64)
    m, s = x.mean(1), x.std(1)
    z = (x - m[:, None]) / (s[:, None] + EPS)
    z3 = z * z * z
    return np.stack([m, s, z3.mean(1), (z3 * z).mean(1)], axis=1)


def residual(x: np.ndarray) -> np.ndarray:
    """What a 3x3 median, edges repeated, doesn't explain."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    h, w = x.shape[1:]
    v = [p[:, i : i + h, j : j + w] for i in range(3) for j in range(3)]
    for a, b in MEDIAN_OF_9:
        v[a], v[b] = np.minimum(v[a], v[b]), np.maximum(v[a], v[b])
    return x - v[4]


def box_mean(x: np.ndarray, size: int = GRID) -> np.ndarray:
    """Mean over size x size pixels, edges mirrored; an even window reaches one pixel further back."""
    lo, hi = size // 2, size - size // 2 - 1
    p = np.pad(x, ((0, 0), (lo, hi), (lo, hi)), mode="symmetric").cumsum(1).cumsum(2)
    p = np.pad(p, ((0, 0), (1, 0), (1, 0)))
    h, w = x.shape[1:]
    return (p[:, size : size + h, size : size + w] - p[:, :h, size : size + w] - p[:, size : size + h, :w] + p[:, :h, :w]) / size**2


def spectrum(grey: np.ndarray) -> np.ndarray:
    """(n, 18): share of power in 16 rings up to the Nyquist frequency of an axis, of the upper half, and the slope
    of the logarithms. Corners count in the whole, not in a ring."""
    n, h, w = grey.shape
    power = np.abs(np.fft.fft2(grey - grey.mean((1, 2), keepdims=True))) ** 2
    fy, fx = np.fft.fftfreq(h) * 2, np.fft.fftfreq(w) * 2
    ring = np.floor(np.sqrt(fy[:, None] ** 2 + fx[None, :] ** 2) * BANDS).astype(int).ravel()
    sums = np.stack([np.bincount(ring, weights=p.ravel(), minlength=BANDS)[:BANDS] for p in power])
    share = sums / (power.reshape(n, -1).sum(1, keepdims=True) + EPS)
    x = np.arange(1, BANDS + 1) - (BANDS + 1) / 2
    slope = (np.log(share + EPS) * x).sum(1) / (x * x).sum()
    return np.column_stack([share, share[:, BANDS // 2 :].sum(1), slope])


def grid_ratio(grey: np.ndarray, axis: int) -> np.ndarray:
    """Mean step across the borders of 8x8 blocks over the mean step elsewhere."""
    d = np.moveaxis(np.abs(np.diff(grey, axis=axis)), axis, 1)
    on = np.arange(1, d.shape[1] + 1) % GRID == 0
    return d[:, on].mean((1, 2)) / (d[:, ~on].mean((1, 2)) + EPS)


def tile_features(rgb: np.ndarray) -> np.ndarray:
    """(n, 68) float32 of (n, h, w, 3) values in [0, 1]; what isn't finite becomes 0."""
    rgb = rgb.astype(np.float32)
    chan = [rgb[..., c] for c in range(3)]
    grey = rgb @ GREY
    rest = residual(grey)
    flat = rgb.reshape(len(rgb), -1, 3).astype(np.float64)
    z = (flat - flat.mean(1, keepdims=True)) / (flat.std(1, keepdims=True) + EPS)
    cross = [v for a, b in ((0, 1), (0, 2), (1, 2)) for v in ((z[..., a] * z[..., b]).mean(1), (flat[..., a] - flat[..., b]).std(1))]
    lattice = np.stack([rest[:, y::2, x::2].reshape(len(rest), -1).var(1) for y in (0, 1) for x in (0, 1)], axis=1)
    lattice = lattice / (lattice.mean(1, keepdims=True) + EPS)
    level = [np.abs(residual(c)).mean((1, 2)) for c in chan]
    var = np.maximum(box_mean(grey.astype(np.float64) ** 2) - box_mean(grey.astype(np.float64)) ** 2, 0).reshape(len(grey), -1)
    q = np.percentile(var, [10, 25, 50, 75, 90, 99], axis=1).T
    top, low = rgb.max(-1), rgb.min(-1)
    out = np.column_stack([
        *[moments(c) for c in chan], *cross, lattice, lattice.std(1), np.ptp(lattice, axis=1), moments(rest), np.abs(rest).mean((1, 2)), *level,
        spectrum(grey), q, q[:, 4] / (q[:, 1] + EPS), var.mean(1), grid_ratio(grey, 1), grid_ratio(grey, 2), moments((top - low) / (top + EPS)), moments(top),
    ])
    return np.where(np.isfinite(out), out, 0).astype(np.float32)


def texture(rgb: np.ndarray) -> np.ndarray:
    """Deviation of the grey values of each tile."""
    return (rgb.astype(np.float32) @ GREY).reshape(len(rgb), -1).std(1)


def difference_hash(grey: np.ndarray) -> list[str]:
    """16 hex digits for each (8, 9) grid of grey values: a bit for each place that is darker than its right neighbour."""
    bits = (grey[:, :, 1:] > grey[:, :, :-1]).reshape(len(grey), 64)
    return [np.packbits(b).tobytes().hex() for b in bits]


def features_column(tile: Column, side: int = 128) -> Column:
    """The 68 values of a column of raw tiles; null for a tile of another length."""

    @F.pandas_udf("array<float>")
    def run(tiles: pd.Series) -> pd.Series:
        at = [i for i, b in enumerate(tiles) if b is not None and len(b) == side * side * 3]
        out: list = [None] * len(tiles)
        step = max(1, 2**19 // side**2)
        for s in range(0, len(at), step):  # bounds what is held as floats
            part = at[s : s + step]
            raw = np.stack([np.frombuffer(tiles.iloc[i], dtype=np.uint8).reshape(side, side, 3) for i in part])
            for i, f in zip(part, tile_features(raw / np.float32(255)), strict=True):
                out[i] = f
        return pd.Series(out, dtype=object)

    return run(tile)
