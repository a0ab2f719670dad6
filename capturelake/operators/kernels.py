"""Thumbnail metrics in Arrow batches: the same numbers as the array forms of ``functions.pixels``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "s bigint, s2 bigint, e bigint, e2 bigint, l bigint, l2 bigint, n bigint, strong int, dhash bigint, phash bigint"


def edge_response(gray: np.ndarray) -> np.ndarray:
    """3x3 edge filter of grey images (..., h, w); border pixels keep their level."""
    g = gray.astype(np.int32)
    out = g.copy()
    if g.shape[-1] > 2 and g.shape[-2] > 2:
        block = sum(
            g[..., 1 + dy:g.shape[-2] - 1 + dy, 1 + dx:g.shape[-1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        out[..., 1:-1, 1:-1] = np.clip(9 * g[..., 1:-1, 1:-1] - block, 0, 255)
    return out


def laplacian_response(gray: np.ndarray) -> np.ndarray:
    """4-neighbour Laplacian with mirrored borders."""
    g = gray.astype(np.int32)
    p = np.pad(g, [(0, 0)] * (g.ndim - 2) + [(1, 1), (1, 1)], mode="reflect")
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * g


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans to signed 64-bit integers, first flag highest."""
    flags = flags.reshape(flags.shape[0], -1)
    weights = np.uint64(1) << np.arange(flags.shape[1] - 1, -1, -1, dtype=np.uint64)
    return (flags.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def thumbnail_sums(px: Column, width: int = 8, height: int = 8, strong: int = 120) -> Column:
    """Exact integer sums of thumbnails, their edges and Laplacians, and both hashes."""

    @F.pandas_udf(SUMS)
    def kernel(batch: pd.Series) -> pd.DataFrame:
        flat = np.stack(batch.to_numpy()).astype(np.int64)
        g = flat.reshape(-1, height, width)
        e, lap = edge_response(g).astype(np.int64), laplacian_response(g).astype(np.int64)
        axes = (1, 2)
        return pd.DataFrame({
            "s": g.sum(axis=axes), "s2": (g * g).sum(axis=axes), "e": e.sum(axis=axes), "e2": (e * e).sum(axis=axes),
            "l": lap.sum(axis=axes), "l2": (lap * lap).sum(axis=axes), "n": width * height,
            "strong": (e >= strong).sum(axis=axes).astype(np.int32),
            "dhash": pack_bits(g[:, :, :-1] > g[:, :, 1:]), "phash": pack_bits(flat[:, 0::4] > flat[:, 2::4]),
        })

    return kernel(px)


def metrics_from_sums(df: DataFrame, sums: str = "sums") -> DataFrame:
    """Brightness, contrast, sharpness and blur out of the exact sums."""
    def mean(total: str) -> Column:
        return F.col(f"{sums}.{total}") / F.col(f"{sums}.n")

    def var(total: str, squares: str) -> Column:
        n, t = F.col(f"{sums}.n"), F.col(f"{sums}.{total}")
        return (n * F.col(f"{sums}.{squares}") - t * t) / (n * n)

    sharp = mean("e") / 255.0 * 0.7 + F.sqrt(var("e", "e2")) / 255.0 * 0.3
    return df.select(
        "*", F.round(mean("s") / 255.0, 4).alias("brightness"),
        F.round(F.sqrt(var("s", "s2")) / 255.0, 4).alias("contrast"),
        F.round(F.least(F.lit(1.0), sharp), 4).alias("sharpness"),
        F.round(var("l", "l2"), 4).alias("blur_score"))
