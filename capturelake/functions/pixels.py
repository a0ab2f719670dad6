"""Pixel metrics of small grey thumbnails held in arrays, as Columns.

``px`` is a row-major ARRAY<INT> of width x height grey levels. Larger images
are left to image libraries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_sum(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def pixel_square_sum(px: Column) -> Column:
    return F.aggregate(px, F.lit(0).cast("bigint"), lambda acc, v: acc + v * v)


def mean_level(px: Column) -> Column:
    return pixel_sum(px) / F.size(px)


def variance(px: Column) -> Column:
    """Population variance from exact integer sums."""
    n = F.size(px).cast("bigint")
    total = pixel_sum(px)
    return (n * pixel_square_sum(px) - total * total) / (n * n)


def edge_map(px: Column, width: int, height: int) -> Column:
    """3x3 edge response clipped to 0..255; border pixels keep their level."""
    w, h = F.lit(width), F.lit(height)

    def edge(v: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        inner = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
        around = sum((px[i + dy * width + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)), F.lit(0)) - v
        return F.when(inner, F.greatest(F.lit(0), F.least(F.lit(255), v * 8 - around))).otherwise(v)

    return F.transform(px, edge)


def laplacian(px: Column, width: int, height: int) -> Column:
    """4-neighbour Laplacian with mirrored borders."""
    w, h = width, height

    def at(x: Column, y: Column) -> Column:
        return px[y * w + x]

    def response(v: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        left = F.when(x == 0, 1).otherwise(x - 1)
        right = F.when(x == w - 1, w - 2).otherwise(x + 1)
        up = F.when(y == 0, 1).otherwise(y - 1)
        down = F.when(y == h - 1, h - 2).otherwise(y + 1)
        return at(left, y) + at(right, y) + at(x, up) + at(x, down) - 4 * v

    return F.transform(px, response)


def brightness(px: Column) -> Column:
    return F.round(mean_level(px) / 255.0, 4)


def contrast(px: Column) -> Column:
    return F.round(F.sqrt(variance(px)) / 255.0, 4)


def sharpness(edges: Column) -> Column:
    mean, std = mean_level(edges) / 255.0, F.sqrt(variance(edges)) / 255.0
    return F.round(F.least(F.lit(1.0), mean * 0.7 + std * 0.3), 4)


def blur_score(response: Column) -> Column:
    return F.round(variance(response), 4)


def bits(flags: Column) -> Column:
    """Pack booleans into a BIGINT, first one highest."""
    return F.aggregate(
        flags, F.lit(0).cast("bigint"),
        lambda acc, f: F.shiftleft(acc, 1).bitwiseOR(F.when(f, 1).otherwise(0).cast("bigint")))


def difference_hash(px: Column, width: int, height: int, direction: str = "falling") -> Column:
    """Row-wise difference hash; ``falling`` sets a bit where the left pixel is brighter."""
    steps = [y * width + x for y in range(height) for x in range(width - 1)]

    def flag(i: Column) -> Column:
        left, right = px[i], px[i + 1]
        return left > right if direction == "falling" else right > left

    return bits(F.transform(F.array(*[F.lit(s) for s in steps]), flag))


def pooled_hash(values: Column) -> Column:
    """16-bit hash comparing the 1st with the 3rd of every four values."""
    starts = F.sequence(F.lit(0), F.size(values) - 4, F.lit(4))
    return bits(F.transform(starts, lambda i: values[i] > values[i + 2]))
