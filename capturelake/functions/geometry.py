"""Plane and space geometry as Columns: quads, boxes, poses, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp, clamp01

Point = tuple[Column, Column]


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def unsigned_mod(value: Column, modulus: int) -> Column:
    """``value mod m`` for a BIGINT holding 64 unsigned bits."""
    wrap = (1 << 64) % modulus
    low = F.pmod(value, F.lit(modulus))
    return F.when(value < 0, F.pmod(low + wrap, F.lit(modulus))).otherwise(low).cast("int")


def hash_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def polygon_area(corners: Sequence[Point]) -> Column:
    """Shoelace area of corners listed in order."""
    terms = F.lit(0.0)
    for here, after in zip(corners, [*corners[1:], corners[0]]):
        terms = terms + (here[0] * after[1] - after[0] * here[1])
    return F.abs(terms) * 0.5


def tilt_degrees(top_left: Point, top_right: Point) -> Column:
    """Smallest angle between the top edge and an image axis; 45 for no edge."""
    dx, dy = top_right[0] - top_left[0], top_right[1] - top_left[1]
    turn = F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double")))) % 180.0
    folded = F.when(turn > 90.0, 180.0 - turn).otherwise(turn)
    flat = (F.abs(dx) <= 1e-9) & (F.abs(dy) <= 1e-9)
    return F.when(flat, F.lit(45.0)).otherwise(F.least(folded, F.abs(90.0 - folded)))


def perspective_ratio(corners: Sequence[Point]) -> Column:
    """Short over long horizontal edge; corners go clockwise from top left."""
    top, bottom = distance(corners[0], corners[1]), distance(corners[3], corners[2])
    return clamp01(F.least(top, bottom) / F.greatest(top, bottom, F.lit(1e-6)))


def center_offset(box: Sequence[Column], width: Column, height: Column,
                  y_anchor: float = 0.5, limit: float = 1.0) -> Column:
    """Distance of the box centre from the anchor, in half-image units."""
    left, top, right, bottom = box
    dx = ((left + right) * 0.5 - width * 0.5) / F.greatest(width * 0.5, F.lit(1.0))
    dy = ((top + bottom) * 0.5 - height * y_anchor) / F.greatest(height * y_anchor, F.lit(1.0))
    bad = (width <= 0) | (height <= 0)
    return F.when(bad, F.lit(1.0)).otherwise(F.least(F.lit(limit), F.sqrt(dx * dx + dy * dy)))


def border_touches(box: Sequence[Column], width: Column, height: Column, margin: int = 1) -> Column:
    left, top, right, bottom = box
    hits = [
        left <= margin,
        top <= margin,
        right >= F.greatest(F.lit(0), width - margin),
        bottom >= F.greatest(F.lit(0), height - margin),
    ]
    return sum((h.cast("int") for h in hits), F.lit(0))


def _widen(low: Column, high: Column, limit: Column) -> tuple[Column, Column]:
    """Grow a span below 24 pixels to 24 about its middle."""
    middle = (low + high) * 0.5
    thin = high - low < 24
    return (
        F.when(thin, F.greatest(F.lit(0), F.round(middle - 12).cast("int"))).otherwise(low),
        F.when(thin, F.least(limit, F.round(middle + 12).cast("int"))).otherwise(high),
    )


def pad_box(box: Sequence[Column], width: Column, height: Column, padding: float = 0.045) -> tuple[Column, ...]:
    left, top, right, bottom = box
    pad = F.round(F.greatest(width, height) * padding).cast("int")
    left, right = _widen(F.greatest(F.lit(0), left - pad), F.least(width, right + pad), width)
    top, bottom = _widen(F.greatest(F.lit(0), top - pad), F.least(height, bottom + pad), height)
    return left, top, right, bottom


def relative_to_absolute_box(box: Sequence[Column], width: Column, height: Column) -> Column:
    """Pixel box of a relative one, padded 6 % (at least 4); NULL when too thin."""

    def span(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
        lo = F.round(clamp01(low) * size).cast("int")
        hi = F.round(clamp01(high) * size).cast("int")
        pad = F.greatest(F.lit(4), F.round((hi - lo) * 0.06).cast("int"))
        return F.greatest(F.lit(0), lo - pad), F.least(size, hi + pad)

    left, right = span(box[0], box[2], width)
    top, bottom = span(box[1], box[3], height)
    good = (width > 1) & (height > 1) & (right - left >= 4) & (bottom - top >= 4)
    return F.when(good, F.array(left, top, right, bottom))


def relative_to_absolute_quad(quad: Sequence[Point], width: Column, height: Column) -> Column:
    """Pixel corners of a relative quad; NULL below an area of 80 pixels."""
    points = [
        (F.round(clamp01(x) * width).cast("int"), F.round(clamp01(y) * height).cast("int"))
        for x, y in quad
    ]
    good = (width > 1) & (height > 1) & (polygon_area(points) >= 80.0)
    return F.when(good, F.array(*[F.array(x, y) for x, y in points]))


def quad_usable(quad: Sequence[Point], width: Column, height: Column) -> Column:
    """Whether a quad is big, inside and upright enough to be rectified."""
    share = polygon_area(quad) / (width * height)
    margin = 2
    touching = sum(
        (((x <= margin) | (x >= width - margin) | (y <= margin) | (y >= height - margin)).cast("int")
         for x, y in quad),
        F.lit(0),
    )
    wide = (distance(quad[0], quad[1]) + distance(quad[3], quad[2])) * 0.5
    tall = (distance(quad[0], quad[3]) + distance(quad[1], quad[2])) * 0.5
    aspect = F.greatest(wide, F.lit(1e-6)) / F.greatest(tall, F.lit(1e-6))
    return (
        (width > 1) & (height > 1)
        & share.between(0.01, 0.55) & (touching <= 1) & aspect.between(0.4, 3.0)
    )


def yaw_quaternion(yaw: Column) -> Column:
    half = yaw / 2
    return F.array(F.lit(0.0), F.lit(0.0), F.round(F.sin(half), 6), F.round(F.cos(half), 6))


def pose_matrix(translation: Column, rotation: Column) -> Column:
    z, w = rotation[2], rotation[3]
    sin_yaw, cos_yaw = 2 * z * w, 1 - 2 * (z * z)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        F.array(F.round(cos_yaw, 6), F.round(-sin_yaw, 6), zero, translation[0]),
        F.array(F.round(sin_yaw, 6), F.round(cos_yaw, 6), zero, translation[1]),
        F.array(zero, zero, one, translation[2]),
        F.array(zero, zero, zero, one),
    )


def quaternion_yaw(rotation: Column) -> Column:
    z, w = rotation[2], rotation[3]
    return F.atan2(2 * z * w, 1 - 2 * (z * z))


def rotate(x: Column, y: Column, yaw: Column) -> Point:
    return (
        F.round(F.cos(yaw) * x - F.sin(yaw) * y, 6),
        F.round(F.sin(yaw) * x + F.cos(yaw) * y, 6),
    )


def sphere_radius(dx: Column, dy: Column, dz: Column) -> Column:
    diagonal = F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(1e-6))
    return clamp(diagonal * 0.01, 0.01, 0.05)


Vector = tuple[Column, Column, Column]


def cross(a: Vector, b: Vector) -> Vector:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))
