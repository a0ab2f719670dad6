"""Descriptor matching, camera poses and lifted 3-D points.

``keypoints`` holds image_id, kp_idx, x, y, score, descriptor; ``pairs`` holds
left_image, right_image. Descriptors meet block against block: an image is cut
into blocks of bounded size and each task compares two blocks, so neither an
image nor the list of all keypoint pairs is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pose_matrix, quaternion_yaw, rotate, yaw_quaternion
from ..session import durable
from .scale import first_rows

BLOCK = 8_192
#: Distances that are compared at once, and tasks that pairs of blocks are dealt to at most.
SCAN, MOST_TASKS = 262_144, 20_000
RATIO, ABSOLUTE = 0.86, 0.22
BINARY_ABSOLUTE = 24
PAIR = ["left_image", "right_image"]


def _blocks(keypoints: DataFrame, block: int) -> DataFrame:
    """Sorted kp_idx and descriptors (one after the other) per image and block."""
    rows = F.sort_array(F.collect_list(F.struct("kp_idx", "descriptor")))
    flat = F.col("_r.descriptor")
    vectors = dict(keypoints.dtypes)["descriptor"].startswith("array")
    return keypoints.groupBy("image_id", F.floor(F.col("kp_idx") / block).alias("block")).agg(rows.alias("_r")).select(
        "image_id", "block", F.col("_r.kp_idx").cast("array<bigint>").alias("idx"),
        (F.flatten(flat).cast("array<double>") if vectors else flat.cast("array<bigint>")).alias("desc"))


class _Nearest:
    """The two closest counterparts seen so far of every row: distances and row numbers; of equal ones the lower number."""

    def __init__(self, rows: int):
        self.d = np.full((2, rows), np.inf)
        self.n = np.full((2, rows), -1)

    def add(self, row: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        """Take in candidates: their row, distance and number; each pair of row and number comes once."""
        own = np.unique(row)
        row = np.concatenate([row, own, own])
        d = np.concatenate([d, self.d[0, own], self.d[1, own]])
        n = np.concatenate([n, self.n[0, own], self.n[1, own]])
        order = np.lexsort((n, d, row))
        row, d, n = row[order], d[order], n[order]
        first = np.searchsorted(row, own)
        for place in (0, 1):
            self.d[place, own], self.n[place, own] = d[first + place], n[first + place]


def _two_smallest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two smallest values of every row; the largest value of the type where there is one only."""
    top = np.iinfo(d.dtype).max
    rows, at = np.arange(len(d)), d.argmin(1)
    least = d[rows, at]
    d[rows, at] = top
    second = d.min(1)
    d[rows, at] = least
    return least, second


def _steps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sets in whole steps of one scale, and by how many a sum of differences may be off: by what the two rows were rounded.

    A sum over all components stays below the largest 16-bit number.
    """
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    steps = 65_534 // a.shape[1] - 1
    scale = steps / (high - low) if high > low and np.isfinite(steps / (high - low)) else 0.0
    scaled = [(x - low) * scale if scale else np.zeros_like(x) for x in (a, b)]
    steps_ = [np.rint(x) for x in scaled]
    # One more for the rounding of these sums themselves.
    off = sum(np.abs(x - q).sum(axis=1).max() for x, q in zip(scaled, steps_, strict=True))
    return *(q.astype(np.int16) for q in steps_), int(np.ceil(off)) + 1


def _candidates(a: np.ndarray, b: np.ndarray, binary: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b, distance) that hold the two closest of every row of either side."""
    if not binary and (not np.isfinite(a).all() or not np.isfinite(b).all() or not 0 < a.shape[1] <= 8_192):
        # Such distances can't be bounded: all of them, but those that are none.
        for at in range(0, len(a), 16):
            for by in range(0, len(b), 1_024):
                d = np.abs(a[at:at + 16, None, :] - b[None, by:by + 1_024, :]).sum(axis=2) / a.shape[1]
                i, j = np.nonzero(~np.isnan(d))
                yield i + at, j + by, d[i, j]
        return
    if binary:
        slack = 0
    else:
        qa, qb, off = _steps(a, b)
        qb, slack = np.ascontiguousarray(qb.T), 2 * off
    # Two smallest of every row of b so far.
    least, second = (np.full(len(b), 65_535, dtype=np.uint16) for _ in range(2))
    rows = max(1, min(len(a), SCAN // len(b)))
    total, step = np.empty((rows, len(b)), dtype=np.uint16), np.empty((rows, len(b)), dtype=np.int16)
    for at in range(0, len(a), rows):
        here = min(rows, len(a) - at)
        q, t = total[:here], step[:here]
        if binary:
            q[:] = np.bitwise_count(a[at:at + here, None] ^ b[None, :])
        else:
            q[:] = 0
            for k in range(len(qb)):
                np.subtract(qb[k][None, :], qa[at:at + here, k][:, None], out=t)
                np.abs(t, out=t)
                np.add(q, t.view(np.uint16), out=q)
        for r in range(here):
            np.minimum(second, np.maximum(least, q[r]), out=second)
            np.minimum(least, q[r], out=least)
        bound = np.minimum(_two_smallest(q)[1].astype(np.int32) + slack, 65_535).astype(np.uint16)
        other = np.minimum(second.astype(np.int32) + slack, 65_535).astype(np.uint16)
        near = q <= bound[:, None]
        near |= q <= other[None, :]
        i, j = np.divmod(np.flatnonzero(near), len(b))
        for by in range(0, len(i), SCAN):
            u, v = i[by:by + SCAN], j[by:by + SCAN]
            yield u + at, v, q[u, v].astype(float) if binary else np.abs(a[u + at] - b[v]).sum(axis=1) / a.shape[1]


def two_nearest(pairs: DataFrame, keypoints: DataFrame, binary: bool = False, block: int = BLOCK) -> DataFrame:
    """Two closest counterparts of every keypoint, from both sides of every image pair.

    Mean absolute difference of vector descriptors, or Hamming distance of
    BIGINT ones. Ties go to the lower index. All pairs of descriptors are
    compared, vectors first in whole steps of 16 bits, whose error is bounded;
    what may be among the two closest is then measured exactly. Every pair of
    blocks is a task's row of its own.
    """
    blocks = durable(_blocks(keypoints, block))
    ids = pairs.select(*PAIR).join(blocks.select(F.col("image_id").alias("left_image"), F.col("block").alias("l_block")), "left_image").join(
        blocks.select(F.col("image_id").alias("right_image"), F.col("block").alias("r_block")), "right_image").select(
        *PAIR, "l_block", "r_block")
    ids = durable(ids)
    count = ids.count()
    met = ids
    for side, image in (("l", "left_image"), ("r", "right_image")):
        met = met.join(blocks.select(F.col("image_id").alias(image), F.col("block").alias(f"{side}_block"),
                                     F.col("idx").alias(f"{side}_idx"), F.col("desc").alias(f"{side}_desc")), [image, f"{side}_block"])
    met = met.select(*PAIR, "l_idx", "l_desc", "r_idx", "r_desc").repartition(max(1, min(count, MOST_TASKS)))
    kind = dict(met.dtypes)
    schema = (f"left_image {kind['left_image']}, right_image {kind['right_image']}, side string, idx bigint, "
              "d1 double, n1 bigint, d2 double, n2 bigint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                left, right, *sides = batch.slice(k, 1).columns
                li, a, ri, b = (s.flatten().to_numpy(zero_copy_only=False) for s in sides)
                if binary:
                    a, b = a.view(np.uint64), b.view(np.uint64)
                else:
                    a, b = a.reshape(len(li), -1), b.reshape(len(ri), -1)
                ends = _Nearest(len(li)), _Nearest(len(ri))
                for i, j, d in _candidates(a, b, binary):
                    ends[0].add(i, d, j)
                    ends[1].add(j, d, i)
                for side, own, other, near in (("left", li, ri, ends[0]), ("right", ri, li, ends[1])):
                    known = near.n >= 0
                    d, n = np.where(known, near.d, np.nan), np.where(known, other[near.n], -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(left[0], len(own)), pa.repeat(right[0], len(own)), pa.repeat(side, len(own)), pa.array(own),
                         pa.array(d[0]), pa.array(n[0]), pa.array(d[1]), pa.array(n[1])],
                        names=["left_image", "right_image", "side", "idx", "d1", "n1", "d2", "n2"])

    # Two candidates per pair of blocks are merged, so the list stays short.
    two = F.array(F.struct(F.col("d1").alias("d"), F.col("n1").alias("n")),
                  F.struct(F.col("d2").alias("d"), F.col("n2").alias("n")))
    merged = F.sort_array(F.flatten(F.collect_list(F.filter(two, lambda e: ~F.isnan(e["d"])))))
    return met.mapInArrow(compare, schema).groupBy(*PAIR, "side", "idx").agg(merged.alias("_m")).select(
        *PAIR, "side", "idx", F.col("_m")[0]["d"].alias("distance"), F.col("_m")[0]["n"].alias("nearest"),
        F.get("_m", F.lit(1))["d"].alias("second"))


def _passes(ratio: float, absolute: float, second: Column) -> Column:
    return ~((F.col("distance") / F.greatest(second, F.lit(1e-6)) > ratio) & (F.col("distance") > absolute))


def mutual_matches(near: DataFrame) -> DataFrame:
    """Keypoints that are each other's nearest."""
    left = near.filter(F.col("side") == "left").select(
        *PAIR, F.col("idx").alias("left_idx"), F.col("nearest").alias("right_idx"), "distance", "second")
    right = near.filter(F.col("side") == "right").select(
        *PAIR, F.col("idx").alias("right_idx"), F.col("nearest").alias("left_idx"))
    return left.join(right, [*PAIR, "left_idx", "right_idx"])


def match_descriptors(pairs: DataFrame, keypoints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Correspondences: mutual nearest neighbours that pass the ratio test."""
    second = F.coalesce("second", F.col("distance") + 1.0)
    return mutual_matches(two_nearest(pairs, keypoints, block=block)).filter(_passes(RATIO, ABSOLUTE, second)).drop("second")


def match_binary_descriptors(pairs: DataFrame, keypoints: DataFrame, block: int = BLOCK) -> DataFrame:
    """One-way ratio matches on bits; the first left keypoint takes a right one."""
    near = two_nearest(pairs, keypoints, binary=True, block=block).filter(F.col("side") == "left")
    passed = near.filter(F.col("second").isNull() | _passes(RATIO, BINARY_ABSOLUTE, F.col("second")))
    return passed.groupBy(*PAIR, F.col("nearest").alias("right_idx")).agg(
        F.min(F.struct(F.col("idx").alias("left_idx"), F.col("distance"))).alias("_f")).select(
        *PAIR, "_f.left_idx", "right_idx", (F.col("_f.distance") / 255.0).alias("distance"))


def match_ratio(pairs: DataFrame, keypoints: DataFrame, limit: int = 64, block: int = BLOCK) -> DataFrame:
    """Share of cross-checked matches within ``limit`` bits of the smaller keypoint set."""
    good = mutual_matches(two_nearest(pairs, keypoints, binary=True, block=block)).filter(
        F.col("distance") <= limit).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_good"))
    sizes = keypoints.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.select(*PAIR).join(sizes.select(F.col("image_id").alias("left_image"), F.col("_n").alias("_nl")), "left_image", "left").join(
        sizes.select(F.col("image_id").alias("right_image"), F.col("_n").alias("_nr")), "right_image", "left")
    smaller = F.greatest(F.lit(1), F.least(F.coalesce("_nl", F.lit(0)), F.coalesce("_nr", F.lit(0))))
    return both.join(good, PAIR, "left").select(
        *PAIR, (F.coalesce("_good", F.lit(0)) / smaller).alias("match_ratio"))


def feature_score(images: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Score of an image from its keypoints, pixel quality and size."""
    c = F.col
    points = keypoints.groupBy("image_id").agg(F.avg("score").alias("_mean"), F.count(F.lit(1)).alias("keypoints"))
    quality = (c("brightness") + c("contrast") + c("sharpness")) / 3
    density = F.least(c("pixel_count") / 120_000, F.lit(1.0))
    score = F.when(
        c("_mean").isNull(), F.round(F.least(F.lit(0.95), quality * 0.85 + density * 0.15), 4)
    ).otherwise(F.round(F.least(F.lit(0.99), c("_mean") * 0.45 + quality * 0.4 + density * 0.15), 4))
    return images.join(points, "image_id", "left").select(
        "image_id", score.alias("feature_score"), F.coalesce("keypoints", F.lit(0)).alias("keypoints"))


def match_edges(correspondences: DataFrame, features: DataFrame) -> DataFrame:
    """One edge per image pair: match count, mean distance and confidence."""
    c = F.col
    grouped = correspondences.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("matched_pairs"), F.avg("distance").alias("average_distance"))
    side = {n: features.select(c("image_id").alias(f"{n}_image"), c("feature_score").alias(f"_{n}s"),
                               c("keypoints").alias(f"_{n}k")) for n in ("left", "right")}
    df = grouped.join(side["left"], "left_image").join(side["right"], "right_image")
    overlap = c("matched_pairs") / F.greatest(F.least("_leftk", "_rightk"), F.lit(1))
    quality = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c("average_distance")))
    score = (c("_lefts") + c("_rights")) / 2
    return df.select(
        *PAIR, "matched_pairs", "average_distance",
        F.round(F.least(F.lit(0.99), F.lit(0.2) + overlap * 0.45 + quality * 0.25 + score * 0.1), 4).alias("confidence"))


def _endpoints(edges: DataFrame) -> DataFrame:
    """Every edge once per end, with the side the image is on."""
    sides = F.array(F.struct(F.col("left_image").alias("image_id"), F.lit("left").alias("side")),
                    F.struct(F.col("right_image").alias("image_id"), F.lit("right").alias("side")))
    return edges.select("*", F.inline(sides))


def image_confidence(edges: DataFrame) -> DataFrame:
    return _endpoints(edges).groupBy("image_id").agg(F.max("confidence").alias("confidence"))


def best_match_per_image(edges: DataFrame, min_pairs: int = 4) -> DataFrame:
    """The most confident edge with enough matches at every image; earlier left image on ties."""
    good = _endpoints(edges.filter(F.col("matched_pairs") >= min_pairs))
    best = F.max(F.struct("confidence", (-F.col("left_image")).alias("_neg"), *PAIR, "side"))
    return good.groupBy("image_id").agg(best.alias("_b")).select(
        "image_id", *[f"_b.{n}" for n in (*PAIR, "side", "confidence")])


def orient_pairs(best: DataFrame, correspondences: DataFrame, keypoints: DataFrame) -> DataFrame:
    """Matched points of every image's best edge, seen from that image."""
    c = F.col
    joined = best.join(correspondences.select(*PAIR, "left_idx", "right_idx"), PAIR)
    is_left = c("side") == "left"
    placed = joined.select(
        "image_id", *PAIR, "confidence", c("left_idx").alias("position"),
        F.when(is_left, c("right_image")).otherwise(c("left_image")).alias("other_image"),
        F.when(is_left, c("left_idx")).otherwise(c("right_idx")).alias("_s"),
        F.when(is_left, c("right_idx")).otherwise(c("left_idx")).alias("_t"))
    for end, image, idx in (("source", "image_id", "_s"), ("target", "other_image", "_t")):
        points = keypoints.select(
            c("image_id").alias(image), c("kp_idx").alias(idx),
            *[c(n).alias(f"{end}_{n}") for n in ("x", "y", "score")])
        placed = placed.join(points, [image, idx])
    return placed.drop("_s", "_t")


def estimate_poses(oriented: DataFrame, features: DataFrame) -> DataFrame:
    """Camera pose of every image from its best edge."""
    c = F.col
    mids = oriented.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("confidence").alias("confidence"),
        *[F.avg(f"{e}_{a}").alias(f"_{e[0]}{a}") for e in ("source", "target") for a in "xy"]
    ).filter(c("_n") >= 4)
    # An edge has at most as many matches as an image has keypoints; one row per image comes back.
    joined = oriented.select("image_id", *[f"{e}_{a}" for e in ("source", "target") for a in "xy"]).join(
        mids.drop("confidence", "_n"), "image_id")
    ds = [c(f"source_{a}") - c(f"_s{a}") for a in "xy"]
    dt = [c(f"target_{a}") - c(f"_t{a}") for a in "xy"]
    turn = F.atan2(dt[1], dt[0]) - F.atan2(ds[1], ds[0])
    spread = joined.groupBy("image_id").agg(
        F.avg(F.sqrt(ds[0] * ds[0] + ds[1] * ds[1])).alias("_rs"),
        F.avg(F.sqrt(dt[0] * dt[0] + dt[1] * dt[1])).alias("_rt"),
        F.atan2(F.sum(F.sin(turn)), F.sum(F.cos(turn))).alias("yaw"))
    df = mids.join(spread, "image_id").join(features.select("image_id", "feature_score"), "image_id")
    scale = c("_rt") / F.greatest(c("_rs"), F.lit(1e-6))
    translation = F.array(
        F.round((c("_tx") - c("_sx")) * scale * 2.5, 6), F.round((c("_ty") - c("_sy")) * scale * 2.5, 6),
        F.round(F.lit(0.75) + c("feature_score") * 0.65 + c("confidence") * 0.4, 6))
    return df.select("image_id", translation.alias("translation"), yaw_quaternion(c("yaw")).alias("rotation"),
                     F.round("confidence", 4).alias("confidence")).withColumn(
        "matrix", pose_matrix(c("translation"), c("rotation")))


def lift_points(oriented: DataFrame, poses: DataFrame, per_pose: int) -> DataFrame:
    """3-D points from the first ``per_pose`` matches of every pose: midpoint, disparity depth, turn, shift."""
    c = F.col
    first = first_rows(oriented.drop("confidence"), ["image_id"], [c("position")], per_pose)
    df = first.join(poses.select("image_id", "translation", "rotation", "confidence"), "image_id")
    gap = F.abs(c("source_x") - c("target_x")) + F.abs(c("source_y") - c("target_y"))
    df = df.withColumn("_depth", F.lit(0.65) + c("confidence") * 0.8 + (1.0 - F.least(gap, F.lit(1.0))) * 0.55)
    depth = c("_depth")
    lx = ((c("source_x") + c("target_x")) / 2 - 0.5) * depth * 2.0
    ly = ((c("source_y") + c("target_y")) / 2 - 0.5) * depth * 2.0
    wx, wy = rotate(lx, ly, quaternion_yaw(c("rotation")))
    t = c("translation")
    return df.select(
        c("image_id").alias("source_image"), "position",
        F.round(t[0] + wx, 6).alias("x"), F.round(t[1] + wy, 6).alias("y"), F.round(t[2] + depth * 0.35, 6).alias("z"),
        F.round(F.lit(0.4) + c("confidence") * 0.45 + (c("source_score") + c("target_score")) * 0.1, 4).alias("intensity"))


def reconstruct(pairs: DataFrame, keypoints: DataFrame, images: DataFrame, per_pose: int) -> DataFrame:
    """Matches, edges, poses and lifted points in one go."""
    correspondences = durable(match_descriptors(pairs, keypoints))
    features = feature_score(images, keypoints)
    best = best_match_per_image(match_edges(correspondences, features))
    oriented = durable(orient_pairs(best, correspondences, keypoints))
    return lift_points(oriented, estimate_poses(oriented, features), per_pose)
