"""Matching and pose queries over the embeddings, with their SQL.

A label is an image, its vectors are the keypoints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.scale import running_total
from ..session import durable
from . import tables as T
from .point_clouds import rounded

c = F.col


def keypoints(spark, sf):
    v = T.load(spark, sf, "embeddings")
    e = F.transform("embedding", lambda x: x.cast("double"))
    placed = running_total(v.select(c("label").alias("image_id"), "vec_id", e.alias("descriptor")), ["image_id"], [c("vec_id")],
                           "kp_idx")
    d = c("descriptor")
    return placed.select("image_id", "kp_idx", F.round((d[0] + 1) / 2, 6).alias("x"), F.round((d[1] + 1) / 2, 6).alias("y"),
                         F.round((d[2] + 1) / 2, 6).alias("score"), "descriptor")


def pairs(spark, sf):
    """Consecutive images."""
    images = T.load(spark, sf, "embeddings").select(c("label").alias("left_image")).distinct()
    nxt = images.select((c("left_image") - 1).alias("left_image"), c("left_image").alias("right_image"))
    return images.join(nxt, "left_image")


def images(kps):
    return kps.groupBy("image_id").agg(
        F.round(F.avg("x"), 4).alias("brightness"), F.round(F.avg("y"), 4).alias("contrast"),
        F.round(F.avg("score"), 4).alias("sharpness"), (F.count(F.lit(1)) * 2000).alias("pixel_count"))


KEYPOINTS_SQL = """
kp AS (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS kp_idx,
    round((embedding[1]::DOUBLE + 1) / 2, 6) AS x, round((embedding[2]::DOUBLE + 1) / 2, 6) AS y,
    round((embedding[3]::DOUBLE + 1) / 2, 6) AS score, embedding::DOUBLE[] AS d FROM embeddings),
imgs AS (SELECT image_id, round(avg(x), 4) AS b, round(avg(y), 4) AS t, round(avg(score), 4) AS s, count(*) * 2000 AS p,
    avg(score) AS m, count(*) AS keypoints FROM kp GROUP BY image_id),
features AS (SELECT image_id, keypoints, round(least(0.99::DOUBLE, m * 0.45::DOUBLE + (b + t + s) / 3 * 0.4::DOUBLE
    + least(p / 120000.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE), 4) AS feature_score FROM imgs),
dist AS (SELECT l.image_id AS left_image, r.image_id AS right_image, l.kp_idx AS li, r.kp_idx AS ri,
    list_sum(list_transform(range(1, 65), lambda i: abs(l.d[i] - r.d[i]))) / 64 AS d
  FROM kp l JOIN kp r ON r.image_id = l.image_id + 1),
lr AS (SELECT *, row_number() OVER (PARTITION BY left_image, li ORDER BY d, ri) AS k,
    lead(d) OVER (PARTITION BY left_image, li ORDER BY d, ri) AS second FROM dist),
rl AS (SELECT *, row_number() OVER (PARTITION BY left_image, ri ORDER BY d, li) AS k FROM dist),
corr AS (SELECT a.left_image, a.right_image, a.li AS left_idx, a.ri AS right_idx, a.d AS distance
  FROM lr a JOIN rl b ON a.left_image = b.left_image AND a.li = b.li AND a.ri = b.ri AND a.k = 1 AND b.k = 1
  WHERE NOT (a.d / greatest(coalesce(a.second, a.d + 1), 1e-6::DOUBLE) > 0.86 AND a.d > 0.22)),
edges AS (SELECT g.*, round(least(0.99::DOUBLE, 0.2::DOUBLE + matched_pairs / greatest(least(l.keypoints, r.keypoints), 1)::DOUBLE
    * 0.45::DOUBLE + greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, average_distance)) * 0.25::DOUBLE
    + (l.feature_score + r.feature_score) / 2 * 0.1::DOUBLE), 4) AS confidence
  FROM (SELECT left_image, right_image, count(*) AS matched_pairs, avg(distance) AS average_distance FROM corr GROUP BY 1, 2) g
  JOIN features l ON l.image_id = left_image JOIN features r ON r.image_id = right_image)"""

POSE_SQL = KEYPOINTS_SQL + """,
ends AS (SELECT *, left_image AS image_id, 'left' AS side FROM edges
  UNION ALL SELECT *, right_image, 'right' FROM edges),
best AS (SELECT image_id, left_image, right_image, side, confidence FROM ends WHERE matched_pairs >= 4
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, left_image) = 1),
oriented AS (SELECT b.image_id, b.left_image, b.right_image, b.confidence, left_idx AS position,
    CASE side WHEN 'left' THEN b.right_image ELSE b.left_image END AS other_image,
    CASE side WHEN 'left' THEN l.x ELSE r.x END AS source_x, CASE side WHEN 'left' THEN l.y ELSE r.y END AS source_y,
    CASE side WHEN 'left' THEN l.score ELSE r.score END AS source_score,
    CASE side WHEN 'left' THEN r.x ELSE l.x END AS target_x, CASE side WHEN 'left' THEN r.y ELSE l.y END AS target_y,
    CASE side WHEN 'left' THEN r.score ELSE l.score END AS target_score
  FROM best b JOIN corr q ON q.left_image = b.left_image AND q.right_image = b.right_image
    JOIN kp l ON l.image_id = q.left_image AND l.kp_idx = q.left_idx
    JOIN kp r ON r.image_id = q.right_image AND r.kp_idx = q.right_idx),
mids AS (SELECT image_id, max(confidence) AS confidence, avg(source_x) AS sx, avg(source_y) AS sy, avg(target_x) AS tx,
    avg(target_y) AS ty FROM oriented GROUP BY 1 HAVING count(*) >= 4),
turns AS (SELECT image_id, avg(sqrt(pow(source_x - sx, 2) + pow(source_y - sy, 2))) AS rs,
    avg(sqrt(pow(target_x - tx, 2) + pow(target_y - ty, 2))) AS rt,
    atan2(sum(sin(atan2(target_y - ty, target_x - tx) - atan2(source_y - sy, source_x - sx))),
      sum(cos(atan2(target_y - ty, target_x - tx) - atan2(source_y - sy, source_x - sx)))) AS yaw
  FROM oriented JOIN mids USING (image_id) GROUP BY 1),
poses AS (SELECT image_id, round(mids.confidence, 4) AS confidence,
    round((tx - sx) * (rt / greatest(rs, 1e-6::DOUBLE)) * 2.5::DOUBLE, 6) + 0.0 AS t0,
    round((ty - sy) * (rt / greatest(rs, 1e-6::DOUBLE)) * 2.5::DOUBLE, 6) + 0.0 AS t1,
    round(0.75::DOUBLE + feature_score * 0.65::DOUBLE + mids.confidence * 0.4::DOUBLE, 6) AS t2,
    round(sin(yaw / 2), 6) + 0.0 AS qz, round(cos(yaw / 2), 6) + 0.0 AS qw
  FROM mids JOIN turns USING (image_id) JOIN features USING (image_id))"""


def _base(spark, sf):
    kps = durable(keypoints(spark, sf))
    return kps, durable(M.match_descriptors(pairs(spark, sf), kps))


def edges(spark, sf):
    kps, corr = _base(spark, sf)
    return M.match_edges(corr, M.feature_score(images(kps), kps))


def oriented(spark, sf):
    kps, corr = _base(spark, sf)
    features = M.feature_score(images(kps), kps)
    best = M.best_match_per_image(M.match_edges(corr, features))
    return durable(M.orient_pairs(best, corr, kps)), features


def poses(spark, sf):
    return M.estimate_poses(*oriented(spark, sf)).select(
        "image_id", "confidence", *[c("translation")[i].alias(f"t{i}") for i in range(3)],
        c("rotation")[2].alias("qz"), c("rotation")[3].alias("qw"), c("matrix")[0][0].alias("m00"),
        c("matrix")[1][0].alias("m10"))


def lifted(spark, sf):
    rows, features = oriented(spark, sf)
    return rounded(M.lift_points(rows, M.estimate_poses(rows, features), 48), 4)


def binary_keypoints(spark, sf):
    """Keypoints whose descriptor is the sign pattern of the vector."""
    bits = F.aggregate("descriptor", F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(
        F.when(v > 0, 1).otherwise(0).cast("bigint")))
    return keypoints(spark, sf).withColumn("descriptor", bits)


BINARY_SQL = KEYPOINTS_SQL.replace(
    "list_sum(list_transform(range(1, 65), lambda i: abs(l.d[i] - r.d[i]))) / 64 AS d",
    "len(list_filter(range(1, 65), lambda i: (l.d[i] > 0) <> (r.d[i] > 0)))::DOUBLE AS d")

QUERIES = {
    "match_descriptors": lambda s, d: rounded(_base(s, d)[1]),
    "match_binary_descriptors": lambda s, d: rounded(M.match_binary_descriptors(pairs(s, d), binary_keypoints(s, d))),
    "match_ratio": lambda s, d: rounded(M.match_ratio(pairs(s, d), binary_keypoints(s, d), 22)),
    "feature_score": lambda s, d: M.feature_score(images(keypoints(s, d)), keypoints(s, d)),
    "match_edges": lambda s, d: rounded(edges(s, d)),
    "image_confidence": lambda s, d: M.image_confidence(edges(s, d)),
    "best_match_per_image": lambda s, d: M.best_match_per_image(edges(s, d)),
    "orient_pairs": lambda s, d: oriented(s, d)[0],
    "estimate_poses": poses,
    "lift_points": lifted,
}

ORACLES = {
    "match_descriptors": f"""WITH {KEYPOINTS_SQL}
SELECT left_image, right_image, left_idx, right_idx, round(distance, 6) AS distance FROM corr""",
    "match_binary_descriptors": f"""WITH {BINARY_SQL}, p AS (SELECT * FROM lr WHERE k = 1
  AND (second IS NULL OR NOT (d / greatest(second, 1e-6::DOUBLE) > 0.86 AND d > 24)))
SELECT left_image, right_image, li AS left_idx, ri AS right_idx, round(d / 255.0::DOUBLE, 6) AS distance FROM p
QUALIFY row_number() OVER (PARTITION BY left_image, ri ORDER BY li) = 1""",
    "match_ratio": f"""WITH {BINARY_SQL}, g AS (SELECT a.left_image, count(*) AS good FROM lr a JOIN rl b
  ON a.left_image = b.left_image AND a.li = b.li AND a.ri = b.ri AND a.k = 1 AND b.k = 1 WHERE a.d <= 22 GROUP BY 1)
SELECT l.image_id AS left_image, r.image_id AS right_image,
  round(coalesce(good, 0) / greatest(1, least(l.keypoints, r.keypoints))::DOUBLE, 6) AS match_ratio
FROM imgs l JOIN imgs r ON r.image_id = l.image_id + 1 LEFT JOIN g ON g.left_image = l.image_id""",
    "feature_score": f"WITH {KEYPOINTS_SQL} SELECT image_id, feature_score, keypoints FROM features",
    "match_edges": f"""WITH {KEYPOINTS_SQL}
SELECT left_image, right_image, matched_pairs, round(average_distance, 6) AS average_distance, confidence FROM edges""",
    "image_confidence": f"""WITH {POSE_SQL} SELECT image_id, max(confidence) AS confidence FROM ends GROUP BY 1""",
    "best_match_per_image": f"WITH {POSE_SQL} SELECT * FROM best",
    "orient_pairs": f"WITH {POSE_SQL} SELECT * FROM oriented",
    "estimate_poses": f"""WITH {POSE_SQL}
SELECT image_id, confidence, t0, t1, t2, qz, qw, round(1 - 2 * (qz * qz), 6) + 0.0 AS m00, round(2 * qz * qw, 6) + 0.0 AS m10
FROM poses""",
    "lift_points": f"""WITH {POSE_SQL}, f AS (SELECT o.*, p.confidence AS pc, t0, t1, t2, atan2(2 * qz * qw, 1 - 2 * (qz * qz)) AS yaw,
    0.65::DOUBLE + p.confidence * 0.8::DOUBLE + (1 - least(abs(source_x - target_x) + abs(source_y - target_y), 1.0::DOUBLE))
      * 0.55::DOUBLE AS depth
  FROM oriented o JOIN poses p USING (image_id)
  QUALIFY row_number() OVER (PARTITION BY o.image_id ORDER BY position) <= 48),
l AS (SELECT *, ((source_x + target_x) / 2 - 0.5::DOUBLE) * depth * 2 AS lx,
    ((source_y + target_y) / 2 - 0.5::DOUBLE) * depth * 2 AS ly FROM f)
SELECT image_id AS source_image, position,
  {T.half_up('round(t0 + round(cos(yaw) * lx - sin(yaw) * ly, 6), 6)', 4)} AS x,
  {T.half_up('round(t1 + round(sin(yaw) * lx + cos(yaw) * ly, 6), 6)', 4)} AS y,
  {T.half_up('round(t2 + depth * 0.35::DOUBLE, 6)', 4)} AS z,
  round(0.4::DOUBLE + pc * 0.45::DOUBLE + (source_score + target_score) * 0.1::DOUBLE, 4) AS intensity FROM l""",
}
