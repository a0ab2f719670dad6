"""Image-batch queries over 8x8 thumbnails of the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as Geo
from ..functions import pixels as Px
from ..operators import images as I
from ..operators import kernels as K
from ..operators import predict as P
from ..operators import selection as Sel
from ..operators import similarity as S
from ..session import durable
from ..sources.readers import IMAGE_SUFFIXES
from . import tables as T
from .point_clouds import rounded

c = F.col
GATES = {"dark": 0.488, "bright": 0.512, "margin": 0.004, "sharp_reject": 0.30, "sharp_warn": 0.31,
         "min_width": 800, "min_height": 600, "min_pixels": 500_000}


def metrics(spark, sf):
    """Thumbnails with every pixel metric, through the Arrow kernel."""
    sums = T.images(spark, sf).withColumn("sums", K.thumbnail_sums(c("px")))
    return K.metrics_from_sums(sums).select(
        "image_id", "project_id", "name", "width", "height", "pixel_count", "px", "brightness", "contrast",
        "sharpness", "blur_score", (c("sums.strong") * 4).alias("keypoint_count"), "sums.dhash", "sums.phash")


def array_metrics(spark, sf):
    """The same metrics from array expressions."""
    px = c("px")
    edges = T.images(spark, sf).withColumn("edges", Px.edge_map(px, 8, 8))
    return edges.select(
        "image_id", "project_id", "name", "width", "height", "pixel_count",
        Px.brightness(px).alias("brightness"), Px.contrast(px).alias("contrast"),
        Px.sharpness(c("edges")).alias("sharpness"), Px.blur_score(Px.laplacian(px, 8, 8)).alias("blur_score"),
        (F.size(F.filter("edges", lambda e: e >= 120)) * 4).alias("keypoint_count"),
        Px.difference_hash(px, 8, 8).alias("dhash"), Px.pooled_hash(px).alias("phash"),
    )


_AROUND = " + ".join(f"px[i + 1 + {dy * 8 + dx}]" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0))

METRICS_SQL = T.IMAGES_SQL + f""",
m0 AS (SELECT *, list_transform(range(0, 64), lambda i: CASE WHEN i % 8 IN (0, 7) OR i // 8 IN (0, 7) THEN px[i + 1]
      ELSE greatest(0, least(255, px[i + 1] * 8 - ({_AROUND}))) END) AS edges,
    list_transform(range(0, 64), lambda i:
      px[(i // 8) * 8 + CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END + 1]
      + px[(i // 8) * 8 + CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END + 1]
      + px[CASE WHEN i // 8 = 0 THEN 1 ELSE i // 8 - 1 END * 8 + i % 8 + 1]
      + px[CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END * 8 + i % 8 + 1] - 4 * px[i + 1]) AS lap
  FROM images),
m1 AS (SELECT *, list_sum(px)::BIGINT AS s, list_sum(list_transform(px, lambda v: v * v))::BIGINT AS s2,
    list_sum(edges)::BIGINT AS e, list_sum(list_transform(edges, lambda v: v * v))::BIGINT AS e2,
    list_sum(lap)::BIGINT AS l, list_sum(list_transform(lap, lambda v: v * v))::BIGINT AS l2 FROM m0),
metrics AS (SELECT image_id, project_id, name, width, height, pixel_count, px,
    round(s / 64.0::DOUBLE / 255.0::DOUBLE, 4) AS brightness,
    round(sqrt((64 * s2 - s * s) / 4096.0::DOUBLE) / 255.0::DOUBLE, 4) AS contrast,
    round(least(1.0::DOUBLE, e / 64.0::DOUBLE / 255.0::DOUBLE * 0.7::DOUBLE
      + sqrt((64 * e2 - e * e) / 4096.0::DOUBLE) / 255.0::DOUBLE * 0.3::DOUBLE), 4) AS sharpness,
    round((64 * l2 - l * l) / 4096.0::DOUBLE, 4) AS blur_score,
    (len(list_filter(edges, lambda v: v >= 120)) * 4)::INT AS keypoint_count,
    list_reduce(list_transform(range(0, 56), lambda i:
      CASE WHEN px[(i // 7) * 8 + i % 7 + 1] > px[(i // 7) * 8 + i % 7 + 2] THEN 1 ELSE 0 END::BIGINT),
      lambda a, b: a * 2 + b) AS dhash,
    list_reduce(list_transform(range(0, 16), lambda i: CASE WHEN px[i * 4 + 1] > px[i * 4 + 3] THEN 1 ELSE 0 END::BIGINT),
      lambda a, b: a * 2 + b) AS phash
  FROM m1)"""


def gated(spark, sf):
    return I.quality_reasons(metrics(spark, sf), IMAGE_SUFFIXES, **GATES)


GATED_SQL = METRICS_SQL + f""",
g0 AS (SELECT *, NOT regexp_matches(lower(name), '\\.(bmp|jpeg|jpg|png|tif|tiff|webp)$') AS odd FROM metrics),
gated AS (SELECT *, list_filter([CASE WHEN odd THEN 'unsupported_extension' END,
    CASE WHEN NOT odd AND (width < {GATES['min_width']} OR height < {GATES['min_height']}
      OR pixel_count < {GATES['min_pixels']}) THEN 'low_resolution' END,
    CASE WHEN NOT odd AND brightness < {GATES['dark']}::DOUBLE THEN 'underexposed' END,
    CASE WHEN NOT odd AND brightness > {GATES['bright']}::DOUBLE THEN 'overexposed' END,
    CASE WHEN NOT odd AND sharpness < {GATES['sharp_reject']}::DOUBLE THEN 'blurry' END], lambda r: r IS NOT NULL)
    AS rejected_reasons,
  list_filter([
    CASE WHEN NOT odd AND brightness >= {GATES['dark']}::DOUBLE AND brightness <= {GATES['bright']}::DOUBLE
      AND brightness < {GATES['dark']}::DOUBLE + {GATES['margin']}::DOUBLE THEN 'near_underexposed' END,
    CASE WHEN NOT odd AND brightness >= {GATES['dark']}::DOUBLE AND brightness <= {GATES['bright']}::DOUBLE
      AND brightness > {GATES['bright']}::DOUBLE - {GATES['margin']}::DOUBLE THEN 'near_overexposed' END,
    CASE WHEN NOT odd AND sharpness >= {GATES['sharp_reject']}::DOUBLE AND sharpness < {GATES['sharp_warn']}::DOUBLE
      THEN 'slightly_blurry' END], lambda r: r IS NOT NULL) AS warning_reasons FROM g0),
judged AS (SELECT *, CASE WHEN len(rejected_reasons) > 0 THEN 'rechazada' WHEN len(warning_reasons) > 0 THEN 'advertida'
    ELSE 'apta' END AS status FROM gated)"""


def text_reasons(df):
    return df.withColumns({n: F.concat_ws("|", n) for n in ("rejected_reasons", "warning_reasons")})


def scored(spark, sf):
    return I.quality_score(gated(spark, sf))


SCORED_SQL = GATED_SQL + """,
scored AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sharpness * 0.55::DOUBLE
    + (1.0::DOUBLE - least(1.0::DOUBLE, abs(brightness - 0.5::DOUBLE) / 0.5::DOUBLE)) * 0.25::DOUBLE
    + pixel_count::DOUBLE / max(pixel_count) OVER (PARTITION BY project_id) * 0.2::DOUBLE
    - least(0.25::DOUBLE, len(warning_reasons) * 0.03::DOUBLE)
    - CASE WHEN status = 'advertida' THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END)) AS quality_score FROM judged)"""


def boxes(spark, sf):
    """Object boxes from bright pixels of the thumbnails, on a 640 x 480 canvas."""
    m = metrics(spark, sf)
    lit = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: c("px")[i] >= 140)
    m = m.withColumn("lit", lit).filter(F.size("lit") > 0)
    xs, ys = F.transform("lit", lambda i: i % 8), F.transform("lit", lambda i: F.floor(i / 8).cast("int"))
    m = m.withColumns({
        "left": F.array_min(xs) * 80, "right": (F.array_max(xs) + 1) * 80,
        "top": F.array_min(ys) * 60, "bottom": (F.array_max(ys) + 1) * 60,
        "width": F.lit(640), "height": F.lit(480),
        "object_pixels": F.size("lit") * 4800, "assisted": c("image_id") % 2 == 0,
        "sharpness": c("sharpness") / 20.0, "saturation_coverage": F.size("lit") / 64.0,
    })
    p = [c("px")[i] % 20 for i in range(4)]
    return m.withColumns({
        "q0x": c("left"), "q0y": c("top") + p[0], "q1x": c("right") - p[1], "q1y": c("top"),
        "q2x": c("right"), "q2y": c("bottom") - p[2], "q3x": c("left") + p[3], "q3y": c("bottom"),
    })


BOXES_SQL = METRICS_SQL + """,
lit0 AS (SELECT * EXCLUDE (width, height, sharpness), sharpness / 20.0::DOUBLE AS sharpness, 640 AS width, 480 AS height,
    list_filter(range(0, 64), lambda i: px[i + 1] >= 140) AS lit FROM metrics),
lit1 AS (SELECT *, list_min(list_transform(lit, lambda i: i % 8)) * 80 AS "left",
    (list_max(list_transform(lit, lambda i: i % 8)) + 1) * 80 AS "right",
    list_min(list_transform(lit, lambda i: i // 8)) * 60 AS "top",
    (list_max(list_transform(lit, lambda i: i // 8)) + 1) * 60 AS bottom,
    len(lit) * 4800 AS object_pixels, image_id % 2 = 0 AS assisted, len(lit) / 64.0::DOUBLE AS saturation_coverage
  FROM lit0 WHERE len(lit) > 0),
boxes AS (SELECT *, "left" AS q0x, "top" + px[1] % 20 AS q0y, "right" - px[2] % 20 AS q1x, "top" AS q1y,
    "right" AS q2x, bottom - px[3] % 20 AS q2y, "left" + px[4] % 20 AS q3x, bottom AS q3y FROM lit1)"""


def _c01(e):
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"


def _peak(e, t, s):
    return _c01(f"1.0::DOUBLE - abs({e} - {t}::DOUBLE) / {s}::DOUBLE")


_DIST = "sqrt(({0}x - {1}x) * ({0}x - {1}x) + ({0}y - {1}y) * ({0}y - {1}y))".format

OBSERVED_SQL = BOXES_SQL + f""",
o0 AS (SELECT *, ("right" - "left")::DOUBLE AS bw, (bottom - "top")::DOUBLE AS bh,
    {_DIST('q0', 'q1')} AS topw, {_DIST('q3', 'q2')} AS botw,
    abs(q0x * q1y - q1x * q0y + q1x * q2y - q2x * q1y + q2x * q3y - q3x * q2y + q3x * q0y - q0x * q3y) * 0.5::DOUBLE AS qa,
    abs(degrees(atan2((q1y - q0y)::DOUBLE, (q1x - q0x)::DOUBLE))) AS t0 FROM boxes),
o1 AS (SELECT *, bw / bh AS width_height_ratio, bw * bh / 307200 AS foreground_ratio,
    CASE WHEN assisted THEN qa ELSE object_pixels END / (bw * bh) AS rectangularity,
    CASE WHEN t0 % 180 > 90 THEN 180 - t0 % 180 ELSE t0 % 180 END AS t1,
    least(1.0::DOUBLE, sqrt(pow((("left" + "right") * 0.5::DOUBLE - 320) / 320, 2)
      + pow((("top" + bottom) * 0.5::DOUBLE - 240) / 240, 2))) AS center_offset,
    {_c01('least(topw, botw) / greatest(topw, botw, 1e-6::DOUBLE)')} AS perspective_ratio FROM o0),
o2 AS (SELECT *, least(t1, abs(90 - t1)) AS tilt_degrees FROM o1 WHERE foreground_ratio >= 0.03),
o3 AS (SELECT *,
    {_c01('1 - tilt_degrees / 30')} * 0.4::DOUBLE + {_c01('1 - center_offset')} * 0.2::DOUBLE
      + {_peak('foreground_ratio', 0.2, 0.25)} * 0.4::DOUBLE AS frontal_score,
    {_peak('width_height_ratio', 0.6, 0.75)} * 0.45::DOUBLE + {_peak('perspective_ratio', 0.65, 0.45)} * 0.35::DOUBLE
      + {_c01('1 - center_offset')} * 0.2::DOUBLE AS side_score,
    CASE WHEN botw > 1e-6 THEN {_c01('(botw - topw) / botw')} ELSE 0 END * 0.45::DOUBLE
      + {_peak('width_height_ratio', 1.6, 1.6)} * 0.35::DOUBLE + {_c01('1 - center_offset')} * 0.2::DOUBLE AS top_score,
    {_peak('brightness', 0.55, 0.45)} AS lighting_score, {_peak('width_height_ratio', 1.8, 1.05)} AS face_ratio_score,
    {_c01('sharpness / 0.025::DOUBLE')} AS sharp, {_c01('rectangularity / 0.75::DOUBLE')} AS rect FROM o2),
observed AS (SELECT *, CASE WHEN assisted THEN sharp * 0.25::DOUBLE + frontal_score * 0.25::DOUBLE
      + face_ratio_score * 0.2::DOUBLE + rect * 0.2::DOUBLE + lighting_score * 0.1::DOUBLE
    ELSE sharp * 0.28::DOUBLE + frontal_score * 0.26::DOUBLE + face_ratio_score * 0.2::DOUBLE + rect * 0.16::DOUBLE
      + lighting_score * 0.1::DOUBLE END AS selection_score FROM o3)"""

_OBS = ["width_height_ratio", "foreground_ratio", "rectangularity", "tilt_degrees", "center_offset",
        "perspective_ratio", "frontal_score", "side_score", "top_score", "lighting_score", "face_ratio_score",
        "selection_score"]


def segmentation(spark, sf):
    """Segmentation outcomes derived from the object boxes."""
    return boxes(spark, sf).select(
        "image_id", "project_id", c("name").alias("filename"),
        F.when(c("object_pixels") >= 40_000, "segmented").otherwise("fallback_original").alias("status"),
        F.when(c("image_id") % 5 == 0, F.lit(None)).when(c("object_pixels") % 9600 == 0, "threshold").otherwise(
            "saturation").alias("method"),
        F.round(c("object_pixels") / 307_200.0, 6).alias("foreground_ratio"),
        (c("object_pixels") >= 60_000).alias("segmentation_success"))


SEG_SQL = BOXES_SQL + """,
seg AS (SELECT image_id, project_id, name AS filename,
    CASE WHEN object_pixels >= 40000 THEN 'segmented' ELSE 'fallback_original' END AS status,
    CASE WHEN image_id % 5 = 0 THEN NULL WHEN object_pixels % 9600 = 0 THEN 'threshold' ELSE 'saturation' END AS method,
    round(object_pixels / 307200.0::DOUBLE, 6) AS foreground_ratio, object_pixels >= 60000 AS segmentation_success
  FROM boxes)"""


def shared_name(count: int):
    """A file name that images of one project and of several have in common."""
    return F.concat(F.lit("Shot_"), c("image_id") % count, F.lit(".jpg"))


def attach_validation(spark, sf):
    def path(count):
        return F.concat(F.lit("in/"), "project_id", F.lit("/"), shared_name(count)).alias("path")

    known = gated(spark, sf).select("image_id", path(37), "status", "warning_reasons", "width", "height", "pixel_count",
                                    "brightness", "sharpness")
    cand = T.images(spark, sf).select("image_id", path(40))
    return I.attach_validation(cand, known, "image_id").withColumn("warning_reasons", F.concat_ws("|", "warning_reasons"))


def attach_segmentation(spark, sf):
    records = segmentation(spark, sf).select(
        "project_id", F.upper(shared_name(37)).alias("filename"), "image_id", "status", "foreground_ratio")
    images = T.images(spark, sf).select(c("image_id").alias("id"), "project_id", shared_name(40).alias("name"))
    return I.attach_segmentation(images, records, "image_id")


def attach_foreground(spark, sf):
    ratios = segmentation(spark, sf).select(
        "project_id", F.concat(F.lit(" "), shared_name(37)).alias("filename"), "image_id", "foreground_ratio")
    images = T.images(spark, sf).select("image_id", "project_id", shared_name(40).alias("name"))
    return I.attach_foreground(images, ratios, "image_id")


def deduped(spark, sf):
    m = metrics(spark, sf).select("image_id", "project_id", "name", "phash")
    return S.dedupe_images(m, ["project_id"], [F.lower("name"), c("name"), c("image_id")], "phash", 2, 3,
                           bits=16)


def deduped_by_quality(spark, sf):
    """Near-duplicates in quality order, the better image first."""
    m = rounded(scored(spark, sf).select("image_id", "project_id", "name", "phash", "quality_score"))
    return S.dedupe_images(m, ["project_id"], [-c("quality_score"), F.lower("name"), c("name"), c("image_id")], "phash", 2, 3,
                           bits=16).drop("quality_score")


def selection_gates(spark, sf):
    """Gate on the number of accepted, sharp images of a batch."""
    counted = gated(spark, sf).groupBy("project_id").agg(
        F.count_if((c("status") != I.REJECTED) & (c("sharpness") > 0.31)).alias("selected_images"))
    gates = counted.withColumn("selected_images", c("selected_images") - c("project_id") * 4)
    return gates.withColumn("blocking_reasons", F.concat_ws("|", I.selection_gate(c("selected_images"))))


def selected(spark, sf):
    return rounded(Sel.select_images(scored(spark, sf).filter(c("status") != I.REJECTED), hash_col="phash", bits=16,
                                     near_duplicate=1, apart=4, min_quality=0.6, max_images=30))


def hybrid(spark, sf):
    """Candidate pairs judged by both hashes and the share of agreeing pixels."""
    m = durable(metrics(spark, sf).select("image_id", "project_id", "px", "dhash", "phash"))
    judged = S.judged_pairs(m, ["project_id"], 3, 24).withColumn("match_ratio", F.round(c("alike") / 64.0, 6)).withColumnRenamed(
        "other_distance", "dhash_distance")
    return judged.select(
        "project_id", "left_id", "right_id", "dhash_distance", c("distance").alias("phash_distance"), "match_ratio",
        S.hybrid_duplicate(c("dhash_distance"), c("distance"), c("match_ratio")).alias("duplicate"))


def datasets(spark, sf):
    """Dataset summaries with scores, verdict inputs and predictions."""
    m = durable(I.identification_confidence(metrics(spark, sf)).withColumn(
        "phash64", F.shiftleft("dhash", 8)))
    summary = I.dataset_summary(m)
    angle = I.angular_coverage(m, "phash64")
    pairs = S.similar_pair_counts(m, ["project_id"], "phash", 2, 16)
    joined = summary.join(angle, "project_id").join(pairs, "project_id").withColumn(
        "duplicate_ratio", I.duplicate_ratio(c("similar_pairs"), c("images")))
    return I.dataset_scores(joined)


SETS_SQL = METRICS_SQL + """,
conf AS (SELECT *, CASE WHEN blur_score >= 60 AND keypoint_count >= 100 THEN 'high'
    WHEN blur_score >= 30 AND keypoint_count >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM metrics),
sums AS (SELECT project_id, count(*) AS n, avg(width) AS w, avg(height) AS h, avg(pixel_count / 1e6::DOUBLE) AS mp,
    avg(blur_score) AS sh, avg(brightness) AS br, avg(keypoint_count) AS ft,
    (count(*) FILTER (confidence <> 'low'))::DOUBLE / count(*) AS us,
    (count(*) FILTER (confidence = 'high'))::DOUBLE / count(*) AS hi,
    (count(*) FILTER (confidence = 'medium'))::DOUBLE / count(*) AS me,
    (count(*) FILTER (confidence = 'low'))::DOUBLE / count(*) AS lo,
    stddev_pop(blur_score) AS s1, stddev_pop(brightness) AS s2, stddev_pop(keypoint_count) AS s3,
    count(DISTINCT (dhash::HUGEINT * 256) % 12) / 12.0::DOUBLE AS angle FROM conf GROUP BY project_id),
dups AS (SELECT a.project_id, count(*) AS similar_pairs FROM metrics a JOIN metrics b ON a.project_id = b.project_id
    AND a.image_id < b.image_id AND bit_count(xor(a.phash, b.phash)) <= 2 GROUP BY 1),
sets0 AS (SELECT s.*, coalesce(d.similar_pairs, 0) AS similar_pairs,
    CASE WHEN n >= 2 THEN coalesce(d.similar_pairs, 0) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END AS dr
  FROM sums s LEFT JOIN dups d USING (project_id)),
sets1 AS (SELECT *, 1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, dr / 0.35::DOUBLE)) AS fresh,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s1 / greatest(1.0::DOUBLE, sh) + s2 / greatest(0.05::DOUBLE, br)
      + s3 / greatest(1.0::DOUBLE, ft)) / 1.2::DOUBLE)) AS spread FROM sets0),
sets2 AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, fresh * 0.6::DOUBLE + spread * 0.4::DOUBLE)) AS variety FROM sets1),
sets AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (n - 20.0::DOUBLE) / 40.0::DOUBLE)) * 0.18::DOUBLE
    + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sh - 35.0::DOUBLE) / 105.0::DOUBLE)) * 0.18::DOUBLE
    + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ft - 60.0::DOUBLE) / 160.0::DOUBLE)) * 0.22::DOUBLE
    + fresh * 0.16::DOUBLE + us * 0.14::DOUBLE + variety * 0.07::DOUBLE + angle * 0.05::DOUBLE)), 6) AS ready FROM sets2)"""

_SET_COLS = """project_id, n AS image_count_valid, round(w, 6) AS average_width, round(h, 6) AS average_height,
  round(mp, 6) AS average_megapixels, round(sh, 6) AS average_sharpness, round(br, 6) AS average_brightness,
  round(ft, 6) AS average_feature_points, round(us, 6) AS usable_images_ratio, round(hi, 6) AS high_confidence_ratio,
  round(me, 6) AS medium_confidence_ratio, round(lo, 6) AS low_confidence_ratio,
  round(angle, 6) AS angular_coverage_score, n AS images, similar_pairs, round(dr, 6) AS duplicate_ratio,
  round(variety, 6) AS visual_variety_score, ready AS mesh_readiness_score"""

_FIT = """n >= 20 AND us >= 0.45 AND ft >= 55 AS fit_for_sparse,
  n >= 30 AND us >= 0.6 AND ft >= 90 AND angle >= 0.45 AND ready >= 0.45 AS fit_for_surface,
  n >= 45 AND us >= 0.75 AND ft >= 120 AND angle >= 0.6 AND ready >= 0.65 AS fit_for_dense"""


def verdicts(spark, sf):
    d = datasets(spark, sf).withColumns({
        "image_count_unreadable": (c("project_id") % 4 * 5).cast("bigint"),
        "average_sharpness": c("average_sharpness") / 60.0})
    return I.dataset_verdict(d, 48, 55, 0.02).select(
        "project_id", F.concat_ws("|", "warnings").alias("warnings"), "recommendation", F.concat_ws("|", "problems").alias("problems"))


def suggestions(spark, sf):
    d = datasets(spark, sf).withColumns({
        "image_count_total": c("image_count_valid"), "average_sharpness": c("average_sharpness") / 60.0})
    return I.capture_suggestions(P.predict_success(d)).select(
        "project_id", "missing_for_45", "missing_for_60", F.concat_ws("|", "advice").alias("advice"), "final_advice",
        F.concat_ws("|", "actions").alias("actions"), "predicted_success_level", "recommended_profile")


def coverage(spark, sf):
    return I.coverage_summary(metrics(spark, sf), "phash", 16, warn_distance=6)


def gate(spark, sf):
    judged = gated(spark, sf)
    cover = coverage(spark, sf)
    out = I.batch_gate(I.batch_summary(judged), cover, min_images=12, block_on_coverage=True)
    return out.withColumn("blocking_reasons", F.concat_ws("|", "blocking_reasons"))


def box_geometry(spark, sf):
    b = boxes(spark, sf)
    box = [c(n) for n in ("left", "top", "right", "bottom")]
    w, h = c("width"), c("height")
    quad = [(c(f"q{i}x"), c(f"q{i}y")) for i in range(4)]
    rel = [c("left") / 700.0, c("top") / 500.0, c("right") / 700.0, c("bottom") / 500.0]
    padded = Geo.pad_box(box, w, h)
    return b.select(
        "image_id", *[p.alias(f"pad_{n}") for p, n in zip(padded, ("l", "t", "r", "b"))],
        F.concat_ws(",", Geo.relative_to_absolute_box(rel, w, h)).alias("absolute"),
        Geo.border_touches(box, w, h).alias("touches"), Geo.quad_usable(quad, w, h).alias("quad_usable"),
        I.needs_refinement(box, w, h).alias("needs_refinement"),
        I.strip_side(c("left"), c("right"), w).alias("strip_side"),
        F.round(Geo.center_offset(box, w, h, 0.55, 1.5), 6).alias("low_center_offset"),
        F.size(Geo.relative_to_absolute_quad([(x / 700.0, y / 500.0) for x, y in quad], w, h)).alias("quad_points"),
        Geo.hash_hex(c("dhash")).alias("hash_hex"))


QUERIES = {
    "image_metrics": lambda s, d: metrics(s, d).drop("px"),
    "image_metrics_arrays": array_metrics,
    "quality_reasons": lambda s, d: text_reasons(gated(s, d)).select(
        "image_id", "rejected_reasons", "warning_reasons", "status"),
    "preprocess_status": lambda s, d: I.preprocess_status(
        metrics(s, d).withColumns({"blur_score": c("blur_score") / 150.0, "contrast": c("contrast") - 0.02}),
        F.when(c("project_id") > 4, "quality").otherwise("balanced")).select(
        "image_id", F.concat_ws("|", "preprocess_warnings").alias("warnings"), "preprocess_status"),
    "identification_confidence": lambda s, d: I.identification_confidence(metrics(s, d)).select(
        "image_id", "confidence", "usable"),
    "batch_summary": lambda s, d: I.batch_summary(gated(s, d)),
    "reason_counts": lambda s, d: I.reason_counts(gated(s, d), "rejected_reasons"),
    "keep_accepted": lambda s, d: I.keep_accepted(
        T.images(s, d), gated(s, d).filter(c("status") != I.REJECTED)).select("image_id", "name"),
    "attach_validation": attach_validation,
    "attach_segmentation": attach_segmentation,
    "attach_foreground": attach_foreground,
    "quality_score": lambda s, d: rounded(scored(s, d).select("image_id", "project_id", "quality_score")),
    "rank_by_quality": lambda s, d: I.rank_by_quality(
        rounded(scored(s, d).select("image_id", "project_id", "name", "quality_score"))),
    "stage_manifest": lambda s, d: I.stage_manifest(gated(s, d).filter(c("status") != I.REJECTED)),
    "consecutive_pairs": lambda s, d: I.consecutive_pairs(
        I.name_order(T.images(s, d)), ["project_id"], [c(n) for n in I.NAME_ORDER]).select(
        "project_id", "image_id", "next_image_id"),
    "neighbor_similarity": lambda s, d: I.neighbor_similarity(metrics(s, d), "phash"),
    "nearest_hamming": lambda s, d: S.nearest_hamming(metrics(s, d), ["project_id"], "dhash"),
    "coverage_summary": coverage,
    "batch_gate": gate,
    "hamming_join": lambda s, d: S.hamming_join(metrics(s, d), ["project_id"], "phash", 3, 16),
    "hamming_join_wide": lambda s, d: S.hamming_join(metrics(s, d), ["project_id"], "dhash", 20),
    "similar_pairs": lambda s, d: S.similar_pairs(metrics(s, d), ["project_id"], "phash", 2, bits=16),
    "hybrid_duplicates": hybrid,
    "dedupe_images": deduped,
    "dedupe_by_quality": deduped_by_quality,
    "selection_gate": selection_gates,
    "select_images": selected,
    "segmentation_summary": lambda s, d: I.segmentation_summary(segmentation(s, d), block=True, min_ratio=0.5)
    .withColumn("blocking_reasons", F.concat_ws("|", "blocking_reasons")),
    "target_count": lambda s, d: I.batch_summary(gated(s, d)).select(
        "project_id", I.target_count(c("total_images"), c("accepted_images"), max_images=60).alias("target"),
        I.target_count(c("total_images"), c("total_images"), 0.5, 2, 25).alias("capped")),
    "shape_observations": lambda s, d: rounded(I.shape_observations(boxes(s, d)).select("image_id", *_OBS)),
    "best_face_view": lambda s, d: I.best_face_view(I.shape_observations(boxes(s, d))),
    "rank_texture_views": lambda s, d: I.rank_texture_views(I.attach_foreground(
        metrics(s, d).withColumn("blur_score", c("blur_score") / 30.0), segmentation(s, d), "image_id"), 6),
    "mean_color": lambda s, d: I.mean_color(metrics(s, d).select(
        "project_id", *[F.aggregate(F.slice("px", i * 20 + 1, 20), F.lit(0), lambda a, v: a + v).alias(f"s{i}")
                        for i in range(3)]).select(
        "project_id", *[(c(f"s{i}") / 20.0).alias(f"mean_{ch}") for i, ch in enumerate("rgb")])),
    "crop_score": lambda s, d: rounded(I.crop_score(boxes(s, d)).select("image_id", "crop_score")),
    "box_geometry": box_geometry,
    "dataset_summary": lambda s, d: rounded(datasets(s, d)),
    "dataset_verdict": verdicts,
    "capture_suggestions": suggestions,
}

_FLIST = "array_to_string({0}, '|') AS {0}".format
_NAMEORD = "lower(name), name, image_id"

ORACLES = {
    "image_metrics": f"WITH {METRICS_SQL} SELECT * EXCLUDE (px) FROM metrics",
    "image_metrics_arrays": f"WITH {METRICS_SQL} SELECT * EXCLUDE (px) FROM metrics",
    "quality_reasons": f"""WITH {GATED_SQL} SELECT image_id, {_FLIST('rejected_reasons')}, {_FLIST('warning_reasons')},
  status FROM judged""",
    "preprocess_status": f"""WITH {METRICS_SQL}, w AS (SELECT image_id, list_filter([
    CASE WHEN brightness < 0.12 THEN 'low_brightness' END, CASE WHEN brightness > 0.92 THEN 'high_brightness' END,
    CASE WHEN contrast - 0.02::DOUBLE < 0.08::DOUBLE THEN 'low_contrast' END,
    CASE WHEN blur_score / 150.0::DOUBLE < CASE WHEN project_id > 4 THEN 45 ELSE 30 END THEN 'possible_blur' END],
    lambda r: r IS NOT NULL) AS w FROM metrics)
SELECT image_id, array_to_string(w, '|') AS warnings, CASE WHEN len(w) > 0 THEN 'warning' ELSE 'accepted' END
  AS preprocess_status FROM w""",
    "identification_confidence": f"""WITH {METRICS_SQL}, k AS (SELECT image_id,
    CASE WHEN blur_score >= 60 AND keypoint_count >= 100 THEN 'high' WHEN blur_score >= 30 AND keypoint_count >= 50
      THEN 'medium' ELSE 'low' END AS confidence FROM metrics)
SELECT *, confidence <> 'low' AS usable FROM k""",
    "batch_summary": f"""WITH {GATED_SQL}
SELECT project_id, count(*) AS total_images, count(*) FILTER (status = 'apta') AS valid_images,
  count(*) FILTER (status = 'advertida') AS warning_images, count(*) FILTER (status = 'rechazada') AS rejected_images,
  count(*) FILTER (status <> 'rechazada') AS accepted_images FROM judged GROUP BY project_id""",
    "reason_counts": f"""WITH {GATED_SQL}
SELECT project_id, reason, count(*) AS count FROM (SELECT project_id, unnest(rejected_reasons) AS reason FROM judged)
GROUP BY ALL""",
    "keep_accepted": f"WITH {GATED_SQL} SELECT image_id, name FROM judged WHERE status <> 'rechazada'",
    "attach_validation": f"""WITH {GATED_SQL},
v AS (SELECT *, 'in/' || project_id || '/Shot_' || image_id % 37 || '.jpg' AS path FROM judged
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY image_id DESC) = 1),
k AS (SELECT image_id, 'in/' || project_id || '/Shot_' || image_id % 40 || '.jpg' AS path FROM images)
SELECT k.image_id, path, coalesce(v.status, 'apta') AS status,
  coalesce(array_to_string(warning_reasons, '|'), '') AS warning_reasons, coalesce(width, 0) AS width,
  coalesce(height, 0) AS height, coalesce(pixel_count, 0) AS pixel_count, coalesce(brightness, 0) AS brightness,
  coalesce(sharpness, 0) AS sharpness
FROM k LEFT JOIN v USING (path)""",
    "attach_segmentation": f"""WITH {SEG_SQL}, r AS (SELECT project_id, image_id % 37 AS k, status, foreground_ratio FROM seg
  QUALIFY row_number() OVER (PARTITION BY project_id, k ORDER BY image_id DESC) = 1)
SELECT i.image_id AS id, i.project_id, 'Shot_' || i.image_id % 40 || '.jpg' AS name, status, foreground_ratio
FROM images i LEFT JOIN r ON i.project_id = r.project_id AND i.image_id % 40 = r.k""",
    "attach_foreground": f"""WITH {SEG_SQL}, r AS (SELECT project_id, image_id % 37 AS k, foreground_ratio FROM seg
  QUALIFY row_number() OVER (PARTITION BY project_id, k ORDER BY image_id DESC) = 1)
SELECT i.image_id, i.project_id, 'Shot_' || i.image_id % 40 || '.jpg' AS name,
  CASE WHEN r.k IS NULL THEN 0.25::DOUBLE ELSE coalesce(foreground_ratio, 0) END AS foreground_ratio
FROM images i LEFT JOIN r ON i.project_id = r.project_id AND i.image_id % 40 = r.k""",
    "quality_score": f"WITH {SCORED_SQL} SELECT image_id, project_id, round(quality_score, 6) AS quality_score FROM scored",
    "rank_by_quality": f"""WITH {SCORED_SQL}, r AS (SELECT image_id, project_id, name, round(quality_score, 6) AS quality_score
  FROM scored)
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY quality_score DESC, {_NAMEORD}) AS rank FROM r""",
    "stage_manifest": f"""WITH {GATED_SQL}, p AS (SELECT project_id, image_id, name,
    row_number() OVER (PARTITION BY project_id ORDER BY {_NAMEORD}) AS position FROM judged WHERE status <> 'rechazada')
SELECT *, printf('%03d_%s', position, name) AS staged_name FROM p""",
    "consecutive_pairs": f"""WITH {T.IMAGES_SQL}
SELECT project_id, image_id, lead(image_id) OVER w AS next_image_id FROM images
WINDOW w AS (PARTITION BY project_id ORDER BY {_NAMEORD}) QUALIFY next_image_id IS NOT NULL""",
    "neighbor_similarity": f"""WITH {METRICS_SQL}, n AS (SELECT project_id, bit_count(xor(phash, lead(phash) OVER (
    PARTITION BY project_id ORDER BY {_NAMEORD}))) AS d FROM metrics)
SELECT project_id, round((count(*) FILTER (d <= 6))::DOUBLE / greatest(1, count(*) - 1), 4) AS neighbor_similarity_ratio
FROM n GROUP BY project_id""",
    "nearest_hamming": f"""WITH {METRICS_SQL}
SELECT a.project_id, a.dhash AS hash, count(DISTINCT a.image_id) AS copies, min(bit_count(xor(a.dhash, b.dhash)))::INT AS nearest
FROM metrics a JOIN metrics b ON a.project_id = b.project_id AND a.image_id <> b.image_id GROUP BY 1, 2""",
    "coverage_summary": f"""WITH {METRICS_SQL}, near AS (SELECT a.project_id, a.image_id, min(bit_count(xor(a.phash, b.phash))) AS d
  FROM metrics a JOIN metrics b ON a.project_id = b.project_id AND a.image_id <> b.image_id GROUP BY 1, 2),
med AS (SELECT project_id, floor(median(d))::INT AS m FROM near GROUP BY 1),
nb AS (SELECT project_id, bit_count(xor(phash, lead(phash) OVER (PARTITION BY project_id ORDER BY {_NAMEORD}))) AS d FROM metrics),
nr AS (SELECT project_id, round((count(*) FILTER (d <= 6))::DOUBLE / greatest(1, count(*) - 1), 4) AS r FROM nb GROUP BY 1),
u AS (SELECT project_id, count(*) AS images, round(count(DISTINCT phash)::DOUBLE / count(*), 4) AS q FROM metrics GROUP BY 1)
SELECT project_id, images, q AS unique_hash_ratio, m AS median_nearest_hamming, r AS neighbor_similarity_ratio,
  (q < 0.55 AND m < 8) OR r > 0.7 AS possible_low_coverage
FROM u JOIN med USING (project_id) JOIN nr USING (project_id)""",
    "hamming_join": f"""WITH {METRICS_SQL}, h AS (SELECT DISTINCT project_id, phash FROM metrics)
SELECT x.project_id, x.phash AS a, y.phash AS b, bit_count(xor(x.phash, y.phash))::INT AS distance
FROM h x JOIN h y ON x.project_id = y.project_id AND x.phash < y.phash AND bit_count(xor(x.phash, y.phash)) <= 3""",
    "hamming_join_wide": f"""WITH {METRICS_SQL}, h AS (SELECT DISTINCT project_id, dhash FROM metrics)
SELECT x.project_id, x.dhash AS a, y.dhash AS b, bit_count(xor(x.dhash, y.dhash))::INT AS distance
FROM h x JOIN h y ON x.project_id = y.project_id AND x.dhash < y.dhash AND bit_count(xor(x.dhash, y.dhash)) <= 20""",
    "similar_pairs": f"""WITH {METRICS_SQL}
SELECT a.project_id, a.image_id AS left_id, b.image_id AS right_id, bit_count(xor(a.phash, b.phash))::INT AS distance
FROM metrics a JOIN metrics b ON a.project_id = b.project_id AND a.image_id < b.image_id
  AND bit_count(xor(a.phash, b.phash)) <= 2""",
    "hybrid_duplicates": f"""WITH {METRICS_SQL}, p AS (
  SELECT a.project_id, a.image_id AS left_id, b.image_id AS right_id, bit_count(xor(a.dhash, b.dhash))::INT AS dhash_distance,
    bit_count(xor(a.phash, b.phash))::INT AS phash_distance,
    round(len(list_filter(range(1, 65), lambda i: abs(a.px[i] - b.px[i]) <= 24)) / 64.0::DOUBLE, 6) AS match_ratio
  FROM metrics a JOIN metrics b ON a.project_id = b.project_id AND a.image_id < b.image_id
    AND bit_count(xor(a.phash, b.phash)) <= 3)
SELECT *, (dhash_distance <= 6 AND phash_distance <= 8 AND match_ratio >= 0.45)
  OR ((dhash_distance <= 6 OR phash_distance <= 10) AND match_ratio >= 0.72) AS duplicate FROM p""",
    "segmentation_summary": f"""WITH {SEG_SQL}, mc AS (SELECT project_id, coalesce(method, 'unknown') AS m, count(*) AS n, min(image_id) AS f
  FROM seg GROUP BY ALL),
top AS (SELECT project_id, m FROM mc QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, f) = 1),
t AS (SELECT project_id, count(*) AS candidate_images, count(*) FILTER (status = 'segmented') AS segmented_images,
    round(avg(foreground_ratio), 6) AS foreground_ratio, bool_or(segmentation_success) AS segmentation_success
  FROM seg GROUP BY 1),
b AS (SELECT t.*, m AS segmentation_method, round(segmented_images::DOUBLE / candidate_images, 4) AS segmentation_ratio,
    list_filter([CASE WHEN segmented_images < least(2, candidate_images) THEN 'insufficient_segmented_images' END,
      CASE WHEN segmented_images::DOUBLE / candidate_images < 0.5 THEN 'segmented_ratio_below_threshold' END],
      lambda r: r IS NOT NULL) AS br FROM t JOIN top USING (project_id))
SELECT * EXCLUDE (br), array_to_string(br, '|') AS blocking_reasons, len(br) = 0 AS allow_processing FROM b""",
    "target_count": f"""WITH {GATED_SQL}, s AS (SELECT project_id, count(*) AS t, count(*) FILTER (status <> 'rechazada') AS a
  FROM judged GROUP BY 1)
SELECT project_id, CASE WHEN a <= 0 THEN 0 ELSE least(greatest(6, greatest(1, round_even(t * 0.75::DOUBLE, 0)::INT)), 60, a)::INT END
  AS target, least(greatest(2, greatest(1, round_even(t * 0.5::DOUBLE, 0)::INT)), 25, t)::INT AS capped FROM s""",
    "shape_observations": f"""WITH {OBSERVED_SQL}
SELECT image_id, {', '.join(f'round({n}, 6) AS {n}' for n in _OBS)} FROM observed""",
    "best_face_view": f"""WITH {OBSERVED_SQL}, s AS (
  SELECT project_id, image_id, 'front' AS face, frontal_score * 0.55::DOUBLE + selection_score * 0.2::DOUBLE + sharp * 0.12::DOUBLE
    + face_ratio_score * 0.08::DOUBLE + {_c01('1 - center_offset')} * 0.05::DOUBLE
    + CASE WHEN assisted THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS score FROM observed
  UNION ALL SELECT project_id, image_id, 'side', side_score * 0.58::DOUBLE + sharp * 0.14::DOUBLE + lighting_score * 0.12::DOUBLE
    + {_c01('1 - center_offset')} * 0.1::DOUBLE + selection_score * 0.06::DOUBLE
    + CASE WHEN assisted THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END FROM observed
  UNION ALL SELECT project_id, image_id, 'top', top_score * 0.58::DOUBLE + sharp * 0.14::DOUBLE + lighting_score * 0.12::DOUBLE
    + {_c01('1 - center_offset')} * 0.1::DOUBLE + selection_score * 0.06::DOUBLE
    + CASE WHEN assisted THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END FROM observed)
SELECT project_id, face, image_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY project_id, face ORDER BY score DESC, image_id) = 1""",
    "rank_texture_views": f"""WITH {SEG_SQL}, s AS (SELECT m.project_id, m.image_id, m.name, (
    least(1.0::DOUBLE, blur_score / 30.0::DOUBLE / 500.0::DOUBLE) * 0.45::DOUBLE
    + least(1.0::DOUBLE, keypoint_count / 220.0::DOUBLE) * 0.35::DOUBLE
    + coalesce(foreground_ratio, 0.25::DOUBLE) * 0.2::DOUBLE) AS score
  FROM metrics m LEFT JOIN seg ON m.image_id = seg.image_id)
SELECT project_id, image_id, name, round(score, 6) AS score,
  row_number() OVER (PARTITION BY project_id ORDER BY s.score DESC, name, image_id) AS rank FROM s QUALIFY rank <= 6""",
    "mean_color": f"""WITH {T.IMAGES_SQL}
SELECT project_id, round(avg(list_sum(px[1:20]) / 20.0::DOUBLE), 0)::INT AS r,
  round(avg(list_sum(px[21:40]) / 20.0::DOUBLE), 0)::INT AS g, round(avg(list_sum(px[41:60]) / 20.0::DOUBLE), 0)::INT AS b
FROM images GROUP BY 1""",
    "crop_score": f"""WITH {OBSERVED_SQL}, k AS (SELECT *, ("right" - "left") * (bottom - "top") / 307200.0::DOUBLE AS ar,
    ("right" - "left")::DOUBLE / (bottom - "top") AS rt, sqrt(pow(("left" + "right") * 0.5::DOUBLE / 640 - 0.5::DOUBLE, 2)
      + pow(("top" + bottom) * 0.5::DOUBLE / 480 - 0.55::DOUBLE, 2)) AS aw FROM boxes)
SELECT image_id, round({_peak('ar', 0.18, 0.17)} * 0.28::DOUBLE + {_peak('rt', 1.6, 0.8)} * 0.23::DOUBLE
  + {_c01('1 - aw / 0.65::DOUBLE')} * 0.18::DOUBLE + {_peak('saturation_coverage', 0.17, 0.14)} * 0.21::DOUBLE
  + {_c01('sharpness / 0.025::DOUBLE')} * 0.1::DOUBLE, 6) AS crop_score FROM k""",
    "box_geometry": f"""WITH {OBSERVED_SQL}, a AS (SELECT *, greatest(0, "left" - 29) AS pl, least(640, "right" + 29) AS pr,
    greatest(0, "top" - 29) AS pt, least(480, bottom + 29) AS pb,
    round("left" / 700.0::DOUBLE * 640)::INT AS abs_l, round("right" / 700.0::DOUBLE * 640)::INT AS abs_r,
    round("top" / 500.0::DOUBLE * 480)::INT AS abs_t, round(bottom / 500.0::DOUBLE * 480)::INT AS abs_b,
    abs(q0x * q1y - q1x * q0y + q1x * q2y - q2x * q1y + q2x * q3y - q3x * q2y + q3x * q0y - q0x * q3y) * 0.5::DOUBLE / 307200 AS qs,
    len(list_filter([[q0x, q0y], [q1x, q1y], [q2x, q2y], [q3x, q3y]],
      lambda q: q[1] <= 2 OR q[1] >= 638 OR q[2] <= 2 OR q[2] >= 478)) AS qt,
    greatest(({_DIST('q0', 'q1')} + {_DIST('q3', 'q2')}) * 0.5::DOUBLE, 1e-6::DOUBLE)
      / greatest(({_DIST('q0', 'q3')} + {_DIST('q1', 'q2')}) * 0.5::DOUBLE, 1e-6::DOUBLE) AS qr,
    (CASE WHEN "left" <= 1 THEN 1 ELSE 0 END + CASE WHEN "top" <= 1 THEN 1 ELSE 0 END
      + CASE WHEN "right" >= 639 THEN 1 ELSE 0 END + CASE WHEN bottom >= 479 THEN 1 ELSE 0 END) AS touches,
    ("right" - "left")::DOUBLE / (bottom - "top") AS asp FROM boxes),
p AS (SELECT *, greatest(4, round((abs_r - abs_l) * 0.06::DOUBLE)::INT) AS px_, greatest(4, round((abs_b - abs_t) * 0.06::DOUBLE)::INT) AS py_ FROM a)
SELECT image_id, pl::INT AS pad_l, pt::INT AS pad_t, pr::INT AS pad_r, pb::INT AS pad_b,
  greatest(0, abs_l - px_) || ',' || greatest(0, abs_t - py_) || ',' || least(640, abs_r + px_) || ',' || least(480, abs_b + py_) AS absolute,
  touches, qs BETWEEN 0.01 AND 0.55 AND qt <= 1 AND qr BETWEEN 0.4 AND 3.0 AS quad_usable,
  ("right" - "left") * (bottom - "top") / 307200.0::DOUBLE > 0.42 OR touches >= 2 OR asp < 0.45 OR asp > 3.1 AS needs_refinement,
  CASE WHEN ("left" + "right") * 0.5::DOUBLE / 640 >= 0.5 THEN 'left' ELSE 'right' END AS strip_side,
  round(least(1.5::DOUBLE, sqrt(pow((("left" + "right") * 0.5::DOUBLE - 320) / 320, 2)
    + pow((("top" + bottom) * 0.5::DOUBLE - 264) / 264, 2))), 6) AS low_center_offset,
  4 AS quad_points, lpad(lower(to_hex(dhash)), 16, '0') AS hash_hex FROM p""",
    "dataset_summary": f"""WITH {SETS_SQL} SELECT {_SET_COLS}, {_FIT},
  CASE WHEN fit_for_dense THEN 'try_dense'
    WHEN fit_for_surface THEN 'surface_possible'
    ELSE 'sparse_only' END AS mesh_recommendation FROM sets""",
    "dataset_verdict": f"""WITH {SETS_SQL}, v AS (SELECT *, sh / 60.0::DOUBLE AS shp, project_id % 4 * 5 AS un,
    br < 0.2 OR br > 0.85 AS odd FROM sets),
w AS (SELECT *, list_filter([CASE WHEN un > 0 THEN 'unreadable_images:' || un END,
    CASE WHEN n < 48 THEN 'few_images:' || n END, CASE WHEN n > 55 THEN 'many_images:' || n END,
    CASE WHEN mp < 0.8 THEN printf('low_resolution:%.2f', mp) END,
    CASE WHEN shp < 60 THEN printf('low_sharpness:%.2f', shp) END,
    CASE WHEN odd THEN printf('odd_brightness:%.3f', br) END,
    CASE WHEN dr > 0.02 THEN printf('many_duplicates:%.3f', dr) END,
    CASE WHEN us < 0.5 THEN 'few_usable_images' END], lambda r: r IS NOT NULL) AS ws,
  list_filter([CASE WHEN n < 48 THEN 'few_images' END, CASE WHEN shp < 60 THEN 'low_sharpness' END,
    CASE WHEN odd THEN 'odd_brightness' END, CASE WHEN dr > 0.02 THEN 'many_duplicates' END,
    CASE WHEN us < 0.5 THEN 'few_usable_images' END], lambda r: r IS NOT NULL) AS ps,
  n < 24 OR mp < 0.4 OR shp < 25 OR br < 0.12 OR br > 0.92 OR dr > 0.45 OR un >= greatest(3, n // 4) AS severe FROM v),
r AS (SELECT *, CASE WHEN severe THEN 'no_apto' WHEN len(ws) > 0 THEN 'mejorar' ELSE 'apto' END AS rec FROM w)
SELECT project_id, array_to_string(ws, '|') AS warnings, rec AS recommendation, array_to_string(ps, '|') AS problems FROM r""",
    "capture_suggestions": f"""WITH {SETS_SQL}, q AS (SELECT *, sh / 60.0::DOUBLE AS shp,
    {_c01('(ready - 0.67::DOUBLE + 0.22::DOUBLE) * 1.3::DOUBLE + angle * 0.15::DOUBLE + us * 0.15::DOUBLE')} AS d,
    {_c01('(ready - 0.46::DOUBLE + 0.28::DOUBLE) * 1.2::DOUBLE + variety * 0.12::DOUBLE + least(ft / 220.0::DOUBLE, 1.0::DOUBLE) * 0.12::DOUBLE')} AS s0
  FROM sets),
q1 AS (SELECT *, CASE WHEN d > 0.45 THEN s0 * 0.75::DOUBLE ELSE s0 END AS s FROM q),
q2 AS (SELECT *, {_c01('1 - greatest(d, s) * 0.75::DOUBLE')} AS sp FROM q1),
q3 AS (SELECT *, round(sp / (d + s + sp), 6) AS psp, round(s / (d + s + sp), 6) AS pa, round(d / (d + s + sp), 6) AS pd FROM q2)
SELECT project_id, greatest(0, 45 - n) AS missing_for_45, greatest(0, 60 - n) AS missing_for_60,
  array_to_string(list_filter([
    CASE WHEN ft < 90 THEN 'few_features' END,
    CASE WHEN dr > 0.12 THEN 'many_duplicates' END,
    CASE WHEN shp < 60 THEN 'low_sharpness' END,
    CASE WHEN us < 0.6 THEN 'few_usable_images' END,
    CASE WHEN angle < 0.5 THEN 'low_angular_coverage' END,
    CASE WHEN variety < 0.45 THEN 'low_variety' END,
    CASE WHEN ft < 60 AND dr > 0.2 THEN 'change_object' END
  ], lambda r: r IS NOT NULL), '|') AS advice,
  CASE WHEN ready >= 0.65 AND n >= 45 THEN 'try_dense'
    WHEN ready >= 0.45 AND n >= 30 THEN 'surface_possible'
    ELSE 'sparse_only' END AS final_advice,
  coalesce(nullif(array_to_string(list_filter([
    CASE WHEN n < 45 THEN 'more_images' END, CASE WHEN ft < 90 THEN 'more_texture' END,
    CASE WHEN shp < 60 THEN 'steady_light' END,
    CASE WHEN angle < 0.5 THEN 'more_angles' END,
    CASE WHEN dr > 0.12 THEN 'fewer_duplicates' END,
    CASE WHEN pd < 0.25 THEN 'use_quality_profile' END
  ], lambda r: r IS NOT NULL), '|'), ''), 'run_quality_profile') AS actions,
  CASE WHEN psp >= pa AND psp >= pd THEN 'sparse' WHEN pa >= pd THEN 'approx_surface' ELSE 'dense_real' END
    AS predicted_success_level,
  CASE WHEN pd >= 0.3 OR pa >= 0.45 THEN 'quality' ELSE 'balanced' END AS recommended_profile FROM q3""",
}

# The greedy order is walked image by image with the kept hashes as state.
ORACLES["dedupe_images"] = f"""WITH RECURSIVE {METRICS_SQL},
o AS (SELECT image_id, project_id, name, phash,
    row_number() OVER (PARTITION BY project_id ORDER BY {_NAMEORD}) AS pos FROM metrics),
walk AS (
  SELECT DISTINCT project_id, 0::BIGINT AS pos, []::STRUCT(h BIGINT, id BIGINT)[] AS held, NULL::STRUCT(d BIGINT, i BIGINT) AS near
    FROM o
  UNION ALL
  SELECT project_id, pos, CASE WHEN coalesce(near.d <= 2, false) THEN held
    ELSE list_append(held, {{'h': phash, 'id': image_id}}) END, near
  FROM (SELECT w.project_id, o.pos, o.phash, o.image_id, w.held, list_sort(list_transform(range(1, len(w.held) + 1),
      lambda i: {{'d': bit_count(xor(w.held[i].h, o.phash))::BIGINT, 'i': i}}))[1] AS near
    FROM walk w JOIN o ON o.project_id = w.project_id AND o.pos = w.pos + 1))
SELECT o.image_id, o.project_id, o.name, o.phash, NOT coalesce(near.d <= 2, false) AS kept,
  CASE WHEN near.d <= 3 THEN held[near.i].id END AS duplicate_of,
  CASE WHEN near.d <= 3 THEN near.d::INT END AS duplicate_distance,
  CASE WHEN near.d <= 2 THEN 'duplicate_near' WHEN near.d <= 3 THEN 'similar_view' END AS duplicate_kind
FROM walk JOIN o USING (project_id, pos)"""

ORACLES["dedupe_by_quality"] = ORACLES["dedupe_images"].replace(METRICS_SQL, SCORED_SQL).replace(
    f"ORDER BY {_NAMEORD}) AS pos FROM metrics", f"ORDER BY round(quality_score, 6) DESC, {_NAMEORD}) AS pos FROM scored")
ORACLES["selection_gate"] = f"""WITH {GATED_SQL}, s AS (SELECT project_id,
  count(*) FILTER (status <> 'rechazada' AND sharpness > 0.31::DOUBLE) - project_id * 4 AS selected_images FROM judged GROUP BY project_id)
SELECT *, array_to_string(list_filter([CASE WHEN selected_images <= 0 THEN 'no_images_selected' END,
  CASE WHEN selected_images < 6 THEN 'insufficient_selected_images' END], lambda r: r IS NOT NULL), '|') AS blocking_reasons FROM s"""

_COVERAGE = ORACLES["coverage_summary"].split("WITH ", 1)[1]
ORACLES["batch_gate"] = f"""WITH cover AS (WITH {_COVERAGE}), {GATED_SQL},
s AS (SELECT project_id, count(*) AS total_images, count(*) FILTER (status = 'apta') AS valid_images,
  count(*) FILTER (status = 'advertida') AS warning_images, count(*) FILTER (status = 'rechazada') AS rejected_images,
  count(*) FILTER (status <> 'rechazada') AS accepted_images FROM judged GROUP BY project_id),
b AS (SELECT s.*, possible_low_coverage, list_filter([
    CASE WHEN total_images < 12 THEN 'insufficient_total_images' END,
    CASE WHEN accepted_images < 12 THEN 'insufficient_valid_images' END,
    CASE WHEN possible_low_coverage THEN 'coverage_below_threshold' END], lambda r: r IS NOT NULL) AS br
  FROM s JOIN cover USING (project_id))
SELECT * EXCLUDE (br), array_to_string(br, '|') AS blocking_reasons, len(br) = 0 AS allow_processing FROM b"""
