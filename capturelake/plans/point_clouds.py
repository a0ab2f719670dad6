"""Point-cloud and mesh queries over lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clouds as C
from ..operators import meshes as M
from ..operators.nearest import nearest_attribute
from ..operators.scale import HOT_ROWS, measure, neighbours
from ..session import durable
from ..sources import readers
from . import tables as T

c = F.col


def rounded(df, digits=6):
    """Round the floating columns, so that both engines print the same text."""
    return df.select(*[
        F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _bounds(spark, sf):
    return rounded(C.cloud_bounds(T.raw_points(spark, sf)))


def _bounds_sql(source="raw_points"):
    return f"""SELECT cloud_id, count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z,
    max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
    round(avg(z), 6) AS cz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez
  FROM {source} GROUP BY cloud_id"""


RADIAL_SQL = T.POINTS_SQL + """,
centers AS (SELECT cloud_id, count(*) AS n, median(x) AS mx, median(y) AS my, median(z) AS mz
  FROM points GROUP BY cloud_id),
radii AS (SELECT points.*, n, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS radius
  FROM points JOIN centers USING (cloud_id)),
spread AS (SELECT cloud_id, quantile_cont(radius, 0.25) AS q25, median(radius) AS median_radius,
    quantile_cont(radius, 0.75) AS q75, quantile_cont(radius, 0.95) AS q95 FROM radii GROUP BY cloud_id),
mads AS (SELECT cloud_id, median(abs(radius - median_radius)) AS mad
  FROM radii JOIN spread USING (cloud_id) GROUP BY cloud_id)"""

IQR_SQL = RADIAL_SQL + """,
fenced0 AS (SELECT r.*, r.radius <= q75 + 1.5::DOUBLE * greatest(q75 - q25, 1e-9::DOUBLE) AS keep
  FROM radii r JOIN spread USING (cloud_id)),
fenced AS (SELECT * FROM fenced0 QUALIFY n < 20 OR keep OR (count(*) FILTER (keep) OVER (PARTITION BY cloud_id)) < 8),
axis_mid AS (SELECT cloud_id, median(x) AS ax, median(y) AS ay, median(z) AS az FROM fenced GROUP BY cloud_id),
axis_mad AS (SELECT cloud_id, median(abs(x - ax)) AS dx, median(abs(y - ay)) AS dy, median(abs(z - az)) AS dz
  FROM fenced JOIN axis_mid USING (cloud_id) GROUP BY cloud_id),
scored AS (SELECT f.*, abs((x - ax) / (1.4826::DOUBLE * (dx + 1e-9::DOUBLE))) <= 3.5
    AND abs((y - ay) / (1.4826::DOUBLE * (dy + 1e-9::DOUBLE))) <= 3.5
    AND abs((z - az) / (1.4826::DOUBLE * (dz + 1e-9::DOUBLE))) <= 3.5 AS inside
  FROM fenced f JOIN axis_mid USING (cloud_id) JOIN axis_mad USING (cloud_id)),
iqr AS (SELECT cloud_id, idx, x, y, z FROM scored
  QUALIFY n < 20 OR inside OR (count(*) FILTER (inside) OVER (PARTITION BY cloud_id)) < 8)"""


def points(spark, sf):
    return T.points(spark, sf)


def xyz(df):
    return rounded(df.select("cloud_id", "idx", "x", "y", "z"))


def unit_points(spark, sf):
    """Clouds in [-1, 1], so that a voxel grid splits them into many cells."""
    return C.normalize_cloud(points(spark, sf))


def vertices(spark, sf):
    """They are made of the points in several steps, which are placed once."""
    return C.ordered_vertices(durable(points(spark, sf)))


def mesh(spark, sf):
    v = durable(vertices(spark, sf))
    return v, C.fan_faces(v)


def whole_clouds(spark, sf):
    """Points with each cloud whole in a task, so that steps by cloud shuffle nothing more, and their shape."""
    raw = T.raw_points(spark, sf)
    shape = measure(raw, ["cloud_id"])
    return T.points(spark, sf, shape, None if shape.hot(HOT_ROWS) else M.corner_tasks(raw, shape.rows)), shape


def sided_faces(spark, sf):
    """Faces by the side they look at; meshes of ordinary size are made, joined and grouped on one shuffle of the points."""
    p, shape = whole_clouds(spark, sf)
    if shape.hot(HOT_ROWS):
        return M.face_groups(*reversed(mesh(spark, sf)))
    v = C.ordered_vertices(p, shape=shape)
    # A fan has fewer faces than points.
    return M.face_groups(C.fan_faces(v, shape=shape), v, (shape.rows, shape.largest))


MESH_SQL = T.POINTS_SQL + """,
mid AS (SELECT cloud_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM points GROUP BY cloud_id),
vertices AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY atan2(y - cy, x - cx), z, idx) - 1
    AS v_idx, x, y, z FROM points JOIN mid USING (cloud_id)),
sizes AS (SELECT cloud_id, max(v_idx) AS last FROM vertices GROUP BY cloud_id),
faces AS (SELECT cloud_id, v_idx - 1 AS f_idx, 0::BIGINT AS a, v_idx AS b, v_idx + 1 AS c
  FROM vertices JOIN sizes USING (cloud_id) WHERE v_idx >= 1 AND v_idx < last)"""

CORNERS_SQL = MESH_SQL + """,
corners AS (SELECT f.*, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1, r.x AS x2, r.y AS y2, r.z AS z2
  FROM faces f JOIN vertices p ON p.cloud_id = f.cloud_id AND p.v_idx = f.a
    JOIN vertices q ON q.cloud_id = f.cloud_id AND q.v_idx = f.b
    JOIN vertices r ON r.cloud_id = f.cloud_id AND r.v_idx = f.c),
normals AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx,
    (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz
  FROM corners),
unit AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM normals),
sided AS (SELECT *, CASE WHEN len <= 1e-12 THEN 1 ELSE len END AS d FROM unit),
grouped AS (SELECT cloud_id, f_idx, a, b, c, CASE
    WHEN nz / d >= greatest(abs(nx / d), abs(ny / d), -nz / d) THEN 'front'
    WHEN -nz / d >= greatest(abs(nx / d), abs(ny / d)) THEN 'back'
    WHEN -nx / d >= greatest(abs(ny / d), nx / d) THEN 'left' WHEN nx / d >= abs(ny / d) THEN 'right'
    WHEN ny >= 0 THEN 'top' ELSE 'bottom' END AS face_group FROM sided)"""


def _colors(spark, sf):
    """Colour lists as long as their clouds: those of all points, in cloud order."""
    return points(spark, sf).select("cloud_id", c("idx").alias("c_idx"), "r", "g", "b")


COLORS_SQL = MESH_SQL + """,
colors AS (SELECT cloud_id, idx AS c_idx, r, g, b FROM points),
n_colors AS (SELECT cloud_id, count(*) AS k FROM colors GROUP BY cloud_id)"""


def nearest(spark, sf):
    p, shape = whole_clouds(spark, sf)
    p = durable(p) if shape.hot(HOT_ROWS) else p
    v = C.ordered_vertices(p, shape=shape).withColumns({"x": c("x") + 0.25, "y": c("y") - 0.5, "z": c("z") + 0.1})
    return rounded(nearest_attribute(v, p, ["r", "g", "b"], shape=shape).select(
        "cloud_id", "v_idx", "distance", "idx", "r", "g", "b"))


def densified(spark, sf):
    return rounded(C.densify_midpoints(points(spark, sf), 80, 2_200))


def palette(spark, sf):
    """Six colours per cloud: those of its first points."""
    return C.cap_rows(whole_clouds(spark, sf)[0], 6).select("cloud_id", c("idx").alias("slot"), "r", "g", "b")


def sizes_of_boxes(spark, sf):
    pts = T.raw_points(spark, sf)
    observed = pts.groupBy("cloud_id").agg(
        (F.percentile("x", 0.5) / F.percentile("y", 0.5)).alias("median_ratio"),
        (F.percentile("z", 0.5) / 12.0).alias("median_foreground"))
    return rounded(C.box_dimensions(observed, C.depth_ratio(points(spark, sf))))


def neighbourhood(spark, sf):
    """Positions of the points before and after in cloud order."""
    near = neighbours(points(spark, sf).select("cloud_id", "idx", "x"), ["cloud_id"], [c("idx")],
                      {"before_x": (c("x"), -1), "after_x": (c("x"), 1)})
    return near


def obj_rows(spark, sf):
    v, f = mesh(spark, sf)
    shown = v.withColumns({a: F.round(a, 3) for a in "xyz"})
    return C.obj_lines(shown, f)


def sparse_text(spark, sf):
    """Points written as sparse-model text lines and parsed back."""
    pts = T.raw_points(spark, sf)
    line = F.when(c("g") == 0, "# header").when(c("g") == 1, F.concat(F.lit("  "), c("l_partkey").cast("string"))).when(
        c("g") == 2, "7 a b c 1 2 3 0.5").otherwise(F.concat_ws(
            "  ", c("l_partkey").cast("string"), *[F.round(a, 4).cast("string") for a in "xyz"],
            c("r").cast("string"), c("g").cast("string"), c("b").cast("string"), F.lit("0.25")))
    return readers.parse_sparse_points(pts.select(c("cloud_id").cast("string").alias("source"), line.alias("value"))).select(
        "source", "point_id", "x", "y", "z", "r", "g", "b", "error")


QUERIES = {
    "cap_rows": lambda s, d: C.cap_rows(points(s, d), 40),
    "cloud_bounds": _bounds,
    "radial_stats": lambda s, d: rounded(C.radial_stats(T.raw_points(s, d))),
    "filter_outliers_mad": lambda s, d: C.filter_outliers_mad(xyz(points(s, d)), 30),
    "filter_outliers_iqr": lambda s, d: C.filter_outliers_iqr(xyz(points(s, d)), 20, 8),
    "trim_quantiles": lambda s, d: C.trim_quantiles(xyz(points(s, d)), 0.04, 50, 8),
    "regularize_extents": lambda s, d: rounded(C.regularize_extents(C.cloud_bounds(T.raw_points(s, d)))),
    "normalize_cloud": lambda s, d: xyz(unit_points(s, d)),
    "voxel_downsample": lambda s, d: xyz(C.voxel_downsample(unit_points(s, d), 0.1, min_points=550)),
    "stride_sample": lambda s, d: xyz(C.stride_sample(points(s, d), 100)),
    "densify_midpoints": densified,
    "shape_prior": lambda s, d: C.shape_prior(T.raw_points(s, d)),
    "box_dimensions": sizes_of_boxes,
    "ordered_vertices": lambda s, d: rounded(vertices(s, d)),
    "fan_faces": lambda s, d: mesh(s, d)[1],
    "mesh_counts": lambda s, d: M.mesh_counts(*mesh(s, d)),
    "mesh_diagnostics": lambda s, d: rounded(M.mesh_diagnostics(*mesh(s, d)), 3),
    "face_groups": lambda s, d: M.face_group_counts(sided_faces(s, d)),
    "paint_face_groups": lambda s, d: M.paint_face_groups(sided_faces(s, d), palette(s, d)),
    "shade_vertices": lambda s, d: M.shade_vertices(*mesh(s, d), rgb=(200, 120, 40)),
    "cyclic_assign": lambda s, d: C.cyclic_assign(vertices(s, d).select("cloud_id", "v_idx"), _colors(s, d)),
    "linspace_assign": lambda s, d: C.linspace_assign(vertices(s, d).select("cloud_id", "v_idx"), _colors(s, d)),
    "nearest_attribute": nearest,
    "point_neighbours": neighbourhood,
    "obj_lines": obj_rows,
    "sparse_points": sparse_text,
}

_PAL = "(SELECT cloud_id, idx AS slot, r, g, b FROM points WHERE idx < 6)"

ORACLES = {
    "cap_rows": f"WITH {T.POINTS_SQL} SELECT * FROM points WHERE idx < 40",
    "cloud_bounds": f"""WITH {T.RAW_POINTS_SQL}, b AS ({_bounds_sql()}),
g AS (SELECT *, sqrt(ex * ex + ey * ey + ez * ez) AS dg FROM b)
SELECT cloud_id, n, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(min_z, 6) AS min_z,
  round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(max_z, 6) AS max_z, cx, cy, cz,
  round(ex, 6) AS extent_x, round(ey, 6) AS extent_y, round(ez, 6) AS extent_z, round(dg, 6) AS diagonal,
  round(greatest(0.01::DOUBLE, least(0.05::DOUBLE, greatest(dg, 1e-6::DOUBLE) * 0.01::DOUBLE)), 6) AS marker_radius FROM g""",
    "radial_stats": f"""WITH {RADIAL_SQL}
SELECT cloud_id, n, round(q25, 6) AS q25, round(median_radius, 6) AS median_radius, round(q75, 6) AS q75,
  round(q95, 6) AS q95, round(mad, 6) AS mad FROM centers JOIN spread USING (cloud_id) JOIN mads USING (cloud_id)""",
    "filter_outliers_mad": f"""WITH {RADIAL_SQL}
SELECT cloud_id, idx, x, round(y, 6) AS y, round(z, 6) AS z
FROM radii JOIN spread USING (cloud_id) JOIN mads USING (cloud_id)
WHERE n < 30 OR radius <= greatest(1e-8::DOUBLE, least(q95, median_radius + 3.5::DOUBLE * greatest(mad, 1e-6::DOUBLE)))""",
    "filter_outliers_iqr": f"WITH {IQR_SQL} SELECT cloud_id, idx, x, round(y, 6) AS y, round(z, 6) AS z FROM iqr",
    "trim_quantiles": f"""WITH {T.POINTS_SQL}, cuts AS (SELECT cloud_id, count(*) AS n,
    quantile_cont(x, 0.04) AS lx, quantile_cont(y, 0.04) AS ly, quantile_cont(z, 0.04) AS lz,
    quantile_cont(x, 0.96) AS hx, quantile_cont(y, 0.96) AS hy, quantile_cont(z, 0.96) AS hz
  FROM (SELECT cloud_id, x, round(y, 6) AS y, round(z, 6) AS z FROM points) GROUP BY cloud_id),
marked AS (SELECT cloud_id, idx, x, round(y, 6) AS y, round(z, 6) AS z, n, x BETWEEN lx AND hx
    AND round(y, 6) BETWEEN ly AND hy AND round(z, 6) BETWEEN lz AND hz AS inside
  FROM points JOIN cuts USING (cloud_id))
SELECT cloud_id, idx, x, y, z FROM marked
QUALIFY n < 50 OR inside OR (count(*) FILTER (inside) OVER (PARTITION BY cloud_id)) < 8""",
    "regularize_extents": f"""WITH {T.RAW_POINTS_SQL}, b AS ({_bounds_sql()}),
s AS (SELECT cloud_id, greatest(ex, 0.02) AS ex, greatest(ey, 0.02) AS ey, greatest(ez, 0.02) AS ez FROM b),
m AS (SELECT *, list_sort([ex, ey, ez])[2] * 0.45::DOUBLE AS f FROM s),
l AS (SELECT cloud_id, greatest(ex, f) AS ex, greatest(ey, f) AS ey, greatest(ez, f) AS ez FROM m),
k AS (SELECT *, greatest(least(ex, ey, ez), 1e-6::DOUBLE) * 2.2::DOUBLE AS cap FROM l)
SELECT cloud_id, round(least(ex, cap), 6) AS size_x, round(least(ey, cap), 6) AS size_y,
  round(least(ez, cap), 6) AS size_z FROM k""",
    "normalize_cloud": f"""WITH {T.POINTS_SQL}, b AS ({_bounds_sql('points')}),
s AS (SELECT *, CASE WHEN greatest(ex, ey, ez) <= 1e-9 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / greatest(ex, ey, ez) END AS k FROM b)
SELECT p.cloud_id, idx, round((x - (min_x + max_x) * 0.5::DOUBLE) * k, 6) + 0.0 AS x,
  round((y - (min_y + max_y) * 0.5::DOUBLE) * k, 6) + 0.0 AS y,
  round((z - (min_z + max_z) * 0.5::DOUBLE) * k, 6) + 0.0 AS z FROM points p JOIN s USING (cloud_id)""",
    "voxel_downsample": f"""WITH {T.POINTS_SQL}, b AS ({_bounds_sql('points')}),
s AS (SELECT *, CASE WHEN greatest(ex, ey, ez) <= 1e-9 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / greatest(ex, ey, ez) END AS k FROM b),
u AS (SELECT p.cloud_id, idx, n, (x - (min_x + max_x) * 0.5::DOUBLE) * k AS x, (y - (min_y + max_y) * 0.5::DOUBLE) * k AS y,
    (z - (min_z + max_z) * 0.5::DOUBLE) * k AS z FROM points p JOIN s USING (cloud_id))
SELECT cloud_id, idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM u
QUALIFY n <= 550 OR row_number() OVER (PARTITION BY cloud_id, floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE),
  floor(z / 0.1::DOUBLE) ORDER BY idx) = 1""",
    "stride_sample": f"""WITH {T.POINTS_SQL}, s AS (
  SELECT *, count(*) OVER (PARTITION BY cloud_id) AS n FROM points)
SELECT cloud_id, idx, x, round(y, 6) AS y, round(z, 6) AS z FROM s
WHERE n <= 100 OR (idx % greatest(1, n // 100) = 0 AND idx // greatest(1, n // 100) < 100)""",
    "densify_midpoints": f"""WITH {T.POINTS_SQL}, s AS (
  SELECT *, count(*) OVER (PARTITION BY cloud_id) AS n FROM points),
h AS (SELECT cloud_id, idx, x, y, z, n, least(3, greatest(1, n // 200)) AS k, greatest(1, n // 1200) AS step,
    unnest(range(1, least(3, greatest(1, n // 200)) + 1)) AS j FROM s
  WHERE n >= 80 AND n < 2200 AND idx < n - 1 AND idx % greatest(1, n // 1200) = 0),
e AS (SELECT *, (idx + j) % n AS b_idx FROM h),
m AS (SELECT e.cloud_id, e.n + e.idx // e.step * e.k + e.j - 1 AS idx, (e.x + t.x) * 0.5::DOUBLE AS x, (e.y + t.y) * 0.5::DOUBLE AS y,
    (e.z + t.z) * 0.5::DOUBLE AS z, f.r, f.g, f.b
  FROM e JOIN points t ON t.cloud_id = e.cloud_id AND t.idx = e.b_idx JOIN points f ON f.cloud_id = e.cloud_id AND f.idx = 0)
SELECT cloud_id, idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, r, g, b
FROM (SELECT cloud_id, idx, x, y, z, r, g, b FROM points UNION ALL SELECT * FROM m)""",
    "shape_prior": f"""WITH {T.RAW_POINTS_SQL}, b AS (
  SELECT cloud_id, count(*) AS n, greatest(max(x) - min(x), 1e-9::DOUBLE) AS ex, greatest(max(y) - min(y), 1e-9::DOUBLE) AS ey,
    greatest(max(z) - min(z), 1e-9::DOUBLE) AS ez, (min(x) + max(x)) * 0.5::DOUBLE AS mx, (min(y) + max(y)) * 0.5::DOUBLE AS my,
    (stddev_pop(x) + stddev_pop(y) + stddev_pop(z)) / 3.0::DOUBLE AS disp FROM raw_points GROUP BY cloud_id),
d AS (SELECT cloud_id, stddev_pop(d) / greatest(avg(d), 1e-6::DOUBLE) AS cv FROM (
    SELECT cloud_id, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS d FROM raw_points JOIN b USING (cloud_id))
  GROUP BY cloud_id),
r AS (SELECT *, greatest(ex, ey) / least(ex, ey) AS xy, greatest(ex, ez) / least(ex, ez) AS xz,
    greatest(ey, ez) / least(ey, ez) AS yz, least(ex, ey, ez) / greatest(ex, ey, ez) AS thin FROM b JOIN d USING (cloud_id)),
s AS (SELECT *, CASE WHEN n < 8 THEN 'irregular' WHEN thin < 0.12 THEN 'flat_object'
    WHEN cv < 0.42 AND xy < 1.6 AND xz > 1.2 AND yz > 1.2 THEN 'cylinder_like'
    WHEN xy < 2.4 AND xz < 2.4 AND yz < 2.4 THEN 'box_like' ELSE 'irregular' END AS shape FROM r)
SELECT cloud_id, n, shape AS detected_shape_prior, round(CASE WHEN n < 8 THEN 0.0::DOUBLE
    WHEN shape = 'flat_object' THEN greatest(0.45::DOUBLE, least(0.92::DOUBLE, 1.0::DOUBLE - thin))
    WHEN shape = 'cylinder_like' THEN greatest(0.4::DOUBLE, least(0.9::DOUBLE, 0.85::DOUBLE - cv * 0.4::DOUBLE))
    WHEN shape = 'box_like' THEN greatest(0.4::DOUBLE, least(0.88::DOUBLE, 0.82::DOUBLE - disp * 0.1::DOUBLE))
    ELSE 0.35::DOUBLE END, 3) AS prior_confidence, shape <> 'irregular' AS prior_used FROM s""",
    "box_dimensions": f"""WITH {T.POINTS_SQL}, o AS (
  SELECT cloud_id, median(x) / median(y) AS r, median(z) / 12.0::DOUBLE AS f FROM points GROUP BY cloud_id),
e AS (SELECT cloud_id, count(*) AS n, list_reverse_sort([max(x) - min(x), max(y) - min(y), max(z) - min(z)]) AS e
  FROM points WHERE idx < 15000 GROUP BY cloud_id),
d AS (SELECT cloud_id, CASE WHEN n >= 20 AND e[1] > 1e-9 THEN greatest(0.65::DOUBLE, least(1.15::DOUBLE, e[2] / e[1])) END
    AS q FROM e),
w AS (SELECT *, greatest(0.8::DOUBLE, least(1.6::DOUBLE, r)) AS wd FROM o JOIN d USING (cloud_id)),
x AS (SELECT *, CASE WHEN q IS NOT NULL THEN greatest(0.6::DOUBLE, least(1.5::DOUBLE, wd * q))
    ELSE greatest(0.7::DOUBLE, least(1.3::DOUBLE, wd * 0.9::DOUBLE)) END AS dp FROM w)
SELECT cloud_id, round(CASE WHEN f >= 0.35 THEN greatest(0.85::DOUBLE, least(1.4::DOUBLE, (wd + 1) / 2)) ELSE wd END, 6) AS width,
  1.0::DOUBLE AS height,
  round(CASE WHEN f >= 0.35 THEN greatest(0.75::DOUBLE, least(1.35::DOUBLE, (dp + 1) / 2)) ELSE dp END, 6) AS depth,
  q IS NOT NULL AS sparse_used, round(r, 4) AS median_image_ratio, round(f, 4) AS median_foreground_ratio FROM x""",
    "ordered_vertices": f"""WITH {MESH_SQL}
SELECT cloud_id, v_idx, x, round(y, 6) AS y, round(z, 6) AS z FROM vertices""",
    "fan_faces": f"WITH {MESH_SQL} SELECT * FROM faces",
    "mesh_counts": f"""WITH {MESH_SQL}
SELECT v.cloud_id, n AS vertex_count, k AS face_count FROM (SELECT cloud_id, count(*) AS n FROM vertices GROUP BY 1) v
JOIN (SELECT cloud_id, count(*) AS k FROM faces GROUP BY 1) f USING (cloud_id)""",
    "mesh_diagnostics": f"""WITH {CORNERS_SQL}, b AS ({_bounds_sql('points')}),
solid AS (SELECT cloud_id, abs(sum((x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6.0::DOUBLE))
    AS vol, sum(len) / 2.0::DOUBLE AS area FROM unit GROUP BY cloud_id),
ends AS (SELECT cloud_id, least(u, v) AS u, greatest(u, v) AS v FROM (
    SELECT cloud_id, a AS u, b AS v FROM faces UNION ALL SELECT cloud_id, b, c FROM faces
    UNION ALL SELECT cloud_id, c, a FROM faces)),
tight AS (SELECT cloud_id, bool_and(k = 2) AS w FROM (
    SELECT cloud_id, u, v, count(*) AS k FROM ends GROUP BY ALL) GROUP BY cloud_id)
SELECT cloud_id, round(ex, 3) AS extent_x, round(ey, 3) AS extent_y, round(ez, 3) AS extent_z,
  round(greatest(ex, ey, ez) / least(ex, ey, ez), 3) AS extent_ratio_max_min, round(ex * ey * ez, 3) AS bbox_volume,
  round(vol, 3) AS mesh_volume, round(vol / round(ex * ey * ez, 6), 3) AS mesh_volume_to_bbox_volume_ratio,
  round(area, 3) AS mesh_surface_area, w AS is_watertight
FROM b JOIN solid USING (cloud_id) JOIN tight USING (cloud_id)""",
    "face_groups": f"WITH {CORNERS_SQL} SELECT cloud_id, face_group, count(*) AS faces FROM grouped GROUP BY ALL",
    "paint_face_groups": f"""WITH {CORNERS_SQL}, slots AS (
  SELECT cloud_id, list_position(['front', 'back', 'left', 'right', 'top', 'bottom'], face_group) - 1 AS slot,
    unnest([a, b, c]) AS v_idx FROM grouped),
last AS (SELECT cloud_id, v_idx, max(slot) AS slot FROM slots GROUP BY ALL)
SELECT last.cloud_id, v_idx, coalesce(r, 180) AS r, coalesce(g, 180) AS g, coalesce(b, 180) AS b
FROM last LEFT JOIN {_PAL} p ON p.cloud_id = last.cloud_id AND p.slot = last.slot""",
    "shade_vertices": f"""WITH {CORNERS_SQL}, incident AS (
  SELECT cloud_id, unnest([a, b, c]) AS v_idx, nx / d AS ux, ny / d AS uy, nz / d AS uz FROM sided),
vn AS (SELECT cloud_id, v_idx, sum(ux) AS sx, sum(uy) AS sy, sum(uz) AS sz FROM incident GROUP BY ALL),
f AS (SELECT v.cloud_id, v.v_idx, greatest(0.72::DOUBLE, least(1.25::DOUBLE, 1.0::DOUBLE + 0.2::DOUBLE * coalesce(
    CASE WHEN sqrt(sx * sx + sy * sy + sz * sz) <= 1e-12 THEN 0.0::DOUBLE ELSE
    (sx * 0.25::DOUBLE + sy * 0.45::DOUBLE + sz * 0.86::DOUBLE) / sqrt(0.25::DOUBLE * 0.25::DOUBLE
      + 0.45::DOUBLE * 0.45::DOUBLE + 0.86::DOUBLE * 0.86::DOUBLE) / sqrt(sx * sx + sy * sy + sz * sz) END, 0.0::DOUBLE))) AS k
  FROM vertices v LEFT JOIN vn ON vn.cloud_id = v.cloud_id AND vn.v_idx = v.v_idx)
SELECT cloud_id, v_idx, floor(least(255.0::DOUBLE, k * 200.0::DOUBLE))::INT AS r, floor(k * 120.0::DOUBLE)::INT AS g,
  floor(k * 40.0::DOUBLE)::INT AS b FROM f""",
    "cyclic_assign": f"""WITH {COLORS_SQL}
SELECT v.cloud_id, v.v_idx, q.c_idx, r, g, b FROM vertices v JOIN n_colors USING (cloud_id)
JOIN colors q ON q.cloud_id = v.cloud_id AND q.c_idx = v.v_idx % k""",
    "linspace_assign": f"""WITH {COLORS_SQL}
SELECT v.cloud_id, v.v_idx, q.c_idx, r, g, b FROM vertices v JOIN n_colors USING (cloud_id) JOIN sizes USING (cloud_id)
JOIN colors q ON q.cloud_id = v.cloud_id AND q.c_idx = floor(v.v_idx * (k - 1) / greatest(last, 1)::DOUBLE)""",
    "nearest_attribute": f"""WITH {MESH_SQL}, moved AS (
  SELECT cloud_id, v_idx, x + 0.25::DOUBLE AS x, y - 0.5::DOUBLE AS y, z + 0.1::DOUBLE AS z FROM vertices),
pairs AS (SELECT v.cloud_id, v.v_idx, (v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) + (v.z - p.z) * (v.z - p.z)
    AS d2, p.idx, p.r, p.g, p.b FROM moved v JOIN points p ON p.cloud_id = v.cloud_id)
SELECT cloud_id, v_idx, round(sqrt(m.d2), 6) AS distance, m.idx AS idx, m.r AS r, m.g AS g, m.b AS b FROM (
  SELECT cloud_id, v_idx, min({{'d2': d2, 'idx': idx, 'r': r, 'g': g, 'b': b}}) AS m FROM pairs GROUP BY ALL)""",
    "point_neighbours": f"""WITH {T.POINTS_SQL}
SELECT cloud_id, idx, x, lag(x) OVER w AS before_x, lead(x) OVER w AS after_x FROM points
WINDOW w AS (PARTITION BY cloud_id ORDER BY idx)""",
    "obj_lines": f"""WITH {MESH_SQL}
SELECT cloud_id, 0 AS part, v_idx AS position, 'v ' || {T.half_up('x', 3)}::VARCHAR || ' '
  || {T.half_up('y', 3)}::VARCHAR || ' ' || {T.half_up('z', 3)}::VARCHAR AS line FROM vertices
UNION ALL SELECT cloud_id, 1, f_idx, format('f {{}} {{}} {{}}', a + 1, b + 1, c + 1) FROM faces""",
    "sparse_points": f"""WITH {T.RAW_POINTS_SQL}
SELECT cloud_id::VARCHAR AS source, l_partkey AS point_id, {T.half_up('x', 4)} AS x, {T.half_up('y', 4)} AS y,
  {T.half_up('z', 4)} AS z, r, g, b,
  0.25::DOUBLE AS error FROM raw_points WHERE g > 2""",
}
