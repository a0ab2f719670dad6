"""Point-cloud analytics: statistics, outlier filters, sampling, priors.

A cloud table holds ``cloud_id, idx, x, y, z`` and any attributes; ``idx`` is
the 0-based position of the point in its cloud. Statistics per cloud are
aggregates; they return to the points through ``attach``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import sphere_radius
from ..functions.scores import clamp
from ..session import durable
from .scale import HOT_ROWS, Shape, attach, exact_percentiles, measure, running_total

AXES = ("x", "y", "z")
KEY = ["cloud_id"]


def cap_rows(points: DataFrame, n: int) -> DataFrame:
    """The first ``n`` points of every cloud, in cloud order."""
    return points.filter(F.col("idx") < n)


def cloud_bounds(points: DataFrame) -> DataFrame:
    """Count, bounds, centroid, extents, diagonal and marker radius per cloud."""
    c = F.col
    grouped = points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES],
        *[F.round(F.avg(a), 6).alias(f"c{a}") for a in AXES],
    )
    e = {a: c(f"max_{a}") - c(f"min_{a}") for a in AXES}
    return grouped.withColumns({f"extent_{a}": e[a] for a in AXES}).withColumns({
        "diagonal": F.sqrt(sum((e[a] * e[a] for a in AXES), F.lit(0.0))),
        "marker_radius": sphere_radius(*[e[a] for a in AXES]),
    })


def _medians(points: DataFrame, prefix: str, hot_rows: int, shape: Shape) -> DataFrame:
    """Per-axis medians and the row count of every cloud."""
    sizes = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))
    medians = exact_percentiles(points, KEY, {f"{prefix}{a}": (F.col(a), 0.5) for a in AXES}, hot_rows, shape)
    return sizes.join(medians, KEY)


def _with_radius(points: DataFrame, hot_rows: int, shape: Shape) -> DataFrame:
    """Add the distance to the per-axis median centre, and the cloud size."""
    center = _medians(points, "_m", hot_rows, shape)
    sized = attach(points, center, KEY, F.col("_rows"), hot_rows, shape)
    d = {a: F.col(a) - F.col(f"_m{a}") for a in AXES}
    return sized.withColumn("radius", F.sqrt(sum((d[a] * d[a] for a in AXES), F.lit(0.0)))).drop("_mx", "_my", "_mz")


def _radial_stats(radii: DataFrame, hot_rows: int, shape: Shape) -> DataFrame:
    r = F.col("radius")
    shares = {"q25": 0.25, "median_radius": 0.5, "q75": 0.75, "q95": 0.95}
    sizes = radii.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.join(
        exact_percentiles(radii, KEY, {k: (r, p) for k, p in shares.items()}, hot_rows, shape), KEY)
    off = attach(radii.select(*KEY, "radius"), spread.select(*KEY, "n", "median_radius"), KEY, F.col("n"),
                 hot_rows, shape)
    mad = exact_percentiles(off, KEY, {"mad": (F.abs(r - F.col("median_radius")), 0.5)}, hot_rows, shape)
    return spread.join(mad, KEY)


def radial_stats(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median, MAD, quartiles and 95 % of the radial distance per cloud."""
    shape = measure(points, KEY)
    radii = durable(_with_radius(points.select(*KEY, *AXES), hot_rows, shape).select(*KEY, "radius"))
    return _radial_stats(radii, hot_rows, shape)


def filter_outliers_mad(points: DataFrame, min_points: int = 0, factor: float = 3.5,
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop points beyond min(95 %, median + 3.5 MAD); clouds below ``min_points`` stay whole."""
    own = points.columns
    shape = measure(points, KEY)
    radii = durable(_with_radius(points, hot_rows, shape))
    stats = _radial_stats(radii.select(*KEY, "radius"), hot_rows, shape)
    limit = F.least(F.col("q95"), F.col("median_radius") + factor * F.greatest(F.col("mad"), F.lit(1e-6)))
    limits = stats.select(*KEY, "n", F.greatest(limit, F.lit(1e-8)).alias("_limit"))
    judged = attach(radii, limits, KEY, F.col("n"), hot_rows, shape)
    return judged.filter((F.col("n") < min_points) | (F.col("radius") <= F.col("_limit"))).select(*own)


def _keep_if_enough(points: DataFrame, keep: Column, enough: int, hot_rows: int, shape: Shape) -> DataFrame:
    """Apply a filter per cloud unless fewer than ``enough`` points would survive."""
    own = points.columns
    marked = points.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    counts = marked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_keep").alias("_kept"))
    judged = attach(marked, counts, KEY, F.col("_n"), hot_rows, shape)
    return judged.filter(F.col("_keep") | (F.col("_kept") < enough)).select(*own)


def filter_outliers_iqr(points: DataFrame, min_points: int = 0, enough: int = 0, fence: float = 1.5,
                        z_limit: float = 3.5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Radial inter-quartile fence, then a per-axis robust z-score.

    Clouds below ``min_points`` stay whole, and a step that would leave fewer than ``enough`` points is left out for its cloud.
    """
    own = points.columns
    shape = measure(points, KEY)
    radii = durable(_with_radius(points, hot_rows, shape).withColumnRenamed("_rows", "_size"))
    r = F.col("radius")
    quart = exact_percentiles(radii, KEY, {"_q1": (r, 0.25), "_q3": (r, 0.75)}, hot_rows, shape).join(
        radii.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows")), KEY)
    fenced = attach(radii, quart, KEY, F.col("_rows"), hot_rows, shape)
    upper = F.col("_q3") + fence * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1e-9))
    first = durable(_keep_if_enough(
        fenced, (F.col("_size") < min_points) | (r <= upper), enough, hot_rows, shape).select(*own, "_size"))

    off = attach(first, _medians(first, "_m", hot_rows, shape), KEY, F.col("_rows"), hot_rows, shape).drop("_rows")
    gap = {a: F.abs(F.col(a) - F.col(f"_m{a}")) for a in AXES}
    mads = exact_percentiles(off, KEY, {f"_mad{a}": (gap[a], 0.5) for a in AXES}, hot_rows, shape).join(
        first.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows")), KEY)
    scored = attach(off, mads, KEY, F.col("_rows"), hot_rows, shape)
    inside = reduce(lambda p, q: p & q, [
        F.abs((F.col(a) - F.col(f"_m{a}")) / (1.4826 * (F.col(f"_mad{a}") + 1e-9))) <= z_limit for a in AXES])
    return _keep_if_enough(scored, (F.col("_size") < min_points) | inside, enough, hot_rows, shape).select(*own)


def trim_quantiles(points: DataFrame, quantile: float = 0.04, min_points: int = 0, enough: int = 0,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep points inside the per-axis quantile box; ``min_points`` and ``enough`` as in ``filter_outliers_iqr``."""
    own = points.columns
    q = max(0.0, min(0.2, quantile))
    if q <= 0.0:
        return points
    shape = measure(points, KEY)
    cuts = {f"_lo{a}": (F.col(a), q) for a in AXES} | {f"_hi{a}": (F.col(a), 1.0 - q) for a in AXES}
    boxes = exact_percentiles(points, KEY, cuts, hot_rows, shape).join(
        points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_size")), KEY)
    boxed = attach(points, boxes, KEY, F.col("_size"), hot_rows, shape)
    inside = reduce(lambda p, r: p & r, [
        (F.col(a) >= F.col(f"_lo{a}")) & (F.col(a) <= F.col(f"_hi{a}")) for a in AXES])
    return _keep_if_enough(boxed, (F.col("_size") < min_points) | inside, enough, hot_rows, shape).select(*own)


def regularize_extents(bounds: DataFrame, min_extent: float = 0.02, min_ratio: float = 0.45,
                       max_aspect: float = 2.2) -> DataFrame:
    """Extents lifted to a minimum and a share of their median, aspect limited."""
    floor = max(0.001, min_extent)
    share, aspect = max(0.0, min(1.0, min_ratio)), max(1.0, max_aspect)
    safe = [F.greatest(F.col(f"extent_{a}"), F.lit(floor)) for a in AXES]
    middle = F.sort_array(F.array(*safe))[1]
    lifted = bounds.withColumns({
        f"_{a}": F.greatest(s, F.lit(floor), middle * share) for a, s in zip(AXES, safe)})
    cap = F.greatest(F.least("_x", "_y", "_z"), F.lit(1e-6)) * aspect
    return lifted.select(*KEY, *[F.least(F.col(f"_{a}"), cap).alias(f"size_{a}") for a in AXES])


def normalize_cloud(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Centre each cloud and scale its largest extent to [-1, 1]."""
    c = F.col
    box = points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(a).alias(f"_lo{a}") for a in AXES], *[F.max(a).alias(f"_hi{a}") for a in AXES])
    extent = F.greatest(*[c(f"_hi{a}") - c(f"_lo{a}") for a in AXES])
    scales = box.select(
        *KEY, "_n", F.when(extent <= 1e-9, 1.0).otherwise(2.0 / extent).alias("_scale"),
        *[((c(f"_lo{a}") + c(f"_hi{a}")) * 0.5).alias(f"_mid{a}") for a in AXES])
    return attach(points, scales, KEY, c("_n"), hot_rows, measure(points, KEY)).select(
        *[((c(n) - c(f"_mid{n}")) * c("_scale")).alias(n) if n in AXES else c(n) for n in points.columns])


def voxel_downsample(points: DataFrame, voxel: float = 0.02, min_points: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First point of every voxel; clouds of at most ``min_points`` stay whole where that is asked.

    The earliest point per voxel is an aggregate with map-side combine, so a
    crowded voxel is no single-task group.
    """
    own = points.columns
    cell = [F.floor(F.col(a) / voxel) for a in AXES]
    if min_points <= 0:
        sized, whole = points, F.lit(False)
    else:
        sizes = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
        sized, whole = attach(points, sizes, KEY, F.col("_n"), hot_rows, measure(points, KEY)), F.col("_n") <= min_points
    # The points of a whole cloud use their own position as the voxel.
    marked = sized.select("*", *[F.when(whole, 0).otherwise(v).alias(f"_v{a}") for a, v in zip(AXES, cell)],
                          F.when(whole, F.col("idx")).otherwise(-1).alias("_own"))
    first = F.min(F.struct("idx", *[n for n in own if n not in (*KEY, "idx")]))
    return (
        marked.groupBy(*KEY, "_vx", "_vy", "_vz", "_own").agg(first.alias("_p"))
        .select(*KEY, "_p.*").select(*own)
    )


def stride_sample(points: DataFrame, max_points: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every n-th point so that at most ``max_points`` remain per cloud."""
    sizes = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(points, sizes, KEY, F.col("_n"), hot_rows, measure(points, KEY))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / max_points))
    on_stride = (F.col("idx") % stride == 0) & (F.floor(F.col("idx") / stride) < max_points)
    return sized.filter((F.col("_n") <= max_points) | on_stride).select(*points.columns)


def densify_midpoints(points: DataFrame, low: int, high: int) -> DataFrame:
    """All points, and midpoints of nearby positions behind those of clouds with ``low`` to ``high`` - 1 points.

    Other clouds pass unchanged. Midpoints carry the attributes of their
    cloud's first point. Partners come from index arithmetic, and a cloud that
    takes part has fewer than ``high`` points, so the join is bounded per cloud.
    """
    c = F.col
    n = c("_n")
    extra = [x for x in points.columns if x not in (*KEY, "idx", *AXES)]
    first = [F.max(F.when(c("idx") == 0, F.struct(*extra))).alias("_first")] if extra else []
    sizes = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), *first).filter((n >= low) & (n < high))
    reach = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 200)))
    step = F.greatest(F.lit(1), F.floor(n / 1200))
    here = points.drop(*extra).join(sizes, KEY).filter((c("idx") < n - 1) & (c("idx") % step == 0)).withColumn("_reach", reach).select(
        *KEY, c("idx").alias("_a"), "_n", "_reach", step.alias("_step"), *[c(a).alias(f"_{a}") for a in AXES],
        *(["_first"] if extra else []), F.explode(F.sequence(F.lit(1), reach.cast("int"))).alias("_jump"))
    there = points.select(*KEY, c("idx").alias("_b"), *AXES)
    pairs = here.withColumn("_b", (c("_a") + c("_jump")) % n).join(there, [*KEY, "_b"])
    place = n + F.floor(c("_a") / c("_step")) * c("_reach") + c("_jump") - 1
    made = pairs.select(*KEY, place.cast(points.schema["idx"].dataType).alias("idx"), *[((c(f"_{a}") + c(a)) * 0.5).alias(a) for a in AXES],
                        *[c(f"_first.{x}").alias(x) for x in extra])
    return points.unionByName(made)


def shape_prior(points: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flat, cylinder, box or irregular, with a confidence, from extents and spread."""
    c = F.col
    box = points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.greatest(F.max(a) - F.min(a), F.lit(1e-9)).alias(f"e{a}") for a in AXES],
        *[((F.min(a) + F.max(a)) * 0.5).alias(f"m{a}") for a in ("x", "y")],
        ((F.stddev_pop("x") + F.stddev_pop("y") + F.stddev_pop("z")) / 3.0).alias("dispersion"),
    )
    flat = attach(points.select(*KEY, "x", "y"), box.select(*KEY, "n", "mx", "my"), KEY, c("n"), hot_rows,
                  measure(points, KEY))
    dx, dy = c("x") - c("mx"), c("y") - c("my")
    radial = flat.select(*KEY, F.sqrt(dx * dx + dy * dy).alias("d")).groupBy(*KEY).agg(
        (F.stddev_pop("d") / F.greatest(F.avg("d"), F.lit(1e-6))).alias("radial_cv"))
    df = box.join(radial, KEY)

    def aspect(a: str, b: str) -> Column:
        return F.greatest(c(f"e{a}"), c(f"e{b}")) / F.greatest(F.least(c(f"e{a}"), c(f"e{b}")), F.lit(1e-9))

    xy, xz, yz = aspect("x", "y"), aspect("x", "z"), aspect("y", "z")
    thin = F.least("ex", "ey", "ez") / F.greatest("ex", "ey", "ez")
    shape = (
        F.when(c("n") < 8, "irregular")
        .when(thin < 0.12, "flat_object")
        .when((c("radial_cv") < 0.42) & (xy < 1.6) & (xz > 1.2) & (yz > 1.2), "cylinder_like")
        .when((xy < 2.4) & (xz < 2.4) & (yz < 2.4), "box_like")
        .otherwise("irregular")
    )
    sure = (
        F.when(c("n") < 8, 0.0)
        .when(c("shape") == "flat_object", clamp(1.0 - thin, 0.45, 0.92))
        .when(c("shape") == "cylinder_like", clamp(0.85 - c("radial_cv") * 0.4, 0.4, 0.9))
        .when(c("shape") == "box_like", clamp(0.82 - c("dispersion") * 0.1, 0.4, 0.88))
        .otherwise(0.35)
    )
    return df.withColumn("shape", shape).select(
        *KEY, "n", c("shape").alias("detected_shape_prior"), F.round(sure, 3).alias("prior_confidence"),
        (c("shape") != "irregular").alias("prior_used"),
    )


def depth_ratio(points: DataFrame, min_points: int = 20) -> DataFrame:
    """Second over first extent, clamped, of clouds with enough points."""
    grouped = points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("sparse_point_count"),
        F.reverse(F.sort_array(F.array(*[F.max(a) - F.min(a) for a in AXES]))).alias("_e"))
    good = (F.col("sparse_point_count") >= min_points) & (F.col("_e")[0] > 1e-9)
    return grouped.select(*KEY, "sparse_point_count", F.when(
        good, clamp(F.col("_e")[1] / F.col("_e")[0], 0.65, 1.15)).alias("depth_ratio"))


def box_dimensions(observed: DataFrame, depth: DataFrame) -> DataFrame:
    """Width, height and depth of the stand-in box, from silhouettes and sparse points.

    ``observed`` has the median silhouette ratio and foreground share per cloud.
    """
    c = F.col
    ratio = F.coalesce(c("median_ratio"), F.lit(1.0))
    front = F.coalesce(c("median_foreground"), F.lit(0.0))
    width = clamp(ratio, 0.8, 1.6)
    deep = F.coalesce(clamp(width * c("depth_ratio"), 0.6, 1.5), clamp(width * 0.9, 0.7, 1.3))
    compact = front >= 0.35
    return observed.join(depth, KEY, "left").select(
        *KEY,
        F.when(compact, clamp((width + 1.0) / 2.0, 0.85, 1.4)).otherwise(width).alias("width"),
        F.lit(1.0).alias("height"),
        F.when(compact, clamp((deep + 1.0) / 2.0, 0.75, 1.35)).otherwise(deep).alias("depth"),
        c("depth_ratio").isNotNull().alias("sparse_used"),
        F.round(ratio, 4).alias("median_image_ratio"), F.round(front, 4).alias("median_foreground_ratio"),
    )


def cyclic_assign(vertices: DataFrame, colors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Colour of vertex i is colour ``i mod n`` of its cloud."""
    return _colored(vertices, colors, F.col("v_idx") % F.col("_colors"), hot_rows)


def _colored(vertices: DataFrame, colors: DataFrame, place: Column, hot_rows: int) -> DataFrame:
    """Vertices with the colour at ``place``, a function of their position and of the sizes of the cloud and its list.

    A short list gives each colour many vertices; where those exceed ``hot_rows``, the colour is broadcast.
    """
    counts = colors.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_colors"))
    sizes = durable(vertices.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows")).join(counts, KEY))
    placed = attach(vertices, sizes, KEY, F.col("_rows"), hot_rows, measure(vertices, KEY)).withColumn("c_idx", place).drop("_colors", "_rows")
    most = sizes.agg(F.max(F.ceil(F.col("_rows") / F.col("_colors")) + 1)).first()[0] or 0
    if most <= hot_rows:
        return placed.join(colors, [*KEY, "c_idx"], "left")
    # Both ways of placing give a colour at most so many vertices.
    used = attach(colors, sizes, KEY, F.col("_colors"), hot_rows).withColumn("_used", F.ceil(F.col("_rows") / F.greatest(F.col("_colors") - 1, F.lit(1))) + 1)
    joined = attach(placed, used.drop("_colors", "_rows"), [*KEY, "c_idx"], F.col("_used"), hot_rows).drop("_used")
    return joined.select(*KEY, "c_idx", *[c for c in joined.columns if c not in (*KEY, "c_idx")])


def linspace_assign(vertices: DataFrame, colors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Colours spread evenly over the vertices by position."""
    last = F.greatest(F.col("_rows") - 1, F.lit(1))
    return _colored(vertices, colors, F.floor(F.col("v_idx") * (F.col("_colors") - 1) / last), hot_rows)


def obj_lines(vertices: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """OBJ text rows per cloud with their order: vertices, then faces or points."""

    def line(kind: int, idx: str, text: Column, df: DataFrame) -> DataFrame:
        return df.select(*KEY, F.lit(kind).alias("part"), F.col(idx).cast("bigint").alias("position"),
                         text.alias("line"))

    coords = [F.col(a).cast("string") for a in AXES]
    rows = line(0, "v_idx", F.concat_ws(" ", F.lit("v"), *coords), vertices)
    if faces is None:
        return rows.unionByName(line(1, "v_idx", F.format_string("p %d", F.col("v_idx") + 1), vertices))
    corners = [F.col(n) + 1 for n in ("a", "b", "c")]
    return rows.unionByName(line(1, "f_idx", F.format_string("f %d %d %d", *corners), faces))


def ordered_vertices(points: DataFrame, hot_rows: int = HOT_ROWS, shape: Shape | None = None) -> DataFrame:
    """Vertices ordered by angle about the cloud's centroid, then height.

    Clouds that are not hot meet in one task for their centroids as for their
    order, so that one shuffle does for both.
    """
    c = F.col
    shape = shape or measure(points, KEY)
    rows = points.select(*KEY, "idx", *AXES)
    if shape.hot(hot_rows):
        center = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), *[F.round(F.avg(a), 6).alias(f"_c{a}") for a in AXES])
        sized = attach(rows, center, KEY, c("_n"), hot_rows, shape)
    else:
        sized = rows.withColumns({f"_c{a}": F.round(F.avg(a).over(Window.partitionBy(*KEY)), 6) for a in AXES})
    turned = sized.withColumn(
        "_angle", F.atan2(c("y") - c("_cy"), c("x") - c("_cx"))).select(*KEY, "idx", *AXES, "_angle")
    ranked = running_total(turned, KEY, [c("_angle"), c("z"), c("idx")], "v_idx", hot_rows=hot_rows, shape=shape)
    return ranked.select(*KEY, "v_idx", *AXES)


def fan_faces(vertices: DataFrame, hot_rows: int = HOT_ROWS, shape: Shape | None = None) -> DataFrame:
    """Triangles (0, i, i+1) over the ordered vertices."""
    i = F.col("v_idx")
    shape = shape or measure(vertices, KEY)
    if shape.hot(hot_rows):
        last = vertices.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.max("v_idx").alias("_last"))
        inner = attach(vertices.select(*KEY, "v_idx"), last, KEY, F.col("_n"), hot_rows, shape)
    else:
        inner = vertices.select(*KEY, "v_idx", F.max("v_idx").over(Window.partitionBy(*KEY)).alias("_last"))
    return inner.filter((i >= 1) & (i < F.col("_last"))).select(
        *KEY, (i - 1).alias("f_idx"), F.lit(0).cast("bigint").alias("a"), i.alias("b"), (i + 1).alias("c"))
