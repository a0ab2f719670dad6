"""Domain tables derived from the bound parquet tables, as Spark and as SQL.

Every ``*_sql`` text is the body of a CTE over the same source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions.scores import reasons  # noqa: F401  (re-exported for the families)
from ..operators.scale import Shape, running_total


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# -- runs: orders with their lines ----------------------------------------------

def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    kept = c("l_returnflag") != "R"
    return load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(c("l_returnflag") == "R").alias("rejected"),
        F.count_if(kept & (c("l_linestatus") == "O")).alias("selected"),
        F.count_if(kept & (c("l_discount") >= 0.08)).alias("warned"),
        F.max("l_discount").alias("max_discount"),
        F.max("l_linenumber").alias("max_line"),
        F.sum("l_quantity").alias("qty"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Flat run rows; every order is a run, its lines are the images."""
    c = F.col
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice")
    joined = orders.join(line_totals(spark, sf), c("o_orderkey") == c("l_orderkey"), "left")
    zero = F.lit(0).cast("bigint")
    status = F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "failed").otherwise(
        "processing")
    base = joined.select(
        c("o_orderkey").alias("run_id"), c("o_custkey").alias("project_id"), c("o_orderdate").alias("generated_at"),
        status.alias("status"), c("o_orderpriority").alias("variant"),
        F.coalesce("n", zero).alias("total_images_loaded"),
        (F.coalesce("n", zero) - F.coalesce("rejected", zero)).alias("accepted_images"),
        F.coalesce("rejected", zero).alias("rejected_images"),
        F.coalesce("warned", zero).alias("warning_images"),
        F.coalesce("selected", zero).alias("selected_images"),
        F.coalesce("max_discount", F.lit(0.0)).alias("max_discount"),
        F.coalesce(c("max_line").cast("bigint"), zero).alias("max_line"),
        F.coalesce("qty", F.lit(0.0)).alias("qty"),
        F.when(c("n").isNotNull(), c("o_totalprice") / 1000.0).alias("total_processing_seconds"),
    )
    failed, acc, sel = c("status") == "failed", c("accepted_images"), c("selected_images")
    slow = c("total_processing_seconds") > 300
    base = base.withColumns({
        "selection_discarded_images": acc - sel,
        "reason_code": F.when(failed, F.when(acc == 0, "input_validation_failed").when(
            sel == 0, "input_selection_failed").when(slow, "colmap_command_timeout").otherwise("processing_failed")),
        "failed_stage": F.when(failed, F.when(acc == 0, "input_validation").when(
            sel == 0, "input_selection").when(slow, "mapper").otherwise("feature_extractor")),
        "fallback_used": (c("status") == "completed") & (c("max_discount") >= 0.1),
    })
    base = base.withColumns({
        "current_stage": F.when(c("status") == "completed", F.when(
            c("fallback_used"), "completed_with_fallback").otherwise("completed")).when(
            failed, F.when(acc == 0, "input_validation_failed").when(
                sel == 0, "input_selection_failed").otherwise("failed")).otherwise("mapper"),
        "final_artifact_type": F.when(c("status") == "completed", F.when(
            c("project_id") % 2 == 0, "glb").otherwise("obj")),
        "final_artifact_size_bytes": F.when(c("status") == "completed", (c("qty") * 1000).cast("bigint")),
        "input_reduction_ratio": F.round(G.reduction_ratio(F.lit(None).cast("double"), acc, sel), 4),
        "coverage_possible_low": c("max_line") < 3,
    })
    blocked = G.blocked_by_input(c("reason_code"), c("current_stage"))
    base = base.withColumns({
        "blocked_by_input_deficiency": blocked,
        "input_reduction_pct": F.round(c("input_reduction_ratio") * 100.0, 2),
    })
    return base.withColumns({
        "scenario_label": G.scenario(c("total_images_loaded"), c("rejected_images"), acc, sel,
                                     c("blocked_by_input_deficiency"), c("coverage_possible_low")),
        "scenario_source": F.lit("inferred"),
    })


RUNS_SQL = """
line_totals AS (
  SELECT l_orderkey, count(*) AS n,
    count(*) FILTER (l_returnflag = 'R') AS rejected,
    count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS selected,
    count(*) FILTER (l_returnflag <> 'R' AND l_discount >= 0.08) AS warned,
    max(l_discount) AS max_discount, max(l_linenumber)::BIGINT AS max_line, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey),
runs0 AS (
  SELECT o_orderkey AS run_id, o_custkey AS project_id, o_orderdate AS generated_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status,
    o_orderpriority AS variant,
    coalesce(n, 0) AS total_images_loaded, coalesce(n, 0) - coalesce(rejected, 0) AS accepted_images,
    coalesce(rejected, 0) AS rejected_images, coalesce(warned, 0) AS warning_images,
    coalesce(selected, 0) AS selected_images, coalesce(max_discount, 0.0) AS max_discount,
    coalesce(max_line, 0) AS max_line, coalesce(qty, 0.0) AS qty,
    CASE WHEN n IS NOT NULL THEN o_totalprice / 1000.0::DOUBLE END AS total_processing_seconds
  FROM orders LEFT JOIN line_totals ON o_orderkey = l_orderkey),
runs1 AS (
  SELECT *, accepted_images - selected_images AS selection_discarded_images,
    CASE WHEN status = 'failed' THEN CASE WHEN accepted_images = 0 THEN 'input_validation_failed'
      WHEN selected_images = 0 THEN 'input_selection_failed'
      WHEN total_processing_seconds > 300 THEN 'colmap_command_timeout' ELSE 'processing_failed' END END AS reason_code,
    CASE WHEN status = 'failed' THEN CASE WHEN accepted_images = 0 THEN 'input_validation'
      WHEN selected_images = 0 THEN 'input_selection'
      WHEN total_processing_seconds > 300 THEN 'mapper' ELSE 'feature_extractor' END END AS failed_stage,
    status = 'completed' AND max_discount >= 0.1 AS fallback_used
  FROM runs0),
runs2 AS (
  SELECT *,
    CASE status WHEN 'completed' THEN CASE WHEN fallback_used THEN 'completed_with_fallback' ELSE 'completed' END
      WHEN 'failed' THEN CASE WHEN accepted_images = 0 THEN 'input_validation_failed'
        WHEN selected_images = 0 THEN 'input_selection_failed' ELSE 'failed' END
      ELSE 'mapper' END AS current_stage,
    CASE WHEN status = 'completed' THEN CASE WHEN project_id % 2 = 0 THEN 'glb' ELSE 'obj' END END
      AS final_artifact_type,
    CASE WHEN status = 'completed' THEN (qty * 1000)::BIGINT END AS final_artifact_size_bytes,
    round(CASE WHEN accepted_images > 0 THEN
      (accepted_images - selected_images)::DOUBLE / accepted_images ELSE 0.0 END, 4)::DOUBLE AS input_reduction_ratio,
    max_line < 3 AS coverage_possible_low
  FROM runs1),
runs3 AS (
  SELECT *, coalesce(reason_code IN ('input_validation_failed', 'input_selection_failed'), false)
      OR current_stage IN ('input_validation_failed', 'input_selection_failed') AS blocked_by_input_deficiency,
    round(input_reduction_ratio * 100.0::DOUBLE, 2) AS input_reduction_pct
  FROM runs2),
runs AS (
  SELECT *, CASE WHEN blocked_by_input_deficiency THEN 'bad' WHEN total_images_loaded <= 0 THEN 'unknown'
      WHEN rejected_images::DOUBLE / total_images_loaded >= 0.45::DOUBLE
        OR accepted_images = 0 OR selected_images::DOUBLE / accepted_images < 0.45::DOUBLE THEN 'bad'
      WHEN rejected_images::DOUBLE / total_images_loaded >= 0.2::DOUBLE
        OR selected_images::DOUBLE / accepted_images < 0.7::DOUBLE OR coverage_possible_low THEN 'mixed'
      ELSE 'good' END AS scenario_label,
    'inferred' AS scenario_source
  FROM runs3)"""


def graded_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the geometry facts that grading reads."""
    c = F.col
    kinds = F.array(*[F.lit(k) for k in RECONSTRUCTION_KINDS])
    methods = F.array(*[F.lit(k) for k in MESH_METHODS])
    n, q = c("total_images_loaded"), c("qty").cast("bigint")
    return runs(spark, sf).withColumns({
        "reconstruction_type": F.element_at(kinds, (c("project_id") % 6 + 1).cast("int")),
        "final_mesh_method": F.element_at(methods, (c("run_id") % 4 + 1).cast("int")),
        "registered_image_count": F.when(n > 0, n * 4 - c("rejected_images")),
        "camera_count": n, "reconstructed_camera_count": c("max_line"),
        "point_count": F.when(c("fallback_used"), F.lit(0).cast("bigint")).otherwise(q * 24),
        "point_3d_count": q * 10, "sparse_point_cloud_count": q,
        "mesh_face_count": F.when(c("max_line") >= 4, q * 5).otherwise(F.lit(0).cast("bigint")),
        "dense_faces_real": q * 4, "dense_vertices_real": q * 2,
        "surface_faces_real": q * 3, "surface_vertices_real": q,
        "visual_only": c("warning_images") > 2,
        "surface_attempted": c("selected_images") > 0, "surface_success": c("selected_images") > 1,
        "sparse_exists": n > 1, "dense_exists": c("max_discount") >= 0.05,
        "visualization_type": F.when(c("max_line") >= 6, "point_spheres"),
        "projected_texture": F.when(c("run_id") % 5 == 0, "real_projection"),
        "color_strategy": F.when(c("run_id") % 3 == 0, "vertex_colors_from_colmap"),
        "captured_texture_applied": c("run_id") % 7 == 0,
        "extent_ratio": c("max_line") * 1.5, "fill_ratio": c("max_discount") * 12.0,
    })


# Names of reconstruction outputs and mesh methods.
RECONSTRUCTION_KINDS = (
    "approximate_box_primitive_fallback",
    "dense_photogrammetry_mesh",
    "sparse_surface_reconstruction",
    "sparse_geometric_prior_reconstruction",
    "sparse_photogrammetry_point_cloud_fallback",
    "sparse_photogrammetry_mesh_fallback",
)
MESH_METHODS = ("delaunay_mesher_sparse", "convex_hull", "bounding_box", "ball_pivoting")


def half_up(expr: str, digits: int) -> str:
    """SQL for rounding the decimal rendering of a double, as Spark's round does."""
    return f"round(({expr})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_MESH_SCORE = """least(1.0::DOUBLE, CASE WHEN source = 'colmap_dense' AND dense_exists THEN 0.85
      WHEN source = 'colmap_sparse' THEN 0.55 WHEN source = 'colmap_sparse_point_cloud' THEN 0.5
      WHEN source = 'geometric_prior' THEN 0.45 WHEN source IN ('primitive_box', 'fallback') THEN 0.25
      ELSE 0.15 END::DOUBLE + least(0.15::DOUBLE, (points / 5000.0::DOUBLE) * 0.1::DOUBLE
      + (cameras / 40.0::DOUBLE) * 0.05::DOUBLE))"""

GRADED_SQL = RUNS_SQL + f""",
graded AS (
  SELECT *, ({sql_list(RECONSTRUCTION_KINDS)})[project_id % 6 + 1] AS kind,
    ({sql_list(MESH_METHODS)})[run_id % 4 + 1] AS method,
    CASE WHEN total_images_loaded > 0 THEN total_images_loaded * 4 - rejected_images END AS registered,
    qty::BIGINT AS q,
    CASE WHEN fallback_used THEN 0 ELSE qty::BIGINT * 24 END AS point_count,
    CASE WHEN max_line >= 4 THEN qty::BIGINT * 5 ELSE 0 END AS faces,
    total_images_loaded > 1 AS sparse_exists, max_discount >= 0.05 AS dense_exists,
    warning_images > 2 AS visual_only, selected_images > 0 AS surface_attempted,
    selected_images > 1 AS surface_success
  FROM runs),
graded1 AS (
  SELECT *,
    CASE WHEN coalesce(registered, 0) <> 0 THEN registered WHEN total_images_loaded <> 0 THEN total_images_loaded
      ELSE max_line END AS cameras,
    CASE WHEN point_count <> 0 THEN point_count WHEN q * 10 <> 0 THEN q * 10 ELSE q END AS points,
    CASE WHEN kind = 'sparse_geometric_prior_reconstruction' THEN 'geometric_prior'
      WHEN kind = 'approximate_box_primitive_fallback' THEN 'primitive_box'
      WHEN kind = 'dense_photogrammetry_mesh' AND dense_exists AND faces >= 100 THEN 'colmap_dense'
      WHEN kind = 'sparse_surface_reconstruction' THEN 'surface_from_sparse'
      WHEN kind LIKE '%point_cloud_fallback%' THEN 'colmap_sparse_point_cloud'
      WHEN kind = 'sparse_photogrammetry_mesh_fallback' OR sparse_exists THEN
        CASE WHEN method = 'bounding_box' THEN 'fallback' ELSE 'colmap_sparse' END
      ELSE 'fallback' END AS source
  FROM graded),
graded2 AS (
  SELECT *, CASE source WHEN 'primitive_box' THEN 'sparse_bbox' WHEN 'geometric_prior' THEN 'approximated_surface'
      WHEN 'colmap_dense' THEN 'dense_mesh' WHEN 'surface_from_sparse' THEN 'reconstructed_surface'
      ELSE CASE WHEN max_line >= 6 THEN 'point_spheres'
        WHEN source = 'colmap_sparse_point_cloud' THEN 'point_spheres' ELSE 'point_cloud' END END AS shown
  FROM graded1),
graded3 AS (
  SELECT *, CASE WHEN status = 'failed' THEN 'failed'
      WHEN kind = 'approximate_box_primitive_fallback' THEN 'fallback_completed'
      WHEN kind = 'dense_photogrammetry_mesh' AND dense_exists AND q * 4 >= 500 AND q * 2 >= 100 AND NOT visual_only
        THEN 'success_real'
      WHEN kind = 'sparse_surface_reconstruction' AND surface_success AND q * 3 >= 500 AND q >= 100
        THEN 'success_approx_surface'
      WHEN kind = 'sparse_geometric_prior_reconstruction' THEN
        CASE WHEN (q * 3 >= 500 AND q >= 100) OR faces >= 500 THEN 'success_approx_surface'
          ELSE 'fallback_completed' END
      WHEN kind = 'sparse_surface_reconstruction' AND surface_attempted AND q * 3 < 500 THEN 'fallback_completed'
      WHEN faces = 0 AND (sparse_exists OR kind LIKE '%point_cloud_fallback%') THEN
        CASE WHEN cameras >= 8 AND points >= 1500 AND shown = 'point_spheres' THEN 'success_sparse_only'
          ELSE 'fallback_completed' END
      WHEN sparse_exists AND cameras >= 8 AND points >= 1500 AND shown IN ('point_spheres', 'point_cloud')
        AND NOT surface_success AND (surface_attempted OR kind LIKE '%point_cloud_fallback%')
        THEN 'success_sparse_only'
      WHEN sparse_exists AND status = 'completed' THEN 'fallback_completed'
      ELSE 'failed' END AS grade,
    CASE WHEN run_id % 5 = 0 THEN 'real_projection' WHEN run_id % 3 = 0 THEN 'vertex_colors_from_colmap'
      WHEN run_id % 7 = 0 THEN 'best_image_projection' ELSE 'none' END AS texture
  FROM graded2),
graded4 AS (
  SELECT *,
    CASE texture WHEN 'real_projection' THEN 0.8 WHEN 'best_image_projection' THEN 0.45
      WHEN 'vertex_colors_from_colmap' THEN 0.55 ELSE CASE WHEN dense_exists THEN 0.3 ELSE 0.0 END END::DOUBLE AS tscore,
    {half_up(_MESH_SCORE, 3)} AS mscore
  FROM graded3)"""


# -- stage events -------------------------------------------------------------------

# Stage each event type stands for.
EVENT_STAGES = {
    "view": "feature_extractor",
    "click": "exhaustive_matcher",
    "signup": "mapper",
    "purchase": "model_converter_txt",
    "error": "patch_match_stereo",
}


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf, "events").select(
        c("user_id").alias("project_id"), c("ts").cast("timestamp").alias("ts"), "event_id",
        G.lookup(c("event_type"), EVENT_STAGES).alias("stage"),
        F.when(c("event_type") == "error", "failed").when(k >= 90, "completed").when(k >= 10, "running")
        .otherwise("odd").alias("stage_status"),
        (c("value") / 200.0 - 0.1).alias("progress"),
        F.concat(F.lit("k="), k.cast("string")).alias("message"),
        c("value").alias("seconds"),
    )


EVENTS_SQL = """
stage_events AS (
  SELECT user_id AS project_id, ts, event_id,
    CASE event_type WHEN 'view' THEN 'feature_extractor' WHEN 'click' THEN 'exhaustive_matcher'
      WHEN 'signup' THEN 'mapper' WHEN 'purchase' THEN 'model_converter_txt'
      WHEN 'error' THEN 'patch_match_stereo' END AS stage,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN k >= 90 THEN 'completed' WHEN k >= 10 THEN 'running'
      ELSE 'odd' END AS stage_status,
    value / 200.0::DOUBLE - 0.1::DOUBLE AS progress, 'k=' || k::VARCHAR AS message, value AS seconds
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events))"""


# -- images: 8x8 grey thumbnails ------------------------------------------------------

def images(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    px = F.transform("embedding", lambda v: F.round((v.cast("double") + 1.0) * 127.5).cast("int"))
    name = F.concat(
        F.when(c("vec_id") % 2 == 0, "IMG_").otherwise("img_"), F.lpad(c("vec_id").cast("string"), 7, "0"),
        F.when(c("vec_id") % 10 == 9, ".gif").when(c("vec_id") % 3 == 0, ".JPG").otherwise(".png"),
    )
    return load(spark, sf, "embeddings").select(
        c("vec_id").alias("image_id"), c("label").alias("project_id"), name.alias("name"), px.alias("px"),
    ).withColumns({
        "width": c("px")[1] * 8, "height": c("px")[2] * 6,
    }).withColumn("pixel_count", (c("width") * c("height")).cast("bigint"))


IMAGES_SQL = """
images0 AS (
  SELECT vec_id AS image_id, label AS project_id,
    CASE WHEN vec_id % 2 = 0 THEN 'IMG_' ELSE 'img_' END || lpad(vec_id::VARCHAR, 7, '0')
      || CASE WHEN vec_id % 10 = 9 THEN '.gif' WHEN vec_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS name,
    list_transform(embedding, lambda v: round((v::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE)::INT) AS px
  FROM embeddings),
images AS (
  SELECT *, px[2] * 8 AS width, px[3] * 6 AS height, (px[2] * 8 * px[3] * 6)::BIGINT AS pixel_count FROM images0)"""


# -- clouds: one per supplier ----------------------------------------------------------

def _colour() -> tuple[Column, Column, Column]:
    c = F.col
    return c("l_linenumber") * 30, (c("l_orderkey") % 256).cast("int"), (c("l_partkey") % 256).cast("int")


def raw_points(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return load(spark, sf, "lineitem").select(
        c("l_suppkey").alias("cloud_id"),
        c("l_quantity").alias("x"), (c("l_extendedprice") / 1000.0).alias("y"),
        (c("l_discount") * 100.0 + c("l_tax")).alias("z"),
        *[v.alias(n) for n, v in zip("rgb", _colour(), strict=True)],
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
    )


POINT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "x", "y", "z")

RAW_POINTS_SQL = """
raw_points AS (
  SELECT l_suppkey AS cloud_id, l_quantity AS x, l_extendedprice / 1000.0::DOUBLE AS y,
    l_discount * 100.0::DOUBLE + l_tax AS z, l_linenumber * 30 AS r, (l_orderkey % 256)::INT AS g,
    (l_partkey % 256)::INT AS b, l_orderkey, l_linenumber, l_partkey, l_shipdate
  FROM lineitem)"""

POINTS_SQL = RAW_POINTS_SQL + """,
points AS (
  SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, x, y, z) - 1 AS idx, x, y, z, r, g, b
  FROM raw_points)"""


def points(spark: SparkSession, sf: str, shape: Shape | None = None, tasks: int | None = None) -> DataFrame:
    """Points with their 0-based position in the cloud.

    Only the columns that order them are shuffled; colours follow from those.
    With ``tasks``, clouds are dealt to so many, whole.
    """
    keyed = raw_points(spark, sf).select("cloud_id", *POINT_ORDER)
    placed = running_total(keyed.repartition(tasks, "cloud_id") if tasks else keyed, ["cloud_id"], [F.col(c) for c in POINT_ORDER], "idx", shape=shape)
    return placed.select("cloud_id", "idx", "x", "y", "z", *[v.alias(n) for n, v in zip("rgb", _colour(), strict=True)])
