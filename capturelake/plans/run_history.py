"""Run-history queries over orders and lineitem, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions.scores import first_text
from ..operators import predict as P
from ..operators import projects as J
from ..operators import records as B
from ..operators import runs as R
from . import tables as T

BASE, ENHANCED = "1-URGENT", "5-LOW"

# Statistics per scope, shared by the SQL of several queries.
STATS_SQL = T.RUNS_SQL + """,
scoped AS (
  SELECT *, 'overall' AS scope_type, 'overall' AS scope FROM runs
  UNION ALL SELECT *, 'variant', variant FROM runs
  UNION ALL SELECT *, 'scenario', scenario_label FROM runs),
stage_counts AS (
  SELECT scope_type, scope, failed_stage, count(*) AS n FROM scoped WHERE failed_stage IS NOT NULL GROUP BY ALL),
stage_top AS (
  SELECT scope_type, scope, failed_stage AS top_failed_stage FROM stage_counts
  QUALIFY row_number() OVER (PARTITION BY scope_type, scope ORDER BY n DESC, failed_stage) = 1),
code_counts AS (
  SELECT scope_type, scope, reason_code, count(*) AS n FROM scoped WHERE reason_code IS NOT NULL GROUP BY ALL),
code_top AS (
  SELECT scope_type, scope, reason_code AS top_reason_code FROM code_counts
  QUALIFY row_number() OVER (PARTITION BY scope_type, scope ORDER BY n DESC, reason_code) = 1),
stats0 AS (
  SELECT scope_type, scope, count(*) AS run_count,
    count(*) FILTER (status = 'completed') AS completed_count,
    count(*) FILTER (status = 'failed') AS failed_count,
    count(*) FILTER (blocked_by_input_deficiency) AS input_blocked_count,
    count(*) FILTER (fallback_used) AS fallback_count,
    round(avg(total_processing_seconds), 3) AS avg_total_processing_seconds,
    round(median(total_processing_seconds), 3) AS median_total_processing_seconds,
    coalesce(round(avg(input_reduction_pct), 3), 0.0) AS avg_input_reduction_pct
  FROM scoped GROUP BY scope_type, scope),
stats AS (
  SELECT s.scope_type, s.scope, run_count, completed_count, failed_count,
    round(completed_count::DOUBLE / run_count, 4) AS success_rate,
    round(failed_count::DOUBLE / run_count, 4) AS failure_rate,
    input_blocked_count, round(input_blocked_count::DOUBLE / run_count, 4) AS input_blocked_rate,
    fallback_count, round(fallback_count::DOUBLE / run_count, 4) AS fallback_rate,
    avg_total_processing_seconds, median_total_processing_seconds, avg_input_reduction_pct,
    top_failed_stage, top_reason_code
  FROM stats0 s LEFT JOIN stage_top USING (scope_type, scope) LEFT JOIN code_top USING (scope_type, scope))"""


def _stats(spark, sf):
    return R.run_stats_by_scope(T.runs(spark, sf))


def run_records(spark, sf):
    return R.flatten_runs(R.build_run_record(_with_gates(T.runs(spark, sf))))


def _with_gates(runs):
    return runs.withColumns({
        "allow_processing_after_validation": F.when(F.col("accepted_images") == 0, F.lit(False)),
        "allow_processing_after_selection": F.when(F.col("selected_images") == 0, F.lit(False)),
    })


def run_record_gates(spark, sf):
    return R.build_run_record(_with_gates(T.runs(spark, sf))).select(
        "schema_version", "run_id", "quality_gates.*", "execution_metrics.completed_with_fallback",
        "run_info.scenario_source", F.col("input_metrics.input_reduction_ratio").alias("input_reduction_ratio"))


def stats_by_key(spark, sf):
    runs = T.runs(spark, sf)
    scoped = R.by_scope(runs, {"year": F.year("generated_at"), "size": F.when(
        F.col("total_images_loaded") > 4, "large").otherwise("small")})
    return R.run_stats(scoped.filter(F.col("scope_type") != "overall"), ["scope_type", "scope"]).select(
        "scope_type", "scope", "run_count", "success_rate", "median_total_processing_seconds", "top_failed_stage")


def report_rows(spark, sf):
    """The run table as it comes back from an untyped report."""
    runs = T.runs(spark, sf).select(*R.RUN_COLUMNS)
    text = runs.select(*[F.col(c).cast("string").alias(c) for c in R.RUN_COLUMNS])
    return R.typed_report_rows(text)


def history(spark, sf):
    graded = R.grade_runs(T.graded_inputs(spark, sf), keep=(
        "run_id", "project_id", "variant", "selected_images", "accepted_images", "total_images_loaded", "max_line",
        "max_discount", "qty"))
    c = F.col
    n = F.greatest(c("total_images_loaded"), F.lit(1))
    return graded.select(
        "run_id", "project_id", F.concat(F.lit("dataset_"), (c("project_id") % 50).cast("string")).alias("dataset_path"),
        c("variant").alias("profile"), "quality_classification", "final_success_level",
        F.round(c("selected_images") / n, 4).alias("mesh_readiness_score"),
        F.round(c("max_line") / 7.0, 4).alias("angular_coverage_score"),
        F.round(c("max_discount") * 10.0, 4).alias("visual_variety_score"),
        c("qty").alias("average_feature_points"),
        F.round(c("accepted_images") / n, 4).alias("usable_images_ratio"),
        (c("total_images_loaded") * 8).alias("image_count"),
        (c("qty").cast("bigint") * 24).alias("points3D_count"),
    )


HISTORY_SQL = T.GRADED_SQL + """,
history AS (
  SELECT run_id, project_id, 'dataset_' || (project_id % 50)::VARCHAR AS dataset_path, variant AS profile,
    grade AS quality_classification,
    CASE grade WHEN 'success_real' THEN 'dense_real' WHEN 'success_approx_surface' THEN 'approx_surface'
      WHEN 'success_sparse_only' THEN 'sparse_only' WHEN 'fallback_completed' THEN 'fallback_only'
      ELSE 'failed' END AS final_success_level,
    round(selected_images::DOUBLE / greatest(total_images_loaded, 1), 4) AS mesh_readiness_score,
    round(max_line / 7.0::DOUBLE, 4) AS angular_coverage_score,
    round(max_discount * 10.0::DOUBLE, 4) AS visual_variety_score,
    qty AS average_feature_points,
    round(accepted_images::DOUBLE / greatest(total_images_loaded, 1), 4) AS usable_images_ratio,
    total_images_loaded * 8 AS image_count, q * 24 AS points3d_count
  FROM graded4)"""


def history_overview(spark, sf):
    return R.history_overview(history(spark, sf), 10)


def train_thresholds(spark, sf):
    return P.train_thresholds(history(spark, sf))


def train_calibrator(spark, sf):
    model = P.train_calibrator(history(spark, sf))
    return model.select("method", "sample_count", *[F.round(k, 3).alias(k) for k in P.DEFAULT_COEFFICIENTS])


def predict_success(spark, sf):
    return P.predict_success(_datasets(spark, sf), P.train_thresholds(history(spark, sf)))


def predict_success_learned(spark, sf):
    return P.predict_success(_datasets(spark, sf), P.train_calibrator(history(spark, sf)))


def _datasets(spark, sf):
    return history(spark, sf).groupBy("dataset_path").agg(
        *[F.round(F.avg(m), 6).alias(m) for m in (
            "mesh_readiness_score", "angular_coverage_score", "visual_variety_score", "average_feature_points",
            "usable_images_ratio")],
        F.sum("image_count").alias("image_count_valid"), F.sum("image_count").alias("image_count_total"))


def _named(runs):
    """Runs with the served files and engine facts that the project views read."""
    c = F.col
    done = c("status") == "completed"
    file = F.concat(F.lit("p"), c("project_id").cast("string"), F.lit("_final."), c("final_artifact_type"))
    return runs.withColumns({
        "engine": F.when(c("max_line") > 2, "colmap"), "engine_requested": F.lit("auto"),
        "stage_status": F.when(c("run_id") % 2 == 0, "running").when(c("run_id") % 3 == 0, ""),
        "progress": F.when(c("run_id") % 4 > 0, c("max_discount") * 15.0),
        "status_message": F.when(c("run_id") % 3 == 0, "processing_failed").when(c("run_id") % 3 == 1, ""),
        "error_message": F.when(c("status") == "failed", c("reason_code")),
        "final_model_path": F.when(done & (c("run_id") % 3 == 0), F.concat(F.lit("out/"), file)),
        "output_path": F.when(done & (c("run_id") % 5 == 0), F.concat(F.lit("srv/other_"), file)),
        "model_path": F.when(done, F.concat(F.lit("out/"), file)),
        "final_model_type": F.when(c("run_id") % 8 == 0, c("final_artifact_type")),
        "method_used": F.when(c("max_line") == 5, "convex_hull"), "mesh_method": F.lit(""),
        "meshing_method": F.when(c("max_line") == 6, "poisson"),
        "model_filename": F.when(done & (c("project_id") % 9 > 0), file),
        "output_format": F.when(c("run_id") % 6 > 0, F.when(c("project_id") % 4 == 0, "glb").otherwise("obj")),
    })


NAMED_SQL = T.RUNS_SQL + """,
named0 AS (SELECT *, status = 'completed' AS done,
    'p' || project_id::VARCHAR || '_final.' || final_artifact_type AS file FROM runs),
named AS (
  SELECT *, CASE WHEN max_line > 2 THEN 'colmap' END AS engine,
    CASE WHEN run_id % 2 = 0 THEN 'running' WHEN run_id % 3 = 0 THEN '' END AS stage_status,
    CASE WHEN run_id % 4 > 0 THEN max_discount * 15.0::DOUBLE END AS progress,
    CASE WHEN run_id % 3 = 0 THEN 'processing_failed' WHEN run_id % 3 = 1 THEN '' END AS status_message,
    CASE WHEN status = 'failed' THEN reason_code END AS error_message,
    CASE WHEN done AND run_id % 3 = 0 THEN 'out/' || file END AS final_model_path,
    CASE WHEN done AND run_id % 5 = 0 THEN 'srv/other_' || file END AS output_path,
    CASE WHEN done THEN 'out/' || file END AS model_path,
    CASE WHEN run_id % 8 = 0 THEN final_artifact_type END AS final_model_type,
    CASE WHEN done AND project_id % 9 > 0 THEN file END AS model_filename,
    CASE WHEN run_id % 6 > 0 THEN CASE WHEN project_id % 4 = 0 THEN 'glb' ELSE 'obj' END END AS output_format
  FROM named0)"""


def status_details(spark, sf):
    return J.status_details(_named(T.runs(spark, sf)))


def artifact_consistent(spark, sf):
    return J.artifact_consistent(_named(T.runs(spark, sf)))


def result_warnings(spark, sf):
    c = F.col
    given = F.array(F.when(c("max_line") > 4, "many_images"), F.when(c("max_line") > 2, "brightness"), F.lit(""))
    graded = R.grade_runs(T.graded_inputs(spark, sf), keep=("run_id", "max_line", "fallback_used", "warning_images"))
    return graded.select("run_id", F.concat_ws("|", J.collect_warnings(
        F.array_compact(given), c("fallback_used"), c("warning_images"), c("quality_classification"))).alias("warnings"))


def next_actions(spark, sf):
    c = F.col
    return T.runs(spark, sf).groupBy(
        G.next_action(c("status"), c("fallback_used"), c("warning_images")).alias("action"), "status").agg(
        F.count(F.lit(1)).alias("runs"))


def profile_params(spark, sf):
    c = F.col
    runs = T.runs(spark, sf).select(
        "run_id", G.lookup(c("variant"), {
            "1-URGENT": " Conservative", "2-HIGH": "balanced", "3-MEDIUM": "balanced", "4-NOT SPECIFIED": "quality",
        }, "other").alias("profile"),
        F.when(c("max_line") == 7, c("total_images_loaded").cast("int")).alias("override_selection_max_images"),
        F.when(c("max_line") == 6, c("max_discount")).alias("override_min_sharpness_reject"),
        "total_images_loaded", "rejected_images", "selected_images", "warning_images", "max_line", "max_discount")
    return J.with_profile_params(runs, ["selection_max_images", "min_sharpness_reject"]).select(
        "run_id", *J.PROFILE_FIELDS, *[
            F.round(x, 6).alias(n) if n.endswith(("weight", "ratio")) else x.alias(n)
            for n, x in zip(
                ("warn_distance", "reject_distance", "quality_weight", "diversity_weight",
                 "near_duplicate_hamming", "diversity_min_hamming", "target_keep_ratio"),
                J.sanitised_thresholds(c("rejected_images"), c("selected_images"), c("selected_images"),
                                       c("rejected_images"), c("max_line"), c("warning_images"),
                                       c("max_discount") * 12.0))])


def evidence_manifest(spark, sf):
    c = F.col
    runs = T.runs(spark, sf)
    file = F.concat(F.lit("runs/"), c("run_id").cast("string"), F.lit("/"))
    flags = {"quality_report": c("max_line") > 5, "colmap_report": c("selected_images") > 1,
             "preprocessing_manifest": c("accepted_images") > 4, "colmap_logs": c("failed_stage") == "mapper",
             "final_model": c("status") == "completed"}
    found = runs.select("project_id", F.explode(F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(n).alias("label"), F.concat(file, F.lit(n)).alias("path")))
        for n, cond in flags.items()]))).alias("_f")).select("project_id", "_f.*")
    projects = T.load(spark, sf, "customer").select(c("c_custkey").alias("project_id"))
    return J.evidence_manifest(projects, found)


def latest_project(spark, sf):
    c = F.col
    runs = T.runs(spark, sf).select(
        "project_id", F.when(c("max_line") > 1, c("generated_at")).alias("updated_at"),
        F.lit("1990-01-01").cast("timestamp_ntz").alias("modified_at"))
    return R.latest_project(runs).select("project_id", "seen_at")


def profile_rows(spark, sf):
    c = F.col
    return R.profile_comparison(T.graded_inputs(spark, sf).select(
        c("variant").alias("profile"), "project_id", "run_id", "status",
        F.when(c("max_line") > 2, c("reconstruction_type")).alias("quality_classification"),
        "total_processing_seconds", c("accepted_images").alias("image_count_accepted"),
        c("total_images_loaded").alias("image_count_processed"), c("selected_images").alias("image_count_selected"),
        c("camera_count").alias("cameras_reconstructed"), "registered_image_count",
        c("point_count").alias("points_3d_count"), "sparse_point_cloud_count", "fallback_used",
        c("final_artifact_size_bytes").alias("model_size_bytes")))


PROFILE_SQL = T.GRADED_SQL + """,
profile_rows AS (
  SELECT variant AS profile, project_id, status,
    coalesce(CASE WHEN max_line > 2 THEN kind END, 'failed') AS quality_classification,
    coalesce(total_processing_seconds, 0.0::DOUBLE) AS total_time_seconds,
    CASE WHEN accepted_images <> 0 THEN accepted_images WHEN total_images_loaded <> 0 THEN total_images_loaded
      ELSE selected_images END AS images_accepted,
    CASE WHEN total_images_loaded <> 0 THEN total_images_loaded ELSE coalesce(registered, 0) END AS cameras_reconstructed,
    CASE WHEN point_count <> 0 THEN point_count ELSE q END AS points_3d_count,
    fallback_used, coalesce(final_artifact_size_bytes, 0) AS model_size_bytes
  FROM graded4)"""


def labels(spark, sf):
    c = F.col
    return T.runs(spark, sf).select(
        "run_id", "scenario_label", "input_reduction_ratio", G.workflow_stage(c("current_stage")).alias("workflow_stage"),
        G.retryable(c("reason_code"), F.concat(F.lit("Etapa "), c("failed_stage"))).alias("retryable"),
        G.fallback_eligible(F.lit(True), c("reason_code"), c("current_stage"), c("selected_images")).alias(
            "fallback_eligible"),
        G.engine_fallback_applies(F.when(c("max_line") > 3, "auto").otherwise("colmap"), F.lit("colmap"),
                                  F.lit("mock"), c("max_discount") > 0.05).alias("engine_fallback"),
        G.presentation_applies(c("max_line") > 2, F.when(c("run_id") % 2 == 0, c("project_id").cast("string")),
                               (c("project_id") + c("run_id") % 4 % 3 - c("run_id") % 4 % 3).cast("string"),
                               F.when(c("run_id") % 3 == 0, "other"), J.PRESENTATION_MODES).alias("presentation"),
        G.has_previous_state(c("status"), c("final_artifact_type"), F.lit(""), c("reason_code"), F.lit(None).cast("string"),
                             c("selected_images") - 2).alias("has_previous_state"),
    )


def texture_strategy(spark, sf):
    c = F.col
    g = T.graded_inputs(spark, sf)
    plan = G.texture_strategy(F.when(c("max_line") > 5, "box_like").otherwise("irregular"), c("selected_images"),
                              c("rejected_images"), c("warning_images") > 0, c("mesh_face_count"))
    return g.select("run_id", plan.alias("_p"), G.surface_confidence(
        c("point_3d_count"), c("point_3d_count") - c("rejected_images") * 20, c("mesh_face_count"),
        c("final_mesh_method")).alias("surface_confidence")).select("run_id", "_p.*", "surface_confidence")


def _failing(spark, sf):
    """Runs with the error facts that the record builders read."""
    c = F.col
    return T.graded_inputs(spark, sf).withColumns({
        "profile": F.when(c("max_line") > 4, " Quality ").when(c("max_line") > 2, "odd"),
        "gpu_requested": c("max_line") > 3, "gpu_used": c("max_discount") > 0.06,
        "warnings": F.lit(None).cast("array<string>"), "engine": F.lit("colmap"),
        "stage_timings_seconds": F.create_map(
            F.lit("mapper"), c("qty"), F.lit("stereo_fusion"), c("max_discount") - 0.05,
            F.lit("poisson_mesher"), c("qty") / 4.0, F.lit("model_converter_txt"), c("max_discount")),
        "cameras_reconstructed": c("camera_count"), "points3D_count": c("point_3d_count"),
        "failure_reason": F.when(c("status") == "failed", F.concat(F.lit("Tiempo de espera en "), c("failed_stage"))),
        "error_stage": F.when(c("run_id") % 3 == 0, c("failed_stage")).when(c("run_id") % 3 == 1, " "),
        "error_reason_code": F.when(c("run_id") % 4 == 0, "colmap_unavailable"),
        "error_retryable": F.when(c("run_id") % 5 == 0, c("run_id") % 2 == 0),
        "progress": F.when(c("run_id") % 2 == 0, c("max_discount")), "status_message": F.lit("msg"),
        "images_dir": F.concat(F.lit("in/"), c("project_id").cast("string")), "failed_command": F.lit(""),
        "model_path": F.when(c("max_line") > 5, "out/box.glb"),
    })


def engine_report(spark, sf):
    out = B.engine_report(_failing(spark, sf))
    return out.select(*[n for n in out.columns if n not in ("stage_timings_by_phase", "warnings")],
                      "stage_timings_by_phase.mapper", "stage_timings_by_phase.dense", "stage_timings_by_phase.matcher",
                      F.size("warnings").alias("warning_count"))


def failure_record(spark, sf):
    out = B.failure_record(_failing(spark, sf).filter(F.col("status") == "failed"))
    return out.select(*[n for n in out.columns if n != "error"], F.col("error.code").alias("error_code"), F.concat_ws(
        ",", F.array_sort(F.map_keys("error.resources"))).alias("resources"))


def fallback_record(spark, sf):
    return B.fallback_record(_failing(spark, sf).filter("fallback_used")).withColumn("limitations", F.size("limitations"))


def project_events(spark, sf):
    c = F.col
    return B.apply_event(_named(T.runs(spark, sf)).withColumns({
        "event": F.element_at(F.array(*[F.lit(e) for e in ("start", "update", "complete", "fail")]), (c("run_id") % 4 + 1).cast("int")),
        "image_count": c("selected_images"), "requested_format": F.lit("obj"), "new_model": F.lit("new.obj"),
        "reason": F.lit("sin memoria")}))


QUERIES = {
    "run_stats_by_scope": _stats,
    "run_stats_by_key": stats_by_key,
    "success_failure": lambda s, d: R.success_failure(_stats(s, d)),
    "reduction_time": lambda s, d: R.reduction_time(_stats(s, d)),
    "variant_delta": lambda s, d: R.variant_delta(_stats(s, d), BASE, ENHANCED),
    "before_after": lambda s, d: R.before_after(_stats(s, d), BASE, ENHANCED),
    "flatten_runs": run_records,
    "build_run_record": run_record_gates,
    "filter_scenario": lambda s, d: R.filter_scenario(T.runs(s, d), " Mixed").select(*R.RUN_COLUMNS[:13]),
    "variant_metrics": lambda s, d: R.variant_metrics(report_rows(s, d)),
    "scenario_variant_metrics": lambda s, d: R.scenario_variant_metrics(report_rows(s, d)),
    "grade_runs": lambda s, d: R.grade_runs(T.graded_inputs(s, d)),
    "incoherence_reasons": lambda s, d: T.graded_inputs(s, d).select("run_id", G.incoherence_reasons(
        F.col("reconstruction_type"), F.col("final_mesh_method"), F.col("registered_image_count"),
        F.col("point_3d_count"), F.col("mesh_face_count"), F.col("extent_ratio"), F.col("fill_ratio"),
    ).alias("reason")).filter(F.col("reason").isNotNull()),
    "profile_comparison": profile_rows,
    "profile_summary": lambda s, d: R.profile_summary(profile_rows(s, d)),
    "history_overview": history_overview,
    "success_conditions": lambda s, d: R.success_conditions(history(s, d)),
    "train_thresholds": train_thresholds,
    "train_calibrator": train_calibrator,
    "predict_success": predict_success,
    "predict_success_learned": predict_success_learned,
    "run_labels": labels,
    "status_details": status_details,
    "artifact_consistent": artifact_consistent,
    "collect_warnings": result_warnings,
    "next_action": next_actions,
    "with_profile_params": profile_params,
    "evidence_manifest": evidence_manifest,
    "latest_project": latest_project,
    "texture_strategy": texture_strategy,
    "engine_report": engine_report,
    "failure_record": failure_record,
    "fallback_record": fallback_record,
    "project_events": project_events,
}


def _report_sql(group: str, keys: str, extra: str) -> str:
    return f"""WITH {T.RUNS_SQL}, g AS (
  SELECT {keys}, count(*) AS run_count, count(*) FILTER (status = 'completed') AS completed_count,
    count(*) FILTER (status = 'failed') AS failed_count,
    count(*) FILTER (blocked_by_input_deficiency) AS blocked_count,
    sum(total_images_loaded)::BIGINT AS total_images_loaded, sum(accepted_images)::BIGINT AS accepted_images,
    sum(rejected_images)::BIGINT AS rejected_images, sum(selected_images)::BIGINT AS selected_images,
    sum(selection_discarded_images)::BIGINT AS selection_discarded_images,
    round(avg(coalesce(input_reduction_pct, 0)), 3) AS avg_input_reduction_pct,
    round(avg(coalesce(total_processing_seconds, 0)), 3) AS avg_total_processing_seconds,
    round(avg(total_images_loaded), 3) AS avg_loaded_images, round(avg(accepted_images), 3) AS avg_accepted_images,
    round(avg(rejected_images), 3) AS avg_rejected_images, round(avg(selected_images), 3) AS avg_selected_images
  FROM runs GROUP BY {group})
SELECT {extra} FROM g"""


def _pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round({a}::DOUBLE / {b} * 100.0::DOUBLE, 3) ELSE 0.0::DOUBLE END"


_HIST_SECTIONS = """
sections AS (
  SELECT 'class' AS section, quality_classification AS key, count(*)::DOUBLE AS value FROM history GROUP BY 2
  UNION ALL SELECT 'profile', profile, count(*)::DOUBLE FROM history GROUP BY 2
  UNION ALL (SELECT 'success_real_by_dataset', dataset_path, count(*)::DOUBLE FROM history
    WHERE quality_classification = 'success_real' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL (SELECT 'mean_points_by_dataset', dataset_path, round(avg(points3d_count), 2) FROM history
    GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10))"""

_THRESHOLD_SQL = """
means AS (SELECT count(*) AS sample_count,
    coalesce(avg(mesh_readiness_score) FILTER (lab = 'sparse_only'), 0) AS sp,
    coalesce(avg(mesh_readiness_score) FILTER (lab = 'approx_surface'), 0) AS su,
    coalesce(avg(mesh_readiness_score) FILTER (lab = 'dense_real'), 0) AS de
  FROM (SELECT *, CASE WHEN final_success_level IN ('dense_real', 'approx_surface', 'sparse_only')
    THEN final_success_level ELSE 'sparse_only' END AS lab FROM history)),
thresholds AS (SELECT 'heuristic_thresholds' AS method, sample_count,
    round(greatest(0.25::DOUBLE, least(0.8::DOUBLE, CASE WHEN su > 0 THEN (sp + su) / 2 ELSE 0.46 END)), 6)
      AS approx_surface_min_score,
    round(greatest(0.45::DOUBLE, least(0.9::DOUBLE, CASE WHEN de > 0 THEN (su + de) / 2 ELSE 0.67 END)), 6)
      AS dense_real_min_score
  FROM means)"""

_C = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))".format

ORACLES = {
    "run_stats_by_scope": f"WITH {STATS_SQL} SELECT * FROM stats",
    "run_stats_by_key": f"""WITH {T.RUNS_SQL}, scoped AS (
  SELECT *, 'year' AS scope_type, year(generated_at)::VARCHAR AS scope FROM runs
  UNION ALL SELECT *, 'size', CASE WHEN total_images_loaded > 4 THEN 'large' ELSE 'small' END FROM runs),
tops AS (SELECT scope_type, scope, failed_stage AS top_failed_stage FROM
    (SELECT scope_type, scope, failed_stage, count(*) AS n FROM scoped WHERE failed_stage IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY scope_type, scope ORDER BY n DESC, failed_stage) = 1)
SELECT g.scope_type, g.scope, run_count, success_rate, median_total_processing_seconds, top_failed_stage FROM (
  SELECT scope_type, scope, count(*) AS run_count,
    round((count(*) FILTER (status = 'completed'))::DOUBLE / count(*), 4) AS success_rate,
    round(median(total_processing_seconds), 3) AS median_total_processing_seconds
  FROM scoped GROUP BY ALL) g LEFT JOIN tops USING (scope_type, scope)""",
    "success_failure": f"""WITH {STATS_SQL}
SELECT scope_type, scope, run_count, completed_count, failed_count,
  round(success_rate * 100.0::DOUBLE, 3) AS success_rate_pct, round(failure_rate * 100.0::DOUBLE, 3) AS failure_rate_pct,
  round(input_blocked_rate * 100.0::DOUBLE, 3) AS input_blocked_rate_pct,
  round(fallback_rate * 100.0::DOUBLE, 3) AS fallback_rate_pct, top_failed_stage, top_reason_code FROM stats""",
    "reduction_time": f"""WITH {STATS_SQL}
SELECT scope_type, scope, avg_input_reduction_pct,
  coalesce(avg_total_processing_seconds, 0.0) AS avg_total_processing_seconds,
  coalesce(median_total_processing_seconds, 0.0) AS median_total_processing_seconds
FROM stats WHERE scope_type <> 'overall'""",
    "variant_delta": f"""WITH {STATS_SQL}
SELECT a.scope AS baseline_variant, b.scope AS improved_variant,
  round(b.success_rate - a.success_rate, 4) + 0.0 AS success_rate_delta,
  round(b.failure_rate - a.failure_rate, 4) + 0.0 AS failure_rate_delta,
  round(b.input_blocked_rate - a.input_blocked_rate, 4) + 0.0 AS input_blocked_rate_delta,
  round(b.fallback_rate - a.fallback_rate, 4) + 0.0 AS fallback_rate_delta,
  round(b.avg_total_processing_seconds - a.avg_total_processing_seconds, 3) + 0.0 AS avg_total_processing_seconds_delta,
  round(b.avg_input_reduction_pct - a.avg_input_reduction_pct, 3) + 0.0 AS avg_input_reduction_pct_delta
FROM stats a, stats b WHERE a.scope = '{BASE}' AND b.scope = '{ENHANCED}'""",
    "before_after": f"""WITH {STATS_SQL}, long AS (
""" + "\n  UNION ALL ".join(
        f"SELECT scope, {i} AS position, '{m}' AS metric, '{u}' AS unit, {d} AS digits, {v} AS value FROM stats "
        f"WHERE scope IN ('{BASE}', '{ENHANCED}')"
        for i, (m, u, d, v) in enumerate([
            ("run_count", "corridas", 0, "run_count::DOUBLE"),
            ("completed_count", "corridas", 0, "completed_count::DOUBLE"),
            ("failed_count", "corridas", 0, "failed_count::DOUBLE"),
            ("success_rate", "%", 4, "round(success_rate * 100.0::DOUBLE, 3)"),
            ("failure_rate", "%", 4, "round(failure_rate * 100.0::DOUBLE, 3)"),
            ("input_blocked_rate", "%", 4, "round(input_blocked_rate * 100.0::DOUBLE, 3)"),
            ("fallback_rate", "%", 4, "round(fallback_rate * 100.0::DOUBLE, 3)"),
            ("avg_input_reduction_pct", "%", 3, "avg_input_reduction_pct"),
            ("avg_total_processing_seconds", "segundos", 3, "avg_total_processing_seconds"),
            ("median_total_processing_seconds", "segundos", 3, "median_total_processing_seconds"),
        ])) + f""")
SELECT a.position::INT AS position, a.metric, a.unit, a.value AS baseline_value, b.value AS enhanced_value,
  CASE a.digits WHEN 0 THEN round(b.value - a.value, 0) WHEN 3 THEN round(b.value - a.value, 3)
    ELSE round(b.value - a.value, 4) END + 0.0 AS delta_enhanced_minus_baseline
FROM long a JOIN long b USING (position) WHERE a.scope = '{BASE}' AND b.scope = '{ENHANCED}'""",
    "flatten_runs": f"""WITH {T.RUNS_SQL}
SELECT run_id::VARCHAR AS run_id, project_id::VARCHAR AS project_id,
  strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at, status, variant, scenario_label, total_images_loaded,
  accepted_images, rejected_images, warning_images, selected_images, selection_discarded_images,
  input_reduction_pct, total_processing_seconds, failed_stage, reason_code, fallback_used,
  blocked_by_input_deficiency, final_artifact_type, final_artifact_size_bytes FROM runs""",
    "build_run_record": f"""WITH {T.RUNS_SQL}
SELECT '1.0' AS schema_version, run_id::VARCHAR AS run_id, blocked_by_input_deficiency,
  accepted_images <> 0 AS allow_processing_after_validation, selected_images <> 0 AS allow_processing_after_selection,
  coverage_possible_low, current_stage = 'completed_with_fallback' AS completed_with_fallback, scenario_source,
  input_reduction_ratio FROM runs""",
    "filter_scenario": f"WITH {T.RUNS_SQL} SELECT {', '.join(R.RUN_COLUMNS[:13])} FROM runs WHERE scenario_label = 'mixed'",
    "variant_metrics": _report_sql("1", "lower(variant) AS variant", ", ".join([
        "variant, run_count, completed_count, failed_count",
        _pct("completed_count", "run_count") + " AS success_rate_pct",
        _pct("failed_count", "run_count") + " AS failure_rate_pct",
        "blocked_count", _pct("blocked_count", "run_count") + " AS blocked_rate_pct",
        "total_images_loaded, accepted_images, rejected_images, selected_images, selection_discarded_images",
        _pct("accepted_images", "total_images_loaded") + " AS acceptance_rate_pct",
        _pct("rejected_images", "total_images_loaded") + " AS rejection_rate_pct",
        _pct("selected_images", "total_images_loaded") + " AS selected_vs_loaded_pct",
        _pct("selected_images", "accepted_images") + " AS selected_vs_accepted_pct",
        "avg_input_reduction_pct, avg_total_processing_seconds"])),
    "scenario_variant_metrics": _report_sql("1, 2", "scenario_label AS scenario, lower(variant) AS variant", ", ".join([
        "scenario, variant, run_count", _pct("completed_count", "run_count") + " AS success_rate_pct",
        _pct("failed_count", "run_count") + " AS failure_rate_pct",
        _pct("blocked_count", "run_count") + " AS blocked_rate_pct",
        "avg_total_processing_seconds, avg_input_reduction_pct, avg_loaded_images, avg_accepted_images, "
        "avg_rejected_images, avg_selected_images"])),
    "grade_runs": f"""WITH {T.GRADED_SQL}
SELECT run_id, project_id, status, source AS geometry_source, shown AS visualization_type,
  grade AS quality_classification,
  CASE grade WHEN 'success_real' THEN 'dense_real' WHEN 'success_approx_surface' THEN 'approx_surface'
    WHEN 'success_sparse_only' THEN 'sparse_only' WHEN 'fallback_completed' THEN 'fallback_only'
    ELSE 'failed' END AS final_success_level,
  cameras AS cameras_reconstructed, points AS points_3d_count,
  CASE WHEN points < 1500 THEN 'low' WHEN points <= 5000 THEN 'medium' ELSE 'high' END AS sparse_density_level,
  {T.half_up("""least(0.75::DOUBLE, points / 8000.0::DOUBLE * 0.75::DOUBLE)
    + least(0.25::DOUBLE, cameras / 24.0::DOUBLE * 0.25::DOUBLE)""", 3)} AS sparse_quality_score,
  mscore AS mesh_quality_score, texture AS texture_source, tscore AS texture_quality_score,
  {T.half_up("""least(1.0::DOUBLE, mscore * 0.65::DOUBLE + tscore * 0.35::DOUBLE + CASE grade
    WHEN 'success_real' THEN 0.1::DOUBLE WHEN 'success_approx_surface' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)""", 3)}
    AS final_model_visual_score,
  CASE WHEN texture IN ('best_image_projection', 'real_projection') AND tscore >= 0.45::DOUBLE THEN 'good'
    WHEN texture IN ('vertex_colors_from_colmap', 'average_image_color') AND tscore >= 0.25::DOUBLE THEN 'acceptable'
    WHEN tscore > 0 THEN 'basic' ELSE 'none' END AS final_model_texture_quality,
  CASE WHEN source NOT IN ('colmap_dense', 'surface_from_sparse', 'geometric_prior') THEN 'false'
    WHEN texture = 'average_image_color' THEN 'partial'
    WHEN tscore >= 0.45::DOUBLE AND grade IN ('success_real', 'success_approx_surface', 'fallback_completed') THEN 'true'
    WHEN tscore > 0 THEN 'partial' ELSE 'false' END AS final_model_is_presentable,
  CASE WHEN source = 'colmap_dense' AND faces >= 500 THEN 'high'
    WHEN source = 'surface_from_sparse' THEN CASE WHEN faces >= 500 THEN 'medium' ELSE 'low' END
    WHEN source = 'colmap_sparse_point_cloud' THEN CASE WHEN points >= 3000 THEN 'medium' ELSE 'low' END
    WHEN faces < 500 THEN 'low' ELSE 'none' END AS visual_quality_level,
  source IN ('colmap_dense', 'colmap_sparse_point_cloud', 'colmap_sparse', 'surface_from_sparse', 'geometric_prior')
    AS is_real_sfm,
  source = 'colmap_dense' AS is_dense_mesh,
  CASE WHEN source = 'primitive_box' THEN 'stand_in_only'
    WHEN grade = 'success_real' THEN 'dataset_ok'
    WHEN grade = 'success_sparse_only' THEN CASE WHEN NOT dense_exists THEN 'enable_dense' ELSE 'use_quality_profile' END
    WHEN points < 500 OR cameras < 6 THEN 'recapture' ELSE 'use_quality_profile' END AS recommendation,
  CASE WHEN grade = 'success_real' AND q * 4 >= 500 AND source IN ('colmap_dense', 'colmap_sparse_point_cloud',
      'colmap_sparse', 'surface_from_sparse', 'geometric_prior') THEN 'real'
    WHEN grade = 'success_approx_surface' THEN 'approximate_surface'
    WHEN grade = 'success_sparse_only' THEN 'partial_sparse' ELSE 'stand_in' END AS defensibility
FROM graded4""",
    "incoherence_reasons": f"""WITH {T.GRADED_SQL}, listed AS (
  SELECT run_id, list_filter([
    CASE WHEN registered < 8 THEN 'registered_image_count=' || registered || ' below threshold=8' END,
    CASE WHEN q * 10 < 1200 THEN 'sparse_point_count=' || q * 10 || ' below threshold=1200' END,
    CASE WHEN registered > 0 AND q * 10 / registered::DOUBLE < 180 THEN 'points_per_registered_image='
      || round(q * 10 / registered::DOUBLE, 3)::VARCHAR || ' below threshold=180' END,
    CASE WHEN faces < 20 THEN 'mesh_face_count=' || faces || ' below threshold=20' END,
    CASE WHEN faces > 700 THEN 'mesh_face_count=' || faces || ' above threshold=700' END,
    CASE WHEN max_line * 1.5::DOUBLE > 6.0 THEN 'extent_ratio_max_min=' || round(max_line * 1.5::DOUBLE, 3)::VARCHAR
      || ' above threshold=6.0' END,
    CASE WHEN max_discount * 12.0::DOUBLE < 0.12::DOUBLE OR max_discount * 12.0::DOUBLE > 1.05::DOUBLE THEN
      'mesh_volume_to_bbox_volume_ratio=' || round(max_discount * 12.0::DOUBLE, 3)::VARCHAR
      || ' outside range=[0.12, 1.05]' END,
    CASE WHEN method = 'bounding_box' THEN 'engine_completed_with_sparse_bounding_box' END
  ], lambda x: x IS NOT NULL) AS found
  FROM graded WHERE kind = 'sparse_photogrammetry_mesh_fallback'
    OR method IN ('delaunay_mesher_sparse', 'convex_hull', 'bounding_box'))
SELECT run_id, array_to_string(found, '; ') AS reason FROM listed WHERE len(found) > 0""",
    "profile_comparison": f"WITH {PROFILE_SQL} SELECT * FROM profile_rows",
    "profile_summary": f"""WITH {PROFILE_SQL}
SELECT profile, count(*) AS run_count, count(*) FILTER (fallback_used) AS fallback_count,
  round(avg(total_time_seconds), 3) AS avg_total_time_seconds, sum(images_accepted)::BIGINT AS images_accepted,
  max(cameras_reconstructed) AS max_cameras_reconstructed, max(points_3d_count) AS max_points_3d_count
FROM profile_rows GROUP BY profile""",
    "history_overview": f"WITH {HISTORY_SQL}, {_HIST_SECTIONS} SELECT * FROM sections",
    "success_conditions": f"""WITH {HISTORY_SQL}
SELECT count(*) AS run_count, round(avg(mesh_readiness_score), 3) AS mesh_readiness_score,
  round(avg(angular_coverage_score), 3) AS angular_coverage_score,
  round(avg(visual_variety_score), 3) AS visual_variety_score,
  round(avg(average_feature_points), 2) AS average_feature_points
FROM history WHERE final_success_level = 'dense_real'""",
    "train_thresholds": f"WITH {HISTORY_SQL}, {_THRESHOLD_SQL} SELECT * FROM thresholds",
    "predict_success": f"""WITH {HISTORY_SQL}, {_THRESHOLD_SQL}, sets AS (
  SELECT dataset_path, round(avg(mesh_readiness_score), 6) AS mesh_readiness_score,
    round(avg(angular_coverage_score), 6) AS angular_coverage_score,
    round(avg(visual_variety_score), 6) AS visual_variety_score,
    round(avg(average_feature_points), 6) AS average_feature_points,
    round(avg(usable_images_ratio), 6) AS usable_images_ratio,
    sum(image_count)::BIGINT AS image_count_valid, sum(image_count)::BIGINT AS image_count_total
  FROM history GROUP BY 1),
p0 AS (SELECT sets.*, {_C('''(mesh_readiness_score - dense_real_min_score + 0.22::DOUBLE) * 1.3::DOUBLE
      + angular_coverage_score * 0.15::DOUBLE + usable_images_ratio * 0.15::DOUBLE''')} AS d,
    {_C('''(mesh_readiness_score - approx_surface_min_score + 0.28::DOUBLE) * 1.2::DOUBLE
      + visual_variety_score * 0.12::DOUBLE
      + least(average_feature_points / 220.0::DOUBLE, 1.0::DOUBLE) * 0.12::DOUBLE''')} AS s0
  FROM sets, thresholds),
p1 AS (SELECT *, CASE WHEN d > 0.45 THEN s0 * 0.75::DOUBLE ELSE s0 END AS s FROM p0),
p2 AS (SELECT *, {_C('1.0::DOUBLE - greatest(d, s) * 0.75::DOUBLE')} AS sp FROM p1),
p3 AS (SELECT *, round(sp / greatest(1e-9::DOUBLE, d + s + sp), 6) AS prob_sparse,
    round(s / greatest(1e-9::DOUBLE, d + s + sp), 6) AS prob_approx_surface,
    round(d / greatest(1e-9::DOUBLE, d + s + sp), 6) AS prob_dense_real FROM p2)
SELECT * EXCLUDE (d, s0, s, sp),
  CASE WHEN prob_sparse >= prob_approx_surface AND prob_sparse >= prob_dense_real THEN 'sparse'
    WHEN prob_approx_surface >= prob_dense_real THEN 'approx_surface' ELSE 'dense_real' END AS predicted_success_level,
  CASE WHEN prob_dense_real >= 0.3::DOUBLE OR prob_approx_surface >= 0.45::DOUBLE THEN 'quality' ELSE 'balanced' END
    AS recommended_profile,
  prob_dense_real >= 0.2::DOUBLE OR prob_approx_surface >= 0.35::DOUBLE OR prob_sparse >= 0.5::DOUBLE AS should_run
FROM p3""",
    "run_labels": f"""WITH {T.RUNS_SQL}
SELECT run_id, scenario_label, input_reduction_ratio,
  CASE WHEN current_stage IN ('input_validation_failed', 'input_selection_failed') THEN 'preprocessing'
    WHEN current_stage = 'mapper' THEN 'reconstructing'
    WHEN current_stage = 'completed_with_fallback' THEN 'fallback_completed' ELSE current_stage END AS workflow_stage,
  coalesce(reason_code NOT IN ('input_validation_failed', 'input_selection_failed'), true) AS retryable,
  coalesce(reason_code, '') NOT IN ('input_validation_failed', 'input_selection_failed') AND selected_images >= 3
    AS fallback_eligible,
  max_line > 3 AND max_discount > 0.05 AS engine_fallback,
  max_line > 2 AND run_id % 3 <> 0 AS presentation,
  status IN ('completed', 'failed') OR final_artifact_type IS NOT NULL OR reason_code IS NOT NULL
    OR selected_images - 2 > 0 AS has_previous_state
FROM runs""",
    "status_details": f"""WITH {NAMED_SQL}, msg AS (
  SELECT *, coalesce(nullif(status_message, ''), error_message) AS raw FROM named),
shown AS (SELECT *, CASE WHEN status = 'failed' AND error_message <> '' AND lower(trim(coalesce(raw, ''))) IN
    ('', 'processing_failed', 'failed', 'error') THEN error_message ELSE raw END AS m,
    coalesce(final_model_path, output_path, model_path) AS path FROM msg)
SELECT run_id, project_id, coalesce(engine, 'auto') AS engine, current_stage,
  coalesce(nullif(stage_status, ''), CASE status WHEN 'processing' THEN 'running' ELSE status END) AS stage_status,
  coalesce(CASE WHEN progress IS NOT NULL THEN {_C('progress')} END,
    CASE WHEN status = 'completed' THEN 1.0::DOUBLE END) AS progress,
  coalesce(nullif(m, ''), CASE status WHEN 'completed' THEN 'completed'
    WHEN 'processing' THEN 'running' END) AS message,
  fallback_used,
  CASE WHEN done THEN coalesce(final_model_type, lower(string_split(path, '.')[-1])) END AS final_model_type,
  CASE WHEN done THEN path END AS final_model_path,
  CASE max_line WHEN 5 THEN 'convex_hull' WHEN 6 THEN 'poisson' END AS method_used
FROM shown""",
    "artifact_consistent": f"""WITH {NAMED_SQL}, c AS (
  SELECT run_id, done AND model_filename IS NOT NULL AS available,
    coalesce('.' || regexp_extract(model_filename, '\\.([^./]+)$', 1) = '.' || output_format, true) AS sfx,
    coalesce(string_split(coalesce(final_model_path, output_path, model_path), '/')[-1] = model_filename, true) AS nm
  FROM named)
SELECT run_id, available, available AND sfx AS suffix_matches, available AND nm AS name_matches,
  available AND sfx AND nm AS consistent FROM c""",
    "collect_warnings": f"""WITH {T.GRADED_SQL}
SELECT run_id, array_to_string(list_sort(list_distinct(list_filter([
  CASE WHEN max_line > 4 THEN 'many_images' END, CASE WHEN max_line > 2 THEN 'brightness' END,
  CASE WHEN fallback_used THEN 'fallback_used' END,
  CASE WHEN warning_images > 0 THEN 'image_warnings:' || warning_images END,
  'quality_classification:' || grade], lambda x: x IS NOT NULL))), '|') AS warnings
FROM graded3""",
    "next_action": f"""WITH {T.RUNS_SQL}
SELECT CASE WHEN status = 'failed'
    THEN 'recapture'
  WHEN fallback_used THEN 'keep_stand_in'
  WHEN warning_images > 0
    THEN 'review_warnings'
  WHEN status = 'completed' THEN 'inspect_model'
  ELSE 'wait' END AS action, status, count(*) AS runs
FROM runs GROUP BY ALL""",
    "with_profile_params": f"""WITH {T.RUNS_SQL}, asked AS (
  SELECT *, CASE variant WHEN '1-URGENT' THEN 'conservative' WHEN '4-NOT SPECIFIED' THEN 'quality'
    ELSE 'balanced' END AS profile, greatest(selected_images + rejected_images, 1e-6::DOUBLE) AS w FROM runs),
presets(profile, preprocessing_max_width, m, use_gpu, gpu_mode, timeout_seconds, validation_level,
    validation_min_images, selection_min_images, s) AS (VALUES
  ('conservative', 1280, 32, false, 'disabled', 900, 'strict', 6, 6, 0.05::DOUBLE),
  ('balanced', 1920, 60, true, 'auto', 1800, 'standard', 6, 6, 0.04::DOUBLE),
  ('quality', 2560, 100, true, 'auto', 3600, 'relaxed', 8, 8, 0.035::DOUBLE))
SELECT run_id, profile, preprocessing_max_width,
  CASE WHEN max_line = 7 THEN total_images_loaded::INT ELSE m END AS selection_max_images, use_gpu, gpu_mode,
  timeout_seconds, validation_level, validation_min_images, selection_min_images,
  CASE WHEN max_line = 6 THEN max_discount ELSE s END AS min_sharpness_reject,
  greatest(rejected_images, selected_images) AS warn_distance, least(rejected_images, selected_images) AS reject_distance,
  CASE WHEN selected_images + rejected_images = 0 THEN 0.65::DOUBLE ELSE round(selected_images / w, 6) END AS quality_weight,
  CASE WHEN selected_images + rejected_images = 0 THEN 0.35::DOUBLE ELSE round(rejected_images / w, 6) END AS diversity_weight,
  max_line AS near_duplicate_hamming,
  CASE WHEN warning_images <= max_line THEN max_line + 1 ELSE warning_images END AS diversity_min_hamming,
  round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, max_discount * 12.0::DOUBLE)), 6) AS target_keep_ratio
FROM asked JOIN presets USING (profile)""",
    "evidence_manifest": f"""WITH {T.RUNS_SQL}, found AS (
  SELECT project_id, label, max('runs/' || run_id || '/' || label) AS path FROM (
    SELECT project_id, run_id, unnest(list_filter([
      CASE WHEN max_line > 5 THEN 'quality_report' END, CASE WHEN selected_images > 1 THEN 'colmap_report' END,
      CASE WHEN accepted_images > 4 THEN 'preprocessing_manifest' END,
      CASE WHEN failed_stage = 'mapper' THEN 'colmap_logs' END,
      CASE WHEN status = 'completed' THEN 'final_model' END], lambda x: x IS NOT NULL)) AS label FROM runs)
  GROUP BY ALL),
expected AS (SELECT DISTINCT c_custkey AS project_id, unnest({T.sql_list(J.EVIDENCE_LABELS)}) AS label FROM customer)
SELECT e.project_id, e.label, path, path IS NULL AS missing
FROM expected e LEFT JOIN found f ON e.project_id = f.project_id AND e.label = f.label""",
    "latest_project": f"""WITH {T.RUNS_SQL}
SELECT project_id, coalesce(CASE WHEN max_line > 1 THEN generated_at END, TIMESTAMP '1990-01-01') AS seen_at
FROM runs ORDER BY seen_at DESC, project_id LIMIT 1""",
    "engine_report": f"""WITH {T.GRADED_SQL}
SELECT run_id, project_id, CASE WHEN max_line > 4 THEN 'quality' ELSE 'balanced' END AS profile, max_line > 3 AS gpu_requested,
  status <> 'failed' AND max_discount > 0.06 AS gpu_used, status <> 'failed' AND sparse_exists AS sparse_created,
  CASE WHEN status = 'failed' THEN 0 ELSE total_images_loaded END AS cameras_reconstructed,
  CASE WHEN status = 'failed' THEN 0 ELSE q * 10 END AS points3D_count, coalesce(registered, 0) AS images_registered,
  fallback_used, 'Tiempo de espera en ' || failed_stage AS failure_reason, qty AS mapper,
  {T.half_up('greatest(0.0::DOUBLE, max_discount - 0.05::DOUBLE) + qty / 4.0::DOUBLE', 3)} AS dense, 0.0::DOUBLE AS matcher,
  CASE WHEN status = 'failed' THEN 2 ELSE 0 END AS warning_count FROM graded4""",
    "failure_record": f"""WITH {T.RUNS_SQL}, f AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN failed_stage END AS ex,
    CASE WHEN run_id % 4 = 0 THEN 'colmap_unavailable' ELSE reason_code END AS code FROM runs WHERE status = 'failed'),
r AS (SELECT *, CASE WHEN run_id % 5 = 0 THEN run_id % 2 = 0 ELSE code NOT IN ('input_validation_failed',
    'input_selection_failed', 'colmap_unavailable') END AS re FROM f)
SELECT run_id, project_id, code AS reason_code, coalesce(ex, current_stage) AS failed_stage, coalesce(ex, 'failed') AS current_stage,
  'failed' AS stage_status, CASE WHEN run_id % 2 = 0 THEN max_discount ELSE 0.0::DOUBLE END AS progress,
  CASE WHEN ex IS NOT NULL THEN 'msg' ELSE 'processing_failed' END AS status_message,
  'Tiempo de espera en ' || failed_stage AS failure_reason, re AS retryable, re AS can_retry, code AS error_code,
  'images_dir' || CASE WHEN max_line > 5 THEN ',model_path' ELSE '' END AS resources FROM r""",
    "fallback_record": f"""WITH {T.RUNS_SQL}
SELECT run_id, project_id, CASE WHEN run_id % 4 = 0 THEN 'colmap_unavailable' ELSE 'processing_failed' END AS reason_code,
  NULL::VARCHAR AS reason_message, CASE WHEN max_line > 4 THEN 'quality' WHEN max_line > 2 THEN 'odd' ELSE 'balanced' END AS profile,
  'colmap' AS engine_attempted, 'primitive_box_academic_fallback' AS fallback_type, selected_images AS images_used,
  3 AS limitations, CASE WHEN max_line > 5 THEN 'out/box.glb' END AS generated_model_path FROM runs WHERE fallback_used""",
    "project_events": f"""WITH {NAMED_SQL}, e AS (SELECT *, (['start', 'update', 'complete', 'fail'])[run_id % 4 + 1] AS event FROM named),
r AS (SELECT *, CASE WHEN event = 'start' THEN CASE WHEN status = 'processing' THEN 'already_running'
    WHEN selected_images = 0 THEN 'no_images' END END AS refused FROM e),
m AS (SELECT *, refused IS NULL AND event <> 'update' AS moved FROM r)
SELECT run_id, project_id, event, CASE WHEN NOT moved THEN status ELSE CASE event WHEN 'start' THEN 'processing'
    WHEN 'complete' THEN 'completed' ELSE 'failed' END END AS status, refused,
  CASE WHEN moved AND event <> 'fail' THEN 'obj' ELSE output_format END AS output_format,
  CASE WHEN moved THEN CASE WHEN event = 'complete' THEN 'new.obj' END ELSE model_filename END AS model_filename,
  CASE WHEN moved THEN CASE WHEN event = 'fail' THEN 'sin memoria' END ELSE error_message END AS error_message,
  moved OR (event = 'update' AND status = 'processing') AS touched FROM m""",
    "texture_strategy": f"""WITH {T.GRADED_SQL}, t AS (
  SELECT *, CASE WHEN max_line > 5 AND selected_images > 0 AND faces > 0 THEN 1 WHEN rejected_images > 0 THEN 2
    WHEN warning_images > 0 THEN 3 ELSE 4 END AS k, q * 10 AS pts FROM graded)
SELECT run_id, (['best_image_projection', 'vertex_colors_from_colmap', 'average_image_color', 'average_image_color'])[k]
    AS texture_source,
  (['box_like_multiview_face_colors', 'nearest_sparse_color_transfer', 'global_average_color',
    'neutral_fallback_color'])[k] AS texture_method,
  ([0.66::DOUBLE, 0.58::DOUBLE, 0.3::DOUBLE, 0.15::DOUBLE])[k] AS texture_confidence,
  CASE WHEN k <= 2 THEN faces ELSE 0 END AS textured_faces_count,
  CASE WHEN k <= 2 THEN 0 ELSE faces END AS untextured_faces_count,
  least(selected_images, ([6, 3, 2, 0])[k]) AS selected_image_count, k > 2 AS fallback_texture_used,
  {T.half_up("""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE * least(1.0::DOUBLE,
    (pts - rejected_images * 20) / greatest(1.0::DOUBLE, pts::DOUBLE))
    + 0.55::DOUBLE * least(1.0::DOUBLE, faces / 5000.0::DOUBLE)
    + CASE WHEN method = 'ball_pivoting' THEN 0.1::DOUBLE WHEN method = 'convex_hull' THEN 0.05::DOUBLE
      ELSE 0.0::DOUBLE END))""", 3)} AS surface_confidence
FROM t""",
}
