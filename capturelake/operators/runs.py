"""Run-history analytics: flattening, statistics, comparisons, report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions.scores import first_text, first_truthy, group_key, lower_key, pct, to_bool, to_float, to_int
from ..session import durable
from .scale import HOT_ROWS, Shape, exact_percentiles

# Column order of the exported run table.
RUN_COLUMNS = (
    "run_id", "project_id", "generated_at", "status", "variant", "scenario_label",
    "total_images_loaded", "accepted_images", "rejected_images", "warning_images",
    "selected_images", "selection_discarded_images", "input_reduction_pct",
    "total_processing_seconds", "failed_stage", "reason_code", "fallback_used",
    "blocked_by_input_deficiency", "final_artifact_type", "final_artifact_size_bytes",
)
RATE_METRICS = ("success_rate", "failure_rate", "input_blocked_rate", "fallback_rate")


REASON_COUNTS = ("validation_rejected_reason_counts", "validation_warning_reason_counts", "selection_discarded_reason_counts")
SOURCES = ("execution_report_path", "input_validation_report_path", "input_selection_report_path")


def build_run_record(flat: DataFrame) -> DataFrame:
    """Versioned nested run records out of flat per-run metrics.

    Optional columns: the three reason counters (maps), ``blocking_reasons``
    (array), ``stage_timings_seconds`` (map), ``stage_observed_count``,
    ``retryable``, ``output_artifacts`` (array) and the report paths. Absent
    counters are empty; the rest is null or, for retryable, told by the code.
    """
    c = F.col
    counters = "map<string,bigint>"

    def given(name: str, kind: str, default: Column | None = None) -> Column:
        value = c(name).cast(kind) if name in flat.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, default.cast(kind))).alias(name)

    blocking = given("blocking_reasons", "array<string>", F.array())
    blocked = F.aggregate(blocking, F.create_map().cast(counters), lambda m, r: F.map_zip_with(
        m, F.create_map(r, F.lit(1).cast("bigint")), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))
    timings = given("stage_timings_seconds", "map<string,double>", F.create_map())
    return flat.select(
        F.lit("1.0").alias("schema_version"),
        c("run_id").cast("string").alias("run_id"),
        c("generated_at").cast("string").alias("generated_at"),
        F.struct(
            c("project_id").cast("string").alias("project_id"), F.lower(F.trim("status")).alias("status"),
            "variant", "scenario_label", "scenario_source",
        ).alias("run_info"),
        F.struct(
            "total_images_loaded", "accepted_images", "rejected_images", "warning_images", "selected_images",
            "selection_discarded_images",
            F.round("input_reduction_ratio", 4).alias("input_reduction_ratio"),
            F.round(c("input_reduction_ratio") * 100.0, 2).alias("input_reduction_pct"),
        ).alias("input_metrics"),
        F.struct(
            *[given(n, counters, F.create_map()) for n in REASON_COUNTS], blocked.alias("pipeline_blocking_reasons"),
        ).alias("reason_frequencies"),
        F.struct(
            "total_processing_seconds", timings, given("stage_observed_count", "int", F.size(timings)),
            "current_stage", "failed_stage", "reason_code",
            given("retryable", "boolean", F.when(c("reason_code").isNotNull(), G.retryable(c("reason_code"), F.lit(None).cast("string")))),
            "fallback_used",
            F.coalesce(c("current_stage") == "completed_with_fallback", F.lit(False)).alias("completed_with_fallback"),
        ).alias("execution_metrics"),
        F.struct(
            "blocked_by_input_deficiency",
            F.coalesce(c("allow_processing_after_validation"), F.lit(True)).alias("allow_processing_after_validation"),
            F.coalesce(c("allow_processing_after_selection"), F.lit(True)).alias("allow_processing_after_selection"),
            F.coalesce(c("coverage_possible_low"), F.lit(False)).alias("coverage_possible_low"),
        ).alias("quality_gates"),
        F.struct("final_artifact_type", "final_artifact_size_bytes", given("output_artifacts", "array<string>", F.array())).alias(
            "artifact_metrics"),
        F.struct(*[given(n, "string") for n in SOURCES]).alias("sources"),
    )


def flatten_runs(records: DataFrame) -> DataFrame:
    """One flat row per nested run record, in report column order."""

    def text(path: str) -> Column:
        return first_text(F.col(path).cast("string"))

    return records.select(
        "run_id", text("run_info.project_id").alias("project_id"), "generated_at",
        text("run_info.status").alias("status"), text("run_info.variant").alias("variant"),
        text("run_info.scenario_label").alias("scenario_label"),
        *[f"input_metrics.{n}" for n in RUN_COLUMNS[6:13]],
        "execution_metrics.total_processing_seconds",
        text("execution_metrics.failed_stage").alias("failed_stage"),
        text("execution_metrics.reason_code").alias("reason_code"),
        "execution_metrics.fallback_used", "quality_gates.blocked_by_input_deficiency",
        text("artifact_metrics.final_artifact_type").alias("final_artifact_type"),
        "artifact_metrics.final_artifact_size_bytes",
    )


def filter_scenario(runs: DataFrame, label: str) -> DataFrame:
    return runs.filter(F.lower(F.trim("scenario_label")) == label.strip().lower())


def by_scope(runs: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Repeat each run once per grouping: the whole, then every named key.

    ``scopes`` maps a scope type to any Column; the copies stay in the same
    task and collapse in the map-side part of the aggregate that follows.
    """
    entries = [F.struct(F.lit("overall").alias("scope_type"), F.lit("overall").alias("scope"))]
    entries += [F.struct(F.lit(n).alias("scope_type"), group_key(k).alias("scope")) for n, k in scopes.items()]
    return runs.select("*", F.explode(F.array(*entries)).alias("_s")).select("*", "_s.*").drop("_s")


def _top(counts: DataFrame, keys: Sequence[str], value: str, n: str, out: str) -> DataFrame:
    """Most frequent text per group out of partial counts; the smaller text wins ties."""
    totals = counts.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    return totals.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def top_key(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-blank text per group."""
    counts = df.groupBy(*keys, first_text(F.col(value).cast("string")).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    return _top(counts, keys, "_k", "_c", out)


def run_stats(runs: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Counts, rates, mean and median time, top failed stage and reason per group.

    One pass counts per group, failed stage and reason code. That small table
    yields the counts, the means and the top keys, and says how large the
    groups are; a second pass finds the medians.
    """
    keys = list(keys)
    c = F.col
    fine = durable(runs.groupBy(
        *keys, first_text(c("failed_stage")).alias("_stage"), first_text(c("reason_code")).alias("_code")
    ).agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(c("status") == "completed").alias("completed_count"),
        F.count_if(c("status") == "failed").alias("failed_count"),
        F.count_if("blocked_by_input_deficiency").alias("input_blocked_count"),
        F.count_if("fallback_used").alias("fallback_count"),
        F.sum("total_processing_seconds").alias("_seconds"), F.count("total_processing_seconds").alias("_timed"),
        F.sum("input_reduction_pct").alias("_reduction"), F.count("input_reduction_pct").alias("_reduced"),
    ))
    sums = [n for n in fine.columns if n not in (*keys, "_stage", "_code")]
    counted = fine.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])
    size = counted.agg(F.count(F.lit(1)), F.max("run_count")).first()
    medians = exact_percentiles(runs, keys, {"_median": (c("total_processing_seconds"), 0.5)}, hot_rows,
                                Shape(size[0], size[1] or 0))
    out = (
        counted.join(medians, keys, "left")
        .join(_top(fine, keys, "_stage", "run_count", "top_failed_stage"), keys, "left")
        .join(_top(fine, keys, "_code", "run_count", "top_reason_code"), keys, "left")
    )

    def rate(count: str) -> Column:
        return F.round(c(count) / c("run_count"), 4)

    return out.select(
        *keys, "run_count", "completed_count", "failed_count",
        rate("completed_count").alias("success_rate"), rate("failed_count").alias("failure_rate"),
        "input_blocked_count", rate("input_blocked_count").alias("input_blocked_rate"),
        "fallback_count", rate("fallback_count").alias("fallback_rate"),
        F.round(c("_seconds") / F.nullif("_timed", F.lit(0)), 3).alias("avg_total_processing_seconds"),
        F.round("_median", 3).alias("median_total_processing_seconds"),
        F.coalesce(F.round(c("_reduction") / F.nullif("_reduced", F.lit(0)), 3), F.lit(0.0)).alias("avg_input_reduction_pct"),
        "top_failed_stage", "top_reason_code",
    )


def run_stats_by_scope(runs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    scoped = by_scope(
        runs.select("status", "variant", "scenario_label", "blocked_by_input_deficiency", "fallback_used",
                    "total_processing_seconds", "input_reduction_pct", "failed_stage", "reason_code"),
        {"variant": F.col("variant"), "scenario": F.col("scenario_label")},
    )
    return run_stats(scoped, ["scope_type", "scope"], hot_rows)


def success_failure(stats: DataFrame) -> DataFrame:
    """Report form of the scope statistics, rates in percent."""
    return stats.select(
        "scope_type", "scope", "run_count", "completed_count", "failed_count",
        *[F.round(F.col(m) * 100.0, 3).alias(f"{m}_pct") for m in RATE_METRICS],
        "top_failed_stage", "top_reason_code",
    )


def reduction_time(stats: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return stats.filter(F.col("scope_type") != "overall").select(
        "scope_type", "scope",
        *[F.round(F.coalesce(F.col(m), zero), 3).alias(m)
          for m in ("avg_input_reduction_pct", "avg_total_processing_seconds", "median_total_processing_seconds")],
    )


def variant_delta(stats: DataFrame, baseline: str, improved: str) -> DataFrame:
    """One row of improved minus baseline; no row when either is missing."""
    digits = {**dict.fromkeys(RATE_METRICS, 4), "avg_total_processing_seconds": 3, "avg_input_reduction_pct": 3}
    chosen = stats.filter((F.col("scope_type") == "variant") & F.col("scope").isin(baseline, improved))

    def of(name: str, metric: str) -> Column:
        return F.max(F.when(F.col("scope") == name, F.col(metric)))

    return chosen.agg(
        F.count_distinct("scope").alias("_sides"),
        *[F.round(of(improved, m) - of(baseline, m), d).alias(f"{m}_delta") for m, d in digits.items()],
    ).filter(F.col("_sides") == 2).select(
        F.lit(baseline).alias("baseline_variant"), F.lit(improved).alias("improved_variant"),
        *[f"{m}_delta" for m in digits],
    )


def before_after(stats: DataFrame, baseline: str, enhanced: str) -> DataFrame:
    """Long comparison table: one row per metric with both values and the change."""
    # Metric, unit, digits of the change.
    metrics = (
        ("run_count", "corridas", 0),
        ("completed_count", "corridas", 0),
        ("failed_count", "corridas", 0),
        ("success_rate", "%", 4),
        ("failure_rate", "%", 4),
        ("input_blocked_rate", "%", 4),
        ("fallback_rate", "%", 4),
        ("avg_input_reduction_pct", "%", 3),
        ("avg_total_processing_seconds", "segundos", 3),
        ("median_total_processing_seconds", "segundos", 3),
    )

    def value(metric: str) -> Column:
        raw = F.col(metric).cast("double")
        return F.round(raw * 100.0, 3) if metric in RATE_METRICS else raw

    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.lit(u).alias("unit"),
                 F.lit(d).alias("digits"), value(m).alias("value"))
        for i, (m, u, d) in enumerate(metrics)
    ])
    both = (
        stats.filter((F.col("scope_type") == "variant") & F.col("scope").isin(baseline, enhanced))
        .select("scope", F.inline(rows))
        .groupBy("position", "metric", "unit", "digits")
        .agg(F.count(F.lit(1)).alias("sides"),
             F.max(F.when(F.col("scope") == baseline, F.col("value"))).alias("baseline_value"),
             F.max(F.when(F.col("scope") == enhanced, F.col("value"))).alias("enhanced_value"))
        .filter(F.col("sides") == 2)
    )
    change = F.col("enhanced_value") - F.col("baseline_value")
    rounded = F.when(F.col("digits") == 0, F.round(change, 0)).when(
        F.col("digits") == 3, F.round(change, 3)).otherwise(F.round(change, 4))
    return both.select("position", "metric", "unit", "baseline_value", "enhanced_value",
                       rounded.alias("delta_enhanced_minus_baseline")).orderBy("position")


def typed_report_rows(rows: DataFrame) -> DataFrame:
    """Types for a run table re-read from CSV, with blank and bad cells as zero."""
    ints = RUN_COLUMNS[6:12]
    return rows.select(
        lower_key(F.col("variant")).alias("variant"),
        lower_key(F.col("scenario_label")).alias("scenario_label"),
        F.lower(F.trim("status")).alias("status"),
        *[to_int(F.col(n)).alias(n) for n in ints],
        to_float(F.col("input_reduction_pct")).alias("input_reduction_pct"),
        to_float(F.col("total_processing_seconds")).alias("total_processing_seconds"),
        to_bool(F.col("blocked_by_input_deficiency")).alias("blocked_by_input_deficiency"),
    )


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if("blocked_by_input_deficiency").alias("blocked_count"),
    ]


def _mean_filled(name: str) -> Column:
    return F.round(F.avg(F.coalesce(F.col(name), F.lit(0))), 3)


def variant_metrics(rows: DataFrame) -> DataFrame:
    sums = ("total_images_loaded", "accepted_images", "rejected_images", "selected_images",
            "selection_discarded_images")
    grouped = rows.groupBy(lower_key(F.col("variant")).alias("variant")).agg(
        *_counts(), *[F.sum(n).cast("bigint").alias(n) for n in sums],
        _mean_filled("input_reduction_pct").alias("avg_input_reduction_pct"),
        _mean_filled("total_processing_seconds").alias("avg_total_processing_seconds"),
    )
    c = F.col
    runs, loaded = c("run_count"), c("total_images_loaded")
    return grouped.select(
        "variant", "run_count", "completed_count", "failed_count",
        pct(c("completed_count"), runs).alias("success_rate_pct"),
        pct(c("failed_count"), runs).alias("failure_rate_pct"),
        "blocked_count", pct(c("blocked_count"), runs).alias("blocked_rate_pct"), *sums,
        pct(c("accepted_images"), loaded).alias("acceptance_rate_pct"),
        pct(c("rejected_images"), loaded).alias("rejection_rate_pct"),
        pct(c("selected_images"), loaded).alias("selected_vs_loaded_pct"),
        pct(c("selected_images"), c("accepted_images")).alias("selected_vs_accepted_pct"),
        "avg_input_reduction_pct", "avg_total_processing_seconds",
    )


def scenario_variant_metrics(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy(
        lower_key(F.col("scenario_label")).alias("scenario"), lower_key(F.col("variant")).alias("variant")
    ).agg(
        *_counts(),
        _mean_filled("total_processing_seconds").alias("avg_total_processing_seconds"),
        _mean_filled("input_reduction_pct").alias("avg_input_reduction_pct"),
        _mean_filled("total_images_loaded").alias("avg_loaded_images"),
        _mean_filled("accepted_images").alias("avg_accepted_images"),
        _mean_filled("rejected_images").alias("avg_rejected_images"),
        _mean_filled("selected_images").alias("avg_selected_images"),
    )
    runs = F.col("run_count")
    return grouped.select(
        "scenario", "variant", "run_count",
        pct(F.col("completed_count"), runs).alias("success_rate_pct"),
        pct(F.col("failed_count"), runs).alias("failure_rate_pct"),
        pct(F.col("blocked_count"), runs).alias("blocked_rate_pct"),
        *[c for c in grouped.columns if c.startswith("avg_")],
    )


def explode_reasons(runs: DataFrame, maps: str = "reason_frequencies") -> DataFrame:
    """(reason_type, reason, count) rows out of a map of counters."""
    return (
        runs.select("run_id", "project_id", "variant", F.explode(maps).alias("reason_type", "_counts"))
        .select("run_id", "project_id", "variant", "reason_type", F.explode("_counts").alias("reason", "count"))
        .filter(F.col("count").isNotNull())
    )


def explode_stage_timings(runs: DataFrame, timings: str = "stage_timings_seconds") -> DataFrame:
    """One row per observed stage: blank names dropped, negatives as 0, 3 digits."""
    return (
        runs.select("run_id", "project_id", "variant", F.explode(timings).alias("_stage", "_seconds"))
        .select("run_id", "project_id", "variant", F.trim("_stage").alias("stage"),
                F.round(F.greatest(F.lit(0.0), F.col("_seconds")), 3).alias("duration_seconds"))
        .filter((F.col("stage") != "") & F.col("duration_seconds").isNotNull())
    )


def reason_totals(rows: DataFrame) -> DataFrame:
    keys = [lower_key(F.col(n)).alias(n) for n in ("variant", "reason_type", "reason")]
    return rows.groupBy(*keys).agg(F.sum(F.coalesce(F.col("count"), F.lit(0))).cast("bigint").alias("total_count"))


def top_reasons(totals: DataFrame, variant: str, n: int) -> DataFrame:
    order = [F.desc("total_count"), F.col("reason_type"), F.col("reason")]
    return (
        totals.filter(F.col("variant") == variant.strip().lower()).orderBy(*order).limit(n)
        .select("reason_type", "reason", "total_count",
                F.format_string("%s: %s -> %d", "reason_type", "reason", "total_count").alias("line"))
    )


def stage_timing_summary(rows: DataFrame) -> DataFrame:
    seconds = F.coalesce(F.col("duration_seconds"), F.lit(0.0))
    return rows.groupBy(
        lower_key(F.col("variant")).alias("variant"), lower_key(F.col("stage")).alias("stage")
    ).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.round(F.avg(seconds), 3).alias("avg_duration_seconds"),
        F.round(F.min(seconds), 3).alias("min_duration_seconds"),
        F.round(F.max(seconds), 3).alias("max_duration_seconds"),
    )


# Which stages make up which reported phase.
DENSE_STAGES = ("image_undistorter", "patch_match_stereo", "stereo_fusion", "poisson_mesher")


def phase_timings(rows: DataFrame, keys: Sequence[str], converter_prefix: str = "model_converter",
                  dense_stages: Sequence[str] = DENSE_STAGES, extractor: str = "feature_extractor",
                  matcher: str = "exhaustive_matcher", mapper: str = "mapper") -> DataFrame:
    seconds = F.greatest(F.lit(0.0), F.coalesce(F.col("duration_seconds"), F.lit(0.0)))

    def total(cond: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(cond, seconds)), F.lit(0.0)), 3)

    stage = F.col("stage")
    return rows.groupBy(*keys).agg(
        total(stage == extractor).alias("feature_extractor"),
        total(stage == matcher).alias("matcher"),
        total(stage == mapper).alias("mapper"),
        total(stage.startswith(converter_prefix)).alias("model_converter"),
        total(stage.isin(*dense_stages)).alias("dense"),
    )


def grade_runs(runs: DataFrame, keep: Sequence[str] = ("run_id", "project_id", "status")) -> DataFrame:
    """Quality class, geometry source, scores and recommendations per run.

    ``keep`` names the input columns to carry along.
    """
    c = F.col
    zero = F.lit(0).cast("bigint")
    flag = {n: F.coalesce(c(n), F.lit(False)) for n in
            ("visual_only", "surface_attempted", "surface_success", "sparse_exists", "dense_exists",
             "captured_texture_applied")}
    number = {n: F.coalesce(c(n), zero) for n in
              ("mesh_face_count", "dense_faces_real", "dense_vertices_real", "surface_faces_real",
               "surface_vertices_real")}
    base = runs.withColumns({
        "_kind": F.lower(F.trim(F.coalesce(c("reconstruction_type"), F.lit("")))),
        "cameras_reconstructed": first_truthy(
            c("registered_image_count"), c("camera_count"), c("reconstructed_camera_count"), default=zero),
        "points_3d_count": first_truthy(
            c("point_count"), c("point_3d_count"), c("sparse_point_cloud_count"), default=zero),
    })
    method = F.lower(F.trim(F.coalesce(c("final_mesh_method"), F.lit(""))))
    kind, faces = c("_kind"), number["mesh_face_count"]
    base = base.withColumn("geometry_source", G.geometry_source(
        kind, faces, flag["dense_exists"], flag["sparse_exists"], method))
    source, points, cameras = c("geometry_source"), c("points_3d_count"), c("cameras_reconstructed")
    base = base.withColumn("shown_as", G.visualization_type(source, c("visualization_type")))
    base = base.withColumn("quality_classification", G.quality_class(
        c("status"), kind, cameras, points, faces, number["dense_faces_real"], number["dense_vertices_real"],
        number["surface_faces_real"], number["surface_vertices_real"], flag["visual_only"],
        flag["surface_success"], flag["surface_attempted"], flag["sparse_exists"], flag["dense_exists"],
        c("shown_as"),
    )).withColumn("texture_source", G.texture_source(
        c("projected_texture"), c("color_strategy"), flag["captured_texture_applied"]))
    grade, texture = c("quality_classification"), c("texture_source")
    base = base.withColumns({
        "mesh_quality_score": G.mesh_score(source, points, cameras, flag["dense_exists"]),
        "texture_quality_score": G.texture_score(texture, flag["dense_exists"]),
    })
    score = c("texture_quality_score")
    real = source.isin(*G.REAL_SFM_SOURCES)
    return base.select(
        *keep, "geometry_source",
        c("shown_as").alias("visualization_type"), "quality_classification",
        G.success_level(grade).alias("final_success_level"),
        "cameras_reconstructed", "points_3d_count",
        G.density_level(points).alias("sparse_density_level"),
        G.sparse_score(points, cameras).alias("sparse_quality_score"),
        "mesh_quality_score", "texture_source", "texture_quality_score",
        G.visual_score(c("mesh_quality_score"), score, grade).alias("final_model_visual_score"),
        G.texture_quality(texture, score).alias("final_model_texture_quality"),
        G.presentable(source, texture, score, grade).alias("final_model_is_presentable"),
        G.visual_level(source, faces, points).alias("visual_quality_level"),
        real.alias("is_real_sfm"), (source == "colmap_dense").alias("is_dense_mesh"),
        G.advice(source, grade, flag["dense_exists"], points, cameras).alias("recommendation"),
        G.defensibility(grade, real, number["dense_faces_real"] >= 500).alias("defensibility"),
    )


def profile_comparison(runs: DataFrame) -> DataFrame:
    """Per-run row of a profile comparison, zero counting as missing."""
    c = F.col
    return runs.select(
        "profile", "project_id", "status",
        F.coalesce(first_text(c("quality_classification")), F.lit("failed")).alias("quality_classification"),
        first_truthy(c("total_processing_seconds"), default=0.0).alias("total_time_seconds"),
        first_truthy(c("image_count_accepted"), c("image_count_processed"), c("image_count_selected"))
        .cast("bigint").alias("images_accepted"),
        first_truthy(c("cameras_reconstructed"), c("registered_image_count")).cast("bigint")
        .alias("cameras_reconstructed"),
        first_truthy(c("points_3d_count"), c("sparse_point_cloud_count")).cast("bigint").alias("points_3d_count"),
        F.coalesce(c("fallback_used"), F.lit(False)).alias("fallback_used"),
        first_truthy(c("model_size_bytes")).cast("bigint").alias("model_size_bytes"),
    )


def profile_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("profile").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if("fallback_used").alias("fallback_count"),
        F.round(F.avg("total_time_seconds"), 3).alias("avg_total_time_seconds"),
        F.sum("images_accepted").cast("bigint").alias("images_accepted"),
        F.max("cameras_reconstructed").alias("max_cameras_reconstructed"),
        F.max("points_3d_count").alias("max_points_3d_count"),
    )


def history_overview(history: DataFrame, n: int) -> DataFrame:
    """Counts by class and profile, the ``n`` top datasets by mean points and by real successes.

    The history is read once, into counts and point sums per class, profile and dataset.
    """
    c = F.col
    fine = durable(history.groupBy(
        group_key(c("quality_classification")).alias("class"), group_key(c("profile")).alias("profile"),
        group_key(c("dataset_path")).alias("dataset"),
    ).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(c("points3D_count"), F.lit(0))).alias("_points")))

    def rows(section: str, key: str, value: Column, source: DataFrame = fine) -> DataFrame:
        return source.groupBy(c(key).alias("key")).agg(F.round(value.cast("double"), 2).alias("value")).select(
            F.lit(section).alias("section"), "key", "value")

    count = F.sum("_n")
    best = rows("success_real_by_dataset", "dataset", count, fine.filter(c("class") == "success_real"))
    mean = rows("mean_points_by_dataset", "dataset", F.sum("_points") / F.sum("_n"))
    order = [F.desc("value"), F.col("key")]
    return (
        rows("class", "class", count).unionByName(rows("profile", "profile", count))
        .unionByName(best.orderBy(*order).limit(n)).unionByName(mean.orderBy(*order).limit(n))
    )


def success_conditions(history: DataFrame) -> DataFrame:
    return history.filter(F.col("final_success_level") == "dense_real").agg(
        F.count(F.lit(1)).alias("run_count"),
        *[F.round(F.avg(F.coalesce(F.col(n), F.lit(0))), d).alias(n) for n, d in
          (("mesh_readiness_score", 3), ("angular_coverage_score", 3), ("visual_variety_score", 3),
           ("average_feature_points", 2))],
    )


def latest_project(projects: DataFrame) -> DataFrame:
    """The project touched last, by update time or else by file time."""
    seen = F.coalesce(F.col("updated_at"), F.col("modified_at"))
    return projects.withColumn("seen_at", seen).orderBy(F.desc("seen_at"), F.col("project_id")).limit(1)
