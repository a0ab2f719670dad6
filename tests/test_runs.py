from pyspark.sql import functions as F

from capturelake.functions import grading as G
from capturelake.operators import predict as P
from capturelake.operators import projects as J
from capturelake.operators import runs as R


def one(df):
    return df.first().asDict()


RUNS = ("status string, variant string, scenario_label string, total_processing_seconds double, input_reduction_pct double, "
        "blocked_by_input_deficiency boolean, fallback_used boolean, failed_stage string, reason_code string")


def test_variant_comparison(spark):
    runs = spark.createDataFrame([
        ("completed", "baseline", "good", 90.0, 0.0, False, False, None, None),
        ("completed", "enhanced", "good", 61.0, 33.3, False, False, None, None),
    ], RUNS)
    stats = R.run_stats_by_scope(runs)
    delta = one(R.variant_delta(stats, "baseline", "enhanced"))
    assert delta["success_rate_delta"] == 0.0
    assert delta["avg_total_processing_seconds_delta"] == -29.0
    assert delta["avg_input_reduction_pct_delta"] == 33.3
    assert R.variant_delta(stats, "baseline", "absent").count() == 0
    assert R.before_after(stats, "baseline", "enhanced").count() == 10


def test_ties_and_nulls_in_group_statistics(spark):
    runs = spark.createDataFrame([
        ("failed", "a", "bad", None, None, True, False, "mapper", " x "),
        ("failed", "a", "bad", 4.0, None, True, False, "export", ""),
        ("completed", None, "", 2.0, 10.0, False, True, " ", None),
    ], RUNS)
    stats = {(r.scope_type, r.scope): r for r in R.run_stats_by_scope(runs, hot_rows=1).collect()}
    whole = stats["overall", "overall"]
    assert (whole.run_count, whole.top_failed_stage, whole.top_reason_code) == (3, "export", "x")
    assert whole.median_total_processing_seconds == 3.0 and whole.avg_input_reduction_pct == 10.0
    assert stats["variant", "a"].avg_input_reduction_pct == 0.0
    assert ("variant", "unknown") in stats and ("scenario", "unknown") in stats


def test_report_tables_from_text(spark):
    cells = [
        ("completed", "baseline", "good", "10", "9", "1", "9", "0", "0", "5.0", "False"),
        ("completed", "enhanced", "good", "10", "6", "4", "4", "2", "33.3", "3.0", "False"),
        ("failed", "enhanced", "bad", "5", "0", "5", "0", "0", "", "bad", "True"),
    ]
    names = ["status", "variant", "scenario_label", "total_images_loaded", "accepted_images", "rejected_images",
             "selected_images", "selection_discarded_images", "input_reduction_pct", "total_processing_seconds",
             "blocked_by_input_deficiency"]
    rows = spark.createDataFrame(cells, ", ".join(f"{n} string" for n in names)).withColumn("warning_images", F.lit("1"))
    got = {r.variant: r for r in R.variant_metrics(R.typed_report_rows(rows)).collect()}
    assert got["baseline"].success_rate_pct == 100.0
    e = got["enhanced"]
    assert (e.run_count, e.failure_rate_pct, e.blocked_rate_pct, e.acceptance_rate_pct, e.rejection_rate_pct) == (
        2, 50.0, 50.0, 40.0, 60.0)
    assert (e.selected_vs_loaded_pct, e.selected_vs_accepted_pct) == (26.667, 66.667)
    assert (e.avg_input_reduction_pct, e.avg_total_processing_seconds) == (16.65, 1.5)
    bad = {(r.scenario, r.variant): r for r in R.scenario_variant_metrics(R.typed_report_rows(rows)).collect()}
    assert bad["bad", "enhanced"].failure_rate_pct == 100.0


def test_scenario_limits(spark):
    cases = [((24, 4, 20, 12), False, "mixed"), ((8, 7, 1, 0), True, "bad"), ((0, 0, 0, 0), False, "unknown"),
             ((20, 0, 20, 20), False, "good"), ((20, 9, 11, 11), False, "bad"), ((20, 4, 16, 16), False, "mixed")]
    for (total, rejected, accepted, selected), blocked, want in cases:
        label = G.scenario(F.lit(total), F.lit(rejected), F.lit(accepted), F.lit(selected), F.lit(blocked), F.lit(False))
        assert spark.range(1).select(label).first()[0] == want


GRADED = ("run_id long, project_id long, status string, reconstruction_type string, registered_image_count int, "
          "camera_count int, reconstructed_camera_count int, point_count long, point_3d_count long, "
          "sparse_point_cloud_count long, mesh_face_count long, dense_faces_real long, dense_vertices_real long, "
          "surface_faces_real long, surface_vertices_real long, visual_only boolean, surface_attempted boolean, "
          "surface_success boolean, visualization_type string, final_mesh_method string, sparse_exists boolean, "
          "dense_exists boolean, projected_texture string, color_strategy string, captured_texture_applied boolean")
FIELDS = [f.split()[0] for f in GRADED.split(", ")]


def grade(spark, **facts):
    row = {n: None for n in FIELDS} | {"run_id": 1, "status": "completed"} | facts
    return one(R.grade_runs(spark.createDataFrame([tuple(row[n] for n in FIELDS)], GRADED)))


def test_quality_rule_table(spark):
    cloud, surface = "sparse_photogrammetry_point_cloud_fallback", "sparse_surface_reconstruction"
    cases = [
        (dict(reconstruction_type="approximate_box_primitive_fallback", registered_image_count=30, point_count=8000), "fallback_completed"),
        (dict(reconstruction_type="sparse_photogrammetry_mesh_fallback", registered_image_count=5, point_count=300, sparse_exists=True), "fallback_completed"),
        (dict(reconstruction_type=cloud, registered_image_count=16, point_count=3000, mesh_face_count=0, sparse_exists=True, visualization_type="point_spheres"), "success_sparse_only"),
        (dict(reconstruction_type="dense_photogrammetry_mesh", registered_image_count=16, point_count=8000, mesh_face_count=500, dense_faces_real=500, dense_vertices_real=300, dense_exists=True), "success_real"),
        (dict(reconstruction_type=surface, registered_image_count=26, point_count=1630, mesh_face_count=1200, surface_faces_real=1200, surface_vertices_real=320, sparse_exists=True, surface_success=True), "success_approx_surface"),
        (dict(reconstruction_type=surface, registered_image_count=26, point_count=1637, mesh_face_count=8, sparse_exists=True, surface_attempted=True), "fallback_completed"),
        (dict(reconstruction_type=cloud, registered_image_count=26, point_count=1637, mesh_face_count=120000, visual_only=True, surface_faces_real=76, surface_vertices_real=40, sparse_exists=True, surface_attempted=True, visualization_type="point_spheres"), "success_sparse_only"),
        (dict(reconstruction_type=cloud, registered_image_count=16, point_count=886, mesh_face_count=0, sparse_exists=True, visualization_type="point_spheres"), "fallback_completed"),
        (dict(reconstruction_type=surface, registered_image_count=24, point_count=2600, mesh_face_count=420, surface_faces_real=420, surface_vertices_real=130, sparse_exists=True, surface_attempted=True), "fallback_completed"),
    ]
    for facts, want in cases:
        assert grade(spark, **facts)["quality_classification"] == want, facts
    assert grade(spark, status="failed")["quality_classification"] == "failed"
    hull = grade(spark, reconstruction_type="sparse_photogrammetry_mesh_fallback", registered_image_count=8,
                 point_count=1200, sparse_exists=True, final_mesh_method="convex_hull")
    assert hull["geometry_source"] == "colmap_sparse"
    prior = grade(spark, reconstruction_type="sparse_geometric_prior_reconstruction", registered_image_count=24,
                  point_count=2000, mesh_face_count=1200, sparse_exists=True)
    assert prior["quality_classification"] != "success_real"


def test_thresholds_and_prediction(spark):
    history = spark.createDataFrame(
        [(0.35, "success_sparse_only", None), (0.55, "success_approx_surface", None), (0.78, "success_real", None)],
        "mesh_readiness_score double, quality_classification string, final_success_level string")
    model = one(P.train_thresholds(history))
    assert (model["approx_surface_min_score"], model["dense_real_min_score"]) == (0.45, 0.665)
    data = spark.createDataFrame(
        [(0.72, 0.68, 0.52, 135.0, 0.82, 52, 52)],
        "mesh_readiness_score double, angular_coverage_score double, visual_variety_score double, "
        "average_feature_points double, usable_images_ratio double, image_count_valid int, image_count_total int")
    got = one(P.predict_success(data))
    assert (got["prob_sparse"], got["prob_approx_surface"], got["prob_dense_real"]) == (0.324421, 0.34128, 0.334299)
    assert (got["predicted_success_level"], got["recommended_profile"], got["should_run"]) == ("approx_surface", "quality", True)
    learned = one(P.predict_success(data, spark.range(1).select(F.lit(P.LOGISTIC).alias("method"))))
    assert abs(sum(learned[f"prob_{n}"] for n in ("sparse", "approx_surface", "dense_real")) - 1) < 1e-5


def test_short_history_falls_back_to_thresholds(spark):
    history = spark.createDataFrame(
        [(0.3, "success_real", None)] * 5, "mesh_readiness_score double, quality_classification string, final_success_level string")
    assert one(P.train_calibrator(history))["method"] == P.HEURISTIC


def test_logistic_fit_is_stationary(spark):
    """At the optimum the penalised gradient vanishes; the intercept is free."""
    rows = [((i * 7 % 50) / 50, (i * 3 % 12) / 12, (i % 9) / 9, float(i * 11 % 240), (i % 10) / 10, float(i % 70),
             ["success_real", "success_approx_surface", "success_sparse_only"][(i * i + i // 3) % 3], None) for i in range(120)]
    names = ["mesh_readiness_score", "angular_coverage_score", "visual_variety_score", "average_feature_points",
             "usable_images_ratio", "image_count"]
    history = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", quality_classification string, final_success_level string")
    model = one(P.train_calibrator(history))
    assert model["method"] == P.LOGISTIC
    import numpy as np

    x = np.array([r[:6] for r in rows])
    x[:, 3], x[:, 5] = np.minimum(x[:, 3] / 200, 1.2), np.minimum(x[:, 5] / 60, 1.2)
    y = np.array([r[6] == "success_real" for r in rows], dtype=float)
    w = np.array([model[f"w_{n}_dense"] for n in P.FEATURES])
    fitted = 1 / (1 + np.exp(-(x @ w + model["bias_dense"])))
    assert abs((fitted - y).sum()) < 0.05
    assert np.abs(x.T @ (fitted - y) + w).max() < 0.05


def test_names(spark):
    rows = [("Caja", "p1", "out/azitromicina_canonical.glb", "Azitromicina"),
            ("Proyecto-cafebabefeed", "cafebabefeed", "out/azitromicina_canonical.glb", "Azitromicina"),
            ("Azitromicina caja lateral", "p2", "out/other.glb", "Azitromicina caja lateral"),
            ("box", "p3", "modelo_final.obj", "box")]
    df = spark.createDataFrame(rows, "name string, id string, candidate string, want string")
    for r in df.withColumn("got", J.resolved_name(F.col("name"), F.col("id"), F.col("candidate"))).collect():
        assert r.got == r.want


def test_document_merge(spark):
    t = "id int, doc map<string,map<string,string>>"
    base = spark.createDataFrame([(1, {"a": {"x": "1", "y": "2"}, "b": {"k": "v"}}), (2, {"a": {"x": "1"}})], t)
    update = spark.createDataFrame([(1, {"a": {"y": "3", "z": "4"}, "c": {"q": "w"}}), (3, {"n": {"m": "o"}})], t)
    got = {r.id: r.doc for r in J.merge_documents(base, update, ["id"]).collect()}
    assert got == {1: {"a": {"x": "1", "y": "3", "z": "4"}, "b": {"k": "v"}, "c": {"q": "w"}}, 2: {"a": {"x": "1"}},
                   3: {"n": {"m": "o"}}}


def test_best_submodel(spark):
    df = spark.createDataFrame([("p", "0", 2, 227), ("p", "1", 7, 538), ("q", "9", 1, 1), ("q", "10", 1, 1), ("r", "5", 1, 1), ("r", "x", 1, 1)],
                               "project string, dir string, registered int, points int")
    assert {r.project: r.dir for r in J.best_submodel(df, ["project"]).collect()} == {"p": "1", "q": "10", "r": "x"}
