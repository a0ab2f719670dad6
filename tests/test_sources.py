import json

from pyspark.sql import functions as F

from capturelake.operators import clouds as C
from capturelake.sources import readers, writers
from capturelake.streaming import tables as ST


def test_json_log_skips_bad_lines(spark, tmp_path):
    log = tmp_path / "log.ndjson"
    log.write_text(json.dumps({"project_id": "a", "image_count": 3}) + "\n{broken\n\n[1, 2]\n" + json.dumps({"project_id": "b"}) + "\n")
    good, bad = readers.read_json_lines(spark, str(log), readers.HISTORY_SCHEMA)
    assert sorted(r.project_id for r in good.collect()) == ["a", "b"]
    assert bad.count() == 2


def test_report_csv(spark, tmp_path):
    columns = ["variant", "run_count", "absent"]
    assert readers.read_report_csv(spark, str(tmp_path / "none"), columns).count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, run_count int")
    writers.write_report_csv(df, str(tmp_path / "t"), columns, single_file=True)
    back = readers.read_report_csv(spark, str(tmp_path / "t"), columns)
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1", None), ("b", "2", None)]


def test_model_text(spark, tmp_path):
    pts = tmp_path / "points3D.txt"
    lines = ["# header", "", "1 0.0 1.0 1.1 10 20 30 0.5 1 2", "2 1.2 0.0 0.1 255 0 0 0.1", "3 x 0 0 1 2 3 0.1", "4 1 2 3"]
    pts.write_text("\n".join(lines))
    got = sorted(tuple(r)[1:] for r in readers.read_sparse_points(spark, str(pts)).collect())
    assert got == [(1, 0.0, 1.0, 1.1, 10, 20, 30, 0.5), (2, 1.2, 0.0, 0.1, 255, 0, 0, 0.1)]
    images = tmp_path / "images.txt"
    images.write_text("# c\n1 a\n2d points\n2 b\n2d points\n3 c\n")
    assert readers.registered_image_count(spark, str(images)).first().registered_images == 2
    assert readers.camera_count(spark, str(images)).first().cameras == 5


def test_sparse_lines_are_made_once(spark):
    """A derived line is one expression of the plan, however many filters and cells read it."""
    made = spark.range(3).select(F.lit("s").alias("source"), F.concat_ws(" ", "id", *[F.lit(str(i)) for i in range(7)]).alias("value"))
    got = readers.parse_sparse_points(made)
    assert [tuple(r) for r in got.orderBy("point_id").collect()] == [("s", i, 0.0, 1.0, 2.0, 3, 4, 5, 6.0) for i in range(3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1 and plan.count("split(") == 1


def test_projects_newest_first(spark, tmp_path):
    for name, body in {"a": {"id": "a", "created_at": "2024-01-01T00:00:00Z"}, "b": {"id": "b", "created_at": "2025-01-01T00:00:00Z"}}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "meta.json").write_text("{ not json")
    assert [r.id for r in readers.read_projects(spark, str(tmp_path)).collect()] == ["b", "a"]


def test_obj_text_is_ordered(spark, tmp_path):
    v = spark.createDataFrame([(1, i, float(i), 0.0, 0.5) for i in range(5)], "cloud_id long, v_idx long, x double, y double, z double")
    writers.write_obj(C.obj_lines(v), str(tmp_path / "obj"))
    text = [p.read_text().split("\n") for p in sorted((tmp_path / "obj").rglob("part-*.txt"))]
    lines = [line for part in text for line in part if line]
    assert lines == [f"v {float(i)} 0.0 0.5" for i in range(5)] + [f"p {i + 1}" for i in range(5)]


def test_tool_log_counters(spark):
    logs = spark.createDataFrame([
        (1, "Registered images: 12\nPoints: 345\nnum_reg_frames=3 num_reg_frames=7"),
        (2, "At least two images must be registered for global bundle-adjustment NumImages() >= 2 (1 vs. 2) num_reg_frames=9"),
        (3, "")], "id int, text string")
    got = {r.id: tuple(r)[1:] for r in readers.parse_tool_logs(logs, ["id"]).collect()}
    assert got == {1: (12, 345, 7, False), 2: (None, None, 1, True), 3: (None, None, None, False)}


def test_upload_stream_with_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "up")
    rows = [(1, f"image-{i % 3}", f"2024-01-01 00:0{i}:00") for i in range(6)]
    df = spark.createDataFrame(rows, "project_id int, content string, t string")
    df.select("project_id", "content", F.to_timestamp("t").alias("uploaded_at")).write.parquet(src)
    stream = spark.readStream.schema("project_id int, content string, uploaded_at timestamp").parquet(src)
    out = ST.run_available(ST.stream_dedup_uploads(stream, "1 hour"), "up", str(tmp_path / "cp"))
    assert out.count() == 3


def test_run_log_repeats_no_field_names_on_disk(spark, tmp_path):
    """A log takes a fraction of its text, and appended parts read back together."""
    flat = spark.range(2_000).selectExpr("cast(id as string) AS run_id", "named_struct('project_id', 'p', 'status', 'completed') AS run_info")
    for _ in range(2):
        writers.append_runs(flat, str(tmp_path / "log"))
    plain = 2 * sum(len(line) + 1 for line in flat.toJSON().collect())
    assert sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*")) < plain / 3
    assert readers.read_runs(spark, str(tmp_path / "log")).select("run_id").distinct().count() == 2_000


def test_project_folders_are_listed_by_tasks(spark, tmp_path):
    """One path is listed, whatever the number of folders; files above or below the project folders take no part."""
    for place in ("a", "b", "b/old", "."):
        (tmp_path / place).mkdir(exist_ok=True)
        (tmp_path / place / "meta.json").write_text(json.dumps({"id": place, "created_at": "2024-01-01 00:00:00"}))
    found = readers.read_projects(spark, str(tmp_path))
    assert [r.id for r in found.collect()] == ["a", "b"]
    scan = found._jdf.queryExecution().analyzed().toString()
    location = found._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in location, scan


def test_project_documents_share_files(spark, tmp_path):
    """Every supplier's document is read, from a file for each 25 of them."""
    from capturelake.plans import streams

    spark.range(1, 101).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").toPandas().to_parquet(tmp_path / "supplier.parquet")
    found = streams.project_documents(spark, str(tmp_path))
    assert len(found.inputFiles()) == 5
    assert sorted((r.id, r.name) for r in found.collect()) == sorted((f"p{k}", f"s{k}") for k in range(1, 101))
