"""Streaming and sink queries: results that plain SQL only reaches in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as G
from ..operators import projects as J
from ..operators import runs as R
from ..session import scratch_path
from ..sources import readers, writers
from ..streaming import stages as SS
from ..streaming import tables as ST
from . import matching as MP
from . import run_history as RH
from . import tables as T
from . import timelines as TL
from .point_clouds import rounded

c = F.col


def _table_stream(spark, sf, name):
    """A table as a stream of its files, whether it is one file or a folder of them: as a pattern, the path may be either."""
    return spark.readStream.schema(T.load(spark, sf, name).schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def _event_stream(spark, sf):
    """The events table as a stream, projected like the batch form."""
    raw = _table_stream(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        c("user_id").alias("project_id"), c("ts").cast("timestamp").alias("ts"), "event_id",
        G.lookup(c("event_type"), T.EVENT_STAGES).alias("stage"),
        F.when(c("event_type") == "error", "failed").when(k >= 90, "completed").when(k >= 10, "running")
        .otherwise("odd").alias("stage_status"),
        (c("value") / 200.0 - 0.1).alias("progress"), F.concat(F.lit("k="), k.cast("string")).alias("message"))


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track_stages(spark, sf):
    _rocks(spark)
    updates = ST.run_available(SS.track_stages(_event_stream(spark, sf)), "track", scratch_path(spark, "stream"), "update")
    return TL.naive(SS.latest_entries(updates), "first_seen_at", "last_update_at", "completed_at")


def status_changes(spark, sf):
    _rocks(spark)
    events = _event_stream(spark, sf).withColumns({
        "message": F.lit(None).cast("string"), "progress": F.round(c("progress"), 0)})
    out = ST.run_available(SS.stream_status_changes(events), "changes", scratch_path(spark, "stream"))
    return TL.naive(out.select("project_id", "ts", "event_id", "stage", "stage_status", "progress"), "ts")


def run_log(spark, sf):
    """Run records written to a JSON log and read back."""
    path = scratch_path(spark, "runs")
    writers.append_runs(R.build_run_record(RH._with_gates(T.runs(spark, sf))), path)
    return path


def _detailed_runs(spark, sf):
    """Run records with counters, timings and sources, written and read back."""
    runs = RH._with_gates(T.runs(spark, sf)).withColumns({
        "validation_rejected_reason_counts": F.create_map(F.lit("low_resolution"), c("rejected_images"), F.lit("blurry"), c("max_line")),
        "validation_warning_reason_counts": F.create_map(F.lit("near_underexposed"), c("warning_images")),
        "blocking_reasons": F.when(c("selected_images") == 0, F.array(F.lit("no_images_selected"), F.lit("no_images_selected"),
                                                                      F.lit("insufficient_total_images"))),
        "stage_timings_seconds": F.create_map(F.lit("mapper"), F.round(c("qty") / 4.0, 2), F.lit("matcher"), c("max_discount") * 100.0),
        "output_artifacts": F.array(F.lit("model.obj")),
        "execution_report_path": F.concat(F.lit("r/"), c("run_id").cast("string")),
    })
    path = scratch_path(spark, "detailed")
    writers.append_runs(R.build_run_record(runs), path)
    return readers.read_runs(spark, path)


def recorded_reasons(spark, sf):
    rows = _detailed_runs(spark, sf).select("run_id", c("run_info.project_id").alias("project_id"),
                                            c("run_info.variant").alias("variant"), "reason_frequencies")
    return R.explode_reasons(rows)


def recorded_timings(spark, sf):
    rows = _detailed_runs(spark, sf).select(
        "run_id", c("run_info.project_id").alias("project_id"), c("run_info.variant").alias("variant"),
        c("execution_metrics.stage_timings_seconds").alias("stage_timings_seconds"))
    return R.explode_stage_timings(rows)


def recorded_facts(spark, sf):
    e = "execution_metrics."
    return _detailed_runs(spark, sf).select(
        "run_id", c(e + "stage_observed_count").alias("stages"), c(e + "retryable").alias("retryable"),
        F.concat_ws("|", "artifact_metrics.output_artifacts").alias("artifacts"), c("sources.execution_report_path").alias("report"))


def _supplier_files(spark, sf):
    """One text file per bucket of suppliers with a line for each; buckets grow with the table."""
    path = scratch_path(spark, "folders")
    T.load(spark, sf, "supplier").select(c("s_name").alias("value"), F.floor(c("s_suppkey") / 25).alias("bucket")).repartition("bucket").write.options(
        **writers.TASKS_COMMIT).partitionBy("bucket").text(path)
    return path


def image_files(spark, sf):
    return readers.read_images(spark, _supplier_files(spark, sf)).select("project_id", "extension", "length")


def _bitmap(width, pixel):
    """Bytes of a one-line bitmap file: header, then so many pixels (hex digits of blue, green, red), filled to four bytes."""
    def word(x):
        return F.concat(F.lpad(F.hex(x), 2, "0"), F.lit("000000"))

    line = (F.floor((width * 3 + 3) / 4) * 4).cast("bigint")
    return F.unhex(F.concat(
        F.lit("424D"), word(line + 54), F.lit("000000003600000028000000"), word(width), F.lit("010000000100180000000000"), word(line),
        F.lit("0" * 32), F.rpad(F.repeat(pixel, width), (line * 2).cast("int"), "0")))


def decoded_images(spark, sf):
    """An image of one to four pixels for every supplier, beside a file for every bucket that is none."""
    path = _supplier_files(spark, sf)
    pixel = F.concat(F.lpad(F.hex("s_nationkey"), 2, "0"), F.lpad(F.hex(c("s_suppkey") % 256), 2, "0"), F.lit("C8"))
    made = T.load(spark, sf, "supplier").select(
        F.floor(c("s_suppkey") / 25).alias("bucket"), _bitmap((c("s_suppkey") % 4 + 1).cast("int"), pixel).cast("string").alias("value"))
    made.repartition("bucket").write.mode("append").options(**writers.TASKS_COMMIT).option("maxRecordsPerFile", 1).partitionBy("bucket").text(path)
    return readers.read_decoded_images(spark, path).select(
        "project_id", "width", "height", "channels", F.hex("pixels").alias("pixels"), "reject_reason")


def project_documents(spark, sf):
    """A document for every supplier, those of a bucket as one JSON array: small files cost more than what they hold."""
    path = scratch_path(spark, "projects")
    docs = T.load(spark, sf, "supplier").select(
        F.floor(c("s_suppkey") / 25).alias("bucket"), F.concat(F.lit("p"), "s_suppkey").alias("id"), c("s_name").alias("name"),
        F.when(c("s_suppkey") % 5 > 1, "completed").otherwise("failed").alias("status"),
        F.when(c("s_suppkey") != 7, F.date_format(F.date_add(F.lit("2024-01-01"), c("s_suppkey").cast("int")), "yyyy-MM-dd HH:mm:ss"))
        .otherwise("no date").alias("created_at"))
    texts = docs.groupBy("bucket").agg(F.to_json(
        F.collect_list(F.struct("id", "name", "status", "created_at")), {"pretty": "true"}).alias("value"))
    texts.repartition("bucket").write.options(**writers.TASKS_COMMIT).partitionBy("bucket").text(path)
    found = readers.read_projects(spark, path, "*/part-*")
    return TL.naive(found.select("id", "name", "status", "created_at"), "created_at")


def _model_texts(spark, sf):
    """A model text per bucket, of which there are more in a larger table: comments, and a line per supplier."""
    path = scratch_path(spark, "models")
    rows = T.load(spark, sf, "supplier").withColumn("bucket", F.floor(c("s_suppkey") / 25))
    lines = rows.select("bucket", F.concat_ws(" ", "s_suppkey", "s_name").alias("value")).union(
        rows.select("bucket", F.concat(F.lit("# "), "s_name")))
    lines.repartition("bucket").write.partitionBy("bucket").text(path)
    return path


def model_counts(spark, sf):
    path = _model_texts(spark, sf)
    cams, imgs = readers.camera_count(spark, path), readers.registered_image_count(spark, path)
    return cams.join(imgs, "source").select(F.regexp_extract("source", r"bucket=(\d+)", 1).alias("bucket"), "cameras", "registered_images")


def runs_roundtrip(spark, sf):
    return R.flatten_runs(readers.read_runs(spark, run_log(spark, sf)))


FLAT = ("status string, variant string, scenario_label string, total_processing_seconds double")


def run_stats_stream(spark, sf):
    path = scratch_path(spark, "flat")
    T.runs(spark, sf).select("status", "variant", "scenario_label", "total_processing_seconds").write.json(path)
    stream = ST.stream_run_stats(ST.tail_json(spark, path, FLAT))
    stats = ST.run_available(stream, "stats", scratch_path(spark, "stream"), "complete").drop("batch_id", "time_sketch")
    # The median is approximate: its rank among all runs is held against the sketch's error.
    m, t = c("median_total_processing_seconds"), c("total_processing_seconds")
    known = stats.select(c("variant").alias("v"), c("scenario_label").alias("s"), "median_total_processing_seconds")
    ranks = T.runs(spark, sf).join(known, c("variant").eqNullSafe(c("v")) & c("scenario_label").eqNullSafe(c("s"))).groupBy("v", "s").agg(
        F.try_divide(F.count_if(t < m), F.count(t)).alias("below"), F.try_divide(F.count_if(t <= m), F.count(t)).alias("up_to"))
    within = (c("below") <= 0.5 + ST.RANK_ERROR) & (c("up_to") >= 0.5 - ST.RANK_ERROR)
    joined = stats.join(ranks, c("variant").eqNullSafe(c("v")) & c("scenario_label").eqNullSafe(c("s")), "left")
    return joined.withColumn("median_in_bounds", within).drop("v", "s", "below", "up_to", "median_total_processing_seconds")


def upload_stream(spark, sf):
    _rocks(spark)
    raw = _table_stream(spark, sf, "documents")
    ups = raw.select(c("source").alias("project_id"), c("text").alias("content"), F.timestamp_seconds(c("doc_id") + 1_000_000_000).alias("uploaded_at"))
    # Digests are forgotten once the watermark has passed them.
    fresh = ST.stream_dedup_uploads(ups, "10000 days")
    return ST.run_available(fresh, "uploads", scratch_path(spark, "stream")).select("project_id", "sha256")


def prediction_stream(spark, sf):
    source, sink = scratch_path(spark, "sets"), scratch_path(spark, "predictions")
    RH._datasets(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = stream.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", scratch_path(spark, "stream")).foreachBatch(
        ST.predictions_sink(RH.train_thresholds(spark, sf), sink)).start()
    query.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def report_csv(spark, sf):
    path = scratch_path(spark, "report")
    writers.write_report_csv(T.runs(spark, sf), path, R.RUN_COLUMNS)
    rows = R.typed_report_rows(readers.read_report_csv(spark, path, list(R.RUN_COLUMNS)))
    return R.variant_metrics(rows)


def report_json(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_report_json(RH._stats(spark, sf).withColumn("name", c("scope")), path, "name")
    docs = readers.read_documents(spark, path)
    return docs.select(F.variant_get("document", "$.scope", "string").alias("scope"),
                       F.variant_get("document", "$.run_count", "bigint").alias("run_count"))


def history_roundtrip(spark, sf):
    path = scratch_path(spark, "history")
    writers.append_runs(RH.history(spark, sf).drop("run_id").withColumn("project_id", c("project_id").cast("string")), path)
    return R.success_conditions(readers.read_history(spark, path))


def inventory(spark, sf):
    """Files of a written table, looked up by path."""
    path = scratch_path(spark, "files")
    T.load(spark, sf, "nation").select(c("n_name").alias("value"), "n_regionkey").write.partitionBy("n_regionkey").text(path)
    files = readers.list_files(spark, path)
    named = files.select("path", F.regexp_extract("path", r"n_regionkey=(\d+)", 1).alias("name"))
    missing = T.load(spark, sf, "nation").select(
        F.concat(F.lit("missing/"), "n_name", F.lit(".GLB")).alias("path"), c("n_nationkey").cast("string").alias("name"))
    out = J.artifact_inventory(named.unionByName(missing), files)
    return out.groupBy("exists", "file_type").agg(F.count_distinct("name").alias("names"))


QUERIES = {
    "track_stages": track_stages,
    "stream_status_changes": status_changes,
    "stream_run_stats": run_stats_stream,
    "stream_dedup_uploads": upload_stream,
    "stream_predictions": prediction_stream,
    "append_runs": runs_roundtrip,
    "recorded_reasons": recorded_reasons,
    "recorded_timings": recorded_timings,
    "recorded_facts": recorded_facts,
    "read_images": image_files,
    "read_decoded_images": decoded_images,
    "read_projects": project_documents,
    "model_counts": model_counts,
    "read_history": history_roundtrip,
    "write_report_csv": report_csv,
    "write_report_json": report_json,
    "artifact_inventory": inventory,
    "reconstruct": lambda s, d: rounded(MP.M.reconstruct(
        MP.pairs(s, d), MP.keypoints(s, d), MP.images(MP.keypoints(s, d)), 48), 4),
}

_HIST = RH.ORACLES["success_conditions"]

ORACLES = {
    "track_stages": TL.ORACLES["stage_rollup"],
    "stream_status_changes": TL.ORACLES["status_changes"],
    "stream_run_stats": f"""WITH {T.RUNS_SQL}
SELECT variant, scenario_label, count(*) AS run_count,
  round(count(*) FILTER (status = 'completed')::DOUBLE / count(*), 4) AS success_rate,
  round(count(*) FILTER (status = 'failed')::DOUBLE / count(*), 4) AS failure_rate,
  round(avg(total_processing_seconds), 3) AS avg_total_processing_seconds,
  CASE WHEN count(total_processing_seconds) > 0 THEN true END AS median_in_bounds FROM runs GROUP BY ALL""",
    "stream_dedup_uploads": "SELECT DISTINCT source AS project_id, sha256(text) AS sha256 FROM documents",
    "stream_predictions": RH.ORACLES["predict_success"],
    "reconstruct": MP.ORACLES["lift_points"],
    "append_runs": RH.ORACLES["flatten_runs"],
    "recorded_reasons": f"""WITH {T.RUNS_SQL}, r AS (
SELECT run_id::VARCHAR AS run_id, project_id::VARCHAR AS project_id, variant, 'validation_rejected_reason_counts' AS reason_type,
  'low_resolution' AS reason, rejected_images::BIGINT AS count FROM runs
UNION ALL SELECT run_id::VARCHAR, project_id::VARCHAR, variant, 'validation_rejected_reason_counts', 'blurry', max_line FROM runs
UNION ALL SELECT run_id::VARCHAR, project_id::VARCHAR, variant, 'validation_warning_reason_counts', 'near_underexposed', warning_images FROM runs
UNION ALL SELECT run_id::VARCHAR, project_id::VARCHAR, variant, 'pipeline_blocking_reasons', 'no_images_selected', 2 FROM runs
  WHERE selected_images = 0
UNION ALL SELECT run_id::VARCHAR, project_id::VARCHAR, variant, 'pipeline_blocking_reasons', 'insufficient_total_images', 1 FROM runs
  WHERE selected_images = 0)
SELECT * FROM r WHERE count IS NOT NULL""",
    "recorded_timings": f"""WITH {T.RUNS_SQL}
SELECT run_id::VARCHAR AS run_id, project_id::VARCHAR AS project_id, variant, s.stage, s.t AS duration_seconds
FROM (SELECT run_id, project_id, variant, unnest([{{'stage': 'mapper', 't': {T.half_up('round(qty / 4.0::DOUBLE, 2)', 3)}}},
  {{'stage': 'matcher', 't': {T.half_up('max_discount * 100.0::DOUBLE', 3)}}}]) AS s FROM runs)""",
    "recorded_facts": f"""WITH {T.RUNS_SQL}
SELECT run_id::VARCHAR AS run_id, 2 AS stages, CASE WHEN reason_code IS NOT NULL
  THEN reason_code NOT IN ('input_validation_failed', 'input_selection_failed') END AS retryable, 'model.obj' AS artifacts,
  'r/' || run_id AS report FROM runs""",
    "read_images": """SELECT 'bucket=' || s_suppkey // 25 AS project_id, '.txt' AS extension, sum(strlen(s_name) + 1)::BIGINT AS length
FROM supplier GROUP BY s_suppkey // 25""",
    "read_decoded_images": """SELECT DISTINCT 'bucket=' || s_suppkey // 25 AS project_id, NULL::INT AS width, NULL::INT AS height,
  NULL::INT AS channels, NULL AS pixels, 'unreadable_image' AS reject_reason FROM supplier
UNION ALL SELECT 'bucket=' || s_suppkey // 25, (s_suppkey % 4 + 1)::INT, 1, 3,
  repeat(printf('%02X%02XC8', s_nationkey, s_suppkey % 256), (s_suppkey % 4 + 1)::INT), NULL FROM supplier""",
    "read_projects": """SELECT 'p' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 5 > 1 THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN s_suppkey <> 7 THEN (DATE '2024-01-01' + s_suppkey::INT)::TIMESTAMP END AS created_at FROM supplier""",
    "model_counts": """SELECT (s_suppkey // 25)::VARCHAR AS bucket, count(*) AS cameras, count(*) // 2 AS registered_images FROM supplier
GROUP BY s_suppkey // 25""",
    "read_history": _HIST,
    "write_report_csv": RH.ORACLES["variant_metrics"],
    "write_report_json": f"WITH {RH.STATS_SQL} SELECT scope, run_count FROM stats",
    "artifact_inventory": """SELECT true AS exists, '.txt'[2:] AS file_type, count(DISTINCT n_regionkey) AS names FROM nation
UNION ALL SELECT false, 'glb', count(*) FROM nation""",
}
