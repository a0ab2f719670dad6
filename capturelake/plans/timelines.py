"""Stage-event queries over events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projects as J
from ..operators import runs as R
from ..operators import stages as St
from . import tables as T

c = F.col

CLEAN_SQL = T.EVENTS_SQL + f""",
ev AS (SELECT project_id, ts, event_id, stage,
    CASE WHEN stage_status IN ('queued', 'running', 'completed', 'failed', 'skipped') THEN stage_status ELSE 'running' END
      AS stage_status,
    {T.half_up('greatest(0.0::DOUBLE, least(1.0::DOUBLE, progress))', 4)} AS progress, message FROM stage_events)"""


def naive(df, *names):
    """Timestamps without zone, as the SQL side has them."""
    return df.withColumns({n: c(n).cast("timestamp_ntz") for n in names})


def timing_rows(spark, sf):
    """Stage timings per project and day out of a map column."""
    day = T.stage_events(spark, sf).groupBy(
        c("project_id"), F.to_date("ts").alias("day"), "stage").agg(F.max("seconds").alias("s"))
    runs = day.groupBy("project_id", "day").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit(" "), "stage"), c("s") - 1.0))).alias("stage_timings_seconds"))
    return R.explode_stage_timings(runs.select(
        F.concat_ws("-", "project_id", "day").alias("run_id"), "project_id",
        F.concat(F.lit("V"), c("project_id") % 3).alias("variant"), "stage_timings_seconds"))


TIMINGS_SQL = T.EVENTS_SQL + """,
timings AS (SELECT project_id || '-' || ts::DATE AS run_id, project_id, 'V' || project_id % 3 AS variant, stage,
    round(greatest(0.0::DOUBLE, max(seconds) - 1.0::DOUBLE), 3) AS duration_seconds
  FROM stage_events GROUP BY ALL)"""


def reason_rows(spark, sf):
    """Reason counters per project and day, nested as in run records."""
    e = T.stage_events(spark, sf)
    kind = F.when(F.dayofmonth("ts") % 2 == 0, "validation_rejected_reason_counts").otherwise(
        "selection_discarded_reason_counts")
    counts = e.groupBy("project_id", F.to_date("ts").alias("day"), kind.alias("kind"), "stage").agg(
        F.count(F.lit(1)).alias("n"))
    inner = counts.groupBy("project_id", "day", "kind").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("m"))
    runs = inner.select(
        F.concat_ws("-", "project_id", "day").alias("run_id"), "project_id",
        F.concat(F.lit("V"), c("project_id") % 3).alias("variant"), F.create_map("kind", "m").alias("reason_frequencies"))
    return R.explode_reasons(runs)


REASONS_SQL = T.EVENTS_SQL + """,
reasons AS (SELECT project_id || '-' || ts::DATE AS run_id, project_id, 'V' || project_id % 3 AS variant,
    CASE WHEN day(ts) % 2 = 0 THEN 'validation_rejected_reason_counts' ELSE 'selection_discarded_reason_counts' END AS reason_type,
    stage AS reason, count(*) AS count FROM stage_events GROUP BY ALL),
totals AS (SELECT lower(variant) AS variant, reason_type, reason, sum(count)::BIGINT AS total_count FROM reasons GROUP BY ALL)"""


def submodels(spark, sf):
    e = T.stage_events(spark, sf)
    name = F.when(c("event_id") % 4 == 3, F.lit("alt")).otherwise((c("event_id") % 4 * 5).cast("string"))
    subs = e.groupBy("project_id", name.alias("dir")).agg(
        F.count_if(c("stage") == "mapper").alias("registered"), F.count(F.lit(1)).alias("points"))
    return J.best_submodel(subs, ["project_id"])


def _daily_files(spark, sf, names):
    from ..functions.grading import lookup

    return T.load(spark, sf, "events").select(
        c("user_id").alias("project_id"), F.to_date("ts").alias("day"), lookup(c("event_type"), names).alias("name"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size_bytes"))


MODEL_FILES = {"view": "cameras.bin", "click": "images.txt", "signup": "points3D.bin", "purchase": "cameras.txt",
               "error": "run.log"}
ARTIFACT_NAMES = {"view": "obj_model_path", "click": "glb_model_path", "signup": "raw_sparse_ply",
                  "purchase": "execution_report", "error": "fused_ply_path"}


def _case(names):
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def missing_files(spark, sf):
    return J.missing_model_files(_daily_files(spark, sf, MODEL_FILES), ["project_id", "day"], "name").withColumn(
        "missing", F.concat_ws(",", "missing"))


def final_artifacts(spark, sf):
    files = _daily_files(spark, sf, ARTIFACT_NAMES).groupBy("project_id", "day", "name").agg(
        F.max("size_bytes").alias("size_bytes"))
    return J.final_artifact(files.withColumn("path", F.concat(F.lit("out/"), "name", F.lit(".GLB"))), ["project_id", "day"])


def merged(spark, sf):
    """Documents of the first half of the month updated by those of the second."""
    def documents(late: bool):
        e = T.load(spark, sf, "events").filter((F.dayofmonth("ts") > 15) == F.lit(late))
        n = e.groupBy("user_id", "event_type", (c("event_id") % 3).alias("slot")).agg(
            F.count(F.lit(1)).cast("string").alias("v"))
        inner = n.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(
            F.struct(F.concat(F.lit("s"), "slot"), "v"))).alias("m"))
        return inner.groupBy(c("user_id").alias("project_id")).agg(
            F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("doc"))

    out = J.merge_documents(documents(False), documents(True), ["project_id"])
    return out.select("project_id", F.explode("doc").alias("section", "m")).select(
        "project_id", "section", F.explode("m").alias("field", "value"))


def top_stage(spark, sf):
    return R.top_key(T.stage_events(spark, sf), ["project_id"], "stage", "top_stage")


def json_values(spark, sf):
    """Nested values of the JSON column through VARIANT, with typed fallbacks."""
    from ..functions.scores import to_bool, to_float, to_int

    e = T.load(spark, sf, "events").withColumn("doc", F.try_parse_json("props"))
    k = F.try_variant_get("doc", "$.k", "int")
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "n/a").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(".75 ")))
    return e.select("event_id", k.alias("k"), F.try_variant_get("doc", "$.missing.deep", "string").alias("deep"),
                    to_int(text).alias("as_int"), to_float(text).alias("as_float"),
                    to_bool(F.when(k % 3 == 0, " Si ").when(k % 3 == 1, "TRUE")).alias("as_bool"))


QUERIES = {
    "stage_rollup": lambda s, d: naive(St.stage_rollup(T.stage_events(s, d)), "first_seen_at", "last_update_at", "completed_at"),
    "stage_transitions": lambda s, d: naive(St.stage_transitions(T.stage_events(s, d)), "ts"),
    "status_changes": lambda s, d: naive(St.status_changes(T.stage_events(s, d).withColumns({
        "message": F.lit(None).cast("string"), "progress": F.round(c("progress"), 0)})), "ts").drop("message", "seconds"),
    "tail_timeline": lambda s, d: naive(St.tail_timeline(T.stage_events(s, d), 15), "ts").drop("seconds"),
    "pending_stages": lambda s, d: St.pending_stages(T.stage_events(s, d).withColumn("project_id", c("event_id") % 5000)).withColumn(
        "pending", F.concat_ws(",", "pending")),
    "explode_stage_timings": timing_rows,
    "stage_timing_summary": lambda s, d: R.stage_timing_summary(timing_rows(s, d)),
    "phase_timings": lambda s, d: R.phase_timings(timing_rows(s, d), ["project_id"]),
    "explode_reasons": reason_rows,
    "reason_totals": lambda s, d: R.reason_totals(reason_rows(s, d)),
    "top_reasons": lambda s, d: R.top_reasons(R.reason_totals(reason_rows(s, d)), "v1", 4),
    "best_submodel": submodels,
    "missing_model_files": missing_files,
    "final_artifact": final_artifacts,
    "merge_documents": merged,
    "top_key": top_stage,
    "json_values": json_values,
}

_W = "WINDOW w AS (PARTITION BY project_id ORDER BY ts, event_id)"

ORACLES = {
    "stage_rollup": f"""WITH {CLEAN_SQL}, n AS (SELECT *, lead(stage) OVER w AS ns, lead(ts) OVER w AS nt FROM ev {_W}),
k AS (SELECT *, coalesce(stage_status IN ('queued', 'running') AND ns <> stage, false) AS lft FROM n),
f AS (SELECT *, CASE WHEN lft THEN 'completed' ELSE stage_status END AS st,
  CASE WHEN lft THEN nt WHEN stage_status IN ('completed', 'failed', 'skipped') THEN ts END AS cl FROM k)
SELECT project_id, stage, arg_max(st, ts) AS status, min(ts) AS first_seen_at, max(ts) AS last_update_at,
  max(cl) AS completed_at, arg_max(progress, ts) AS latest_progress, arg_max(message, ts) AS latest_message,
  count(*) AS event_count FROM f GROUP BY ALL""",
    "stage_transitions": f"""WITH {CLEAN_SQL}, n AS (SELECT *, lag(stage) OVER w AS ps, lag(stage_status) OVER w AS pst,
    lag(ts) OVER w AS pt FROM ev {_W})
SELECT project_id, ts, event_id, ps AS from_stage, stage AS to_stage, pst IN ('queued', 'running') AS auto_completed,
  round(epoch_us(ts) / 1e6::DOUBLE - epoch_us(pt) / 1e6::DOUBLE, 3) AS seconds_since_last FROM n WHERE ps <> stage""",
    "status_changes": f"""WITH {CLEAN_SQL}, r AS (SELECT * EXCLUDE (progress), round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    p0)), 4) AS progress FROM (SELECT ev.*, round(s.progress, 0) AS p0 FROM ev JOIN stage_events s USING (event_id))),
n AS (SELECT *, lag({{'a': stage, 'b': stage_status, 'c': progress}}) OVER w AS b FROM r {_W})
SELECT project_id, ts, event_id, stage, stage_status, progress FROM n
WHERE b IS DISTINCT FROM {{'a': stage, 'b': stage_status, 'c': progress}}""",
    "tail_timeline": f"""WITH {CLEAN_SQL}
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) AS age FROM ev QUALIFY age <= 15""",
    "pending_stages": f"""WITH {CLEAN_SQL}, s AS (SELECT event_id % 5000 AS project_id, list(DISTINCT stage) AS seen FROM stage_events
  GROUP BY 1)
SELECT project_id, array_to_string(list_filter({T.sql_list(St.STAGE_SEQUENCE)}, lambda x: NOT list_contains(seen, x)), ',')
  AS pending FROM s""",
    "explode_stage_timings": f"WITH {TIMINGS_SQL} SELECT * FROM timings",
    "stage_timing_summary": f"""WITH {TIMINGS_SQL}
SELECT lower(variant) AS variant, stage, count(*) AS sample_count, round(avg(duration_seconds), 3) AS avg_duration_seconds,
  min(duration_seconds) AS min_duration_seconds, max(duration_seconds) AS max_duration_seconds FROM timings GROUP BY ALL""",
    "phase_timings": f"""WITH {TIMINGS_SQL}
SELECT project_id, round(coalesce(sum(duration_seconds) FILTER (stage = 'feature_extractor'), 0), 3) AS feature_extractor,
  round(coalesce(sum(duration_seconds) FILTER (stage = 'exhaustive_matcher'), 0), 3) AS matcher,
  round(coalesce(sum(duration_seconds) FILTER (stage = 'mapper'), 0), 3) AS mapper,
  round(coalesce(sum(duration_seconds) FILTER (stage LIKE 'model_converter%'), 0), 3) AS model_converter,
  round(coalesce(sum(duration_seconds) FILTER (stage = 'patch_match_stereo'), 0), 3) AS dense FROM timings GROUP BY 1""",
    "explode_reasons": f"WITH {REASONS_SQL} SELECT * FROM reasons",
    "reason_totals": f"WITH {REASONS_SQL} SELECT * FROM totals",
    "top_reasons": f"""WITH {REASONS_SQL}
SELECT reason_type, reason, total_count, reason_type || ': ' || reason || ' -> ' || total_count AS line FROM totals
WHERE variant = 'v1' ORDER BY total_count DESC, reason_type, reason LIMIT 4""",
    "best_submodel": f"""WITH {T.EVENTS_SQL}, s AS (SELECT project_id,
    CASE WHEN event_id % 4 = 3 THEN 'alt' ELSE (event_id % 4 * 5)::VARCHAR END AS dir,
    count(*) FILTER (stage = 'mapper') AS registered, count(*) AS points FROM stage_events GROUP BY ALL)
SELECT project_id, dir, registered, points FROM s QUALIFY row_number() OVER (PARTITION BY project_id
  ORDER BY registered DESC, points DESC, dir = 'alt' DESC, TRY_CAST(dir AS INT) DESC) = 1""",
    "missing_model_files": f"""WITH f AS (SELECT user_id AS project_id, ts::DATE AS day, list({_case(MODEL_FILES)}) AS fs
  FROM events GROUP BY ALL)
SELECT project_id, day, array_to_string(list_filter(['cameras', 'images', 'points3D'], lambda p:
  NOT list_contains(fs, p || '.bin') AND NOT list_contains(fs, p || '.txt')), ',') AS missing FROM f""",
    "final_artifact": f"""WITH f AS (SELECT user_id AS project_id, ts::DATE AS day, {_case(ARTIFACT_NAMES)} AS name,
    max(json_extract(props, '$.k')::BIGINT) AS size_bytes FROM events GROUP BY ALL)
SELECT project_id, day, name, 'out/' || name || '.GLB' AS path, size_bytes, '.glb' AS file_type FROM f
QUALIFY row_number() OVER (PARTITION BY project_id, day ORDER BY CASE name WHEN 'model_path' THEN 1
  WHEN 'glb_model_path' THEN 2 WHEN 'obj_model_path' THEN 3 WHEN 'output_path' THEN 4 ELSE 99 END, name) = 1""",
    "merge_documents": """WITH n AS (SELECT user_id AS project_id, event_type AS section, 's' || event_id % 3 AS field,
    day(ts) > 15 AS late, count(*)::VARCHAR AS value FROM events GROUP BY ALL)
SELECT project_id, section, field, value FROM n
QUALIFY row_number() OVER (PARTITION BY project_id, section, field ORDER BY late DESC) = 1""",
    "top_key": f"""WITH {T.EVENTS_SQL}, k AS (SELECT project_id, stage, count(*) AS n FROM stage_events GROUP BY ALL)
SELECT project_id, stage AS top_stage FROM k QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, stage) = 1""",
    "json_values": """WITH v AS (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, k, NULL::VARCHAR AS deep, CASE WHEN k % 5 < 2 THEN 0 ELSE k END::BIGINT AS as_int,
  CASE WHEN k % 5 < 2 THEN 0.0::DOUBLE ELSE k + 0.75::DOUBLE END AS as_float, k % 3 < 2 AS as_bool FROM v""",
}
