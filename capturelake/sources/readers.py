"""Scans: images, run logs, report tables, project documents, sparse-model text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Accepted image suffixes.
IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")

HISTORY_SCHEMA = (
    "project_id string, dataset_path string, image_count int, mesh_readiness_score double, "
    "angular_coverage_score double, visual_variety_score double, average_feature_points double, "
    "high_confidence_ratio double, usable_images_ratio double, average_sharpness double, average_brightness double, "
    "duplicate_ratio double, profile string, colmap_gpu_used boolean, cameras_reconstructed int, points3D_count bigint, "
    "surface_faces_count_real bigint, dense_faces_count_real bigint, quality_classification string, "
    "geometry_source string, visualization_type string, total_processing_time double, final_success_level string"
)
RUN_SCHEMA = (
    "schema_version string, run_id string, generated_at string, "
    "run_info struct<project_id:string,status:string,variant:string,scenario_label:string,scenario_source:string>, "
    "input_metrics struct<total_images_loaded:int,accepted_images:int,rejected_images:int,warning_images:int,"
    "selected_images:int,selection_discarded_images:int,input_reduction_ratio:double,input_reduction_pct:double>, "
    "reason_frequencies map<string,map<string,bigint>>, "
    "execution_metrics struct<total_processing_seconds:double,stage_timings_seconds:map<string,double>,"
    "stage_observed_count:int,current_stage:string,failed_stage:string,reason_code:string,retryable:boolean,"
    "fallback_used:boolean,completed_with_fallback:boolean>, "
    "quality_gates struct<blocked_by_input_deficiency:boolean,allow_processing_after_validation:boolean,"
    "allow_processing_after_selection:boolean,coverage_possible_low:boolean>, "
    "artifact_metrics struct<final_artifact_type:string,final_artifact_size_bytes:bigint,output_artifacts:array<string>>, "
    "sources struct<execution_report_path:string,input_validation_report_path:string,input_selection_report_path:string>"
)
PROJECT_SCHEMA = (
    "id string, name string, status string, created_at string, updated_at string, image_files array<string>, "
    "output_format string, model_filename string, error_message string"
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``<path>/<project>/`` as binary rows, one row per file.

    Rows come with project, name, lower-cased suffix, length and content.
    Unsupported files stay as rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        parent_name(F.col("path")).alias("project_id"), file_name(F.col("path")).alias("name"), "path",
        F.lower(F.regexp_extract(file_name(F.col("path")), r"(\.[^.]+)$", 1)).alias("extension"),
        "length", "modificationTime", "content",
    )


def read_decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images through the image source; undecodable files stay as rows.

    Pixels are BGR rows; an unreadable file has NULL pixels and a reason.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    bad = F.col("image.width") < 0
    return rows.select(
        parent_name(F.col("image.origin")).alias("project_id"), file_name(F.col("image.origin")).alias("name"),
        F.when(~bad, F.col("image.width")).alias("width"), F.when(~bad, F.col("image.height")).alias("height"),
        F.when(~bad, F.col("image.nChannels")).alias("channels"), F.when(~bad, F.col("image.data")).alias("pixels"),
        F.when(bad, "unreadable_image").alias("reject_reason"),
    )


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records, one for each line that holds a JSON object, and the other lines.

    A line with an array of objects is no record. A field of the wrong type is
    null; the rest of its record stays.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    records = lines.filter(good).select(F.from_json("value", schema).alias("r")).select("r.*")
    return records, lines.filter(~good)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, RUN_SCHEMA)[0]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, HISTORY_SCHEMA)[0]


def read_report_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A report table with a header, all text; a missing path gives no rows."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        return spark.read.option("header", True).schema(schema).csv(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_projects(spark: SparkSession, path: str, pattern: str = "*/meta.json") -> DataFrame:
    """Project documents ``<path>/<pattern>``, newest first, broken ones skipped.

    Where the pattern names a file in any folder, tasks list the folders, not
    the driver one after the other; files elsewhere below the path take no part.
    """
    typed = StructType.fromDDL(PROJECT_SCHEMA).add("_corrupt_record", "string")
    reader = spark.read.schema(typed).option("multiLine", True)
    folder, _, file = pattern.rpartition("/")
    if folder == "*":
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath()
        rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", file).json(path)
        # The path's folders, the project's folder and the file.
        depth = F.size(F.split(F.regexp_replace("_metadata.file_path", "^[a-z0-9+.-]+:(//[^/]*)?", ""), "/"))
        rows = rows.filter(depth == len(root.rstrip("/").split("/")) + 2)
    else:
        rows = reader.json(f"{path}/{pattern}")
    good = rows.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).drop("_corrupt_record")
    return good.withColumns({
        "created_at": F.try_to_timestamp("created_at"), "updated_at": F.try_to_timestamp("updated_at"),
    }).orderBy(F.desc("created_at"), "id")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Report documents as VARIANT; files that hold no JSON object are dropped."""
    rows = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value"))
    return rows.filter(F.trim("value").startswith("{")).select(
        "path", F.try_parse_json("value").alias("document")).filter(F.col("document").isNotNull())


def _model_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))


def parse_sparse_points(lines: DataFrame) -> DataFrame:
    """Points out of (source, value) text lines; comments and bad lines drop out.

    A line and its parts are generated columns: as plain ones, filters and cells would each make them anew.
    """
    text = F.col("_t")
    trimmed = lines.select("source", F.explode(F.array(F.trim("value"))).alias("_t")).filter((text != "") & ~text.startswith("#"))
    cells = trimmed.select("source", F.explode(F.array(F.split(text, r"\s+"))).alias("_p")).filter(F.size("_p") >= 8)
    names = ("x", "y", "z", "r", "g", "b", "error")
    kinds = ("double", "double", "double", "int", "int", "int", "double")
    parsed = cells.select(
        "source", F.col("_p")[0].try_cast("bigint").alias("point_id"),
        *[F.col("_p")[i].try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds), start=1)])
    return parsed.dropna(subset=list(names))


def read_sparse_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_sparse_points(spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value"))


def registered_image_count(spark: SparkSession, path: str) -> DataFrame:
    """Two text lines per registered image."""
    return _model_lines(spark, path).groupBy("source").agg(
        F.floor(F.count(F.lit(1)) / 2).alias("registered_images"))


def camera_count(spark: SparkSession, path: str) -> DataFrame:
    return _model_lines(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("cameras"))


# Patterns of the tool's log lines.
LOG_REGISTERED = r"(?i)Registered images:\s*(\d+)"
LOG_POINTS = r"(?i)Points:\s*(\d+)"
LOG_FRAMES = r"(?i)num_reg_frames=(\d+)"
LOG_NUM_IMAGES = r"(?i)NumImages\(\)\s*>?=\s*2\s*\((\d+)\s+vs\.\s*2\)"
LOG_TOO_FEW = r"(?i)At least two images must be registered for global bundle-adjustment"


def parse_tool_logs(logs: DataFrame, keys: list[str], text: str = "text",
                    registered: str = LOG_REGISTERED, points: str = LOG_POINTS, frames: str = LOG_FRAMES,
                    num_images: str = LOG_NUM_IMAGES, too_few: str = LOG_TOO_FEW) -> DataFrame:
    """Counters found in log texts; the last frame count wins, the bundle check beats it."""

    def first(pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("bigint")

    frames_seen = F.regexp_extract_all(text, F.lit(frames), F.lit(1))
    last = F.when(F.size(frames_seen) > 0, F.element_at(frames_seen, -1).try_cast("bigint"))
    return logs.select(
        *keys, first(registered).alias("registered_images"), first(points).alias("points"),
        F.coalesce(first(num_images), last).alias("mapper_registered"),
        F.col(text).rlike(too_few).alias("too_few_registered"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "length", F.col("modificationTime").alias("modified"))
