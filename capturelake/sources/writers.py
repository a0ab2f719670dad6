"""Sinks: appended run logs, report documents and tables, model text, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Many small files are moved to their place by the tasks that wrote them, not one by one by the driver.
TASKS_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def append_runs(records: DataFrame, path: str) -> None:
    """Append records to a newline-delimited JSON log, whose repeated field names are compressed."""
    records.write.mode("append").option("compression", "gzip").json(path)


def write_report_json(df: DataFrame, path: str, key: str) -> None:
    """One readable JSON document per key, each in the folder of its key."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"pretty": "true"})
    df.select(key, body.alias("value")).repartition(key).write.mode("overwrite").options(**TASKS_COMMIT).partitionBy(key).text(path)


def write_report_csv(df: DataFrame, path: str, columns: Sequence[str], single_file: bool = False) -> None:
    """A table with a header and fixed column order; missing columns come out empty.

    ``single_file`` is for finished report tables of known, small size only.
    """
    have = set(df.columns)
    out = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_obj(lines: DataFrame, path: str) -> None:
    """OBJ text per cloud, rows in order within every file.

    Range partitioning by cloud and position keeps the lines of a large cloud
    in consecutive files instead of one task.
    """
    ordered = lines.repartitionByRange("cloud_id", "part", "position").sortWithinPartitions("cloud_id", "part", "position")
    ordered.select("cloud_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("cloud_id").text(path)


def export_staged(manifest: DataFrame, contents: DataFrame, path: str) -> None:
    """Renumbered image files as a table of name and bytes, one folder per project."""
    manifest.join(contents, "image_id").select("project_id", "staged_name", "position", "content").write.mode(
        "overwrite").partitionBy("project_id").parquet(path)
