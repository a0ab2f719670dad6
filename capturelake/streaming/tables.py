"""Run statistics, upload de-duplication and predictions kept fresh by streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predict import predict_success
from ..operators.uploads import content_hash


#: Size parameter of the sketches of run times, and the rank error that it keeps to in 99 of 100 cases.
SKETCH_SIZE, RANK_ERROR = 1_000, 0.005


def tail_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """An append-only JSON log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_run_stats(runs: DataFrame, keys: Sequence[str] = ("variant", "scenario_label")) -> DataFrame:
    """Continuously updated statistics.

    Times are held as a KLL sketch, whose median is off by at most
    ``RANK_ERROR`` in rank; ``merge_time_sketches`` joins the sketches of
    streams and batches.
    """
    c = F.col
    n = F.count(F.lit(1))
    return runs.groupBy(*keys).agg(
        n.alias("run_count"),
        F.round(F.count_if(c("status") == "completed") / n, 4).alias("success_rate"),
        F.round(F.count_if(c("status") == "failed") / n, 4).alias("failure_rate"),
        F.round(F.avg("total_processing_seconds"), 3).alias("avg_total_processing_seconds"),
        F.kll_sketch_agg_double(c("total_processing_seconds").cast("double"), F.lit(SKETCH_SIZE)).alias("time_sketch"),
    ).withColumn("median_total_processing_seconds", _median("time_sketch"))


def _median(sketch: str) -> Column:
    known = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(known, F.kll_sketch_get_quantile_double(F.when(known, F.col(sketch)), F.lit(0.5)))


def merge_time_sketches(stats: DataFrame, keys: Sequence[str] = ("variant", "scenario_label")) -> DataFrame:
    """One sketch of run times and its median for each key, from statistics of separate runs, batch or stream."""
    return stats.groupBy(*keys).agg(F.kll_merge_agg_double("time_sketch", F.lit(SKETCH_SIZE)).alias("time_sketch")).withColumn(
        "median_total_processing_seconds", _median("time_sketch"))


def stream_dedup_uploads(uploads: DataFrame, delay: str | None = None, content: str = "content",
                         time_col: str = "uploaded_at") -> DataFrame:
    """First upload of every content per project.

    With a ``delay`` the digests are forgotten once the watermark has passed
    them; without one every digest is remembered.
    """
    rows = uploads.withColumn("sha256", content_hash(F.col(content))).drop(content)
    if delay is None:
        return rows.dropDuplicates(["project_id", "sha256"])
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["project_id", "sha256"])


def predictions_sink(calibrator: DataFrame | None, path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: score a batch of dataset summaries and append it once.

    The calibrator's one row is read here, before the stream starts, not in
    every micro-batch. Every batch writes its own folder, so a batch that is repeated after a
    failure replaces its rows instead of doubling them.
    """

    known = calibrator.first() if calibrator is not None else None

    def write(batch: DataFrame, batch_id: int) -> None:
        predict_success(batch, known).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything there is and return what it emitted."""
    path = f"{checkpoint}/{name}-out"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}")
        .trigger(availableNow=True).foreachBatch(keep).start())
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
