"""Session set-up and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folder of each local application that names no shared one; removed when this process ends.
_LOCAL: dict[str, str] = {}


def build_session(app: str = "capturelake", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    It is the one named in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = context.getCheckpointDir()
    if current:
        # setCheckpointDir appends a random leaf; its parent is the named folder.
        return current.rsplit("/", 1)[0]
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if context.applicationId not in _LOCAL:
            folder = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-capturelake-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return _LOCAL[context.applicationId]
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the files of ``durable`` frames that nothing reads any more; other frames are left alone.

    Shuffle files of what was computed from them go with Spark's next cleaning,
    which this prompts: long chains of rounds would else keep all of theirs.
    """
    for df in frames:
        context, plan = df.sparkSession.sparkContext, df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            place = context._jvm.org.apache.hadoop.fs.Path(file.get())
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if frames:
        sweep(frames[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return os.path.join(shared_dir(spark), "capturelake", f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table that ``scratch_path`` placed, once nothing reads it any more."""
    if "/capturelake/" not in path or not path.startswith(shared_dir(spark)):
        raise ValueError(f"no scratch table: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
