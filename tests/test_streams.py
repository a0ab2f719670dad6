"""Keyed streams: order across Arrow batches and triggers, and timeouts."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from capturelake.operators import images as I
from capturelake.operators import stages as St
from capturelake.sources import readers
from capturelake.streaming import stages as SS
from capturelake.streaming import tables as ST

SCHEMA = "project_id bigint, ts timestamp, event_id bigint, stage string, stage_status string, progress double, message string"


def events(n, projects, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((rng.randrange(projects), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(n // 2)), i,
                     rng.choice(["a", "b", "c", "completed"]), rng.choice(["queued", "running", "completed", "failed"]),
                     rng.choice([None, 0.5, 1.0]), rng.choice([None, "m"])))
    return rows


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def stream_of(spark, rows, path, files):
    """Rows in order of time, cut into files that are read one for each trigger."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size:(k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def rows_of(df, names):
    return sorted(map(str, df.select(*names).collect()))


@pytest.mark.parametrize("files", [1, 3])
def test_streams_equal_their_batch_twins(small_batches, tmp_path, files):
    spark, rows = small_batches, events(400, 3, files)
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = stream_of(spark, rows, str(tmp_path), files)
    tracked = SS.latest_entries(ST.run_available(SS.track_stages(stream), "t", f"{tmp_path}/t", "update"))
    want = St.stage_rollup(batch)
    assert rows_of(tracked, want.columns) == rows_of(want, want.columns)
    changed = ST.run_available(SS.stream_status_changes(stream), "c", f"{tmp_path}/c")
    names = ["project_id", "ts", "event_id", "stage", "stage_status", "progress", "message"]
    twin = St.status_changes(batch.withColumn("progress", F.col("progress")))
    # After a terminal stage the stream has forgotten the project, so an equal event counts as a change again.
    known = set(rows_of(twin, names))
    got = set(rows_of(changed, names))
    assert known <= got and all("stage='completed'" in r for r in got - known)


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers, self.state = [], State()

    def getValueState(self, name, schema):
        return self.state

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_tracker_sorts_no_frames_for_each_project(monkeypatch):
    """Entries come from plain values, whatever the order and the batches of a project's events; open stages end with the next one."""
    class Held:
        def __init__(self):
            self.kept = {}

        def exists(self):
            return () in self.kept

        def get(self):
            return self.kept[()]

        def update(self, value):
            self.kept[()] = value

        def containsKey(self, key):
            return key in self.kept

        def getValue(self, key):
            return self.kept[key]

        def updateValue(self, key, value):
            self.kept[key] = value

    def events(*rows):
        return pd.DataFrame([(pd.Timestamp(f"2024-01-01 00:00:0{s}"), e, stage, status, p, None) for s, e, stage, status, p in rows],
                            columns=["ts", "event_id", "stage", "stage_status", "progress", "message"])

    tracker = SS.StageTracker()
    tracker.active, tracker.stages = Held(), Held()
    monkeypatch.setattr(pd.DataFrame, "sort_values", None)
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    at = [pd.Timestamp(f"2024-01-01 00:00:0{s}") for s in range(7)]
    names = ["stage", "status", "first_seen_at", "last_update_at", "completed_at", "latest_progress", "event_count"]

    def entries(*frames):
        return {r[0]: tuple(None if pd.isna(v) else v for v in r[1:]) for out in tracker.handleInputRows((7,), iter(frames), None)
                for r in out[names].itertuples(index=False)}

    assert entries(events((3, 2, "b", "running", 0.5), (1, 9, "a", "running", None)), events((2, 1, "b", "queued", 0.1))) == {
        "a": ("completed", at[1], at[1], at[2], None, 1), "b": ("running", at[2], at[3], None, 0.5, 2)}
    assert entries(events((5, 1, "a", "failed", 1.0))) == {
        "b": ("completed", at[2], at[3], at[5], 0.5, 2), "a": ("failed", at[1], at[5], at[5], 1.0, 2)}


def test_only_the_last_timer_stays():
    handle, clock = Handle(), Clock()
    detector = SS.ChangeDetector(1000)
    detector.init(handle)

    def send(at, stage):
        clock.now = at
        frame = pd.DataFrame({"ts": [pd.Timestamp(at, unit="ms")], "event_id": [at], "stage": [stage], "stage_status": ["running"],
                              "progress": [None], "message": [None]})
        return len(next(detector.handleInputRows((1,), iter([frame]), clock)))

    assert [send(0, "a"), send(600, "a"), send(900, "b")] == [1, 0, 1]
    assert handle.timers == [1900]
    assert send(1500, "b") == 0 and handle.timers == [2500]
    list(detector.handleExpiredTimer((1,), clock, None))
    handle.timers.clear()
    assert send(3000, "b") == 1 and handle.timers == [4000]
    assert send(3100, "completed") == 1 and not handle.state.exists() and handle.timers == []


def test_lookups_stay_inside_their_project(spark):
    images = spark.createDataFrame([(1, 1, "A.jpg"), (2, 2, "a.jpg"), (3, 3, "a.jpg")], "image_id int, project_id int, name string")
    records = spark.createDataFrame([(1, " a.JPG", 1, "old", 0.1), (1, "A.jpg", 5, "new", 0.2), (2, "a.jpg", 3, "failed", None)],
                                    "project_id int, filename string, n int, status string, foreground_ratio double")
    got = I.attach_segmentation(images, records, "n").orderBy("image_id").collect()
    assert [r["status"] for r in got] == ["new", "failed", None]
    got = I.attach_foreground(images, records, "n").orderBy("image_id").collect()
    assert [r["foreground_ratio"] for r in got] == [0.2, 0.0, 0.25]


def test_lines_of_arrays_are_no_records(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"project_id": "a", "image_count": 3}\n[{"project_id": "z"}]\n{broken\n\n{"project_id": "b", "image_count": "x"}\n7\n')
    good, bad = readers.read_json_lines(spark, str(tmp_path), readers.HISTORY_SCHEMA)
    assert [(r["project_id"], r["image_count"]) for r in good.orderBy("project_id").collect()] == [("a", 3), ("b", None)]
    assert sorted(r[0] for r in bad.collect()) == ['7', '[{"project_id": "z"}]', "{broken"]


def test_stream_median_is_close(spark):
    rows = [("v", "s", "completed", float(i)) for i in range(1001)]
    df = spark.createDataFrame(rows, "variant string, scenario_label string, status string, total_processing_seconds double")
    r = ST.stream_run_stats(df).first()
    assert abs(r["median_total_processing_seconds"] - 500) <= 1 and r["run_count"] == 1001


def test_sketches_of_run_times_merge(spark):
    rows = spark.range(30_000).selectExpr(
        "'completed' AS status", "'v' || id % 2 AS variant", "CAST(NULL AS STRING) AS scenario_label",
        "CAST(id * 7919 % 30011 AS DOUBLE) AS total_processing_seconds")
    parts = [ST.stream_run_stats(rows.filter(F.col("total_processing_seconds") % 3 == k)) for k in range(3)]
    merged = ST.merge_time_sketches(parts[0].union(parts[1]).union(parts[2])).collect()
    assert sorted(r["variant"] for r in merged) == ["v0", "v1"]
    assert all(abs(r["median_total_processing_seconds"] / 30_011 - 0.5) <= 3 * ST.RANK_ERROR for r in merged)
    none = rows.withColumn("total_processing_seconds", F.lit(None).cast("double"))
    assert {r["median_total_processing_seconds"] for r in ST.stream_run_stats(none).collect()} == {None}
    assert ST.merge_time_sketches(parts[0].limit(0)).count() == 0


def test_streams_read_tables_of_one_or_many_files(spark, tmp_path):
    """Documents as one file and as a folder of files give the same digests."""
    from capturelake.plans import streams

    docs = spark.createDataFrame([(i, f"s{i % 3}", f"text {i % 7}") for i in range(60)], "doc_id bigint, source string, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    docs.repartition(4).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    one, many = (sorted(map(tuple, streams.upload_stream(spark, str(p)).collect())) for p in (tmp_path, tmp_path / "many"))
    assert one == many and len(one) == 21
