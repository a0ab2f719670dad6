"""Stage timeline of the projects: roll-up, transitions, changes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grading import STAGE_SEQUENCE, clamp_progress, stage_status
from .scale import HOT_ROWS, first_rows, neighbours

KEY = ["project_id"]
ORDER = ("ts", "event_id")
OPEN = ("queued", "running")
CLOSED = ("completed", "failed", "skipped")


def clean_events(events: DataFrame) -> DataFrame:
    """Known states, progress within 0..1, blank stages dropped."""
    return events.filter(F.trim("stage") != "").withColumns({
        "stage": F.trim("stage"), "stage_status": stage_status(F.col("stage_status")),
        "progress": clamp_progress(F.col("progress")),
        "message": F.nullif(F.trim("message"), F.lit("")),
    })


def _order() -> list[Column]:
    return [F.col(n) for n in ORDER]


def stage_rollup(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """State of every stage after the last event.

    An open stage is completed by the next event of another stage of its
    project. ``completed_at`` keeps the last closing time.
    """
    c = F.col
    near = neighbours(clean_events(events), KEY, _order(), {
        "_next_stage": (c("stage"), 1), "_next_ts": (c("ts"), 1)}, hot_rows)
    left = c("stage_status").isin(*OPEN) & (c("_next_stage") != c("stage"))
    closed = near.withColumns({
        "_status": F.when(left, "completed").otherwise(c("stage_status")),
        "_closed": F.when(left, c("_next_ts")).when(c("stage_status").isin(*CLOSED), c("ts")),
    })
    last = F.max(F.struct(*ORDER, "_status", "progress", "message")).alias("_l")
    return closed.groupBy(*KEY, "stage").agg(
        last, F.min("ts").alias("first_seen_at"), F.max("_closed").alias("completed_at"),
        F.count(F.lit(1)).alias("event_count"),
    ).select(
        *KEY, "stage", c("_l._status").alias("status"), "first_seen_at", c("_l.ts").alias("last_update_at"),
        "completed_at", c("_l.progress").alias("latest_progress"), c("_l.message").alias("latest_message"), "event_count")


def stage_transitions(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events at which the active stage changes, and whether that closed the old one."""
    c = F.col
    near = neighbours(clean_events(events), KEY, _order(), {
        "from_stage": (c("stage"), -1), "_from_status": (c("stage_status"), -1), "_from_ts": (c("ts"), -1)}, hot_rows)
    return near.filter(c("from_stage") != c("stage")).select(
        *KEY, "ts", "event_id", "from_stage", c("stage").alias("to_stage"),
        c("_from_status").isin(*OPEN).alias("auto_completed"),
        F.round(c("ts").cast("double") - c("_from_ts").cast("double"), 3).alias("seconds_since_last"))


def status_changes(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events whose stage, state, progress or message differs from the one before."""
    c = F.col
    seen = F.struct("stage", "stage_status", "progress", "message")
    near = neighbours(clean_events(events), KEY, _order(), {"_before": (seen, -1)}, hot_rows)
    return near.filter(~seen.eqNullSafe(c("_before"))).drop("_before")


def tail_timeline(events: DataFrame, limit: int) -> DataFrame:
    """The latest ``limit`` events of every project, newest first."""
    order = [F.desc(n) for n in ORDER]
    return first_rows(clean_events(events), KEY, order, limit, rank="age")


def pending_stages(events: DataFrame, sequence: tuple[str, ...] = STAGE_SEQUENCE) -> DataFrame:
    """Expected stages a project has not reached, in order."""
    seen = clean_events(events).filter(F.col("stage").isin(*sequence)).groupBy(*KEY).agg(
        F.collect_set("stage").alias("_seen"))
    projects = events.select(*KEY).distinct()
    return projects.join(seen, KEY, "left").select(*KEY, F.array_except(
        F.array(*[F.lit(s) for s in sequence]), F.coalesce("_seen", F.array().cast("array<string>"))).alias("pending"))
