"""Keyed stage tracker and change detection over a stream of stage events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stages import CLOSED, OPEN, clean_events

ACTIVE = "stage string"
INFO = ("status string, first_seen_at timestamp, last_update_at timestamp, completed_at timestamp, "
        "latest_progress double, latest_message string, event_count bigint")
TRACKED = "project_id bigint, stage string, " + INFO
CHANGED = "project_id bigint, ts timestamp, event_id bigint, stage string, stage_status string, progress double, message string"
TERMINAL_STAGES = ("completed", "failed", "completed_with_fallback")


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All events of a project's trigger in order, whatever Arrow batches they came in.

    One project's events of one trigger are held at once; the source's rate
    (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds them.
    """
    return pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)


def _plain(value):
    return None if pd.isna(value) else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value


class StageTracker(StatefulProcessor):
    """Per project: the active stage and one entry per stage seen.

    Rows arrive in batches of a project's events. The state holds only stage
    entries, so it stays small however many events a project sends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", ACTIVE)
        self.stages = handle.getMapState("stages", "stage string", INFO)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Most projects have few events a trigger: plain values cost far less there than frames.
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        order = np.lexsort((frame["event_id"].to_numpy(), frame["ts"].to_numpy()))
        ts = frame["ts"].to_numpy()[order]
        stage, status, progress, message = (frame[n].to_numpy()[order].tolist() for n in ("stage", "stage_status", "progress", "message"))
        active = self.active.get()[0] if self.active.exists() else None
        known = {} if active is None else {active: self.stages.getValue((active,))}
        last, first, closed, counts = {}, {}, {}, {}
        void = np.isnat(ts).tolist()
        for i, name in enumerate(stage):
            last[name] = i
            first.setdefault(name, i)
            counts[name] = counts.get(name, 0) + 1
            # An open stage is completed by the next event of another stage; the first event may end the stage left active.
            if status[i] in OPEN and i + 1 < len(stage) and stage[i + 1] != name:
                status[i] = "completed"
                end = i + 1
            else:
                end = i if status[i] in CLOSED else None
            if end is not None and not void[end]:
                closed[name] = end

        def moment(i: int | None):
            return None if i is None or void[i] else pd.Timestamp(ts[i]).to_pydatetime()

        out = {}
        if active is not None and active != stage[0] and known[active][0] in OPEN:
            known[active] = ("completed", *known[active][1:3], moment(0), *known[active][4:])
            out[active] = known[active]
        for name, i in last.items():
            # A project without an active stage has no entries yet.
            if active is not None and name not in known and self.stages.containsKey((name,)):
                known[name] = self.stages.getValue((name,))
            before = known.get(name)
            out[name] = (
                status[i], before[1] if before else moment(first[name]), moment(i),
                moment(closed.get(name)) or (before[3] if before else None), _plain(progress[i]), _plain(message[i]),
                (before[6] if before else 0) + counts[name])
        self.active.update((stage[-1],))
        for name, info in out.items():
            self.stages.updateValue((name,), info)
        names = [f.split()[0] for f in TRACKED.split(", ")]
        yield pd.DataFrame([(key[0], name, *info) for name, info in out.items()], columns=names)

    def close(self) -> None:
        pass


def track_stages(events: DataFrame) -> DataFrame:
    """Updated stage entries of every project touched in a trigger."""
    clean = clean_events(events).select("project_id", "ts", "event_id", "stage", "stage_status", "progress", "message")
    return clean.groupBy("project_id").transformWithStateInPandas(
        StageTracker(), outputStructType=TRACKED, outputMode="Update", timeMode="None")


class ChangeDetector(StatefulProcessor):
    """Lets an event through only when the project's status text changed.

    A terminal state forgets the project; so does silence beyond the timeout.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "stage string, stage_status string, progress double, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = ["stage", "stage_status", "progress", "message"]
        events = _ordered(rows)
        before = events[fields].shift(1)
        if self.last.exists():
            before.loc[0, fields] = self.last.get()
        same = ((events[fields] == before) | (events[fields].isna() & before.isna())).all(axis=1)
        # Nothing is remembered beyond a terminal state.
        same &= ~before["stage"].isin(TERMINAL_STAGES)
        if not self.last.exists():
            same.iloc[0] = False
        if self.timeout_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        end = events.iloc[-1]
        if end["stage"] in TERMINAL_STAGES:
            self.last.clear()
        else:
            self.last.update(tuple(_plain(end[f]) for f in fields))
            if self.timeout_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        changed = events[~same]
        yield changed.assign(project_id=key[0])[[f.split()[0] for f in CHANGED.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({f.split()[0]: [] for f in CHANGED.split(", ")})

    def close(self) -> None:
        pass


def stream_status_changes(events: DataFrame, timeout_ms: int = 0) -> DataFrame:
    clean = clean_events(events).select("project_id", "ts", "event_id", "stage", "stage_status", "progress", "message")
    return clean.groupBy("project_id").transformWithStateInPandas(
        ChangeDetector(timeout_ms), outputStructType=CHANGED, outputMode="Append",
        timeMode="ProcessingTime" if timeout_ms else "None")


def latest_entries(updates: DataFrame) -> DataFrame:
    """Final entry per stage out of the emitted updates."""
    names = [f.split()[0] for f in INFO.split(", ")]
    # A stage closed by another one keeps its own count; the closed row sorts last by completion.
    ranked = updates.groupBy("project_id", "stage").agg(
        F.max(F.struct("event_count", F.coalesce("completed_at", F.timestamp_seconds(F.lit(0))).alias("_done"), *names[:6])).alias("_b"))
    return ranked.select("project_id", "stage", *[f"_b.{n}" for n in names[:6]], "_b.event_count")
