"""Analysis windows over a stream of polls.

The same rules as ``operators.windows.analysis_windows``, one config per state key: the open
window, the tick grid's anchor, and the polls of the trailing hour. Ticks follow the poll
times, so a replay gives the windows of the batch job.

Order: polls wait until a poll ``lateness_seconds`` newer has come, and are then taken by time; a
poll that arrives in parts meanwhile is one poll. So any arrival order within that span gives the
batch job's windows. What comes later still is never lost: it counts in the open window, at the
time the config has reached. ``idle_flush_seconds`` (at least the time ceiling) takes what waits
and closes the window of a config that has gone quiet; its next poll belongs to a later tick.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.windows import COUNTERS, window_id
from wardline.settings import DEFAULTS, Settings

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

_CLOSED = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("trigger_reason", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField("poll_batch_ids", T.ArrayType(T.StringType())),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("closed_ms", T.LongType()),
        T.StructField("was_escalated", T.BooleanType()),
    ]
)
_STATE = T.StructType([T.StructField("window", T.StringType())])


class _WindowProcessor(StatefulProcessor):
    """State per config, one small JSON value: anchor, tick, open window, trailing hour."""

    def __init__(self, settings: Settings, idle_flush_seconds: int | None, lateness_seconds: int):
        self.settings = settings
        self.idle_ms = idle_flush_seconds * 1000 if idle_flush_seconds else None
        self.lateness_ms = lateness_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("config", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        waiting = state["waiting"]
        # one frame at a time; a poll is a few numbers here
        for frame in rows:
            for poll in frame.itertuples(index=False):
                known = waiting.setdefault(poll.batch_id, [int(poll.ms), *[0] * len(COUNTERS)])
                for i, c in enumerate(COUNTERS, 1):
                    known[i] += int(getattr(poll, c))
                state["newest"] = max(state["newest"], int(poll.ms))
        closed = self._take(state, state["newest"] - self.lateness_ms)
        self.value.update((json.dumps(state),))
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._rows(key[0], closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        closed = self._take(state, state["newest"])
        if state["polls"]:
            end = self._tick_end(state)
            closed.append(self._end(state, "time_ceiling", end, False))
            # the tick is over; a straggler of it counts in the next one
            state["tick"] += 1
            state["now"] = end
        self.value.update((json.dumps(state),))
        yield self._rows(key[0], closed)

    def _take(self, state: dict, upto: int) -> list[tuple]:
        """Add the waiting polls up to a time, oldest first."""
        waiting = state["waiting"]
        due = sorted((p[0], batch) for batch, p in waiting.items() if p[0] <= upto)
        closed = []
        for _, batch in due:
            ms, *counts = waiting.pop(batch)
            state["now"] = max(state["now"], ms)
            closed += self._add(state, batch, state["now"], counts)
        return closed

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        if self.value.exists():
            return json.loads(self.value.get()[0])
        clock = {"t0": None, "tick": 0, "now": 0, "newest": 0}
        return {**clock, "waiting": {}, "hour": [], **self._fresh()}

    @staticmethod
    def _fresh() -> dict:
        return {"polls": [], "start": None, "end": None, "counts": [0] * len(COUNTERS)}

    def _tick_end(self, state: dict) -> int:
        return state["t0"] + (state["tick"] + 1) * self.settings.time_ceiling_ms

    def _add(self, state: dict, batch_id: str, now: int, counts: list[int]) -> list[tuple]:
        cfg, closed = self.settings, []
        if state["t0"] is None:
            if not counts[0]:
                return closed
            state["t0"] = now
        tick = (now - state["t0"]) // cfg.time_ceiling_ms
        if tick > state["tick"]:
            if state["polls"]:
                closed.append(self._end(state, "time_ceiling", self._tick_end(state), False))
            state["tick"] = tick
        if not counts[0]:
            return closed

        state["hour"] = [
            p for p in [*state["hour"], [now, counts[0]]] if p[0] > now - cfg.baseline_ms
        ]
        minutes = (now - state["hour"][0][0]) / 60_000 or 1.0
        baseline = sum(n for _, n in state["hour"]) / minutes

        state["start"] = now if state["start"] is None else state["start"]
        state["end"] = now
        if batch_id not in state["polls"]:
            state["polls"].append(batch_id)
        state["counts"] = [n + c for n, c in zip(state["counts"], counts)]
        events, denied = state["counts"][:2]

        by_deny = denied / events >= cfg.deny_ratio_threshold
        rate = events / max(1.0, (now - state["start"]) / 60_000)
        by_spike = baseline > 0 and rate > baseline * cfg.spike_multiplier
        if by_deny or by_spike or events >= cfg.event_count_threshold:
            count_only = events >= cfg.event_count_threshold and not by_deny
            reason = "event_count" if count_only else "severity_escalation"
            closed.append(self._end(state, reason, now, by_deny or by_spike))
        return closed

    def _end(self, state: dict, reason: str, closed_ms: int, escalated: bool) -> tuple:
        row = (
            reason, *state["counts"], list(state["polls"]),
            state["start"], state["end"], closed_ms, escalated,
        )
        state.update(self._fresh())
        return row

    @staticmethod
    def _rows(config_id: str, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(
            [(config_id, *row) for row in closed], columns=[f.name for f in _CLOSED.fields]
        )


def stream_windows(
    polls: DataFrame,
    *,
    idle_flush_seconds: int | None = None,
    lateness_seconds: int = 0,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Closed windows of a streaming poll table, in append mode, with the batch columns.

    A poll without events only shows that time has passed. A task holds the polls of one config in one micro-batch:
    limit the files of a trigger when a long history is replayed. The session needs the state
    store of ``STATE_STORE``.
    """
    if idle_flush_seconds and idle_flush_seconds < settings.time_ceiling_seconds:
        raise ValueError("an idle flush before the time ceiling would cut a tick in two")
    inputs = polls.select(
        "config_id",
        "batch_id",
        F.unix_millis("poll_time").alias("ms"),
        *[F.col(c).cast("bigint").alias(c) for c in COUNTERS],
    )
    closed = inputs.groupBy("config_id").transformWithStateInPandas(
        statefulProcessor=_WindowProcessor(settings, idle_flush_seconds, lateness_seconds),
        outputStructType=_CLOSED,
        outputMode="append",
        timeMode="ProcessingTime" if idle_flush_seconds else "None",
    )
    return closed.select(
        window_id(F.col("config_id"), F.col("start_ms")).alias("window_id"),
        "config_id",
        "trigger_reason",
        *COUNTERS,
        "poll_batch_ids",
        F.timestamp_millis("start_ms").alias("window_start"),
        F.timestamp_millis("end_ms").alias("window_end"),
        F.floor((F.col("end_ms") - F.col("start_ms")) / 1000 + 0.5).alias(
            "window_duration_seconds"
        ),
        (F.col("deny_count") / F.col("event_count")).alias("deny_ratio"),
        "was_escalated",
        F.timestamp_millis("closed_ms").alias("closed_at"),
    )
