"""Analysis windows: polls accumulate until a trigger closes the window.

Polls of one config add up until the event count, the deny ratio or a rate spike closes the
window at a poll, or a tick of the time ceiling closes it between polls. Counters reset after
each close, so this is no plain window function over the config. But a tick always leaves
the counters empty, whether or not anything was pending. Ticks sit on a fixed grid from the
first poll on, hence every (config, tick interval) cell can be folded by itself: the cells
spread over the cluster and hold at most ``time_ceiling`` worth of polls.

Conventions: a tick at or before a poll's time fires before that poll; a window still open
at ``as_of`` (default: the config's last poll) is not returned.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.times import utc_seconds
from wardline.settings import (
    BASE_TIER,
    DEFAULTS,
    ESCALATED_TIER,
    STRATEGIC_TIER,
    SUMMARY_TIER,
    Settings,
)


def poll_aggregate(events: DataFrame) -> DataFrame:
    """Counts per poll over all arrivals; an event with deny and alert counts in both."""
    return events.groupBy("config_id", "batch_id", "poll_time").agg(
        F.count("*").alias("event_count"),
        F.count_if("has_deny").alias("deny_count"),
        F.count_if(F.array_contains("actions", "alert")).alias("alert_count"),
        F.count_if(F.array_contains("actions", "monitor")).alias("monitor_count"),
    )


def baseline_rate(polls: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``baseline_rate``: events per minute over the trailing hour, this poll included.

    The minutes run from the oldest poll in range (1 if that is this poll). Each poll is
    copied into the next hour's group as context, so a group holds two hours of one config
    instead of its whole history.
    """
    span = settings.baseline_ms
    at = F.unix_millis("poll_time")
    hour = F.floor(at / span)
    spread = polls.select(
        "*",
        at.alias("_ms"),
        F.inline(
            F.array(
                F.struct(hour.alias("_hour"), F.lit(True).alias("_own")),
                F.struct((hour + 1).alias("_hour"), F.lit(False).alias("_own")),
            )
        ),
    )
    trailing = (
        Window.partitionBy("config_id", "_hour").orderBy("_ms").rangeBetween(-(span - 1), 0)
    )
    minutes = (F.col("_ms") - F.min("_ms").over(trailing)) / 60_000
    rate = F.sum("event_count").over(trailing) / F.when(minutes == 0, 1.0).otherwise(minutes)
    return (
        spread.withColumn("baseline_rate", rate).filter("_own").drop("_ms", "_hour", "_own")
    )


COUNTERS = ("event_count", "deny_count", "alert_count", "monitor_count")
_WINDOW_TYPE = (
    "struct<start_ms:bigint,end_ms:bigint,event_count:bigint,deny_count:bigint,"
    "alert_count:bigint,monitor_count:bigint,poll_batch_ids:array<string>,"
    "reason:string,escalated:boolean>"
)
_EMPTY = "cast(named_struct({}) as {})".format(
    ", ".join(
        f"'{name}', {value}"
        for name, value in (
            ("start_ms", "null"),
            ("end_ms", "null"),
            *((c, "0") for c in COUNTERS),
            ("poll_batch_ids", "array()"),
            ("reason", "null"),
            ("escalated", "false"),
        )
    ),
    _WINDOW_TYPE,
)


def _fold(polls: str, settings: Settings) -> Column:
    """The polls of one cell, in order, to the windows closed in it and the one left open.

    Each step is a chain of one-element transforms, "let" style: add the poll to the open
    window, judge the sum, then keep it open or close it. The deny ratio overrides the count
    as the reason; a spike adds a reason only where there is none.
    """
    summed = ", ".join(f"'{c}', s.open.{c} + p.{c}" for c in COUNTERS)
    grown = (
        f"named_struct('start_ms', coalesce(s.open.start_ms, p.ms), 'end_ms', p.ms, {summed},"
        " 'poll_batch_ids', array_append(s.open.poll_batch_ids, p.batch_id))"
    )
    judged = f"""named_struct('w', g,
        'deny', g.deny_count / g.event_count >= {settings.deny_ratio_threshold}D,
        'many', g.event_count >= {settings.event_count_threshold},
        'spike', p.baseline_rate > 0 and g.event_count / greatest(1D, (g.end_ms - g.start_ms) / 60000)
          > p.baseline_rate * {settings.spike_multiplier}D)"""
    kept = ", ".join(f"'{c}', j.w.{c}" for c in ("start_ms", "end_ms", *COUNTERS, "poll_batch_ids"))
    finished = f"""named_struct({kept},
        'reason', case when j.deny then 'severity_escalation' when j.many then 'event_count'
          when j.spike then 'severity_escalation' end,
        'escalated', j.deny or j.spike)"""
    step = f"""transform(transform(transform(array({grown}), g -> {judged}), j -> {finished}), w ->
        if(w.reason is null,
          named_struct('open', w, 'closed', s.closed),
          named_struct('open', {_EMPTY}, 'closed', array_append(s.closed, w))))[0]"""
    start = f"named_struct('open', {_EMPTY}, 'closed', cast(array() as array<{_WINDOW_TYPE}>))"
    return F.expr(f"aggregate({polls}, {start}, (s, p) -> {step})")


def analysis_windows(
    polls: DataFrame, *, as_of: datetime | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per closed window from the poll table (``poll_aggregate``, or the ingest's log).

    A poll without events only shows that time has passed.
    """
    ceiling = settings.time_ceiling_ms
    busy = F.col("event_count") > 0
    anchors = polls.groupBy("config_id").agg(
        F.unix_millis(F.min(F.when(busy, F.col("poll_time")))).alias("_t0"),
        F.unix_millis(F.max("poll_time")).alias("_last"),
    )
    if as_of is not None:
        anchors = anchors.withColumn("_last", F.lit(int(utc_seconds(as_of) * 1000)))
        polls = polls.filter(F.unix_millis("poll_time") <= int(utc_seconds(as_of) * 1000))
    cells = (
        baseline_rate(polls.filter(busy), settings=settings)
        .withColumn("_ms", F.unix_millis("poll_time"))
        .join(anchors, "config_id")
        .withColumn("_tick", F.floor((F.col("_ms") - F.col("_t0")) / ceiling))
        .groupBy("config_id", "_tick")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(F.col("_ms").alias("ms"), "batch_id", *COUNTERS, "baseline_rate")
                )
            ).alias("_polls"),
            (F.first("_t0") + (F.col("_tick") + 1) * ceiling).alias("_tick_end"),
            F.first("_last").alias("_last"),
        )
    )
    folded = cells.withColumn("_state", _fold("_polls", settings))
    # What is left over closes at the tick, if that tick has come.
    left_over = F.when(
        F.col("_state.open.start_ms").isNotNull() & (F.col("_tick_end") <= F.col("_last")),
        F.array("_state.open"),
    ).otherwise(F.array().cast(f"array<{_WINDOW_TYPE}>"))
    closed = folded.select(
        "config_id",
        "_tick_end",
        F.explode(F.concat("_state.closed", left_over)).alias("w"),
    )
    start_ms, end_ms = F.col("w.start_ms"), F.col("w.end_ms")
    by_tick = F.col("w.reason").isNull()
    return closed.select(
        window_id(F.col("config_id"), start_ms).alias("window_id"),
        "config_id",
        F.coalesce("w.reason", F.lit("time_ceiling")).alias("trigger_reason"),
        *[F.col(f"w.{c}").alias(c) for c in COUNTERS],
        F.col("w.poll_batch_ids").alias("poll_batch_ids"),
        F.timestamp_millis(start_ms).alias("window_start"),
        F.timestamp_millis(end_ms).alias("window_end"),
        F.floor((end_ms - start_ms) / 1000 + 0.5).alias("window_duration_seconds"),
        (F.col("w.deny_count") / F.col("w.event_count")).alias("deny_ratio"),
        F.col("w.escalated").alias("was_escalated"),
        F.timestamp_millis(F.when(by_tick, F.col("_tick_end")).otherwise(end_ms)).alias(
            "closed_at"
        ),
    )


def window_id(config_id: Column, start_ms: Column) -> Column:
    """A config's windows start at different polls, so config and start identify one."""
    return F.concat_ws("#", config_id, start_ms.cast("string"))


def window_polls(windows: DataFrame) -> DataFrame:
    """(window_id, batch_id) for every poll a window covers."""
    return windows.select("window_id", F.explode("poll_batch_ids").alias("batch_id"))


def batch_tier() -> Column:
    return F.when(F.col("was_escalated"), ESCALATED_TIER).otherwise(BASE_TIER)


def summary_tier() -> Column:
    return F.lit(SUMMARY_TIER)


def strategic_tier() -> Column:
    return F.lit(STRATEGIC_TIER)


def route_tier(windows: DataFrame, crossings: DataFrame) -> DataFrame:
    """Add ``tier``; windows after the one whose call reached the day's budget cap get no row.

    ``crossings``: ``date, cap_reached_at, cap_call`` per day, from ``budget_flags`` over the calls of
    the windows (``call_seq`` is the window id). Windows count in the order of (closed_at,
    window_id), like the budget gate, so of several that close at one moment only those up to the
    crossing pass.
    """
    day_cap = crossings.select(
        F.col("date").alias("_date"), F.struct("cap_reached_at", "cap_call").alias("_cap")
    )
    own = F.struct(F.col("closed_at"), F.col("window_id"))
    return (
        windows.withColumn("_date", F.to_date("closed_at"))
        .join(day_cap, "_date", "left")
        .filter(F.col("_cap").isNull() | F.col("_cap.cap_call").isNull() | (own <= F.col("_cap")))
        .withColumn("tier", batch_tier())
        .drop("_date", "_cap")
    )
