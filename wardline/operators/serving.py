"""Lookups, filtered queries, streams and series for analysts."""

from __future__ import annotations

from datetime import datetime, timedelta
from math import trunc

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.coerce import half_up
from wardline.functions.text import entity_refs
from wardline.functions.times import utc_literal
from wardline.settings import DEFAULTS, Settings

#: Time bounds further from 1970 select by time alone.
MOST_SECONDS = 6e10


def event_by_id(events: DataFrame, event_id: str | Column) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def query_events(
    events: DataFrame,
    *,
    client_ip: str | None = None,
    path: str | None = None,
    geo_country: str | None = None,
    action: str | None = None,
    start: float | None = None,
    end: float | None = None,
    limit: int | None = 100,
    time_filter: str = "before_limit",
) -> DataFrame:
    """The newest ``limit`` matching events; None returns all of them.

    The time range is searched; with ``after_limit`` it only applies to the limited rows, so a range
    in the past may give fewer rows than exist.
    """
    if time_filter not in ("after_limit", "before_limit"):
        raise ValueError(f"time_filter: {time_filter}")
    equal = {
        "client_ip": client_ip,
        "path": path,
        "geo_country": geo_country,
        "rule_action_summary": action,
    }
    for column, value in equal.items():
        if value:
            events = events.filter(F.col(column) == value)

    at = F.col("event_time_epoch")
    in_range = F.lit(True)
    if start:
        # a null time fails the lower bound and passes the upper one
        in_range = in_range & F.coalesce(at >= start, F.lit(False))
    if end:
        in_range = in_range & F.coalesce(at <= end, F.lit(True))

    if time_filter == "before_limit":
        if "event_date" in events.columns:
            events = events.filter(in_dates(start, end))
        events = events.filter(in_range)
    newest = events.orderBy(at.desc_nulls_last(), "id")
    if limit is not None:
        newest = newest.limit(limit)
    return newest.filter(in_range) if time_filter == "after_limit" else newest


def in_dates(start: float | None, end: float | None) -> Column:
    """Bounds of time as bounds of ``event_date``, a partition column: whole dates are not read.

    Event times are whole milliseconds towards 0, so the bounds are cut alike. Rows without a date have no time, or
    one beyond all dates, so they stay in the filter and are judged by their time.
    """
    day, wanted = F.col("event_date"), F.lit(True)
    for bound, above in ((start, True), (end, False)):
        seconds = bound and trunc(bound * 1000) / 1000
        if seconds and abs(seconds) < MOST_SECONDS:
            edge = F.lit((datetime(1970, 1, 1) + timedelta(seconds=seconds)).date())
            wanted = wanted & ((day >= edge if above else day <= edge) | day.isNull())
    return wanted


def ip_drilldown(events: DataFrame, ip: str, limit: int | None = 50) -> DataFrame:
    return query_events(events, client_ip=ip, limit=limit).select(
        "event_time", "method", "path", "rule_action_summary", "geo_country", "bot_score", "id"
    )


def batch_page(
    events: DataFrame, batch_id: str, *, limit: int = 100, offset: int = 0, after: str | None = None
) -> DataFrame:
    """A page of one batch, by event id, with the batch's total on every row.

    ``after`` is the last id of the page before: the next page starts behind it and costs what the first
    one did, while ``offset`` sorts all rows it skips. The page is a distributed top-k and the total a
    partial count; a page past the end is one row without event. With ``read_batch`` as ``events`` only the
    dates of the batch are read.
    """
    batch = events.filter(F.col("batch_id") == batch_id)
    total = batch.groupBy("batch_id").agg(F.count("*").alias("total"))
    rest = batch if after is None else batch.filter(F.col("id") > after)
    page = rest.orderBy("id").offset(offset).limit(limit)
    return total.join(page, "batch_id", "left")


STREAM_COLUMNS = (
    "id",
    "config_id",
    "type",
    "created_at",
    "severity",
    "events",
    "deny_count",
    "deny_ratio",
    "unique_ips",
    "model",
    "was_escalated",
    "analysis",
)


def analysis_stream(
    summaries: DataFrame,
    strategic: DataFrame,
    *,
    severity: str | None = None,
    limit: int = 50,
    strategic_limit: int = 10,
) -> DataFrame:
    """The newest windows (of one severity, if asked for) and the newest complete strategic
    analyses together, newest first."""
    newest = [F.col("created_at").desc(), F.col("id")]
    batch = summaries.withColumn("id", F.col("window_id"))
    if severity:
        batch = batch.filter(F.col("severity") == severity)
    batch = batch.orderBy(*newest).limit(limit).withColumns(
        {"type": F.lit("batch"), "events": F.col("event_count"), "model": F.col("model_used")}
    )
    done = (
        strategic.filter(F.col("status") == "complete")
        .orderBy(*newest)
        .limit(strategic_limit)
        .withColumns({"type": F.lit("strategic"), "events": F.col("total_events")})
    )
    merged = batch.select(*[c for c in STREAM_COLUMNS if c in batch.columns]).unionByName(
        done.select(*[c for c in STREAM_COLUMNS if c in done.columns]), allowMissingColumns=True
    )
    return merged.withColumn("events", F.coalesce("events", F.lit(0))).orderBy(*newest)


def analysis_by_id(summaries: DataFrame, strategic: DataFrame, wanted: str) -> DataFrame:
    """A window record of that id, else a strategic one, tagged with its type."""
    batch = summaries.filter(F.col("window_id") == wanted).select(
        F.lit(1).alias("_rank"),
        F.lit("batch").alias("type"),
        F.col("window_id").alias("id"),
        "created_at",
        "severity",
        "analysis",
        F.col("event_count").alias("events"),
    )
    other = strategic.filter(F.col("id") == wanted).select(
        F.lit(2).alias("_rank"),
        F.lit("strategic").alias("type"),
        "id",
        "created_at",
        "severity",
        "analysis",
        F.col("total_events").alias("events"),
    )
    return batch.unionByName(other).orderBy("_rank").limit(1).drop("_rank")


def volume_series(summaries: DataFrame, limit: int = 30) -> DataFrame:
    """The newest ``limit`` windows in chronological order."""
    return (
        summaries.orderBy(F.col("created_at").desc(), "window_id")
        .limit(limit)
        .select(
            F.col("created_at").alias("time"), "window_id", "event_count", "deny_count", "severity"
        )
        .orderBy("time", F.col("window_id").desc())
    )


def scaled_series(
    series: DataFrame, *, width: int = 200, height: int = 40, pad: int = 2
) -> DataFrame:
    """Both lines of a volume series as points in a box, one decimal.

    A series is as many points as were asked for (see ``volume_series``), one small group.
    """
    draw_w, draw_h = float(width - 2 * pad), float(height - 2 * pad)
    group = Window.partitionBy(F.lit(0))
    order = group.orderBy("time", F.col("window_id").desc())
    top = F.greatest(
        F.lit(1), F.max("event_count").over(group), F.max("deny_count").over(group)
    )
    n = F.count("*").over(group)
    i = F.row_number().over(order) - 1
    x = pad + F.when(n == 1, draw_w / 2).otherwise(i / (n - 1) * draw_w)

    def y(value: str) -> Column:
        return half_up(pad + draw_h - F.col(value) / top * draw_h, 1)

    return series.select(
        (i + 1).alias("point"),
        half_up(x, 1).alias("x"),
        y("event_count").alias("event_y"),
        y("deny_count").alias("deny_y"),
    )


def entity_references(analyses: DataFrame, *, id_column: str = "id") -> DataFrame:
    """Every ``[ip::X]`` and ``[event::X]`` mentioned in an analysis, in order."""
    def listed(kind: str) -> Column:
        return F.transform(
            entity_refs(F.coalesce("analysis", F.lit("")), kind),
            lambda ref, i: F.struct(
                F.lit(kind).alias("kind"), (i + 1).alias("pos"), ref.alias("ref")
            ),
        )

    lists = [listed("ip"), listed("event")]
    return analyses.select(F.col(id_column).alias("analysis_id"), F.inline(F.concat(*lists)))


def referenced_events(references: DataFrame, events: DataFrame) -> DataFrame:
    """The events that analyses refer to by id; references that match none keep nulls."""
    wanted = references.filter(F.col("kind") == "event")
    found = events.select(
        F.col("id").alias("ref"),
        "event_time_epoch",
        "client_ip",
        "path",
        "rule_action_summary",
    )
    return wanted.join(found, "ref", "left")


def window_counts(
    summaries: DataFrame, as_of: datetime, *, settings: Settings = DEFAULTS
) -> DataFrame:
    cutoff = utc_literal(as_of - timedelta(hours=settings.lookback_hours))
    return summaries.agg(
        F.count("*").alias("count_all"),
        F.count_if(F.col("created_at") > cutoff).alias("count_filtered"),
    )
