"""Raw newline-delimited JSON, one directory per poll:
``<root>/config_id=<c>/poll_epoch=<seconds>/*.ndjson``.

Raw lines are a table ``(config_id, poll_epoch, line_pos, value)``. ``line_pos`` orders the
lines of one poll: file, start of the split inside the file, position inside the split. It
costs no shuffle and survives a re-run of any task, because it depends only on how the file
was split.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.times import utc_seconds
from wardline.settings import DEFAULTS, Settings


def read_raw_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of all polls under ``path``; blank lines are gone, nothing is parsed yet."""
    lines = (
        spark.read.schema("value string, config_id string, poll_epoch bigint")
        .text(path)
        .select("config_id", "poll_epoch", "value", "_metadata.file_path",
                "_metadata.file_block_start")
    )
    return with_line_pos(lines)


def with_line_pos(lines: DataFrame) -> DataFrame:
    return lines.select(
        "config_id",
        "poll_epoch",
        F.struct(
            F.col("file_path").alias("file"),
            F.col("file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_pos"),
        "value",
    ).filter(~is_blank(F.col("value")))


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^\s*$")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``doc``, the parsed line; lines that are no JSON document are skipped.

    The parse sits under ``explode`` so that it runs once per line: a plain filter on its
    result would be pushed below the projection and parse every line a second time.
    """
    parsed = F.filter(
        F.array(F.try_parse_json("value")), lambda d: d.isNotNull() & ~F.is_variant_null(d)
    )
    return lines.select(
        *[c for c in lines.columns if c != "value"], F.explode(parsed).alias("doc")
    )


def is_metadata(doc: Column) -> Column:
    """A line with both ``total`` and ``offset`` describes its poll, even if one is null."""
    return (
        F.try_variant_get(doc, "$.total", "variant").isNotNull()
        & F.try_variant_get(doc, "$.offset", "variant").isNotNull()
    )


def may_be_metadata(value: Column) -> Column:
    """Cheap text test that no metadata line fails: its member name is written out, or some
    character of it is escaped."""
    return value.contains('"offset"') | value.contains("\\u")


def event_docs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~is_metadata(F.col("doc")))


def split_batch_metadata(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event documents, one metadata row per poll: the last such line wins)."""
    metadata = (
        parsed.filter(is_metadata(F.col("doc")))
        .select(
            "config_id",
            "poll_epoch",
            "line_pos",
            F.try_variant_get("doc", "$.total", "bigint").alias("total"),
            F.try_variant_get("doc", "$.offset", "string").alias("offset"),
        )
        .groupBy("config_id", "poll_epoch")
        .agg(F.max_by(F.struct("total", "offset"), F.col("line_pos")).alias("m"))
        .select("config_id", "poll_epoch", "m.total", "m.offset")
    )
    return event_docs(parsed), metadata


def line_quality(lines: DataFrame) -> DataFrame:
    """Per poll: lines read, skipped as malformed, metadata, events."""
    doc = F.try_parse_json("value")
    kind = (
        F.when(doc.isNull() | F.is_variant_null(doc), "malformed")
        .when(is_metadata(doc), "metadata")
        .otherwise("event")
    )
    return (
        lines.filter(~is_blank(F.col("value")))
        # explode for the same reason as in parse_lines: classify each line once
        .select("config_id", "poll_epoch", F.explode(F.array(kind)).alias("kind"))
        .groupBy("config_id", "poll_epoch")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(F.col("kind") == "malformed").alias("malformed"),
            F.count_if(F.col("kind") == "metadata").alias("metadata"),
            F.count_if(F.col("kind") == "event").alias("events"),
        )
    )


def batch_id(config_id: Column, poll_epoch: Column) -> Column:
    return F.concat_ws("@", config_id, poll_epoch.cast("string"))


def tag_batch(df: DataFrame) -> DataFrame:
    """All rows of one poll share a ``batch_id`` that a re-run reproduces."""
    return df.withColumns(
        {
            "batch_id": batch_id(F.col("config_id"), F.col("poll_epoch")),
            "poll_time": F.timestamp_seconds("poll_epoch"),
        }
    )


def incremental_slice(
    events: DataFrame,
    poll_log: DataFrame,
    as_of: datetime,
    *,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Rows a backfill at ``as_of`` still has to read, per config.

    Offsets are opaque, so progress is told by polls: an offset covers everything up to the poll
    that returned it, and a poll without one moves nothing. Wanted are rows of polls after the last
    offset; from ``as_of`` minus the stale limit (by event time) when the last poll is older than
    that limit; everything when the config has no offset yet. ``events`` needs ``config_id``,
    ``poll_time`` and ``event_time_epoch``, ``poll_log`` ``config_id, poll_time, last_offset``: the
    ingest's own tables.
    """
    covered = F.when(F.col("last_offset").isNotNull(), F.col("poll_time"))
    latest = poll_log.groupBy("config_id").agg(
        F.max(covered).alias("_covered_to"), F.max("poll_time").alias("_last_poll")
    )
    now = F.lit(utc_seconds(as_of))
    limit = F.lit(settings.offset_stale_hours * 3600.0)
    stale = now - F.unix_millis("_last_poll") / 1000 > limit
    wanted = (
        F.col("_covered_to").isNull()
        | F.coalesce(~stale & (F.col("poll_time") > F.col("_covered_to")), F.lit(False))
        | F.coalesce(stale & (F.col("event_time_epoch") >= F.floor(now - limit)), F.lit(False))
    )
    # one row per config: a shuffle by config would make each a single task
    return events.join(F.broadcast(latest), "config_id", "left").filter(wanted).drop("_covered_to", "_last_poll")
