"""Continuous ingest: raw files in, bronze events, poll log, sketches and the event table out.

One query owns one checkpoint; the checkpoint takes the place of offsets and of any lease
between pollers. Each micro-batch writes into directories named after its epoch and replaces
them when it is replayed, so a restart neither loses nor doubles rows. Bronze keeps every
delivery, by date and then epoch; ``upsert_events`` over it is the event table, which the same
micro-batches merge into where one is named. The table remembers the epoch it has seen of a query, so a
replay leaves it as it is.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.normalize import DEFAULT_SOURCE, normalize_events
from wardline.functions.times import utc_seconds
from wardline.operators.stats import ip_sketches
from wardline.operators.windows import poll_aggregate
from wardline.schemas import BRONZE, POLL_LOG, SKETCHES
from wardline.session import configure
from wardline.settings import DEFAULTS, Settings
from wardline.sources.event_table import FILE_ROWS, merge_events
from wardline.sources.ndjson import (
    batch_id,
    event_docs,
    incremental_slice,
    may_be_metadata,
    parse_lines,
    split_batch_metadata,
    tag_batch,
    with_line_pos,
)

COUNTERS = ("event_count", "deny_count", "alert_count", "monitor_count")
LINE_SCHEMA = "value string, config_id string, poll_epoch bigint"


def stream_raw_ndjson(
    spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The streaming twin of ``read_raw_ndjson``, before line positions."""
    reader = spark.readStream.schema(LINE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(
        "config_id",
        "poll_epoch",
        "value",
        "_metadata.file_path",
        "_metadata.file_block_start",
    )


def ingest_stream(
    lines: DataFrame,
    target: str,
    *,
    source: str = DEFAULT_SOURCE,
    available_now: bool = False,
    interval: str = "30 seconds",
    table: str | None = None,
    counts: bool = False,
    remembered_epochs: int = 0,
    file_rows: int = FILE_ROWS,
) -> StreamingQuery:
    """Start ingest of streaming raw lines into ``target``/{bronze,poll_log,sketches}.

    ``lines`` comes from ``stream_raw_ndjson``, or from any source that already has
    ``config_id, poll_epoch, line_pos, value``. With ``table``, every micro-batch is merged into the event
    table there (``counts``: with signed counts per batch). With ``remembered_epochs``, an event that one
    of so many micro-batches before stored for the same poll is not stored again, such as from a file
    that landed twice; one that comes later is stored once more, and the merge takes the last.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        # the stream runs on a session of its own
        spark = configure(batch.sparkSession)
        positioned = batch if "line_pos" in batch.columns else with_line_pos(batch)
        # every line is parsed and mapped once, on its way to bronze; what follows reads columns of that
        docs = event_docs(parse_lines(positioned))
        events = normalize_events(tag_batch(docs), source=source, whole=True)
        if remembered_epochs:
            events = _unseen(spark, target, events, epoch, remembered_epochs)
        dated = events.withColumns({"event_date": F.to_date("event_time"), "epoch": F.lit(epoch)})
        _by_date(dated).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "maxRecordsPerFile", file_rows
        ).partitionBy("event_date", "epoch").parquet(f"{target}/bronze")
        written = _read(spark, f"{target}/bronze", BRONZE).where(F.col("epoch") == epoch).drop("epoch")
        # few lines are parsed for this: those whose text may be a poll's metadata
        few = positioned.where(may_be_metadata(F.col("value")))
        metadata = split_batch_metadata(parse_lines(few))[1]
        poll_log(poll_aggregate(written), metadata).write.mode("overwrite").parquet(
            f"{target}/poll_log/epoch={epoch}"
        )
        ip_sketches(written).write.mode("overwrite").parquet(f"{target}/sketches/epoch={epoch}")
        if table is not None:
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            merge_events(
                spark, table, written, writer=query, epoch=epoch, counts=counts, file_rows=file_rows
            )

    writer = lines.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{target}/checkpoint"
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _by_date(events: DataFrame) -> DataFrame:
    """Rows of a date side by side, in the order of ids; by their size, a date is one task or many.

    Ranges would have to be sampled first, which runs all that leads to the rows a second time.
    """
    return events.hint("rebalance", "event_date").sortWithinPartitions("event_date", "epoch", "id")


def _unseen(spark: SparkSession, target: str, events: DataFrame, epoch: int, remembered: int) -> DataFrame:
    """Events that the ``remembered`` epochs before did not store for the same poll.

    The state is bronze itself, of which only the folders of those epochs are read.
    """
    recent = _read(spark, f"{target}/bronze", BRONZE).where(
        (F.col("epoch") >= epoch - remembered) & (F.col("epoch") < epoch)
    )
    known = recent.select("id", "batch_id").distinct()
    return events.join(known, ["id", "batch_id"], "left_anti").select(events.columns)


def poll_log(polls: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts and last offset of every poll; one that brought only metadata has counts of 0."""
    offsets = metadata.select(
        "config_id",
        batch_id(F.col("config_id"), F.col("poll_epoch")).alias("batch_id"),
        F.timestamp_seconds("poll_epoch").alias("poll_time"),
        F.col("offset").alias("last_offset"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS]
    keys = ["config_id", "batch_id", "poll_time"]
    return polls.join(offsets, keys, "full").select(*keys, *counts, "last_offset")


def read_bronze(spark: SparkSession, target: str) -> DataFrame:
    """All deliveries so far; empty before the first event."""
    return _read(spark, f"{target}/bronze", BRONZE).drop("epoch")


def read_poll_log(spark: SparkSession, target: str) -> DataFrame:
    """One row per poll; a poll whose files fell into two micro-batches is added up."""
    has_offset = F.when(F.col("last_offset").isNotNull(), F.col("epoch"))
    return (
        _read(spark, f"{target}/poll_log", POLL_LOG)
        .groupBy("config_id", "batch_id", "poll_time")
        .agg(
            *[F.sum(c).alias(c) for c in COUNTERS],
            F.max_by(F.col("last_offset"), has_offset).alias("last_offset"),
        )
    )


def read_sketches(spark: SparkSession, target: str) -> DataFrame:
    """(batch_id, sketch) of every poll's addresses, one per micro-batch that brought some of it."""
    return _read(spark, f"{target}/sketches", SKETCHES).drop("epoch")


def read_slice(
    spark: SparkSession,
    target: str,
    as_of: datetime,
    *,
    log: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """What a backfill at ``as_of`` still has to read of bronze (see ``incremental_slice``).

    The poll log names the epoch of every poll, so only folders of epochs from the first wanted poll on
    are read, and for stale configs those of dates from the stale limit on. ``log`` replaces the poll
    log (with the columns of ``read_poll_log``).
    """
    log = read_poll_log(spark, target) if log is None else log
    progress = log.groupBy("config_id").agg(
        F.max(F.when(F.col("last_offset").isNotNull(), F.col("poll_time"))).alias("covered"),
        F.max("poll_time").alias("newest"),
    )
    now, limit = utc_seconds(as_of), settings.offset_stale_hours * 3600.0
    stale = F.lit(now) - F.unix_millis("newest") / 1000 > limit
    polls = _read(spark, f"{target}/poll_log", POLL_LOG).select("config_id", "poll_time", "epoch")
    started = F.col("covered").isNotNull()
    fresh = ~started | (~stale & (F.col("poll_time") > F.col("covered")))
    first, any_stale = (
        polls.join(F.broadcast(progress), "config_id")
        .agg(F.min(F.when(fresh, F.col("epoch"))), F.coalesce(F.bool_or(started & stale), F.lit(False)))
        .first()
    )
    wanted = F.lit(False) if first is None else F.col("epoch") >= first
    if any_stale:
        day = F.to_date(F.timestamp_seconds(F.floor(F.lit(now - limit))))
        wanted = wanted | (F.col("event_date") >= day) | F.col("event_date").isNull()
    rows = _read(spark, f"{target}/bronze", BRONZE).where(wanted)
    return incremental_slice(rows.drop("epoch"), log, as_of, settings=settings)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ingest with its known schema, also when no file has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
