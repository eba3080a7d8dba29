"""From the ingest's poll log to stored window records, without reading an event again.

``stream_polls`` follows the poll log, ``stream_windows`` closes windows over it, and ``summarise_stream``
writes the record of every closed window from the signed counts that the event table keeps per poll. Trends read the
stored records: a few rows per window, by date, instead of all events behind them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.times import utc_literal
from wardline.operators.stats import window_counts_from_batches, window_records
from wardline.schemas import POLL_LOG
from wardline.session import configure
from wardline.settings import DEFAULTS, Settings
from wardline.sources.event_table import read_counts


def stream_polls(
    spark: SparkSession, target: str, *, remember: str = "1 day", max_files_per_trigger: int | None = None
) -> DataFrame:
    """The poll log of an ingest as a stream; a poll is counted once per micro-batch that brought it.

    A micro-batch that the ingest runs again replaces its files, which then arrive here a second time.
    They are told by poll and epoch; the state of those is dropped ``remember`` after they arrived, by the
    clock of arrivals, on which no row is ever late.
    """
    reader = spark.readStream.schema(POLL_LOG).option("ignoreMissingFiles", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (
        reader.parquet(f"{target}/poll_log")
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", remember)
        .dropDuplicatesWithinWatermark(["batch_id", "epoch"])
    )


def summarise_stream(
    windows: DataFrame,
    table: str,
    target: str,
    *,
    top_n: int = 10,
    settings: Settings = DEFAULTS,
    available_now: bool = False,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Write the record of every closed window to ``target``/summaries, by closing date.

    ``windows`` comes from ``stream_windows``; ``table`` is an event table with counts (see
    ``merge_events``). The statistics are those of the rows the table holds when the window closes. A
    replayed micro-batch replaces its own records.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = configure(batch.sparkSession)
        # the state store's output is read twice: for the counts and for the records
        closed = batch.persist()
        try:
            counts = window_counts_from_batches(closed, read_counts(spark, table))
            records = window_records(closed, counts, top_n=top_n, settings=settings)
            dated = records.withColumns({"closed_date": F.to_date("closed_at"), "epoch": F.lit(epoch)})
            dated.repartition("closed_date").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("closed_date", "epoch").parquet(f"{target}/summaries")
        finally:
            closed.unpersist()

    writer = windows.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{target}/summaries-checkpoint"
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_summaries(
    spark: SparkSession, target: str, *, since: datetime | None = None
) -> DataFrame | None:
    """The stored records, those of windows that closed from ``since`` on; older dates are not read.

    None before the first window has closed.
    """
    try:
        records = spark.read.parquet(f"{target}/summaries")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    if since is not None:
        edge = utc_literal(since)
        records = records.where((F.col("closed_date") >= F.to_date(edge)) & (F.col("closed_at") >= edge))
    return records.drop("closed_date", "epoch")
