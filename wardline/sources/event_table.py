"""The event table as files: immutable commits, versions that list them, a pointer written last.

    <path>/data/commit=<c>/event_date=<d>/   files of one commit, sorted by id
    <path>/batches/commit=<c>/               dates of each batch of the commit
    <path>/counts/commit=<c>/                signed counts per batch and value (where they are kept)
    <path>/versions/<n>/                     what version n consists of

A merge adds a delta to the dates of its batch and publishes a version; nothing that a reader may
have open is touched, and a merge that dies leaves the version before it. A date has a base and
deltas; reading takes the last delivery of each id over both. Once the deltas of a date outgrow a budget of
rows they are compacted into a new base, so what a merge writes follows its batch, not the day.

An event's id contains its start time, so all deliveries of it lie in one date. Files are ranges of ids:
one date is written by as many tasks as its rows ask for, and a lookup opens the files whose bounds or
Bloom filters let it. A version lists a few numbers per date and commit; that list is all a driver reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import date, datetime
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.times import utc_seconds
from wardline.operators.stats import counted_columns, value_counts
from wardline.operators.upkeep import apply_retention, upsert_latest
from wardline.schemas import EVENT
from wardline.session import scratch_path
from wardline.settings import RETENTION_SECONDS

SCHEMA = EVENT + ", event_date date"
BATCHES = "batch_id string, event_date date"
COUNTS = "batch_id string, kind string, value string, bot bigint, risk bigint, n bigint, denied bigint"
VERSION = (
    "kind string, event_date date, commit string, rows bigint, untimed bigint, oldest bigint,"
    " newest bigint, writer string, epoch bigint"
)
#: Rows of a file, and of the deltas of a date before they become a base.
FILE_ROWS = 200_000
DELTA_ROWS = 1_000_000
#: Index and count commits that are folded into one.
FOLD = 32
#: Columns that lookups name; ids also have tight bounds, as files are sorted by them.
LOOKUPS = ("id", "client_ip", "batch_id")
ORDER = ["poll_time", "line_pos"]


class Part(NamedTuple):
    """A line of a version: rows of one date and commit, an index, or what a writer has applied.

    ``oldest`` and ``newest`` are poll times in microseconds, over the rows that have one.
    """

    kind: str
    event_date: date | None = None
    commit: str | None = None
    rows: int = 0
    untimed: int = 0
    oldest: int | None = None
    newest: int | None = None
    writer: str | None = None
    epoch: int | None = None


class ConcurrentMerge(RuntimeError):
    """Another writer published a version first; run the merge again."""


# --- versions -----------------------------------------------------------------------


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Names of what matches, by the file system of the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().toString() for f in found or []]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, ascending; one without its success mark was never published."""
    marks = _glob(spark, f"{path}/versions/*/_SUCCESS")
    return sorted(int(m.split("/")[-2]) for m in marks)


def parts(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[Part]]:
    """A version, by default the newest, and its lines; 0 and none before the first merge."""
    known = versions(spark, path)
    version = version if version is not None else (known[-1] if known else 0)
    if not version:
        return 0, []
    rows = spark.read.schema(VERSION).parquet(f"{path}/versions/{version}").collect()
    return version, [Part(*r) for r in rows]


def _publish(spark: SparkSession, path: str, base: int, lines: list[Part]) -> int:
    """Make ``lines`` the version after ``base``; the last step of every change."""
    known = versions(spark, path)
    if (known[-1] if known else 0) != base:
        raise ConcurrentMerge(f"{path}: version {known[-1]} was published after {base}")
    # a dead writer may have left a number without a mark behind
    taken = [int(p.split("/")[-1]) for p in _glob(spark, f"{path}/versions/*")]
    version = max([base, *taken]) + 1
    spark.createDataFrame(lines, VERSION).coalesce(1).write.parquet(f"{path}/versions/{version}")
    return version


# --- reading ------------------------------------------------------------------------


def _folder(path: str, part: Part) -> str:
    name = "__HIVE_DEFAULT_PARTITION__" if part.event_date is None else f"{part.event_date:%Y-%m-%d}"
    return f"{path}/data/commit={part.commit}/event_date={name}"


def _files(spark: SparkSession, path: str, schema: str, found: list[Part]) -> DataFrame:
    if not found:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(f"{schema}, commit string").option("basePath", f"{path}/data")
    return reader.parquet(*(_folder(path, p) for p in found)).drop("commit")


def _live(
    spark: SparkSession, path: str, schema: str, lines: Iterable[Part], matching: Column | None = None
) -> DataFrame:
    """The last delivery of each event in the given dates, of those that match.

    A date of one commit is read as it is; only dates with several are compared by id, and of them
    only events of which some delivery matches.
    """
    by_date: dict[date | None, list[Part]] = {}
    for p in lines:
        if p.kind in ("base", "delta"):
            by_date.setdefault(p.event_date, []).append(p)
    single = [ps[0] for ps in by_date.values() if len(ps) == 1]
    several = [p for ps in by_date.values() if len(ps) > 1 for p in ps]
    wanted = F.lit(True) if matching is None else matching
    settled = _files(spark, path, schema, single).where(wanted)
    if not several:
        return settled
    deliveries = _files(spark, path, schema, several)
    if matching is not None:
        hits = deliveries.where(matching).select(F.col("event_date").alias("_date"), F.col("id").alias("_id"))
        same = (F.col("id") == F.col("_id")) & F.col("event_date").eqNullSafe(F.col("_date"))
        deliveries = deliveries.join(hits.distinct(), same, "left_semi")
    compared = upsert_latest(deliveries, ["event_date", "id"], ORDER).where(wanted)
    return settled.unionByName(compared) if single else compared


def read_events(
    spark: SparkSession,
    path: str,
    schema: str = SCHEMA,
    *,
    version: int | None = None,
    matching: Column | None = None,
) -> DataFrame:
    """The event table, or an older version of it; empty before the first merge.

    ``event_date`` is a partition column: what filters it reads no other date's files. ``matching`` gives
    the rows that a filter after it would, but reaches the files of dates with open deltas too, whose
    other events are then neither shuffled nor compared.
    """
    return _live(spark, path, schema, parts(spark, path, version)[1], matching)


def batch_dates(spark: SparkSession, path: str, batch_id: str) -> list[date | None]:
    """The dates that a batch has rows in, by the index of the merges; a batch has few."""
    commits = [p.commit for p in parts(spark, path)[1] if p.kind == "batches"]
    if not commits:
        return []
    index = spark.read.schema(BATCHES).parquet(*(f"{path}/batches/commit={c}" for c in commits))
    found = index.where(F.col("batch_id") == batch_id).select("event_date").distinct()
    return [r.event_date for r in found.collect()]


def read_batch(spark: SparkSession, path: str, batch_id: str, schema: str = SCHEMA) -> DataFrame:
    """The rows of one batch; only files of its dates are listed and read."""
    dates = set(batch_dates(spark, path, batch_id))
    lines = [p for p in parts(spark, path)[1] if p.event_date in dates]
    return _live(spark, path, schema, lines, F.col("batch_id") == batch_id)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the table's rows per batch and value: the sum of what all merges added and took back."""
    commits = [p.commit for p in parts(spark, path)[1] if p.kind == "counts"]
    if not commits:
        return spark.createDataFrame([], COUNTS)
    return _summed(spark.read.schema(COUNTS).parquet(*(f"{path}/counts/commit={c}" for c in commits)))


def _summed(counts: DataFrame) -> DataFrame:
    keys = [c for c in counts.columns if c not in ("n", "denied")]
    total = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("denied").alias("denied"))
    return total.where((F.col("n") != 0) | (F.col("denied") != 0))


# --- writing ------------------------------------------------------------------------


def _ranged(rows: DataFrame, n: int, file_rows: int) -> DataFrame:
    return rows.repartitionByRange(max(1, ceil(n / file_rows)), "event_date", "id")


def clustered(rows: DataFrame, n: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``n`` rows as ranges of (event_date, id), sorted: a day of many rows is many tasks."""
    return _ranged(rows, n, file_rows).sortWithinPartitions("event_date", "id")


def _write(rows: DataFrame, n: int, folder: str, file_rows: int) -> None:
    """Write ``n`` rows, or some fewer, that are clustered."""
    writer = rows.write
    for column in LOOKUPS:
        if column in rows.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(max(1, min(n, file_rows))))
    writer.partitionBy("event_date").parquet(folder)


def _staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _dated(rows: DataFrame, kind: str, commit: str) -> list[Part]:
    """A line per date of ``rows``."""
    at = F.unix_micros("poll_time")
    found = rows.groupBy("event_date").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("poll_time").isNull()).alias("untimed"),
        F.min(at).alias("oldest"),
        F.max(at).alias("newest"),
    )
    return [Part(kind, r.event_date, commit, r.rows, r.untimed, r.oldest, r.newest) for r in found.collect()]


def merge_events(
    spark: SparkSession,
    path: str,
    arrivals: DataFrame,
    *,
    writer: str | None = None,
    epoch: int | None = None,
    counts: bool = False,
    file_rows: int = FILE_ROWS,
    delta_rows: int = DELTA_ROWS,
) -> bool:
    """Put a batch of deliveries: the last one of each event stays, by poll and line.

    With ``writer`` and ``epoch`` a batch that the writer has already put is left out (the result is
    False), so a replayed micro-batch changes nothing. ``counts`` keeps the table of signed counts: what
    the new rows add to their batches, and what rows they replace take from theirs; a table
    either has it from its first merge on or never. Writes as many rows as the batch holds; a date
    whose deltas reach ``delta_rows``, or half of its base if that is more, is compacted afterwards.
    """
    version, lines = parts(spark, path)
    applied = {p.writer: p.epoch for p in lines if p.kind == "applied"}
    if writer is not None and epoch <= applied.get(writer, -1):
        return False
    fields = [f for f in arrivals.columns if f != "event_date"]
    new = arrivals.select(*fields, F.to_date("event_time").alias("event_date"))
    new = _staged(upsert_latest(new, ["event_date", "id"], ORDER), "arrivals")
    schema, commit = _ddl(new), uuid.uuid4().hex
    added = _dated(new, "delta", commit)
    if added:
        n = sum(p.rows for p in added)
        _write(clustered(new, n, file_rows), n, f"{path}/data/commit={commit}", file_rows)
        if "batch_id" in new.columns:
            new.select("batch_id", "event_date").distinct().write.parquet(f"{path}/batches/commit={commit}")
            added.append(Part("batches", commit=commit))
        if counts:
            dates = {p.event_date for p in added}
            known = _live(spark, path, schema, [p for p in lines if p.event_date in dates])
            # by the tasks of its shuffle: a few files of a large batch, one of a small one
            _changes(new, known).write.parquet(f"{path}/counts/commit={commit}")
            added.append(Part("counts", commit=commit))
    if writer is not None:
        lines = [p for p in lines if p.kind != "applied" or p.writer != writer]
        added.append(Part("applied", writer=writer, epoch=epoch))
    if added:
        _publish(spark, path, version, lines + added)
        due = _due(lines + added, delta_rows)
        if due or sum(p.kind == "batches" for p in lines + added) > FOLD:
            compact_events(spark, path, due, schema, file_rows=file_rows)
    return True


def _changes(new: DataFrame, known: DataFrame) -> DataFrame:
    """What a batch changes in the counts: its winning rows count, the rows they replace no longer do."""
    own = F.struct(*(F.col(f"n.{c}") for c in ORDER))
    other = F.struct(*(F.col(f"k.{c}") for c in ORDER))
    same = (F.col("n.id") == F.col("k.id")) & F.col("n.event_date").eqNullSafe(F.col("k.event_date"))
    # of the rest of an event nothing is read and moved; it would not be pruned below the structs
    keys = ["id", "event_date", "batch_id", *ORDER]
    new, known = (rows.select(*keys, *counted_columns()) for rows in (new, known))
    # events are shuffled, never sent through the driver to every task; once, for both kinds of change
    met = new.alias("n").join(known.hint("merge").alias("k"), same, "left")
    counted = [c for c in new.columns if c not in keys]

    def change(side: str, sign: int) -> Column:
        batch = F.struct(F.col(f"{side}.batch_id").alias("batch_id"), F.lit(sign).alias("sign"))
        return F.struct(batch.alias("change"), *(F.col(f"{side}.{c}").alias(c) for c in counted))

    replaced = F.when(F.col("k.id").isNotNull(), change("k", -1))
    changes = met.where(F.col("k.id").isNull() | (own > other)).select(
        F.inline(F.array_compact(F.array(change("n", 1), replaced)))
    )
    signed = [(F.col("change.sign") * F.col(c)).alias(c) for c in ("n", "denied")]
    found = value_counts(changes, key="change")
    return _summed(found.select("change.batch_id", "kind", "value", "bot", "risk", *signed))


def _due(lines: list[Part], delta_rows: int) -> list[date | None]:
    """Dates whose deltas have outgrown their budget."""
    base, deltas, many = {}, {}, {}
    for p in lines:
        if p.kind == "base":
            base[p.event_date] = p.rows
        elif p.kind == "delta":
            deltas[p.event_date] = deltas.get(p.event_date, 0) + p.rows
            many[p.event_date] = many.get(p.event_date, 0) + 1
    return [
        d for d, n in deltas.items() if (many[d] > 1 or d in base) and n >= max(delta_rows, base.get(d, 0) / 2)
    ]


def compact_events(
    spark: SparkSession,
    path: str,
    dates: Iterable[date | None] | None = None,
    schema: str = SCHEMA,
    *,
    file_rows: int = FILE_ROWS,
    kept: DataFrame | None = None,
) -> None:
    """One base for each of ``dates`` (by default all that have deltas); many index commits become one.

    ``kept`` takes the place of the rows of those dates where some of them are to go.
    """
    version, lines = parts(spark, path)
    wanted = {p.event_date for p in lines if p.kind == "delta"} if dates is None else set(dates)
    touched = [p for p in lines if p.kind in ("base", "delta") and p.event_date in wanted]
    rest = [p for p in lines if p not in touched]
    commit = uuid.uuid4().hex
    folder = f"{path}/data/commit={commit}"
    if touched and kept is None:
        # a commit holds an id once, so ids have few rows: one shuffle serves the comparison and the files
        n = sum(p.rows for p in touched)
        deliveries = _ranged(_files(spark, path, schema, touched), n, file_rows)
        _write(upsert_latest(deliveries, ["event_date", "id"], ORDER), n, folder, file_rows)
        rest += _dated(spark.read.schema(schema).parquet(folder), "base", commit)
    elif touched:
        rows = _staged(kept, "compacted")
        bases = _dated(rows, "base", commit)
        if bases:
            n = sum(p.rows for p in bases)
            _write(clustered(rows, n, file_rows), n, folder, file_rows)
        rest += bases
    for kind, kinds in (("batches", BATCHES), ("counts", COUNTS)):
        found = [p for p in rest if p.kind == kind]
        if len(found) > FOLD:
            table = spark.read.schema(kinds).parquet(*(f"{path}/{kind}/commit={p.commit}" for p in found))
            table = table.distinct() if kind == "batches" else _summed(table)
            table.write.parquet(f"{path}/{kind}/commit={commit}")
            rest = [p for p in rest if p not in found] + [Part(kind, commit=commit)]
    if rest != lines:
        _publish(spark, path, version, rest)


def purge_events(
    spark: SparkSession, path: str, as_of: datetime, schema: str = SCHEMA, *, file_rows: int = FILE_ROWS
) -> None:
    """Remove what has outlived the table's lifetime, counted from the poll that wrote it.

    The version knows the oldest and newest poll of every date: a date whose newest has expired
    leaves the version unread, one that holds both is rewritten, others are not touched. Rows without a
    poll time stay. The signed counts describe what was merged; a purge does not change them.
    """
    version, lines = parts(spark, path)
    cutoff = round((utc_seconds(as_of) - RETENTION_SECONDS["events"]) * 1_000_000)
    by_date: dict[date | None, list[Part]] = {}
    for p in lines:
        if p.kind in ("base", "delta"):
            by_date.setdefault(p.event_date, []).append(p)
    timed = {d: [p for p in ps if p.newest is not None] for d, ps in by_date.items()}
    expired = {
        d
        for d, ps in by_date.items()
        if timed[d] and not any(p.untimed for p in ps) and max(p.newest for p in timed[d]) < cutoff
    }
    mixed = {d for d in by_date if d not in expired and timed[d] and min(p.oldest for p in timed[d]) < cutoff}
    if expired:
        rest = [p for p in lines if p.kind not in ("base", "delta") or p.event_date not in expired]
        _publish(spark, path, version, rest)
    if mixed:
        table = _live(spark, path, schema, [p for d in mixed for p in by_date[d]])
        kept = apply_retention(table, "events", as_of, ts="poll_time")
        compact_events(spark, path, mixed, schema, file_rows=file_rows, kept=kept)


def vacuum_events(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the files that none of the newest ``keep`` versions consists of.

    Readers of older versions lose them, and so does a merge that runs meanwhile: its files are in
    no version yet. Call it from the writer, between merges.
    """
    known = versions(spark, path)
    used = {p.commit for v in known[-keep:] for p in parts(spark, path, v)[1]}
    for kind in ("data", "batches", "counts"):
        for folder in _glob(spark, f"{path}/{kind}/commit=*"):
            if folder.rsplit("=", 1)[1] not in used:
                _remove(spark, folder)
    for folder in _glob(spark, f"{path}/versions/*"):
        if int(folder.rsplit("/", 1)[1]) not in known[-keep:]:
            _remove(spark, folder)
