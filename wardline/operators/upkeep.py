"""Keeping the tables: latest-write-wins views, retention, poll state, configuration, users.

Where a mutable row would be updated in place elsewhere, these jobs append to a log and
derive the current state from it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.blocked import next_value
from wardline.functions.times import utc_literal
from wardline.settings import DEFAULTS, RETENTION_SECONDS, Settings


def upsert_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Full-record put by key: the last write in ``order`` wins.

    The rank filter becomes a group limit that runs before the shuffle as well, so a key
    with very many writes sends at most one row per task.
    """
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def upsert_events(arrivals: DataFrame) -> DataFrame:
    """The event table: a re-delivered event keeps its id and moves to the newer batch."""
    return upsert_latest(arrivals, ["id"], ["poll_time", "line_pos"])


def apply_retention(
    df: DataFrame, table: str, as_of: datetime, *, ts: str, date_partition: str | None = None
) -> DataFrame:
    """Rows still inside the table's lifetime at ``as_of``.

    The lifetime counts from the write, so ``ts`` is the time a row was written (``poll_time`` of an
    event, not its own time); a row without one is kept. With ``date_partition``, the date of that
    time, whole partitions are pruned before any file is opened.
    """
    cutoff = utc_literal(as_of) - F.make_dt_interval(
        secs=F.lit(RETENTION_SECONDS[table]).cast("decimal(18,6)")
    )
    kept = df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff))
    if date_partition:
        day = F.col(date_partition)
        kept = kept.filter(day.isNull() | (day >= F.to_date(cutoff)))
    return kept


def poll_state(poll_log: DataFrame) -> DataFrame:
    """State after every poll: batch, size and running total of the UTC day.

    A config polls at most once a second, so a (config, day) group has at most 86,400 rows.
    """
    today = (
        Window.partitionBy("config_id", "poll_date")
        .orderBy("poll_time")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return poll_log.withColumn("poll_date", F.to_date("poll_time")).select(
        "config_id",
        "poll_time",
        F.col("batch_id").alias("last_batch_id"),
        F.col("event_count").alias("events_in_last_batch"),
        F.sum("event_count").over(today).alias("total_events_today"),
        "poll_date",
    )


def poll_health(
    configs: DataFrame, poll_log: DataFrame, cost: DataFrame, as_of: datetime
) -> DataFrame:
    """One row per config: poll status, latest poll and the spend of the day of ``as_of``.

    ``configs`` has ``config_id`` (null or '' = not configured); ``cost`` is the output of
    ``cost_summary``. Only polls up to ``as_of`` count.
    """
    # The total belongs to the day of the last poll; the latest poll is found first, with
    # map-side combine, and its day alone is summed.
    known = poll_log.filter(F.col("poll_time") <= utc_literal(as_of)).withColumn(
        "poll_date", F.to_date("poll_time")
    )
    by_day = known.groupBy("config_id", "poll_date").agg(
        F.sum("event_count").alias("total_events_today"),
        F.max_by(F.struct("poll_time", "event_count"), F.col("poll_time")).alias("last"),
    )
    latest = (
        by_day.groupBy("config_id")
        .agg(F.max_by(F.struct("last", "total_events_today"), F.col("poll_date")).alias("d"))
        .select(
            "config_id",
            F.col("d.last.poll_time").alias("last_poll_time"),
            F.col("d.last.event_count").alias("events_in_last_batch"),
            F.col("d.total_events_today").alias("total_events_today"),
        )
    )
    today = cost.select(
        F.col("date").alias("_date"),
        F.col("estimated_total_usd").alias("today_usd"),
        "budget_remaining_usd",
        "budget_cap_reached",
        F.col("analysis_call_count").alias("analysis_count"),
    )
    status = (
        F.when(F.coalesce(F.col("config_id"), F.lit("")) == "", "unconfigured")
        .when(F.col("last_poll_time").isNotNull(), "active")
        .otherwise("idle")
    )
    return (
        configs.select("config_id")
        .withColumn("_date", F.to_date(utc_literal(as_of)))
        .join(latest, "config_id", "left")
        .join(today, "_date", "left")
        .withColumn("status", status)
        .drop("_date")
    )


def config_current(config_log: DataFrame) -> DataFrame:
    """Value now in force per key. ``config_log``: key, value, change_seq, updated_by, …"""
    return upsert_latest(config_log, ["key"], ["change_seq"])


def config_history(
    config_log: DataFrame, *, ts: str = "updated_at", settings: Settings = DEFAULTS
) -> DataFrame:
    """Every value with the span in which it was in force; ``valid_to`` null = current."""
    block = F.floor(F.col("change_seq") / settings.block_rows)
    return next_value(
        config_log, ["key"], "change_seq", block, ts, "valid_to"
    ).withColumnRenamed(ts, "valid_from")


def with_user(df: DataFrame, users: DataFrame, fk: str, *, prefix: str) -> DataFrame:
    """Resolve a user id. No broadcast hint: the planner broadcasts when the users table is
    within its size threshold."""
    resolved = users.select(
        F.col("id").alias(fk),
        F.col("email").alias(f"{prefix}_email"),
        F.col("name").alias(f"{prefix}_name"),
    )
    return df.join(resolved, fk, "left")


def _text(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def upsert_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Users after a set of logins, matched by email.

    A new email becomes an analyst with the name and provider of its first login. A known
    one keeps role and provider and takes the newest name given and the login time; the
    login that creates a user does not set one. Logins without email are rejected.
    """
    valid = logins.filter(_text(F.col("email")).isNotNull()).withColumn(
        "_at", F.struct("login_at", "login_seq")
    )
    name = _text(F.col("name"))
    named = F.when(name.isNotNull(), F.col("_at"))
    by_email = valid.groupBy("email").agg(
        F.min_by(F.struct("name", "provider", "login_at"), F.col("_at")).alias("first"),
        F.max_by(name, named).alias("new_name"),
        F.max("login_at").alias("last_at"),
        F.count("*").alias("n_logins"),
    )
    known = F.col("id").isNotNull()
    return users.join(by_email, "email", "full").select(
        # an id of its own derivation: the same new email always gets the same id
        F.coalesce(F.col("id"), F.substring(F.sha2("email", 256), 1, 32)).alias("id"),
        "email",
        F.coalesce(F.col("new_name"), F.when(known, F.col("name")).otherwise(F.col("first.name")))
        .alias("name"),
        F.when(known, F.col("provider")).otherwise(F.col("first.provider")).alias("provider"),
        F.when(known, F.col("role")).otherwise("analyst").alias("role"),
        F.when(known, F.coalesce(F.col("last_at"), F.col("last_login_at")))
        .otherwise(F.when(F.col("n_logins") > 1, F.col("last_at")))
        .alias("last_login_at"),
    )
