"""Every registered query: an operator applied to inputs derived from the given tables.

Results are flat: arrays come out as one row per element, timestamps as epoch numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import lenient_float, preview, score_band
from wardline.functions.coerce import epoch_timestamp
from wardline.operators import normalize, serving, spend, stats, trends, upkeep
from wardline.operators import windows as win
from wardline.plans import inputs as src
from wardline.plans.inputs import FIXTURE
from wardline import streaming
from wardline.session import configure, scratch_path
from wardline.sources import event_table, exports, ndjson
from wardline.settings import Settings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def _s(ts: str):
    """A timestamp column as epoch seconds."""
    return F.unix_seconds(ts).alias(f"{ts}_s")


# --- sources ------------------------------------------------------------------------


def _parsed(spark, sf):
    return ndjson.parse_lines(src.raw_lines(spark, sf))


def _tagged(spark, sf):
    return ndjson.tag_batch(ndjson.event_docs(_parsed(spark, sf)))


def _normalized(spark, sf):
    return normalize.normalize_events(_tagged(spark, sf))


@query
def read_raw_ndjson(spark, sf):
    return normalize.bind_texts(_parsed(spark, sf)).select(
        "config_id",
        "poll_epoch",
        normalize.numeric_text_field("request_id").alias("request_id"),
        F.try_variant_get("doc", "$.total", "bigint").alias("total"),
    )


_LANDED: dict[tuple[str, str], str] = {}
# a compressed file is read by one task: a large poll has several
LANDING = {"compression": "gzip", "maxRecordsPerFile": "200000"}


def _landed(spark, sf) -> str:
    """The raw lines as compressed files, a folder for each config and poll; written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LANDED:
        path = scratch_path(spark, "landed")
        lines = src.raw_lines(spark, sf).repartition("config_id", "poll_epoch")
        lines.sortWithinPartitions("config_id", "poll_epoch", "line_pos").select(
            "value", "config_id", "poll_epoch"
        ).write.partitionBy("config_id", "poll_epoch").options(**LANDING).text(path)
        _LANDED[key] = path
    return _LANDED[key]


@query
def read_raw_files(spark, sf):
    """The same lines read from files, counted by poll and kind."""
    return ndjson.line_quality(ndjson.read_raw_ndjson(spark, _landed(spark, sf)))


@query
def line_quality(spark, sf):
    return ndjson.line_quality(src.raw_lines(spark, sf))


@query
def split_batch_metadata(spark, sf):
    return ndjson.split_batch_metadata(_parsed(spark, sf))[1]


@query
def tag_batch(spark, sf):
    return (
        _tagged(spark, sf)
        .groupBy("batch_id", "config_id", "poll_epoch")
        .agg(F.count("*").alias("n"), F.min(F.unix_seconds("poll_time")).alias("poll_time_s"))
    )


def _offset_poll_log(spark, sf):
    """Opaque offsets: cfg-0 was polled until shortly before the end, its last polls without an
    offset; cfg-1 stopped half-way."""
    no = F.floor((F.unix_seconds("poll_time") - src.EPOCH_0) / src.POLL_EVERY_SECONDS)
    busy = F.col("config_id") == "cfg-0"
    polled = src.polls(spark, sf).withColumn("no", no)
    return polled.filter(F.col("no") < F.when(busy, 1430).otherwise(700)).select(
        "config_id",
        "poll_time",
        F.when(~busy | (F.col("no") < 1400), F.concat(F.lit("o"), F.col("no"))).alias("last_offset"),
    )


@query
def incremental_slice(spark, sf):
    """Six hours after the first poll's day began; a config is stale after three here."""
    as_of = datetime.fromtimestamp(src.EPOCH_0 + 12 * 3600, timezone.utc).replace(tzinfo=None)
    return ndjson.incremental_slice(
        src.arrivals(spark, sf),
        _offset_poll_log(spark, sf),
        as_of,
        settings=Settings(offset_stale_hours=3),
    ).select("config_id", "request_id", "poll_no")


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _stored(spark, df, name):
    """Write ``df`` as files of the shared folder, for a stream to read."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


_INGESTED: dict[tuple[str, str], str] = {}


def _ingested(spark, sf) -> str:
    """The tables that the streaming ingest makes of the landed files in three micro-batches or more; made once
    per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INGESTED:
        target = scratch_path(spark, "ingest")
        lines = streaming.stream_raw_ndjson(spark, _landed(spark, sf), max_files_per_trigger=1000)
        _finish(
            streaming.ingest_stream(lines, target, available_now=True, table=f"{target}/events", counts=True)
        )
        _INGESTED[key] = target
    return _INGESTED[key]


@query
def ingest_stream(spark, sf):
    """All raw files through the streaming ingest; the event table over its bronze files."""
    bronze = streaming.read_bronze(spark, _ingested(spark, sf))
    return upkeep.upsert_events(bronze).select("id", "batch_id", "client_ip")


@query
def ingest_event_table(spark, sf):
    """The event table that the micro-batches of the ingest merged into."""
    table = event_table.read_events(spark, f"{_ingested(spark, sf)}/events")
    return table.select("id", "batch_id", "client_ip")


@query
def ingest_poll_log(spark, sf):
    """The poll log the streaming ingest leaves behind."""
    return streaming.read_poll_log(spark, _ingested(spark, sf)).select(
        "batch_id", "event_count", "deny_count", "alert_count", "monitor_count", "last_offset"
    )


@query
def ingest_slice(spark, sf):
    """What a backfill still has to read of the ingest's own tables, its last polls without offset."""
    target = _ingested(spark, sf)
    no = F.floor((F.unix_seconds("poll_time") - src.EPOCH_0) / src.POLL_EVERY_SECONDS)
    log = streaming.read_poll_log(spark, target).withColumn(
        "last_offset", F.when(no < 1400, F.col("last_offset"))
    )
    as_of = datetime.fromtimestamp(src.EPOCH_0 + 12 * 3600, timezone.utc).replace(tzinfo=None)
    return streaming.read_slice(spark, target, as_of, log=log).select("config_id", "batch_id", "request_id")


# --- decode and normalise -----------------------------------------------------------


@query
def decode_fields(spark, sf):
    return normalize.bind_texts(_tagged(spark, sf)).select(
        normalize.numeric_text_field("request_id").alias("request_id"),
        "batch_id",
        F.array_join(normalize.rule_list("rule_tag"), "|").alias("tags"),
        F.array_join(normalize.rule_list("rule_action"), "|").alias("actions"),
    )


@query
def assemble_rules(spark, sf):
    return normalize.rules_long(
        _normalized(spark, sf).select("id", "batch_id", "decoded_rules")
    ).filter(F.col("rule_pos").isNotNull())


@query
def action_summary(spark, sf):
    return (
        _normalized(spark, sf)
        .groupBy("config_id", "rule_action_summary")
        .agg(F.count("*").alias("n"))
    )


@query
def severity_indicators(spark, sf):
    return _normalized(spark, sf).select(
        "id",
        "batch_id",
        "has_deny",
        "has_tarpit",
        F.col("rule_count").cast("bigint").alias("rule_count"),
        F.array_join("actions", "|").alias("actions"),
    )


@query
def map_fields(spark, sf):
    return _normalized(spark, sf).select(
        "config_id",
        "policy_id",
        "batch_id",
        "client_ip",
        "request_id",
        "protocol",
        "method",
        "host",
        "port",
        "path",
        "query",
        "response_status",
        "response_bytes",
        "geo_country",
        "geo_city",
        "user_risk_uuid",
    )


@query
def event_id(spark, sf):
    return _normalized(spark, sf).select("id").distinct()


@query
def event_time(spark, sf):
    started = normalize.bind_texts(_tagged(spark, sf)).select(
        normalize.numeric_text_field("start").alias("start")
    )
    timed = started.withColumn("event_time_epoch", lenient_float(F.col("start")))
    return timed.withColumn(
        "event_time_ms", F.unix_millis(epoch_timestamp(F.col("event_time_epoch")))
    )


@query
def lenient_ints(spark, sf):
    return (
        normalize.bind_texts(_tagged(spark, sf))
        .select(
            "config_id",
            normalize.int_field("bot_score").alias("bot_score"),
            normalize.int_field("user_risk_score").alias("user_risk_score"),
        )
        .groupBy("config_id", "bot_score", "user_risk_score")
        .agg(F.count("*").alias("n"))
    )


@query
def rules_long(spark, sf):
    return (
        normalize.rules_long(_normalized(spark, sf))
        .groupBy("config_id", "rule", "rule_tag", "rule_action")
        .agg(F.count("*").alias("n"))
    )


# --- table upkeep -------------------------------------------------------------------


@query
def upsert_latest(spark, sf):
    """From raw lines through parsing to the last delivery of each event."""
    return upkeep.upsert_events(_normalized(spark, sf)).select("id", "batch_id", "client_ip")


@query
def apply_retention(spark, sf):
    """A week after the middle of the polls: what was polled before it has expired."""
    as_of = datetime.fromtimestamp(src.EPOCH_0 + 7 * 86_400 + 6 * 3600, timezone.utc)
    return upkeep.apply_retention(
        src.events(spark, sf), "events", as_of.replace(tzinfo=None), ts="poll_time"
    ).select("id", "event_time_epoch")


@query
def poll_state(spark, sf):
    return upkeep.poll_state(src.polls(spark, sf)).select(
        "config_id",
        _s("poll_time"),
        "last_batch_id",
        "events_in_last_batch",
        "total_events_today",
    )


def _configs(spark, sf):
    """Each nation is a config; the first two are those that poll, one has no id."""
    return src.table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") == 24, "")
        .otherwise(F.concat(F.lit("cfg-"), F.col("n_nationkey")))
        .alias("config_id")
    )


@query
def poll_health(spark, sf):
    as_of = datetime(2024, 1, 1, 23, 0)
    day = spark.range(1).select(F.lit(as_of.date()).alias("date"))
    calls = src.window_calls(src.windows(spark, sf))
    cost = spend.cost_summary(day, calls)
    return upkeep.poll_health(_configs(spark, sf), src.polls(spark, sf), cost, as_of).select(
        "config_id",
        "status",
        _s("last_poll_time"),
        "events_in_last_batch",
        "total_events_today",
        "today_usd",
        "budget_remaining_usd",
        "budget_cap_reached",
        "analysis_count",
    )


@query
def config_current(spark, sf):
    return upkeep.config_current(src.config_log(spark, sf)).select("key", "value", _s("updated_at"))


@query
def config_history(spark, sf):
    history = upkeep.config_history(src.config_log(spark, sf), settings=Settings(block_rows=512))
    return history.select("key", "value", "change_seq", _s("valid_from"), _s("valid_to"))


@query
def with_user(spark, sf):
    return upkeep.with_user(
        src.config_log(spark, sf), src.users(spark, sf), "updated_by_user_id", prefix="updated_by"
    ).select("key", "change_seq", "updated_by_user_id", "updated_by_email", "updated_by_name")


@query
def upsert_users(spark, sf):
    return upkeep.upsert_users(src.users(spark, sf), src.logins(spark, sf)).select(
        "id", "email", "name", "provider", "role", _s("last_login_at")
    )


# --- windows and triggers -----------------------------------------------------------


@query
def poll_aggregate(spark, sf):
    """From raw lines: parse, decode, normalise, count per poll."""
    return win.poll_aggregate(_normalized(spark, sf)).select(
        "config_id",
        "batch_id",
        _s("poll_time"),
        "event_count",
        "deny_count",
        "alert_count",
        "monitor_count",
    )


@query
def baseline_rate(spark, sf):
    return win.baseline_rate(src.polls(spark, sf)).select("batch_id", "baseline_rate")


def _flat_windows(windows):
    return windows.select(
        "window_id",
        "config_id",
        "trigger_reason",
        *win.COUNTERS,
        F.size("poll_batch_ids").cast("bigint").alias("polls"),
        _s("window_start"),
        _s("window_end"),
        "window_duration_seconds",
        "deny_ratio",
        "was_escalated",
        _s("closed_at"),
    )


@query
def analysis_windows(spark, sf):
    return _flat_windows(src.windows(spark, sf))


@query
def trigger_event_count(spark, sf):
    return _flat_windows(src.windows(spark, sf).filter("trigger_reason = 'event_count'"))


@query
def trigger_severity_escalation(spark, sf):
    return _flat_windows(
        src.windows(spark, sf).filter(
            (F.col("trigger_reason") == "severity_escalation")
            & (F.col("deny_ratio") >= FIXTURE.deny_ratio_threshold)
        )
    )


@query
def trigger_rate_spike(spark, sf):
    """Only the spike rule can close these windows: the other thresholds are out of reach."""
    spiky = Settings(
        event_count_threshold=10**9, deny_ratio_threshold=2.0, spike_multiplier=1.2
    )
    closed = win.analysis_windows(src.polls(spark, sf), settings=spiky)
    return _flat_windows(closed)


@query
def trigger_time_ceiling(spark, sf):
    return _flat_windows(src.windows(spark, sf).filter("trigger_reason = 'time_ceiling'"))


@contextmanager
def _state_store(spark):
    """The session with the state store that the windows need."""
    before = {key: spark.conf.get(key, None) for key in streaming.STATE_STORE}
    for key, value in streaming.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@query
def stream_windows(spark, sf):
    """The windows of a stream of polls, with state per config."""
    polls = _stored(spark, src.polls(spark, sf), "polls")
    target = scratch_path(spark, "windows")
    sink = (
        streaming.stream_windows(polls, settings=FIXTURE)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
    )
    with _state_store(spark):
        _finish(sink.start())
    return _flat_windows(spark.read.parquet(f"{target}/data"))


# A cap that is reached within the day, by a window that closes together with others.
CAPPED = Settings(cap_nano_usd=1_500_000_000)


def _window_crossings(closed):
    minute = F.floor(F.unix_seconds("call_ts") / 60)
    return spend.budget_flags(
        src.window_calls(closed), order=["call_ts", "call_seq"], block=minute, settings=CAPPED
    )


@query
def route_tier(spark, sf):
    closed = src.windows(spark, sf)
    return win.route_tier(closed, _window_crossings(closed)).select(
        "window_id", "tier", _s("closed_at")
    )


# --- per-window statistics ----------------------------------------------------------


def _joined(spark, sf):
    return stats.window_events(src.windows(spark, sf), src.events(spark, sf))


@query
def window_events(spark, sf):
    return _joined(spark, sf).select("window_id", "id", "batch_id")


def _top(rows):
    return rows.select("window_id", "value", "n", F.col("rank").cast("bigint").alias("rank"))


@query
def top_ips(spark, sf):
    return _top(stats.top_ips(_joined(spark, sf)))


@query
def top_paths(spark, sf):
    return _top(stats.top_paths(_joined(spark, sf)))


@query
def top_countries(spark, sf):
    return _top(stats.top_countries(_joined(spark, sf)))


@query
def top_rule_tags(spark, sf):
    return _top(stats.top_rule_tags(_joined(spark, sf)))


@query
def unique_ips(spark, sf):
    return stats.unique_ips(_joined(spark, sf))


@query
def unique_ips_sketched(spark, sf):
    """Distinct addresses delivered in every window, from the sketches that the ingest keeps per poll."""
    sketches = streaming.read_sketches(spark, _ingested(spark, sf))
    return stats.unique_ips_from_sketches(src.windows(spark, sf), sketches)


@query
def avg_scores(spark, sf):
    return stats.avg_scores(_joined(spark, sf))


@query
def score_distribution(spark, sf):
    return stats.score_distribution(_joined(spark, sf))


SAMPLING = Settings(event_count_threshold=30, sample_size=12, sample_score_threshold=20)


@query
def priority_sample(spark, sf):
    """A dozen events of each window: small windows here are larger than that."""
    return stats.priority_sample(_joined(spark, sf), settings=SAMPLING).select(
        "window_id", "id", "tier", F.col("sample_pos").cast("bigint").alias("sample_pos")
    )


@query
def classify_severity(spark, sf):
    return stats.classify_severity(src.windows(spark, sf), _joined(spark, sf)).select(
        "window_id", "deny_ratio", "coordinated", "severity"
    )


def _listed(name: str):
    """A top list in order, as ``key:count`` joined by ``|``."""
    entry = lambda e: F.concat_ws(":", e["key"], e["count"].cast("string"))
    return F.array_join(F.transform(name, entry), "|").alias(name)


def _buckets(name: str):
    counts = F.transform(name, lambda b: b["n"].cast("string"))
    return F.array_join(counts, "|").alias(name)


def _recorded(records):
    return records.select(
        "window_id",
        "config_id",
        "batch_id",
        "trigger_reason",
        "model_used",
        "severity",
        "event_count",
        "stored_events",
        "deny_count",
        "unique_ips",
        "avg_bot_score",
        "avg_user_risk_score",
        F.get(F.col("top_ips"), F.lit(0))["key"].alias("top_ip"),
        F.get(F.col("top_ips"), F.lit(0))["count"].alias("top_ip_count"),
        F.get(F.col("top_rule_tags"), F.lit(0))["key"].alias("top_rule_tag"),
        F.coalesce(F.size("top_paths"), F.lit(0)).cast("bigint").alias("paths_listed"),
        F.coalesce(F.col("bot_score_distribution")[4]["n"], F.lit(0)).alias("bot_80_100"),
        *[_listed(name) for name in stats.TOP_KINDS.values()],
        *[_buckets(f"{score}_distribution") for score in stats.SCORES],
    )


@query
def window_summary(spark, sf):
    return _recorded(
        stats.window_summary(src.windows(spark, sf), src.events(spark, sf), settings=FIXTURE)
    )


@query
def window_summary_from_counts(spark, sf):
    """The same records from the signed counts that the ingest keeps per poll; no event is read."""
    windows = src.windows(spark, sf)
    counts = event_table.read_counts(spark, f"{_ingested(spark, sf)}/events")
    totals = stats.window_counts_from_batches(windows, counts)
    return _recorded(stats.window_records(windows, totals, settings=FIXTURE))


_SUMMARISED: dict[tuple[str, str], str] = {}


def _summarised(spark, sf):
    """The records that the streams leave behind: polls of the ingest, windows, records; made once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SUMMARISED:
        target, ingested = scratch_path(spark, "summarised"), _ingested(spark, sf)
        with _state_store(spark):
            closed = streaming.stream_windows(streaming.stream_polls(spark, ingested), settings=FIXTURE)
            _finish(
                streaming.summarise_stream(
                    closed, f"{ingested}/events", target, settings=FIXTURE, available_now=True
                )
            )
        _SUMMARISED[key] = target
    return streaming.read_summaries(spark, _SUMMARISED[key])


@query
def stored_summaries(spark, sf):
    """Window records written by the streams, from the ingest's tables alone."""
    return _recorded(_summarised(spark, sf))


@query
def stored_rule_tag_trend(spark, sf):
    """The trend over stored records; neither windows nor events are computed again."""
    return trends.rule_tag_trend(_summarised(spark, sf), by=["config_id"])


@query
def batch_request(spark, sf):
    """The requests, with some members read back out of their JSON."""
    closed, joined = src.windows(spark, sf), _joined(spark, sf)
    summary = stats.window_summary(closed, src.events(spark, sf), settings=FIXTURE)
    requests = stats.batch_request(summary, joined, settings=SAMPLING).withColumn(
        "doc", F.parse_json("request")
    )
    return requests.select(
        "window_id",
        "config_id",
        "tier",
        F.col("sampled").cast("bigint").alias("sampled"),
        F.variant_get("doc", "$.metadata.denyRatio", "string").alias("deny_ratio"),
        F.variant_get("doc", "$.metadata.windowStart", "string").alias("window_start"),
        F.variant_get("doc", "$.statistics.uniqueIPs", "bigint").alias("unique_ips"),
        F.variant_get("doc", "$.statistics.topIPs[0].key", "string").alias("top_ip"),
        F.variant_get("doc", "$.sampledEvents[0].id", "string").alias("first_event"),
        F.variant_get("doc", "$.sampledEvents[0].rules[0]", "string").alias("first_rule"),
    )


@query
def parse_response(spark, sf):
    return stats.parse_response(src.responses(spark, sf)).select(
        "response_id",
        "is_json",
        "analysis",
        "severity",
        F.array_join("flags", "|").alias("flags"),
        F.array_join("notable_ips", "|").alias("notable_ips"),
        "total_events",
    )


@query
def complete_windows(spark, sf):
    closed = src.windows(spark, sf)
    record = stats.window_summary(closed, src.events(spark, sf), settings=FIXTURE)
    answers = stats.parse_response(src.window_responses(closed))
    return stats.complete_windows(record, answers).select(
        "window_id",
        "answered",
        "analysis",
        "severity",
        F.array_join("flags", "|").alias("flags"),
        F.array_join("notable_ips", "|").alias("notable_ips"),
        F.size("notable_patterns").cast("bigint").alias("n_patterns"),
        "model_used",
        "input_tokens",
        "output_tokens",
        "estimated_cost_usd",
        "unique_ips",
    )


# --- trends -------------------------------------------------------------------------


@query
def latest_windows(spark, sf):
    """The newest twenty of every config."""
    return trends.latest_windows(src.summaries(spark, sf), by=["config_id"]).select(
        "window_id", "config_id", "severity", _s("created_at")
    )


@query
def severity_counts(spark, sf):
    return trends.severity_counts(src.summaries(spark, sf), by=["config_id"])


@query
def deny_ratio_trend(spark, sf):
    return trends.deny_ratio_trend(src.dated_windows(spark, sf)).select(
        "config_id", _s("time"), "deny_ratio", "event_count"
    )


@query
def persistent_ips(spark, sf):
    return trends.persistent_ips(src.summaries(spark, sf), by=["config_id"])


@query
def rule_tag_trend(spark, sf):
    return trends.rule_tag_trend(src.summaries(spark, sf), by=["config_id"])


@query
def country_trend(spark, sf):
    return trends.country_trend(src.summaries(spark, sf), by=["config_id"])


@query
def window_table(spark, sf):
    return trends.window_table(src.summaries(spark, sf), by=["config_id"]).select(
        "config_id",
        F.col("batch").cast("bigint").alias("batch"),
        _s("time"),
        "severity",
        "event_count",
        "deny_count",
        "deny_ratio",
        "unique_ips",
        "avg_bot_score",
        "avg_user_risk_score",
        F.array_join("flags", "|").alias("flags"),
    )


@query
def notable_windows(spark, sf):
    return trends.notable_windows(src.summaries(spark, sf)).select(
        "window_id",
        "severity",
        _s("time"),
        "analysis",
        F.array_join("notable_ips", "|").alias("notable_ips"),
        F.array_join("notable_patterns", "|").alias("notable_patterns"),
    )


@query
def latest_prior(spark, sf):
    return trends.latest_prior(src.strategic_records(spark, sf)).select(
        "id", "analysis", "severity", _s("created_at")
    )


@query
def strategic_request(spark, sf):
    """The request, with some of its sections cut out again."""

    def section(title):
        return F.regexp_extract("request", rf"## {title}\n(.*?)(?:\n|$)", 1)

    return trends.strategic_request(
        src.summaries(spark, sf), src.strategic_records(spark, sf)
    ).select(
        "batch_count",
        "tier",
        section("Windows By Severity").alias("severities"),
        section("Recurring Addresses").alias("persistent_ips"),
        section("Countries").alias("countries"),
        section("Previous Assessment").alias("prior_analysis"),
    )


@query
def hourly_request(spark, sf):
    requests = trends.hourly_request(src.summaries(spark, sf)).withColumn(
        "doc", F.parse_json("request")
    )
    return requests.select(
        "config_id",
        _s("interval_start"),
        "batch_count",
        "listed_count",
        "tier",
        F.variant_get("doc", "$[0].id", "string").alias("newest_window"),
        F.variant_get("doc", "$[0].analysis", "string").alias("newest_analysis"),
    )


def _strategic_answer(spark):
    text = (
        '{"analysis":"calm","severity":"low","flags":["f"],"recommendations":["r","s"],'
        '"policyEffectivenessNotes":"good","campaignsDetected":[{"name":"c1","events":3}]}'
    )
    row = spark.range(1).select(
        F.lit(text).alias("response"),
        F.lit(4000).cast("bigint").alias("input_tokens"),
        F.lit(500).cast("bigint").alias("output_tokens"),
    )
    return stats.parse_response(row)


@query
def strategic_summary(spark, sf):
    """Three runs over the same windows: still running, answered, and failed."""
    rows = src.dated_windows(spark, sf)
    runs = [
        trends.strategic_summary(rows, as_of=src.AS_OF),
        trends.strategic_summary(
            rows,
            _strategic_answer(spark),
            as_of=src.AS_OF,
            run_id="run-1",
            requested_by="ann@example.com",
            requested_by_user_id="17",
            time_range="24h",
        ),
        trends.strategic_summary(
            rows, as_of=src.AS_OF, run_id="run-2", requested_by="debug", failure=("call_model", "timeout")
        ),
    ]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select(
        "id",
        "source",
        "requested_by",
        "requested_by_user_id",
        "time_range_requested",
        "analysis",
        "severity",
        F.array_join("flags", "|").alias("flags"),
        F.array_join("recommendations", "|").alias("recommendations"),
        "policy_effectiveness_notes",
        F.to_json("campaigns_detected").alias("campaigns"),
        "input_tokens",
        "output_tokens",
        "estimated_cost_usd",
        "status",
        "trigger_type",
        "model",
        _s("window_start"),
        _s("window_end"),
        "batch_summary_count",
        F.array_join("batch_summary_ids", "|").alias("batch_summary_ids"),
        "total_events",
        "total_denies",
        "total_alerts",
    )


# --- serving ------------------------------------------------------------------------

_TABLES: dict[tuple[str, str], tuple[str, str]] = {}


def _merged_table(spark, sf, path, **options) -> str:
    """Merge the deliveries into ``path`` in three batches: the re-deliveries of the middle one change
    rows of the first. Returns the table's schema."""
    rows = src.arrivals(spark, sf).drop("offset", "poll_no")
    no = F.floor((F.unix_seconds("poll_time") - src.EPOCH_0) / src.POLL_EVERY_SECONDS)
    for part in range(3):
        event_table.merge_events(spark, path, rows.filter(F.pmod(no, F.lit(3)) == part), **options)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", event_date date"


def _event_table(spark, sf) -> tuple[str, str]:
    """Path and schema of the event table, merged and compacted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        path = scratch_path(spark, "events")
        schema = _merged_table(spark, sf, path)
        event_table.compact_events(spark, path, schema=schema)
        _TABLES[key] = path, schema
    return _TABLES[key]


def _stored_events(spark, sf):
    path, schema = _event_table(spark, sf)
    return event_table.read_events(spark, path, schema)


@query
def merge_events(spark, sf):
    """Three merges into a new table, read over base and deltas."""
    path = scratch_path(spark, "merged")
    schema = _merged_table(spark, sf, path)
    table = event_table.read_events(spark, path, schema)
    return table.select("id", "batch_id", F.col("event_date").cast("string").alias("event_date"))


@query
def compact_events(spark, sf):
    """The same table with deltas compacted as they come."""
    path = scratch_path(spark, "compacted")
    schema = _merged_table(spark, sf, path, delta_rows=1, file_rows=20_000)
    table = event_table.read_events(spark, path, schema)
    return table.select("id", "batch_id", F.col("event_date").cast("string").alias("event_date"))


@query
def purge_events(spark, sf):
    """A week after the middle of the polls: expired dates leave the table, mixed ones are rewritten."""
    path = scratch_path(spark, "purged")
    schema = _merged_table(spark, sf, path)
    as_of = datetime.fromtimestamp(src.EPOCH_0 + 7 * 86_400 + 6 * 3600, timezone.utc)
    event_table.purge_events(spark, path, as_of.replace(tzinfo=None), schema)
    return event_table.read_events(spark, path, schema).select("id", "event_time_epoch")


def _served(rows):
    return rows.select(
        "id", "batch_id", "client_ip", "path", "geo_country", "rule_action_summary", "event_time_epoch"
    )


@query
def event_by_id(spark, sf):
    """Lookup of the smallest id."""
    smallest = src.arrivals(spark, sf).agg(F.min("id")).scalar()
    return _served(serving.event_by_id(_stored_events(spark, sf), smallest))


@query
def query_events(spark, sf):
    return _served(
        serving.query_events(_stored_events(spark, sf), geo_country="US", action="deny", limit=200)
    )


@query
def query_events_in_range(spark, sf):
    start = src.EPOCH_0 + 10 * 86_400
    return _served(
        serving.query_events(
            _stored_events(spark, sf),
            path="/console",
            start=start,
            end=start + 5 * 86_400,
            limit=None,
        )
    )


@query
def query_events_range_after_limit(spark, sf):
    start = src.EPOCH_0 + 26 * 86_400
    return _served(
        serving.query_events(
            _stored_events(spark, sf),
            path="/find",
            start=start,
            end=start + 3 * 86_400,
            limit=300,
            time_filter="after_limit",
        )
    )


@query
def query_events_all(spark, sf):
    """Every event of one country: more rows than any page holds."""
    return _served(serving.query_events(_stored_events(spark, sf), geo_country="RU", limit=None))


@query
def ip_drilldown(spark, sf):
    return serving.ip_drilldown(_stored_events(spark, sf), "198.51.0.7").select(
        F.unix_seconds("event_time").alias("event_time_s"),
        "method",
        "path",
        "rule_action_summary",
        "geo_country",
        "bot_score",
        "id",
    )


@query
def batch_page(spark, sf):
    """The second page of a batch, behind the last id of the first one."""
    batch = f"cfg-0@{src.EPOCH_0 + 30 * 100}"
    path, schema = _event_table(spark, sf)
    rows = event_table.read_batch(spark, path, batch, schema)
    last = serving.batch_page(rows, batch, limit=2).agg(F.max("id")).first()[0]
    return serving.batch_page(rows, batch, limit=5, after=last).select("batch_id", "total", "id", "client_ip")


@query
def analysis_stream(spark, sf):
    return serving.analysis_stream(
        src.summaries(spark, sf), src.strategic_records(spark, sf), severity="high", limit=100
    ).select("id", "type", _s("created_at"), "severity", "events", "model", "deny_count")


@query
def analysis_by_id(spark, sf):
    return serving.analysis_by_id(
        src.summaries(spark, sf), src.strategic_records(spark, sf), "s-cfg-0-473352"
    ).select("type", "id", _s("created_at"), "severity", "analysis", "events")


@query
def volume_series(spark, sf):
    return serving.volume_series(src.summaries(spark, sf), 100).select(
        _s("time"), "window_id", "event_count", "deny_count", "severity"
    )


@query
def scaled_series(spark, sf):
    series = serving.volume_series(src.summaries(spark, sf), 100)
    return serving.scaled_series(series).select(
        F.col("point").cast("bigint").alias("point"), "x", "event_y", "deny_y"
    )


@query
def score_bands(spark, sf):
    return (
        src.events(spark, sf)
        .groupBy(
            score_band(F.col("bot_score")).alias("bot_band"),
            score_band(F.col("user_risk_score")).alias("risk_band"),
        )
        .agg(F.count("*").alias("n"))
    )


@query
def previews(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query
def entity_references(spark, sf):
    rows = src.summaries(spark, sf)
    return serving.entity_references(rows, id_column="window_id").select(
        "analysis_id", "kind", F.col("pos").cast("bigint").alias("pos"), "ref"
    )


@query
def referenced_events(spark, sf):
    """Texts that mention the event of each order's customer, joined to the event table."""
    mentions = src.arrivals(spark, sf).select(
        F.col("request_id").alias("analysis_id"),
        F.concat(F.lit("see [event::"), "id", F.lit("] from [ip::"), "client_ip", F.lit("]")).alias(
            "analysis"
        ),
    )
    refs = serving.entity_references(mentions, id_column="analysis_id")
    return serving.referenced_events(refs, src.events(spark, sf)).select(
        "analysis_id", "ref", "event_time_epoch", "client_ip", "path", "rule_action_summary"
    )


@query
def window_counts(spark, sf):
    return serving.window_counts(src.dated_windows(spark, sf), datetime(2024, 1, 8, 6, 0))


@query
def export_ndjson(spark, sf):
    """The JSON lines of all deny events, read back from the files."""
    path = scratch_path(spark, "export-ndjson")
    exports.write_ndjson(
        exports.export_rows(src.events(spark, sf), {"rule_action_summary": "deny"}), path
    )
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    lines = lines.withColumn("doc", F.parse_json("line"))
    return lines.select(
        F.variant_get("doc", "$.id", "string").alias("id"),
        F.variant_get("doc", "$.clientIP", "string").alias("client_ip"),
        F.variant_get("doc", "$.decodedRules[1].ruleTag", "string").alias("second_tag"),
        F.variant_get("doc", "$.botScore", "int").alias("bot_score"),
        F.col("line").contains('"botScore":null').alias("null_kept"),
    )


@query
def export_csv(spark, sf):
    """All events as CSV, read back from the files; some ids hold quotes, commas and line ends."""
    odd = F.when(F.col("path") == "/console", F.concat(F.lit('/console,"a b"\n'), "geo_country"))
    rows = src.events(spark, sf).withColumn("path", F.coalesce(odd, "path"))
    path = scratch_path(spark, "export-csv")
    exports.write_csv(exports.export_rows(rows), path)
    kinds = {"botScore": "bigint", "userRiskScore": "bigint"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in exports.CSV_FIELDS)
    read = spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
    # an empty text and null are both written as nothing
    return read.select(
        "id",
        "clientIP",
        "method",
        "path",
        "ruleActionSummary",
        "geoCountry",
        "botScore",
        "userRiskScore",
        "eventTime",
        "responseStatus",
    )


@query
def export_manifest(spark, sf):
    """Exports of every country as CSV, in one job, and their manifest."""
    folder = scratch_path(spark, "exports")
    requests = {f"export-{c}": {"geo_country": c} for c in src.COUNTRIES if c}
    exports.run_exports(
        spark, src.events(spark, sf), folder, requests, fmt="csv", as_of=src.AS_OF
    )
    return exports.export_manifest(spark, folder).select(
        "id", "status", "format", "actual_rows", "has_data", _s("created_at"), _s("completed_at")
    )


# --- spend --------------------------------------------------------------------------


@query
def call_cost(spark, sf):
    return spend.call_cost(src.usage_log(spark, sf)).select("call_seq", "tier", "cost_nano")


@query
def daily_spend(spark, sf):
    return spend.daily_spend(src.usage_log(spark, sf)).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd")
    )


BLOCKED = Settings(block_rows=1_000)


@query
def budget_flags(spark, sf):
    return spend.budget_flags(src.usage_log(spark, sf), settings=BLOCKED).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "warning_call", "cap_call"
    )


@query
def budget_gate(spark, sf):
    return spend.budget_gate(src.usage_log(spark, sf), settings=BLOCKED).select(
        "call_seq", "cost_nano", "spent_before", "admitted"
    )


@query
def cost_summary(spark, sf):
    """Every day from the first to the last call, also those without any."""
    usage = src.usage_log(spark, sf)
    days = usage.agg(
        F.min(F.to_date("call_ts")).alias("a"), F.max(F.to_date("call_ts")).alias("b")
    ).select(F.explode(F.sequence("a", "b")).alias("date"))
    return spend.cost_summary(days, usage).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
