"""Trends over window summaries and the strategic record.

``summaries`` are rows of ``window_summary`` plus the response fields (``analysis``, ``flags``,
``notable_ips``, ``notable_patterns``). Every report takes ``by``: the columns that separate
independent reports (none = one report over all rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.times import utc_literal
from wardline.operators.normalize import DEFAULT_SOURCE
from wardline.operators.spend import cost_nano, usd
from wardline.operators.windows import strategic_tier, summary_tier
from wardline.settings import DEFAULTS, SEVERITIES, Settings

# Columns of the report's window table, in this order.
WINDOW_TABLE_COLUMNS = (
    "severity",
    "event_count",
    "deny_count",
    "deny_ratio",
    "unique_ips",
    "avg_bot_score",
    "avg_user_risk_score",
    "flags",
)


def _newest(*ties: str) -> list[Column]:
    return [F.col("created_at").desc(), *[F.col(t) for t in ties]]


def latest_windows(
    summaries: DataFrame,
    n: int | None = None,
    *,
    by: Sequence[str] = (),
    lookback_from: datetime | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The newest n summaries. The lookback is a label of the record and filters only when
    ``lookback_from`` is given."""
    n = settings.strategic_windows if n is None else n
    if lookback_from is not None:
        cutoff = utc_literal(lookback_from - timedelta(hours=settings.lookback_hours))
        summaries = summaries.filter(F.col("created_at") > cutoff)
    if not by:
        return summaries.orderBy(*_newest("window_id")).limit(n)
    newest = Window.partitionBy(*by).orderBy(*_newest("window_id"))
    return (
        summaries.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    )


def severity_counts(summaries: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """One column per class; other values are ignored."""
    return summaries.groupBy(*by).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    )


def deny_ratio_trend(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "config_id",
        F.col("created_at").alias("time"),
        F.coalesce("deny_ratio", F.lit(0.0)).alias("deny_ratio"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
    ).orderBy("time", "config_id")


def _ranked_top(totals: DataFrame, by: Sequence[str], key: str, total: str, n: int) -> DataFrame:
    if not by:
        return totals.orderBy(F.col(total).desc(), key).limit(n)
    ranked = Window.partitionBy(*by).orderBy(F.col(total).desc(), key)
    return totals.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n).drop("_rn")


def persistent_ips(
    summaries: DataFrame, *, by: Sequence[str] = (), at_least: int = 2, n: int = 20
) -> DataFrame:
    """Addresses notable in several windows (every mention counts)."""
    mentions = summaries.select(*by, F.explode("notable_ips").alias("ip"))
    counts = (
        mentions.groupBy(*by, "ip")
        .agg(F.count("*").alias("batch_count"))
        .filter(F.col("batch_count") >= at_least)
    )
    return _ranked_top(counts, by, "ip", "batch_count", n)


def _key_totals(
    summaries: DataFrame, column: str, name: str, by: Sequence[str], n: int
) -> DataFrame:
    listed = summaries.select(*by, F.explode(column).alias("_item"))
    if "struct" in dict(summaries.dtypes)[column]:
        # a missing or zero count stands for one
        count = F.coalesce(F.nullif(F.col("_item.count"), F.lit(0)), F.lit(1))
        key = F.col("_item.key")
    else:
        key, count = F.col("_item"), F.lit(1)
    totals = listed.select(*by, key.alias(name), count.alias("_n")).groupBy(*by, name).agg(
        F.sum("_n").alias("count")
    )
    return _ranked_top(totals, by, name, "count", n)


def rule_tag_trend(summaries: DataFrame, *, by: Sequence[str] = (), n: int = 15) -> DataFrame:
    """Counts per tag summed over windows; a list of plain tags counts one each."""
    return _key_totals(summaries, "top_rule_tags", "tag", by, n)


def country_trend(summaries: DataFrame, *, by: Sequence[str] = (), n: int = 10) -> DataFrame:
    return _key_totals(summaries, "top_countries", "country", by, n)


def window_table(
    summaries: DataFrame, n: int | None = None, *, by: Sequence[str] = (), settings: Settings = DEFAULTS
) -> DataFrame:
    """The newest n summaries, numbered from 1 = newest."""
    latest = latest_windows(summaries, n, by=by, settings=settings)
    # at most n rows per report by now
    newest = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*_newest("window_id"))
    return latest.select(
        *by,
        F.row_number().over(newest).alias("batch"),
        F.col("created_at").alias("time"),
        *WINDOW_TABLE_COLUMNS,
    )


def notable_windows(summaries: DataFrame) -> DataFrame:
    return summaries.filter(F.col("severity").isin("critical", "high")).select(
        "window_id",
        "severity",
        F.col("created_at").alias("time"),
        "analysis",
        "notable_ips",
        "notable_patterns",
    )


def latest_prior(strategic: DataFrame) -> DataFrame:
    """The newest complete strategic record, if any."""
    return (
        strategic.filter(F.col("status") == "complete").orderBy(*_newest("id")).limit(1)
    )


def _list_json(items: DataFrame, entry: Column, order: list[Column], name: str, empty: str) -> DataFrame:
    """A short report list as one JSON text under the key ``_one``."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    listed = F.sort_array(F.collect_list(F.struct(key.alias("k"), entry.alias("e"))))
    text = F.to_json(F.transform(listed, lambda e: e["e"]))
    return items.groupBy(F.lit(1).alias("_one")).agg(text.alias(name)).withColumn(
        name, F.coalesce(name, F.lit(empty))
    )


def strategic_request(
    summaries: DataFrame,
    strategic: DataFrame | None = None,
    *,
    time_range: str | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One request over the newest windows: numbered table, trends, notable windows and the
    previous strategic analysis. Only the newest ``strategic_windows`` rows take part."""
    # some twenty rows that nine reports read; their exchanges are shared by the planner
    latest = latest_windows(summaries, settings=settings)
    table = window_table(latest, settings=settings)
    trend = deny_ratio_trend(latest)
    none, no_data = "none", "nothing known"

    head = latest.groupBy(F.lit(1).alias("_one")).agg(F.count("*").alias("batch_count"))
    counts = severity_counts(latest.withColumn("_one", F.lit(1)), by=["_one"]).select(
        "_one", F.to_json(F.struct(*SEVERITIES)).alias("severity_distribution")
    )
    parts = [
        counts,
        _list_json(table, F.struct(*table.columns), [F.col("batch")], "summary_table", "[]"),
        _list_json(
            trend,
            F.struct("time", "deny_ratio", "event_count"),
            [F.col("time"), F.col("config_id")],
            "deny_ratio_over_time",
            "[]",
        ),
        *[
            _list_json(df, F.struct(*df.columns), [-F.col(total), F.col(key)], name, empty)
            for df, key, total, name, empty in (
                (persistent_ips(latest), "ip", "batch_count", "persistent_ips", none),
                (rule_tag_trend(latest), "tag", "count", "top_attack_types", none),
                (country_trend(latest), "country", "count", "geographic_distribution", no_data),
            )
        ],
        _notable_section(latest),
    ]
    if strategic is not None:
        parts.append(
            latest_prior(strategic).select(
                F.lit(1).alias("_one"), F.col("analysis").alias("prior_analysis")
            )
        )
    request = head
    for part in parts:
        request = request.join(part, "_one", "left")
    if strategic is None:
        request = request.withColumn("prior_analysis", F.lit(None).cast("string"))
    covering = (
        F.lit(f"Time asked for: {time_range}")
        if time_range
        else F.format_string("The newest %d windows", "batch_count")
    )
    sections = {
        "Windows": F.col("summary_table"),
        "Windows By Severity": F.col("severity_distribution"),
        "Denied Share By Time": F.col("deny_ratio_over_time"),
        "Recurring Addresses": F.coalesce("persistent_ips", F.lit(none)),
        "Frequent Rule Tags": F.coalesce("top_attack_types", F.lit(none)),
        "Countries": F.coalesce("geographic_distribution", F.lit(no_data)),
        "Windows Of Note": F.nullif("notable", F.lit("")),
        "Previous Assessment": F.nullif("prior_analysis", F.lit("")),
    }
    # concat_ws skips the optional sections that are null
    body = F.concat_ws(
        "\n\n",
        covering,
        *[F.concat(F.lit(f"## {title}\n"), text) for title, text in sections.items()],
    )
    return request.select("batch_count", strategic_tier().alias("tier"), body.alias("request"))


def _notable_section(latest: DataFrame) -> DataFrame:
    def listing(label: str, column: str) -> Column:
        return F.when(
            F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", "))
        )

    entry = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit("###"), F.upper("severity"), F.col("time").cast("string")),
        "analysis",
        listing("Addresses", "notable_ips"),
        listing("Patterns", "notable_patterns"),
    )
    newest_first = F.sort_array(
        F.collect_list(F.struct((-F.unix_micros("time")).alias("t"), "window_id", entry.alias("e")))
    )
    return (
        notable_windows(latest)
        .groupBy(F.lit(1).alias("_one"))
        .agg(F.array_join(F.transform(newest_first, lambda e: e["e"]), "\n").alias("notable"))
    )


def hourly_request(
    summaries: DataFrame, *, by: Sequence[str] = ("config_id",), settings: Settings = DEFAULTS
) -> DataFrame:
    """One request per interval over its summaries, newest first.

    ``batch_count`` is the interval's number of summaries, ``listed_count`` those in the request: all,
    or the newest ``summary_max_windows``. Analyses are cut to ``summary_analysis_chars``.
    """
    span = F.window("created_at", f"{settings.summary_interval_minutes} minutes")
    newest = Window.partitionBy(*by, "interval_start").orderBy(*_newest("window_id"))
    listed = summaries.withColumn("interval_start", span["start"]).withColumn(
        "_rn", F.row_number().over(newest)
    )
    most = settings.summary_max_windows
    is_listed = F.lit(True) if most is None else F.col("_rn") <= most
    # Member names of the payload.
    entry = F.struct(
        F.col("_rn").alias("n"),
        F.col("window_id").alias("id"),
        F.col("created_at").alias("time"),
        "severity",
        F.col("event_count").alias("eventCount"),
        F.col("deny_count").alias("denyCount"),
        F.col("unique_ips").alias("uniqueIPs"),
        F.col("deny_ratio").alias("denyRatio"),
        F.col("avg_bot_score").alias("avgBotScore"),
        F.col("avg_user_risk_score").alias("avgUserRiskScore"),
        F.col("top_ips").alias("topIPs"),
        F.col("top_paths").alias("topPaths"),
        F.col("top_countries").alias("topCountries"),
        "flags",
        F.col("notable_ips").alias("notableIPs"),
        F.col("notable_patterns").alias("notablePatterns"),
        F.col("model_used").alias("model"),
        F.substring("analysis", 1, settings.summary_analysis_chars).alias("analysis"),
    )
    return (
        listed.groupBy(*by, "interval_start")
        .agg(
            F.count("*").alias("batch_count"),
            F.count_if(is_listed).alias("listed_count"),
            F.to_json(F.sort_array(F.collect_list(F.when(is_listed, entry)))).alias("request"),
        )
        .withColumn("tier", summary_tier())
    )


def strategic_summary(
    summaries: DataFrame,
    response: DataFrame | None = None,
    *,
    as_of: datetime,
    run_id: str | None = None,
    requested_by: str | None = None,
    requested_by_user_id: str | None = None,
    time_range: str | None = None,
    failure: tuple[str, str] | None = None,
    source: str = DEFAULT_SOURCE,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The record of one strategic run over the newest windows, always one row.

    Totals are summed from the windows. ``response`` (one row of ``parse_response``, with
    ``input_tokens`` and ``output_tokens`` if known) completes the run; without one it is still
    running. It has failed without any summaries, or with a ``failure`` (step, message).
    """
    latest = latest_windows(summaries, settings=settings)
    totals = latest.agg(
        F.count("*").alias("batch_summary_count"),
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.unix_micros("created_at")).alias("t"), "window_id")
                )
            ),
            lambda w: w["window_id"],
        ).alias("batch_summary_ids"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("deny_count"), F.lit(0)).alias("total_denies"),
        F.coalesce(F.sum("alert_count"), F.lit(0)).alias("total_alerts"),
    ).withColumn("_one", F.lit(1))
    types = {
        "analysis": "string",
        "severity": "string",
        "flags": "array<string>",
        "recommendations": "array<string>",
        "policy_effectiveness_notes": "string",
        "campaigns_detected": "variant",
        "input_tokens": "bigint",
        "output_tokens": "bigint",
    }
    given = () if response is None else response.columns
    missing = {f: F.lit(None).cast(t) for f, t in types.items() if f not in given}
    if response is None:
        joined = totals.withColumns(missing)
        answered = F.lit(False)
    else:
        answer = response.withColumns(missing).select(
            F.lit(1).alias("_one"), F.lit(True).alias("_answered"), *types
        )
        joined = totals.join(answer, "_one", "left")
        answered = F.coalesce("_answered", F.lit(False))
    empty = F.col("batch_summary_count") == 0
    failed = empty | F.lit(failure is not None)
    status = F.when(failed, "failed").when(answered, "complete").otherwise("running")
    # Fixed format: the texts of a run that has failed.
    reason = "Analysis error at [{}]: {}".format(*failure) if failure else None
    told = F.when(empty, "No batch analyses available.").otherwise(
        F.coalesce(F.lit(reason), F.col("analysis"))
    )
    cost = cost_nano(strategic_tier(), F.col("input_tokens"), F.col("output_tokens"), settings)
    trigger = "debug" if requested_by == "debug" else ("on_demand" if run_id else "scheduled")
    end = utc_literal(as_of)
    return joined.select(
        F.lit(run_id or f"scheduled-{as_of:%Y%m%dT%H%M%S}").alias("id"),
        status.alias("status"),
        F.lit(trigger).alias("trigger_type"),
        F.lit(source).alias("source"),
        F.lit(requested_by).cast("string").alias("requested_by"),
        F.lit(requested_by_user_id).cast("string").alias("requested_by_user_id"),
        F.lit(time_range).cast("string").alias("time_range_requested"),
        utc_literal(as_of - timedelta(hours=settings.lookback_hours)).alias("window_start"),
        end.alias("window_end"),
        end.alias("created_at"),
        "batch_summary_ids",
        "batch_summary_count",
        strategic_tier().alias("model"),
        "total_events",
        "total_denies",
        "total_alerts",
        told.alias("analysis"),
        F.when(~failed, F.col("severity")).alias("severity"),
        "flags",
        "recommendations",
        "policy_effectiveness_notes",
        "campaigns_detected",
        "input_tokens",
        "output_tokens",
        usd(cost).alias("estimated_cost_usd"),
    )
