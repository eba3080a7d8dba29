"""Statistics, sample, class and records per analysis window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.coerce import half_up
from wardline.functions.text import fenced_json
from wardline.operators.normalize import DEFAULT_SOURCE
from wardline.operators.spend import cost_nano, usd
from wardline.operators.upkeep import upsert_latest
from wardline.operators.windows import batch_tier, window_polls
from wardline.settings import DEFAULTS, SCORE_BUCKETS, Settings

TOP_KINDS = {
    "ip": "top_ips",
    "path": "top_paths",
    "country": "top_countries",
    "rule_tag": "top_rule_tags",
}
SCORES = ("bot_score", "user_risk_score")
ALL_KINDS = ("scores", *TOP_KINDS)


def window_events(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Stored events of every window: an equi-join on the batch id.

    No broadcast hint, as windows grow with the data; the planner broadcasts when they fit
    its threshold, and a batch with very many events is split by the adaptive skew join.
    """
    return events.join(window_polls(windows), "batch_id")


def counted_columns() -> list[Column]:
    """What ``value_counts`` reads of an event, besides the key; of its rules the tags alone."""
    tags = F.struct(F.col("decoded_rules.rule_tag").alias("rule_tag")).alias("decoded_rules")
    return [F.col(c) for c in ("client_ip", "path", "geo_country", *SCORES, "rule_action_summary")] + [tags]


def value_counts(
    joined: DataFrame, *, kinds: tuple[str, ...] = ALL_KINDS, key: str = "window_id"
) -> DataFrame:
    """Counts per window (or other ``key``) and value: ``window_id, kind, value, bot, risk, n, denied``.

    One row per event and top list (and rule), and one of kind ``scores`` with both scores, whose
    counts give the number of events, the means and the distributions. ``denied`` are the deny events
    of an address. Partial aggregation absorbs hot values, and all statistics share this shuffle.
    """
    no_score = F.lit(None).cast("bigint")

    def entry(kind: str, value: Column, bot: Column = no_score, risk: Column = no_score) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), bot.alias("bot"), risk.alias("risk")
        )

    scores = [F.col(s).cast("bigint") for s in SCORES]
    single = {
        "ip": entry("ip", F.col("client_ip")),
        "path": entry("path", F.col("path")),
        "country": entry("country", F.col("geo_country")),
        "scores": entry("scores", F.lit("*"), *scores),
    }
    values = F.array(*[e for kind, e in single.items() if kind in kinds])
    if "rule_tag" in kinds:
        tags = F.coalesce(F.col("decoded_rules.rule_tag"), F.array().cast("array<string>"))
        values = F.concat(values, F.transform(tags, lambda t: entry("rule_tag", t)))
    deny = F.col("rule_action_summary") == "deny" if "ip" in kinds else F.lit(False)
    return (
        joined.select(key, deny.alias("deny"), F.inline(values))
        .filter(F.col("value") != "")
        .groupBy(key, "kind", "value", "bot", "risk")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("deny") & (F.col("kind") == "ip")).alias("denied"),
        )
    )


def window_counts_from_batches(windows: DataFrame, batch_counts: DataFrame) -> DataFrame:
    """``value_counts`` of every window as sums over its polls: no event is read.

    ``batch_counts``: counts per batch of the stored rows, such as the event table keeps.
    """
    keys = ["window_id", "kind", "value", "bot", "risk"]
    summed = (
        # a count is small, all of them are not: they are never sent through the driver to every task
        batch_counts.hint("merge").join(window_polls(windows), "batch_id")
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.sum("denied").alias("denied"))
    )
    return summed.filter(F.col("n") > 0)


def top_values(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent values per window and kind; ties by value.

    The rank filter prunes to n rows per group before the shuffle. ``denied`` orders nothing, as a value
    has one row: without it the counts would be pruned, and not share the shuffle of the other statistics.
    """
    ranked = Window.partitionBy("window_id", "kind").orderBy(
        F.col("n").desc(), "value", "bot", "risk", "denied"
    )
    return counts.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)


def denied_by_busiest(counts: DataFrame, n: int) -> DataFrame:
    """``window_id, top_deny``: deny events of the ``n`` addresses with most of them.

    Only addresses count denials, so no filter on the kind is needed; one would be pushed below the
    shuffle of the counts, which could then not be shared.
    """
    ranked = Window.partitionBy("window_id").orderBy(F.col("denied").desc(), "value")
    return (
        counts.filter(F.col("denied") > 0)
        .withColumn("_rn", F.row_number().over(ranked))
        .filter(F.col("_rn") <= n)
        .groupBy("window_id")
        .agg(F.sum("denied").alias("top_deny"))
    )


def _top(joined: DataFrame, kind: str, n: int) -> DataFrame:
    counts = value_counts(joined, kinds=(kind,))
    return top_values(counts, n).select("window_id", "value", "n", "rank")


def top_ips(joined: DataFrame, n: int = 10) -> DataFrame:
    return _top(joined, "ip", n)


def top_paths(joined: DataFrame, n: int = 10) -> DataFrame:
    return _top(joined, "path", n)


def top_countries(joined: DataFrame, n: int = 10) -> DataFrame:
    return _top(joined, "country", n)


def top_rule_tags(joined: DataFrame, n: int = 10) -> DataFrame:
    """Every rule of an event counts, so an event may add to a tag twice."""
    return _top(joined, "rule_tag", n)


def unique_ips(joined: DataFrame, *, approximate: bool = False) -> DataFrame:
    ip = F.nullif(F.col("client_ip"), F.lit(""))
    distinct = F.approx_count_distinct(ip) if approximate else F.count_distinct(ip)
    return joined.groupBy("window_id").agg(distinct.alias("unique_ips"))


def ip_sketches(events: DataFrame, *, log2_size: int = 12) -> DataFrame:
    """(batch_id, sketch): a mergeable distinct count of the addresses of each poll.

    A sketch has at most about 2^log2_size bytes; its relative standard error is about
    1.04 / 2^(log2_size / 2), and small counts are all but exact.
    """
    ip = F.nullif(F.col("client_ip"), F.lit(""))
    return events.groupBy("batch_id").agg(F.hll_sketch_agg(ip, log2_size).alias("sketch"))


def unique_ips_from_sketches(windows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct addresses of every window from the sketches of its polls: no event is read.

    Sketches can't give back: an address counts in the poll that first brought it even if all its events
    have moved to a newer one. Several sketches of a poll (its files fell into two micro-batches) merge.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return (
        sketches.join(window_polls(windows), "batch_id")
        .groupBy("window_id")
        .agg(merged.alias("unique_ips"))
    )


def avg_scores(joined: DataFrame) -> DataFrame:
    totals = _window_totals(value_counts(joined, kinds=("scores",)))
    return totals.select("window_id", *[f"avg_{s}" for s in SCORES])


def score_bucket(score: Column) -> Column:
    """Bucket label; below 0 counts in the first, above 100 in the last."""
    label = F.lit(SCORE_BUCKETS[-1])
    for i in range(len(SCORE_BUCKETS) - 2, -1, -1):
        label = F.when(score < 20 * (i + 1), SCORE_BUCKETS[i]).otherwise(label)
    return F.when(score.isNotNull(), label)


def score_distribution(joined: DataFrame) -> DataFrame:
    """Long form: window_id, score, bucket, n; all five buckets, zeros included."""
    totals = _window_totals(value_counts(joined, kinds=("scores",)))
    kinds = F.array(
        *[
            F.struct(F.lit(s).alias("score"), F.col(f"{s}_distribution").alias("buckets"))
            for s in SCORES
        ]
    )
    return totals.select("window_id", F.inline(kinds)).select(
        "window_id", "score", F.inline("buckets")
    )


def priority_sample(
    joined: DataFrame,
    *,
    arrival: tuple[str, ...] = ("poll_time", "line_pos"),
    seed: int = 0,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """A stratified sample per window: ``window_id, id, tier, sample_pos``.

    A window with at most ``sample_size`` events is taken whole, in arrival order. A larger
    one gives, in turn and without repeats, its first deny events, its first high-risk
    events, its first high-bot events (each up to its quota) and a fill in hash order.

    A tier can lose only rows that earlier tiers took, so the tier's own first
    (its quota + earlier quotas) rows decide it, and the first ``sample_size`` in hash order
    decide the fill. Those candidates are pruned by a group limit before the shuffle: no
    task sees a whole window.
    """
    n = settings.sample_size
    quotas = {
        "deny": settings.sample_quota(settings.deny_sample_ratio),
        "risk": settings.sample_quota(settings.risk_sample_ratio),
        "bot": settings.sample_quota(settings.bot_sample_ratio),
    }
    high = settings.sample_score_threshold
    member = {
        "deny": F.col("rule_action_summary") == "deny",
        "risk": F.coalesce(F.col("user_risk_score") >= high, F.lit(False)),
        "bot": F.coalesce(F.col("bot_score") >= high, F.lit(False)),
    }
    flagged = joined.select(
        "window_id",
        "id",
        F.struct(*arrival).alias("_at"),
        F.md5(F.concat_ws(":", "id", F.lit(str(seed)))).alias("_hash"),
        *[member[t].alias(t) for t in quotas],
    )
    # one candidate list per tier; the order key is the arrival, or the hash for the fill
    lists = F.array(
        *[
            F.struct(F.lit(t).alias("list"), F.col(t).alias("use"), F.lit("").alias("hash_key"))
            for t in quotas
        ],
        F.struct(F.lit("fill").alias("list"), F.lit(True).alias("use"), F.col("_hash").alias("hash_key")),
    )
    in_list = Window.partitionBy("window_id", "list").orderBy("hash_key", "_at", "id")
    # n + 1 rows in hash order also tell whether the window is larger than n
    candidates = (
        flagged.select("*", F.inline(lists))
        .filter("use")
        .withColumn("_rn", F.row_number().over(in_list))
        .filter(F.col("_rn") <= n + 1)
        .groupBy("window_id", "id", "_at", "_hash", *quotas)
        .agg(F.max(F.col("list") == "fill").alias("_in_fill"))
    )
    whole = Window.partitionBy("window_id")
    by_arrival = whole.orderBy("_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    picked = candidates.withColumn(
        "_small", F.count_if("_in_fill").over(whole) <= n
    ).withColumn("tier", F.when(F.col("_small"), "all"))
    for tier, quota in quotas.items():
        eligible = F.col("tier").isNull() & F.col(tier)
        picked = picked.withColumn(
            "_nth", F.count_if(eligible).over(by_arrival)
        ).withColumn(
            "tier",
            F.when(eligible & (F.col("_nth") <= quota), tier).otherwise(F.col("tier")),
        )
    taken = F.count("tier").over(whole)
    open_first = whole.orderBy(F.col("tier").isNotNull(), "_hash", "_at", "id")
    picked = (
        picked.withColumn("_taken", taken)
        .withColumn("_fill_nth", F.row_number().over(open_first))
        .withColumn(
            "tier",
            F.when(F.col("tier").isNotNull(), F.col("tier")).when(
                F.col("_in_fill") & (F.col("_fill_nth") <= n - F.col("_taken")), "fill"
            ),
        )
        .filter(F.col("tier").isNotNull())
    )
    rank = F.array_position(F.array(*[F.lit(t) for t in ("all", *quotas, "fill")]), F.col("tier"))
    hash_in_fill = F.when(F.col("tier") == "fill", F.col("_hash")).otherwise("")
    final = whole.orderBy(rank, hash_in_fill, "_at", "id")
    return picked.select(
        "window_id", "id", "tier", F.row_number().over(final).alias("sample_pos")
    )


def severity_class(
    deny_ratio: Column, coordinated: Column, settings: Settings = DEFAULTS
) -> Column:
    """Class from the deny ratio; without signs of coordination it stops at high."""
    return (
        F.when((deny_ratio > settings.severity_critical_ratio) & coordinated, "critical")
        .when(deny_ratio >= settings.severity_high_ratio, "high")
        .when(deny_ratio >= settings.severity_medium_ratio, "medium")
        .when(deny_ratio > 0, "low")
        .otherwise("info")
    )


def _window_tops(counts: DataFrame, n: int) -> DataFrame:
    """The top lists as sorted arrays of (key, count): at most n rows per window and kind are
    collected."""
    entry = F.struct("rank", F.col("value").alias("key"), F.col("n").alias("count"))

    def pick(kind: str) -> Column:
        listed = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry)))
        return F.transform(
            listed, lambda e: F.struct(e["key"].alias("key"), e["count"].alias("count"))
        )

    # Ranks run over every kind, for the same reason as in denied_by_busiest.
    return (
        top_values(counts, n)
        .groupBy("window_id")
        .agg(*[pick(kind).alias(name) for kind, name in TOP_KINDS.items()])
    )


def _window_totals(counts: DataFrame) -> DataFrame:
    kind, n = F.col("kind"), F.col("n")

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, n)), F.lit(0))

    def mean(score: Column) -> Column:
        weighted = F.sum(score * n) / F.sum(F.when(score.isNotNull(), n))
        return half_up(F.coalesce(weighted, F.lit(0.0)), 2)

    def buckets(score: Column) -> Column:
        bucket = score_bucket(score)
        return F.array(
            *[
                F.struct(F.lit(b).alias("bucket"), total(bucket == b).alias("n"))
                for b in SCORE_BUCKETS
            ]
        )

    columns = dict(zip(SCORES, (F.col("bot"), F.col("risk"))))
    return counts.groupBy("window_id").agg(
        total(kind == "scores").alias("stored_events"),
        F.count_if(kind == "ip").alias("unique_ips"),
        F.sum("denied").alias("ip_deny"),
        *[mean(c).alias(f"avg_{s}") for s, c in columns.items()],
        *[buckets(c).alias(f"{s}_distribution") for s, c in columns.items()],
    )


def window_statistics(
    counts: DataFrame, *, top_n: int = 10, settings: Settings = DEFAULTS
) -> DataFrame:
    """All statistics, one row per window, from ``value_counts``."""
    busiest = denied_by_busiest(counts, settings.coordinated_ips)
    return (
        _window_totals(counts)
        .join(_window_tops(counts, top_n), "window_id")
        .join(busiest, "window_id", "left")
    )


def _classified(df: DataFrame, settings: Settings) -> DataFrame:
    share = F.col("top_deny") >= settings.coordinated_share * F.col("ip_deny")
    return (
        df.withColumn("coordinated", F.coalesce(share, F.lit(False)))
        .withColumn("severity", severity_class(F.col("deny_ratio"), F.col("coordinated"), settings))
        .drop("top_deny", "ip_deny")
    )


def classify_severity(
    windows: DataFrame, joined: DataFrame, *, settings: Settings = DEFAULTS
) -> DataFrame:
    """Add ``coordinated`` and ``severity``. Coordinated: the busiest few addresses hold at
    least the given share of the window's denied events."""
    counts = value_counts(joined, kinds=("ip",))
    busiest = denied_by_busiest(counts, settings.coordinated_ips)
    denied = counts.groupBy("window_id").agg(F.sum("denied").alias("ip_deny"))
    joined_in = windows.join(denied.join(busiest, "window_id"), "window_id", "left")
    return _classified(joined_in, settings)


def window_summary(
    windows: DataFrame, events: DataFrame, *, top_n: int = 10, settings: Settings = DEFAULTS
) -> DataFrame:
    """The record of each closed window: snapshot, statistics and class.

    Counts of the snapshot are arrivals; ``stored_events`` and the statistics are over stored
    rows, which a re-delivery moves to a newer batch.
    """
    counts = value_counts(window_events(windows, events))
    return window_records(windows, counts, top_n=top_n, settings=settings)


def window_records(
    windows: DataFrame, counts: DataFrame, *, top_n: int = 10, settings: Settings = DEFAULTS
) -> DataFrame:
    """``window_summary`` from the counts of each window."""
    statistics = window_statistics(counts, top_n=top_n, settings=settings)
    summary = _classified(windows.join(statistics, "window_id", "left"), settings)
    # A window keeps its record even when every event of it moved to a newer batch.
    zeros = {
        "stored_events": 0,
        "unique_ips": 0,
        "avg_bot_score": 0.0,
        "avg_user_risk_score": 0.0,
    }
    no_scores = F.array(
        *[F.struct(F.lit(b).alias("bucket"), F.lit(0).cast("bigint").alias("n")) for b in SCORE_BUCKETS]
    )
    no_values = F.array().cast("array<struct<key:string,count:bigint>>")
    empty = {
        **{f"{score}_distribution": no_scores for score in SCORES},
        **{name: no_values for name in TOP_KINDS.values()},
    }
    return summary.fillna(zeros).withColumns(
        {
            **{name: F.coalesce(name, default) for name, default in empty.items()},
            "batch_id": F.col("poll_batch_ids")[0],
            "model_used": batch_tier(),
            "created_at": F.col("closed_at"),
        }
    )


def percent(ratio: Column) -> Column:
    """Share in percent with one decimal, as text."""
    return F.format_string("%.1f%%", ratio * 100)


def batch_request(
    summaries: DataFrame, joined: DataFrame, *, settings: Settings = DEFAULTS
) -> DataFrame:
    """One JSON request per window: metadata, statistics and the sampled events.

    The sample is drawn on narrow rows; the fields of the events it holds, at most ``sample_size``
    a window, are then fetched by window and id.
    """
    # Member names of the payload, here and in the body below.
    event = F.struct(
        "id",
        F.col("client_ip").alias("clientIP"),
        "method",
        "path",
        F.col("rule_action_summary").alias("action"),
        F.col("geo_country").alias("country"),
        F.col("bot_score").alias("botScore"),
        F.col("user_risk_score").alias("userRiskScore"),
        F.filter(F.col("decoded_rules.rule_tag"), lambda t: t != "").alias("rules"),
    )
    listed = F.sort_array(F.collect_list(F.struct("sample_pos", "kept")))
    events = (
        joined.select("window_id", "id", event.alias("kept"))
        .join(priority_sample(joined, settings=settings), ["window_id", "id"])
        .groupBy("window_id")
        .agg(F.transform(listed, lambda e: e["kept"]).alias("events"))
    )

    def iso(ts: str) -> Column:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    body = F.struct(
        F.struct(
            F.col("event_count").alias("eventCount"),
            iso("window_start").alias("windowStart"),
            iso("window_end").alias("windowEnd"),
            F.col("window_duration_seconds").alias("durationSeconds"),
            F.col("trigger_reason").alias("trigger"),
            F.col("deny_count").alias("denyCount"),
            percent(F.col("deny_ratio")).alias("denyRatio"),
            F.col("alert_count").alias("alertCount"),
            F.col("monitor_count").alias("monitorCount"),
        ).alias("metadata"),
        F.struct(
            F.col("unique_ips").alias("uniqueIPs"),
            F.col("top_ips").alias("topIPs"),
            F.col("top_paths").alias("topPaths"),
            F.col("top_countries").alias("topCountries"),
            F.col("top_rule_tags").alias("topRuleTags"),
            F.col("avg_bot_score").alias("avgBotScore"),
            F.col("bot_score_distribution").alias("botScoreDistribution"),
            F.col("avg_user_risk_score").alias("avgUserRiskScore"),
            F.col("user_risk_score_distribution").alias("userRiskScoreDistribution"),
        ).alias("statistics"),
        F.coalesce("events", F.array().cast(events.schema["events"].dataType)).alias(
            "sampledEvents"
        ),
    )
    return summaries.join(events, "window_id", "left").select(
        "window_id",
        "config_id",
        F.col("model_used").alias("tier"),
        F.coalesce(F.size("events"), F.lit(0)).alias("sampled"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("request"),
    )


def _text_list(doc: Column, path: str) -> Column:
    return F.coalesce(
        F.try_variant_get(doc, path, "array<string>"), F.array().cast("array<string>")
    )


def _or_default(doc: Column, path: str, default: Column) -> Column:
    return F.coalesce(F.nullif(F.try_variant_get(doc, path, "string"), F.lit("")), default)


def parse_response(responses: DataFrame, *, text: str = "response") -> DataFrame:
    """Structured fields of model responses; text that is no JSON becomes the analysis."""
    parsed = responses.withColumn("_doc", F.explode(F.array(fenced_json(F.col(text)))))
    doc, body = F.col("_doc"), F.col(text)
    return parsed.select(
        *responses.columns,
        doc.isNotNull().alias("is_json"),
        _or_default(doc, "$.analysis", body).alias("analysis"),
        _or_default(doc, "$.severity", F.lit("info")).alias("severity"),
        _text_list(doc, "$.flags").alias("flags"),
        _text_list(doc, "$.notableIPs").alias("notable_ips"),
        _text_list(doc, "$.notablePatterns").alias("notable_patterns"),
        _text_list(doc, "$.recommendations").alias("recommendations"),
        _or_default(doc, "$.policyEffectivenessNotes", F.lit("")).alias(
            "policy_effectiveness_notes"
        ),
        F.try_variant_get(doc, "$.campaignsDetected", "variant").alias("campaigns_detected"),
        *[
            F.coalesce(F.try_variant_get(doc, f"$.{name}", "bigint"), F.lit(0)).alias(alias)
            for name, alias in (
                ("totalEvents", "total_events"),
                ("totalDenies", "total_denies"),
                ("totalAlerts", "total_alerts"),
            )
        ],
    )


def complete_windows(
    summaries: DataFrame,
    answers: DataFrame,
    *,
    source: str = DEFAULT_SOURCE,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Window records with the fields of their responses, tokens and cost.

    ``answers``: ``parse_response`` over rows with ``window_id, response_seq, input_tokens,
    output_tokens``; the last of several answers counts. A window without one keeps its own severity
    class, an empty analysis and lists, and no tokens.
    """
    fields = ("analysis", "severity", "flags", "notable_ips", "notable_patterns")
    latest = upsert_latest(answers, ["window_id"], ["response_seq"]).select(
        "window_id",
        "input_tokens",
        "output_tokens",
        *[F.col(f).alias(f"_{f}") for f in fields],
    )
    no_values = F.array().cast("array<string>")
    answered = F.col("_analysis").isNotNull()
    tokens = {f"{side}_tokens": F.coalesce(f"{side}_tokens", F.lit(0)) for side in ("input", "output")}
    joined = summaries.join(latest, "window_id", "left").withColumns(tokens)
    cost = cost_nano(F.col("model_used"), F.col("input_tokens"), F.col("output_tokens"), settings)
    return joined.withColumns(
        {
            "answered": answered,
            "source": F.lit(source),
            "analysis": F.coalesce("_analysis", F.lit("")),
            "severity": F.coalesce("_severity", "severity"),
            **{f: F.coalesce(f"_{f}", no_values) for f in fields[2:]},
            "estimated_cost_usd": usd(cost),
        }
    ).drop(*[f"_{f}" for f in fields])
