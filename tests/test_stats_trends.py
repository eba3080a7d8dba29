import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.operators import stats, trends
from wardline.plans import inputs as src
from wardline.settings import Settings


def events(spark, rows):
    """rows: (window, id, action, risk, bot)"""
    return spark.createDataFrame(
        rows, "window_id string, id string, rule_action_summary string, user_risk_score int, bot_score int"
    ).withColumns({"poll_time": F.lit(0), "line_pos": F.col("id")})


def brute_sample(rows, s):
    import hashlib

    rows = sorted(rows, key=lambda r: r[1])
    if len(rows) <= s.sample_size:
        return [(r[1], "all") for r in rows]
    taken = {}
    for tier, ratio, ok in (
        ("deny", s.deny_sample_ratio, lambda r: r[2] == "deny"),
        ("risk", s.risk_sample_ratio, lambda r: (r[3] or 0) >= s.sample_score_threshold),
        ("bot", s.bot_sample_ratio, lambda r: (r[4] or 0) >= s.sample_score_threshold),
    ):
        eligible = [r[1] for r in rows if r[1] not in taken and ok(r)]
        taken.update({i: tier for i in eligible[: s.sample_quota(ratio)]})
    rest = sorted(
        (r[1] for r in rows if r[1] not in taken), key=lambda i: hashlib.md5(f"{i}:0".encode()).hexdigest()
    )
    fill = rest[: s.sample_size - len(taken)]
    return [*taken.items(), *((i, "fill") for i in fill)]


@pytest.mark.parametrize("size", [10, 50, 51, 400])
def test_sample_equals_brute_force(spark, size):
    rng = random.Random(size)
    rows = [
        (
            "w",
            f"e{i:04d}",
            rng.choice(["deny", "alert", "none"]),
            rng.choice([None, 10, 70, 90]),
            rng.choice([None, 5, 69, 95]),
        )
        for i in range(size)
    ]
    got = stats.priority_sample(events(spark, rows)).orderBy("sample_pos").collect()
    assert [(r.id, r.tier) for r in got] == brute_sample(rows, Settings())
    assert [r.sample_pos for r in got] == list(range(1, min(size, 50) + 1))


def test_sample_without_high_rows_fills_up(spark):
    rows = [("w", f"e{i:03d}", "none", None, None) for i in range(80)]
    tiers = [r.tier for r in stats.priority_sample(events(spark, rows)).collect()]
    assert tiers == ["fill"] * 50


def test_quotas():
    s = Settings()
    assert [s.sample_quota(r) for r in (s.deny_sample_ratio, s.risk_sample_ratio, s.bot_sample_ratio)] == [20, 15, 10]


def test_score_buckets_and_average(spark):
    df = spark.createDataFrame(
        [("w", v, None) for v in (-5, 0, 19, 20, 59, 79, 80, 100, 140)] + [("w", None, None)],
        "window_id string, bot_score int, user_risk_score int",
    )
    rows = {(r.score, r.bucket): r.n for r in stats.score_distribution(df).collect()}
    assert [rows["bot_score", b] for b in ("0-19", "20-39", "40-59", "60-79", "80-100")] == [3, 1, 1, 1, 3]
    assert all(n == 0 for (score, _), n in rows.items() if score == "user_risk_score")
    avg = stats.avg_scores(df).first()
    assert (avg.avg_bot_score, avg.avg_user_risk_score) == (54.67, 0.0)


def test_statistics_share_a_shuffle(spark):
    """Sums, top lists and busiest addresses come from one table of counts, shuffled once."""
    counts = spark.createDataFrame(
        [("b1", "ip", "a", None, None, 2, 1)],
        "batch_id string, kind string, value string, bot bigint, risk bigint, n bigint, denied bigint",
    )
    windows = spark.createDataFrame([("w", ["b1"])], "window_id string, poll_batch_ids array<string>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = stats.window_statistics(stats.window_counts_from_batches(windows, counts))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin [batch_id") == 1
    assert [r.unique_ips for r in found.collect()] == [1]


def test_severity_classes(spark):
    rows = [(0.6, True), (0.6, False), (0.5, True), (0.3, False), (0.15, True), (0.1, True), (0.0, True)]
    df = spark.createDataFrame(rows, "r double, c boolean")
    got = [r[0] for r in df.select(stats.severity_class(F.col("r"), F.col("c"))).collect()]
    assert got == ["critical", "high", "high", "high", "medium", "low", "info"]


def test_parse_response(spark):
    texts = [
        'Intro\n```json\n{"analysis":"A","severity":"high","flags":["x"],"notableIPs":["1.1.1.1"]}\n```\nend',
        '  {"analysis":"","totalEvents":7}\n',
        "no json here",
        "null",
        '```\n{"severity":"low"}\n```',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    r = sorted(stats.parse_response(df).drop("campaigns_detected").collect())
    assert (r[0].analysis, r[0].severity, r[0].flags, r[0].notable_ips) == ("A", "high", ["x"], ["1.1.1.1"])
    assert (r[1].analysis, r[1].severity, r[1].flags, r[1].total_events) == (texts[1], "info", [], 7)
    assert (r[2].analysis, r[2].severity, r[2].is_json) == ("no json here", "info", False)
    assert (r[3].analysis, r[3].is_json) == ("null", False)
    assert (r[4].analysis, r[4].severity) == (texts[4], "low")


# --- trends ---------------------------------------------------------------------------

SUMMARY = (
    "window_id string, config_id string, created_at timestamp, severity string, analysis string,"
    " event_count long, deny_count long, alert_count long, deny_ratio double, unique_ips long, flags array<string>,"
    " notable_ips array<string>, notable_patterns array<string>,"
    " top_rule_tags array<struct<key:string,count:long>>,"
    " top_countries array<struct<key:string,count:long>>, avg_bot_score double, avg_user_risk_score double"
)


def summaries(spark, *overrides):
    base = {
        "config_id": "c",
        "created_at": datetime(2026, 3, 20, 10),
        "severity": "medium",
        "analysis": "Sample batch analysis text.",
        "event_count": 100,
        "deny_count": 20,
        "alert_count": 3,
        "deny_ratio": 0.2,
        "unique_ips": 15,
        "flags": ["credential-stuffing"],
        "notable_ips": ["1.2.3.4"],
        "notable_patterns": ["brute-force login"],
        "top_rule_tags": [("CMD-INJ", 5), ("SQLI", 3)],
        "top_countries": [("US", 40), ("CN", 20)],
        "avg_bot_score": 65.0,
        "avg_user_risk_score": 45.0,
    }
    rows = [{"window_id": f"w{i}", **base, **o} for i, o in enumerate(overrides)]
    names = [f.split()[0] for f in SUMMARY.replace("struct<key:string,count:long>", "s").split(", ")]
    return spark.createDataFrame([tuple(r[n.strip()] for n in names) for r in rows], SUMMARY)


def test_severity_counts(spark):
    df = summaries(spark, *[{"severity": s} for s in ("critical", "high", "medium", "medium", "info", "odd")])
    assert trends.severity_counts(df).first().asDict() == {
        "critical": 1, "high": 1, "medium": 2, "low": 0, "info": 1}


def test_deny_ratio_trend_is_chronological(spark):
    df = summaries(
        spark,
        {"created_at": datetime(2026, 3, 20, 12), "deny_ratio": 0.5},
        {"created_at": datetime(2026, 3, 20, 11), "deny_ratio": None},
        {"created_at": datetime(2026, 3, 20, 10), "deny_ratio": 0.1},
    )
    assert [r.deny_ratio for r in trends.deny_ratio_trend(df).collect()] == [0.1, 0.0, 0.5]


def test_persistent_ips(spark):
    df = summaries(
        spark,
        {"notable_ips": ["1.2.3.4", "5.6.7.8"]},
        {"notable_ips": ["1.2.3.4", "9.10.11.12"]},
        {"notable_ips": ["1.2.3.4", "5.6.7.8"]},
        {"notable_ips": None},
    )
    assert [tuple(r) for r in trends.persistent_ips(df).collect()] == [("1.2.3.4", 3), ("5.6.7.8", 2)]


def test_tag_and_country_trends(spark):
    df = summaries(
        spark,
        {"top_rule_tags": [("SQLI", 10), ("XSS", 5)], "top_countries": [("US", 50)]},
        {"top_rule_tags": [("SQLI", 8), ("CMD-INJ", 0)], "top_countries": [("US", 30), ("DE", None)]},
        {"top_rule_tags": None, "top_countries": None},
    )
    assert [tuple(r) for r in trends.rule_tag_trend(df).collect()] == [("SQLI", 18), ("XSS", 5), ("CMD-INJ", 1)]
    assert [tuple(r) for r in trends.country_trend(df).collect()] == [("US", 80), ("DE", 1)]
    plain = df.withColumn("top_countries", F.array(F.lit("FR")))
    assert [tuple(r) for r in trends.country_trend(plain).collect()] == [("FR", 3)]


def test_empty_trends(spark):
    df = summaries(spark, {}).filter("false")
    assert set(trends.severity_counts(df).first().asDict().values()) == {0}
    assert trends.persistent_ips(df).count() == trends.deny_ratio_trend(df).count() == 0
    record = trends.strategic_summary(df, as_of=datetime(2026, 3, 21)).first()
    assert (record.status, record.analysis, record.total_events) == ("failed", "No batch analyses available.", 0)


def test_strategic_request_sections(spark):
    df = summaries(
        spark,
        {"severity": "critical", "analysis": "Critical finding here.", "notable_ips": ["1.2.3.4", "9.9.9.9"]},
        {"notable_ips": [], "top_countries": []},
    )
    prior = spark.sql(
        "select 's1' id, timestamp'2026-03-19 00:00:00' created_at, 'complete' status, 'Previous strategic assessment.' analysis"
    )
    text = trends.strategic_request(df, prior).first().request
    for part in (
        "The newest 2 windows", "Windows", '"event_count":100', "Windows By Severity",
        "Windows Of Note", "CRITICAL", "Critical finding here.", "Addresses: 1.2.3.4, 9.9.9.9",
        "Previous strategic assessment.", "## Recurring Addresses\nnone",
    ):
        assert part in text
    quiet = trends.strategic_request(
        summaries(spark, {"top_countries": [], "top_rule_tags": []}), time_range="24h"
    ).first().request
    assert "Time asked for: 24h" in quiet and "## Countries\nnothing known" in quiet
    assert "Windows Of Note" not in quiet and "Previous Assessment" not in quiet


def test_strategic_summary_with_response(spark):
    df = summaries(spark, *[{"created_at": datetime(2026, 3, 1 + i)} for i in range(25)])
    answer = stats.parse_response(
        spark.createDataFrame([('{"analysis":"calm","severity":"low","recommendations":["r"]}',)], "response string")
    )
    r = trends.strategic_summary(
        df, answer, as_of=datetime(2026, 3, 27), run_id="run-1", requested_by="a@b.c"
    ).first()
    assert (r.id, r.status, r.trigger_type, r.severity, r.recommendations) == (
        "run-1", "complete", "on_demand", "low", ["r"])
    assert (r.batch_summary_count, r.total_events, r.total_denies, r.total_alerts) == (20, 2000, 400, 60)
    assert r.batch_summary_ids[0] == "w24" and len(r.batch_summary_ids) == 20
    assert trends.strategic_summary(df, as_of=datetime(2026, 3, 27)).first().status == "running"


def test_batch_request_payload(spark, sf_dir):
    windows, table = src.windows(spark, sf_dir), src.events(spark, sf_dir)
    joined = stats.window_events(windows, table)
    summary = stats.window_summary(windows, table, settings=src.FIXTURE)
    for row in stats.batch_request(summary, joined, settings=src.FIXTURE).collect():
        body = json.loads(row.request)
        assert len(body["sampledEvents"]) == row.sampled <= 50
        assert body["metadata"]["denyRatio"].endswith("%")
        assert len(body["statistics"]["botScoreDistribution"]) == 5
        for event in body["sampledEvents"]:
            assert "" not in event["rules"]


def test_hourly_request_lists_all_or_the_newest(spark):
    df = summaries(spark, *[{"analysis": "x" * 600} for _ in range(23)]).withColumns(
        {"top_ips": F.col("top_countries"), "top_paths": F.col("top_countries"), "model_used": F.lit("haiku")}
    )
    row = trends.hourly_request(df).first()
    body = json.loads(row.request)
    assert row.batch_count == row.listed_count == len(body) == 23 and len(body[0]["analysis"]) == 500
    cut = trends.hourly_request(df, settings=Settings(summary_max_windows=20)).first()
    body = json.loads(cut.request)
    assert (cut.batch_count, cut.listed_count) == (23, 20)
    assert [e["n"] for e in body] == list(range(1, 21))
