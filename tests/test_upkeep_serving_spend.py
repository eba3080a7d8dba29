import csv
import io
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions import next_value, preview, running_sum, score_band
from wardline.operators import serving, spend, upkeep
from wardline.plans import inputs as src
from wardline.settings import Settings
from wardline.sources import exports, ndjson


def test_last_write_wins_also_for_a_hot_key(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.col("id").alias("seq"),
    )
    got = {r.key: r.seq for r in upkeep.upsert_latest(df, ["key"], ["seq"]).collect()}
    want = {}
    for i in range(20_000):
        want["hot" if i % 3 == 0 else f"k{i % 50}"] = i
    assert got == want


def test_upsert_is_pruned_before_the_shuffle(spark, sf_dir):
    plan = src.events(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retention_boundary(spark):
    df = spark.sql(
        "select timestamp'2024-01-24 00:00:00' ts, 1 i union all select timestamp'2024-01-23 23:59:59', 2"
        " union all select null, 3"
    )
    kept = upkeep.apply_retention(df, "events", datetime(2024, 1, 31), ts="ts").collect()
    assert sorted(r.i for r in kept) == [1, 3]


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_blocked_windows_equal_plain_ones(spark, block_rows):
    df = spark.range(500).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        (F.col("id") * 7 % 13).alias("v"),
    )
    block = F.floor(F.col("seq") / block_rows)
    got = running_sum(df, ["k"], ["seq"], block, "v", "before")
    got = next_value(got, ["k"], "seq", block, "v", "nxt")
    plain = df.selectExpr(
        "*",
        "coalesce(sum(v) over (partition by k order by seq rows between unbounded preceding and 1 preceding), 0) before",
        "lead(v) over (partition by k order by seq) nxt",
    )
    rows = lambda d: sorted(map(tuple, d.select("seq", "k", "v", "before", "nxt").collect()))
    assert rows(got) == rows(plain)


def test_incremental_slice(spark):
    events = spark.createDataFrame(
        [
            (c, p, datetime(1970, 1, 2, p), float(e))
            for c in ("fresh", "stale", "new")
            for p, e in ((0, 0), (1, 50_000), (2, 90_000))
        ],
        "config_id string, poll int, poll_time timestamp, event_time_epoch double",
    )
    log = spark.createDataFrame(
        [
            # opaque offsets; the newest poll returned none, which moves nothing
            ("fresh", datetime(1970, 1, 2), "o9"),
            ("fresh", datetime(1970, 1, 2, 1), "o10"),
            ("fresh", datetime(1970, 1, 2, 2), None),
            ("stale", datetime(1970, 1, 1), "x"),
            ("new", datetime(1970, 1, 2, 2), None),
        ],
        "config_id string, poll_time timestamp, last_offset string",
    )
    rows = ndjson.incremental_slice(events, log, datetime(1970, 1, 2, 2)).collect()
    got = sorted((r.config_id, r.poll) for r in rows)
    # 12 h before 26:00 is 50,400 s
    assert got == [("fresh", 2), ("new", 0), ("new", 1), ("new", 2), ("stale", 2)]


def test_upsert_users(spark):
    users = spark.createDataFrame(
        [("u1", "a@x", "Ann", "directory", "admin", None)],
        "id string, email string, name string, provider string, role string, last_login_at timestamp",
    )
    logins = spark.createDataFrame(
        [
            (1, "a@x", "", "oidc", datetime(2024, 1, 1)),
            (2, "b@x", "Bob", "oidc", datetime(2024, 1, 2)),
            (3, "b@x", "Rob", "oidc", datetime(2024, 1, 3)),
            (4, None, "Eve", "oidc", datetime(2024, 1, 4)),
        ],
        "login_seq int, email string, name string, provider string, login_at timestamp",
    )
    rows = {r.email: r for r in upkeep.upsert_users(users, logins).collect()}
    assert set(rows) == {"a@x", "b@x"}
    assert (rows["a@x"].name, rows["a@x"].role, rows["a@x"].provider) == ("Ann", "admin", "directory")
    assert (rows["b@x"].name, rows["b@x"].role, rows["b@x"].provider) == ("Rob", "analyst", "oidc")
    assert rows["a@x"].last_login_at == datetime(2024, 1, 1)


# --- serving ------------------------------------------------------------------------------


def served(spark):
    return spark.createDataFrame(
        [(f"e{i}", float(i) if i != 3 else None, "US" if i % 2 else "DE") for i in range(10)],
        "id string, event_time_epoch double, geo_country string",
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_time_range_is_searched_unless_asked_otherwise(spark):
    df = served(spark)
    late = serving.query_events(df, limit=3, end=8, time_filter="after_limit")
    assert sorted(ids(late)) == ["e7", "e8"]
    assert ids(serving.query_events(df, limit=3, end=6)) == ["e6", "e5", "e4"]
    # a null time passes the upper bound and fails the lower one
    assert "e3" in ids(serving.query_events(df, end=2))
    assert "e3" not in ids(serving.query_events(df, start=1))


def test_page_past_the_end_keeps_the_total(spark):
    df = served(spark).withColumn("batch_id", F.lit("b"))
    page = serving.batch_page(df, "b", limit=4, offset=8).collect()
    assert [(r.id, r.total) for r in page] == [("e8", 10), ("e9", 10)]
    past = serving.batch_page(df, "b", offset=50).collect()
    assert [(r.id, r.total) for r in past] == [(None, 10)]


def test_single_point_series_is_centred(spark):
    series = spark.sql("select timestamp'2024-01-01' time, 'w' window_id, 0L event_count, 0L deny_count")
    assert tuple(serving.scaled_series(series).first()) == (1, 100.0, 38.0, 38.0)


def test_preview_and_band(spark):
    df = spark.createDataFrame([("x" * 500, 80), ("y" * 501, 39), (None, None)], "t string, s int")
    rows = df.select(preview(F.col("t")), score_band(F.col("s"))).collect()
    assert [len(r[0]) for r in rows] == [500, 503, 0]
    assert [r[1] for r in rows] == ["critical", "low", ""]


# --- exports ------------------------------------------------------------------------------


def test_export_round_trips(spark, sf_dir, tmp_path):
    table = src.events(spark, sf_dir)
    folder, now = str(tmp_path), datetime(2024, 2, 1)
    status = exports.run_export(
        spark, table, folder, "x1", fmt="csv", criteria={"geo_country": "US"}, limit=None, as_of=now
    )
    assert status == "complete"
    want = table.filter("geo_country = 'US'").count()
    lines = [f for p in (tmp_path / "data" / "x1").glob("*.csv") for f in csv.DictReader(io.StringIO(p.read_text()))]
    assert len(lines) == want and tuple(lines[0]) == exports.CSV_FIELDS
    assert all(line["geoCountry"] == "US" for line in lines)

    assert exports.run_export(spark, table, folder, "x2", limit=7, as_of=now) == "complete"
    docs = [json.loads(t) for p in (tmp_path / "data" / "x2").glob("*.json") for t in p.read_text().splitlines()]
    assert len(docs) == 7 and all("userRiskScore" in d for d in docs)
    assert exports.run_export(spark, table, folder, "x2", as_of=now) == "failed"

    view = {r.id: r for r in exports.export_manifest(spark, folder).collect()}
    assert (view["x1"].status, view["x1"].actual_rows, view["x1"].has_data) == ("complete", want, True)
    assert view["x2"].status == "failed" and "x2" in view["x2"].error
    assert "data_path" not in exports.export_manifest(spark, folder).columns


def test_csv_quotes(spark, tmp_path):
    row = spark.sql(
        "select 'a,\"b\"' id, '' client_ip, 'GET' method, cast(null as string) path, 'deny' rule_action_summary, 'US' geo_country,"
        " cast(null as int) bot_score, 3 user_risk_score, timestamp'2024-01-01 00:00:00.5' event_time, '200' response_status"
    )
    exports.write_csv(row, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[1] == '"a,""b""",,GET,,deny,US,,3,2024-01-01T00:00:00.500Z,200'


# --- spend --------------------------------------------------------------------------------


def usage(spark, rows):
    return spark.createDataFrame(
        [(i, datetime(2024, 1, d), t, a, b) for i, (d, t, a, b) in enumerate(rows)],
        "call_seq long, call_ts timestamp, tier string, input_tokens long, output_tokens long",
    )


def test_prices(spark):
    m = 1_000_000
    df = usage(spark, [(1, t, m, m) for t in ("haiku", "sonnet", "opus", "unknown")])
    rows = spend.call_cost(df).orderBy("call_seq").collect()
    assert [r.cost_nano / 1e9 for r in rows] == [1.5, 18.0, 90.0, 0.0]
    small = spend.call_cost(usage(spark, [(1, "haiku", 2000, 800), (1, "opus", 10_000, 4_000)])).collect()
    assert 0.0001 < small[0].cost_nano / 1e9 < 0.01 and 0.1 < small[1].cost_nano / 1e9 < 1.0


def test_budget(spark):
    # 3 USD of output per call
    df = usage(spark, [(1, "sonnet", 0, 200_000)] * 5 + [(2, "sonnet", 0, 100_000), (2, "unknown", 9, 9)])
    gate = spend.budget_gate(df, settings=Settings(block_rows=2)).orderBy("call_seq").collect()
    assert [r.admitted for r in gate] == [True, True, True, True, False, True, True]
    flags = {str(r.date): (r.warning_call, r.cap_call) for r in spend.budget_flags(df).collect()}
    assert flags == {"2024-01-01": (1, 3), "2024-01-02": (None, None)}
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-03')) date")
    got = {str(r.date): r for r in spend.cost_summary(days, df).collect()}
    assert got["2024-01-01"].budget_remaining_usd == 0.0 and got["2024-01-01"].budget_cap_reached
    assert got["2024-01-02"].budget_remaining_usd == 8.5 and got["2024-01-02"].analysis_call_count == 1
    assert got["2024-01-03"].budget_remaining_usd == 10.0 and got["2024-01-03"].estimated_total_usd == 0.0
