"""Triggers and the fold, also against a plain sequential fold."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from wardline.operators.windows import analysis_windows, baseline_rate, poll_aggregate, route_tier
from wardline.operators.spend import budget_flags, budget_gate
from wardline.plans.inputs import window_calls
from wardline.settings import Settings

T0 = 1_704_067_200
SCHEMA = (
    "config_id string, batch_id string, poll_time timestamp, event_count long, deny_count long,"
    " alert_count long, monitor_count long"
)


def polls(spark, rows, config="c"):
    """rows: (seconds after T0, events, denies)"""
    data = [
        (config, f"b{i}", datetime.fromtimestamp(T0 + t, timezone.utc), n, d, 0, n - d)
        for i, (t, n, d) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def closed(spark, rows, **kw):
    out = analysis_windows(polls(spark, rows), **kw).orderBy("window_start").collect()
    return [(r.trigger_reason, r.event_count, r.deny_count, len(r.poll_batch_ids), r.was_escalated) for r in out]


def test_event_count(spark):
    assert closed(spark, [(0, 600, 0)]) == [("event_count", 600, 0, 1, False)]


def test_severity_escalation_overrides_count(spark):
    assert closed(spark, [(0, 600, 200)]) == [("severity_escalation", 600, 200, 1, True)]


def test_time_ceiling_needs_a_later_poll_or_as_of(spark):
    assert closed(spark, [(0, 10, 0)]) == []
    assert closed(spark, [(0, 10, 0), (300, 5, 0)]) == [("time_ceiling", 10, 0, 1, False)]
    late = datetime.fromtimestamp(T0 + 300, timezone.utc)
    assert closed(spark, [(0, 10, 0)], as_of=late) == [("time_ceiling", 10, 0, 1, False)]
    assert closed(spark, [(0, 10, 0)], as_of=late - timedelta(seconds=1)) == []


def test_accumulates_and_resets(spark):
    assert closed(spark, [(0, 200, 0), (30, 200, 0), (60, 200, 0), (90, 500, 0)]) == [
        ("event_count", 600, 0, 3, False),
        ("event_count", 500, 0, 1, False),
    ]


def test_spike_alone_closes(spark):
    quiet = [(30 * i, 10, 0) for i in range(120)]
    rows = analysis_windows(polls(spark, [*quiet, (3600, 200, 0)])).filter("was_escalated").collect()
    assert [(r.trigger_reason, r.event_count, r.deny_ratio) for r in rows] == [("severity_escalation", 200, 0.0)]


def test_baseline_forgets_after_an_hour(spark):
    df = baseline_rate(polls(spark, [(0, 60, 0), (60, 60, 0), (3600, 60, 0), (9000, 30, 0)]))
    rates = {r.batch_id: r.baseline_rate for r in df.collect()}
    assert rates == {"b0": 60.0, "b1": 120.0, "b2": 120 / 59, "b3": 30.0}


def test_deny_and_alert_count_in_both(spark):
    events = spark.createDataFrame(
        [("c", "b", datetime(2024, 1, 1), True, ["deny", "alert"]), ("c", "b", datetime(2024, 1, 1), False, ["monitor"])],
        "config_id string, batch_id string, poll_time timestamp, has_deny boolean, actions array<string>",
    )
    row = poll_aggregate(events).first()
    assert (row.event_count, row.deny_count, row.alert_count, row.monitor_count) == (2, 1, 1, 1)


def sequential(rows, s):
    """Brute force: one pass over one config's polls."""
    out, hour, cur, tick = [], [], None, 0
    t0 = rows[0][0]
    for t, n, d in rows:
        k = (t - t0) // s.time_ceiling_seconds
        if k > tick:
            if cur:
                out.append(("time_ceiling", cur["n"], cur["d"], cur["p"], False))
            cur, tick = None, k
        hour = [h for h in hour if h[0] > t - s.baseline_seconds] + [(t, n)]
        base = sum(h[1] for h in hour) / ((t - hour[0][0]) / 60 or 1)
        cur = cur or {"s": t, "n": 0, "d": 0, "p": 0}
        cur["n"] += n
        cur["d"] += d
        cur["p"] += 1
        deny = cur["d"] / cur["n"] >= s.deny_ratio_threshold
        spike = cur["n"] / max(1, (t - cur["s"]) / 60) > base * s.spike_multiplier
        if deny or spike or cur["n"] >= s.event_count_threshold:
            count = cur["n"] >= s.event_count_threshold and not deny
            out.append(("event_count" if count else "severity_escalation", cur["n"], cur["d"], cur["p"], deny or spike))
            cur = None
    return out


def test_fold_equals_sequential(spark):
    rng = random.Random(7)
    s = Settings(event_count_threshold=120, spike_multiplier=2.0)
    t, rows = 0, []
    for _ in range(600):
        t += rng.choice([5, 20, 30, 30, 45, 200, 900])
        n = rng.choice([1, 5, 20, 20, 60, 150])
        rows.append((t, n, rng.randint(0, n) if rng.random() < 0.3 else 0))
    got = closed(spark, rows, settings=s)
    assert got == sequential(rows, s)
    assert {r[0] for r in got} == {"time_ceiling", "event_count", "severity_escalation"}


def test_configs_do_not_mix(spark):
    both = polls(spark, [(0, 300, 0), (30, 300, 0)], "a").union(polls(spark, [(10, 300, 0), (40, 100, 0)], "b"))
    rows = analysis_windows(both).collect()
    assert [(r.config_id, r.event_count) for r in rows] == [("a", 600)]


def test_route_tier_agrees_with_the_gate_on_ties(spark):
    """Ten configs close at the same two moments; the cap is reached by the second call."""
    windows = None
    for i in range(10):
        own = analysis_windows(polls(spark, [(0, 600, 0), (60 + i % 2, 600, 300)], f"c{i}"))
        windows = own if windows is None else windows.unionByName(own)
    calls = window_calls(windows)
    settings = Settings(cap_nano_usd=2 * 600 * 150_000)
    order, block = ["call_ts", "call_seq"], F.floor(F.unix_seconds("call_ts") / 60)
    crossings = budget_flags(calls, order=order, block=block, settings=settings)
    gate = budget_gate(calls, order=order, block=block, settings=settings)
    admitted = sorted(r.call_seq for r in gate.filter("admitted").collect())
    routed = route_tier(windows, crossings).collect()
    assert sorted(r.window_id for r in routed) == admitted
    assert len(admitted) == 2 and windows.count() == 20
