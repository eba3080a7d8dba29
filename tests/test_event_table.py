"""The event table as files: versions, deltas, compaction, pruned lookups, purge."""

import re
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardline.operators import serving
from wardline.operators.stats import value_counts, window_counts_from_batches
from wardline.operators.upkeep import upsert_events
from wardline.plans import inputs as src
from wardline.session import fan_out
from wardline.sources import event_table, exports

KINDS = "id string, batch_id string, client_ip string, event_time timestamp, poll_time timestamp, line_pos int"
NARROW = KINDS + ", event_date date"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def schema_of(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", event_date date"


def key(df):
    return sorted(map(tuple, df.select("id", "batch_id").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the file scans of ``df`` hand on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if "Adaptive" not in plan.nodeName() else plan.executedPlan().collectLeaves()
    total, todo = 0, [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        leaf = todo.pop()
        if "QueryStage" in leaf.getClass().getSimpleName():
            inner = leaf.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif "Scan" in leaf.nodeName():
            total += leaf.metrics().apply("numOutputRows").value()
    return total


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("part-*") if "versions" not in p.parts}


def events(spark, n, *, day=0, poll=0, first=0, prefix="e"):
    """``n`` events of one day, delivered by one poll."""
    at = F.lit(T0) + F.make_dt_interval(days=F.lit(day))
    return spark.range(first, first + n).select(
        F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 8, "0")).alias("id"),
        F.lit(f"b{poll}").alias("batch_id"),
        F.concat(F.lit("10.0.0."), F.col("id") % 200).alias("client_ip"),
        (at + F.make_dt_interval(secs=(F.col("id") % 80000).cast("decimal(18,6)"))).alias("event_time"),
        (F.lit(T0) + F.make_dt_interval(mins=F.lit(poll))).alias("poll_time"),
        F.col("id").cast("int").alias("line_pos"),
    )


def test_merges_equal_the_view(spark, sf_dir, tmp_path):
    rows = src.arrivals(spark, sf_dir)
    at = F.floor((F.unix_seconds("poll_time") - src.EPOCH_0) / 30)
    for name, options in (("deltas", {}), ("compacted", {"delta_rows": 1, "file_rows": 300})):
        path = str(tmp_path / name)
        for part in (1, 0, 1):  # out of order, and one batch twice
            event_table.merge_events(spark, path, rows.filter(F.pmod(at, F.lit(2)) == part), **options)
        table = event_table.read_events(spark, path, schema_of(rows))
        assert key(table) == key(upsert_events(rows))
        kinds = {p.kind for p in event_table.parts(spark, path)[1]}
        assert ("base" in kinds) == (name == "compacted")
    # a settled table is read as it is: predicates reach the scan and nothing is exchanged by id
    event_table.compact_events(spark, path, schema=schema_of(rows))
    table = event_table.read_events(spark, path, schema_of(rows))
    assert key(table) == key(upsert_events(rows))
    plan = plan_of(serving.ip_drilldown(table, "198.51.0.7"))
    assert "EqualTo(client_ip,198.51.0.7)" in plan and "hashpartitioning" not in plan


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    event_table.merge_events(spark, path, events(spark, 50, poll=1))
    before, publish = key(event_table.read_events(spark, path, NARROW)), event_table._publish
    open_reader = event_table.read_events(spark, path, NARROW)

    def dies(*_):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(event_table, "_publish", dies)
    with pytest.raises(RuntimeError):
        event_table.merge_events(spark, path, events(spark, 80, poll=2))
    with pytest.raises(RuntimeError):
        event_table.compact_events(spark, path, schema=NARROW)
    assert key(event_table.read_events(spark, path, NARROW)) == before
    monkeypatch.setattr(event_table, "_publish", publish)
    # a version that was never finished is none, and its number is not used again
    (tmp_path / "events" / "versions" / "2").mkdir()
    event_table.merge_events(spark, path, events(spark, 80, poll=2))
    assert event_table.versions(spark, path) == [1, 3]
    assert key(event_table.read_events(spark, path, NARROW)) == key(events(spark, 80, poll=2))
    # what was opened before the merge still reads what it was, and so does its version
    assert key(open_reader) == before == key(event_table.read_events(spark, path, NARROW, version=1))
    event_table.vacuum_events(spark, path, keep=1)
    assert event_table.versions(spark, path) == [3]
    assert len(event_table.read_events(spark, path, NARROW).collect()) == 80
    assert len({p.parent.parent for p in files(tmp_path / "events" / "data")}) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    event_table.merge_events(spark, path, events(spark, 5))
    write = event_table._write

    def meanwhile(*args):
        monkeypatch.setattr(event_table, "_write", write)
        event_table.merge_events(spark, path, events(spark, 5, first=5))
        write(*args)

    monkeypatch.setattr(event_table, "_write", meanwhile)
    with pytest.raises(event_table.ConcurrentMerge):
        event_table.merge_events(spark, path, events(spark, 5, first=10))
    event_table.merge_events(spark, path, events(spark, 5, first=10))
    assert event_table.read_events(spark, path, NARROW).count() == 15


def test_a_merge_writes_its_batch(spark, tmp_path):
    """Bytes follow the batch, not the day; the budget of rows turns deltas into a base."""
    path = str(tmp_path / "events")
    event_table.merge_events(spark, path, events(spark, 20_000, poll=0))
    seen = files(tmp_path)
    for poll in range(1, 4):
        event_table.merge_events(spark, path, events(spark, 100, poll=poll, first=poll * 50))
    now = files(tmp_path)
    assert all(now[p] == t for p, t in seen.items())
    size = lambda ps: sum(p.stat().st_size for p in ps if "data" in p.parts)
    assert size(now.keys() - seen.keys()) < 0.2 * size(seen)
    assert [p.kind for p in event_table.parts(spark, path)[1]].count("delta") == 4
    table = event_table.read_events(spark, path, NARROW)
    assert table.count() == 20_000
    assert {r.batch_id: r["count"] for r in table.groupBy("batch_id").count().collect()} == {
        "b0": 19_800, "b1": 50, "b2": 50, "b3": 100
    }
    event_table.merge_events(spark, path, events(spark, 100, poll=4), delta_rows=20_000)
    lines = [p for p in event_table.parts(spark, path)[1] if p.kind in ("base", "delta")]
    assert [(p.kind, p.rows) for p in lines] == [("base", 20_000)]
    assert event_table.read_events(spark, path, NARROW).where("batch_id = 'b4'").count() == 100


def test_a_day_is_many_tasks(spark, tmp_path):
    path = str(tmp_path / "events")
    event_table.merge_events(spark, path, events(spark, 1_000_000), file_rows=100_000)
    assert len(files(tmp_path / "events" / "data")) == 10
    table = event_table.read_events(spark, path, NARROW)
    assert table.count() == 1_000_000
    # a lookup by id opens the one file whose bounds hold it, one by address the row groups that may
    one = serving.event_by_id(table, "e00777777")
    assert [r.client_ip for r in one.collect()] == ["10.0.0.177"]
    assert rows_scanned(serving.event_by_id(table, "e00777777")) <= 100_000
    assert rows_scanned(table.where("client_ip = '10.9.9.9'")) == 0
    assert rows_scanned(serving.event_by_id(table, "e0077777x")) <= 100_000
    assert rows_scanned(serving.event_by_id(table, "none")) == 0


def test_matching_rows_of_open_dates(spark, tmp_path):
    """A filter over base and deltas: an event that moved away or here is judged by its last delivery."""
    path = str(tmp_path / "events")
    moved = lambda df, ip: df.withColumn("client_ip", F.lit(ip))
    event_table.merge_events(spark, path, events(spark, 5000, poll=1))
    event_table.merge_events(spark, path, events(spark, 400, day=1, poll=1, prefix="f"))
    event_table.merge_events(spark, path, moved(events(spark, 3, poll=2, first=7), "10.0.0.50"))
    event_table.merge_events(spark, path, moved(events(spark, 1, poll=2, first=50), "10.9.9.9"))
    for ip in ("10.0.0.50", "10.9.9.9", "10.0.0.8", "none"):
        wanted = F.col("client_ip") == ip
        got = event_table.read_events(spark, path, NARROW, matching=wanted)
        assert key(got) == key(event_table.read_events(spark, path, NARROW).where(wanted))
    late = spark.createDataFrame([("z", "b9", "10.9.9.9", None, T0, 1)], KINDS)
    for _ in range(2):
        event_table.merge_events(spark, path, late)
    got = event_table.read_events(spark, path, NARROW, matching=F.col("client_ip") == "10.9.9.9")
    assert [r[0] for r in key(got)] == ["e00000050", "z"]
    assert "left_semi" in plan_of(got).lower() or "leftsemi" in plan_of(got).lower()


def test_replayed_epochs(spark, tmp_path):
    path = str(tmp_path / "events")
    put = lambda df, epoch, writer="q": event_table.merge_events(
        spark, path, df, writer=writer, epoch=epoch
    )
    assert put(events(spark, 30, poll=1), 0) and put(events(spark, 10, poll=2), 1)
    state = event_table.versions(spark, path), files(tmp_path)
    assert not put(events(spark, 10, poll=2), 1) and not put(events(spark, 30, poll=1), 0)
    assert state == (event_table.versions(spark, path), files(tmp_path))
    # another query has epochs of its own; an empty epoch is applied too
    assert put(events(spark, 5, poll=3), 0, "other") and put(events(spark, 0), 2)
    applied = {p.writer: p.epoch for p in event_table.parts(spark, path)[1] if p.kind == "applied"}
    assert applied == {"q": 2, "other": 0}


def counted(rows):
    return sorted(map(repr, map(tuple, rows.select(*[c.split()[0] for c in event_table.COUNTS.split(", ")]).collect())))


def test_counts_follow_moved_events(spark, sf_dir, tmp_path, monkeypatch):
    """Signed counts over merges out of order equal the counts of the rows that the table holds."""
    monkeypatch.setattr(event_table, "FOLD", 3)
    rows = src.arrivals(spark, sf_dir).drop("offset", "poll_no")
    path = str(tmp_path / "events")
    at = F.floor((F.unix_seconds("poll_time") - src.EPOCH_0) / 30)
    for part in (2, 0, 3, 1, 0):
        batch = rows.filter(F.pmod(at, F.lit(4)) == part)
        event_table.merge_events(spark, path, batch, counts=True, delta_rows=200)
    live = event_table.read_events(spark, path, schema_of(rows))
    assert key(live) == key(upsert_events(rows))
    assert counted(event_table.read_counts(spark, path)) == counted(value_counts(live, key="batch_id"))
    lines = [p.kind for p in event_table.parts(spark, path)[1]]
    assert lines.count("counts") <= 3 and lines.count("batches") <= 3


def test_time_ranges_prune_dates(spark, tmp_path):
    path = str(tmp_path / "events")
    for day in range(4):
        event_table.merge_events(spark, path, events(spark, 100, day=day, poll=day, first=day * 100))
    late = spark.createDataFrame([("z", "b9", "ip", None, T0, 1)], KINDS)
    event_table.merge_events(spark, path, late)
    table = event_table.read_events(spark, path, NARROW).withColumn(
        "event_time_epoch", F.unix_millis("event_time") / 1000
    )
    start = T0.timestamp() + 86_400
    found = serving.query_events(table, start=start, end=start + 86_399, limit=500)
    assert "PartitionFilters: [" in plan_of(found) and re.search(r"event_date#\d+ >= ", plan_of(found))
    assert found.count() == 100 and rows_scanned(found) == 101  # the day, and the row without a time
    assert serving.query_events(table, end=start - 1, limit=None).count() == 101
    assert serving.query_events(table, start=start - 0.5, end=1e300, limit=None).count() == 300
    assert serving.query_events(table, start=-5.5, end=start + 1e12, limit=None).count() == 400


def test_pages_of_a_batch(spark, tmp_path):
    """The index of the merges names a batch's dates; a page starts behind the last id."""
    path = str(tmp_path / "events")
    for day in range(5):
        event_table.merge_events(spark, path, events(spark, 200, day=day, poll=day, first=day * 200))
    event_table.merge_events(spark, path, events(spark, 40, day=4, poll=1, first=5000))
    assert set(event_table.batch_dates(spark, path, "b1")) == {date(2024, 1, 5), date(2024, 1, 2)}
    rows = event_table.read_batch(spark, path, "b1", NARROW)
    assert {re.search("event_date=([0-9-]+)", f)[1] for f in rows.inputFiles()} == {"2024-01-02", "2024-01-05"}
    seen, last, costs = [], None, []
    while True:
        page = serving.batch_page(rows, "b1", limit=100, after=last)
        costs.append(rows_scanned(page))
        found = sorted(r.id for r in page.collect() if r.id is not None)
        assert {r.total for r in page.collect()} == {240}
        if not found:
            break
        seen, last = seen + found, found[-1]
    assert seen == sorted(r.id for r in rows.collect()) and len(seen) == 240
    assert max(costs) <= 2 * costs[0]
    assert event_table.read_batch(spark, path, "none", NARROW).count() == 0
    assert event_table.batch_dates(spark, str(tmp_path / "no"), "b1") == []


def test_null_times_and_empty_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    kinds = "id string, event_time timestamp, poll_time timestamp, line_pos int"
    assert event_table.read_events(spark, path, kinds + ", event_date date").count() == 0
    rows = [
        ("a", T0, T0, 1),
        ("a", T0, T0 + timedelta(days=8), 1),  # delivered again, late
        ("b", T0, T0, 2),
        ("c", None, T0 + timedelta(days=8), 1),
        ("d", T0 - timedelta(days=2), T0, 1),
        ("e", T0 - timedelta(days=3), None, 1),
    ]
    event_table.merge_events(spark, path, spark.createDataFrame(rows, kinds))
    table = lambda: sorted(
        r.id for r in event_table.read_events(spark, path, kinds + ", event_date date").collect()
    )
    assert table() == ["a", "b", "c", "d", "e"]
    # a week later the first polls have expired: one date goes, another is rewritten, e has no poll time
    event_table.purge_events(spark, path, datetime(2024, 1, 9), kinds + ", event_date date")
    assert table() == ["a", "c", "e"]
    event_table.vacuum_events(spark, path, keep=1)
    assert table() == ["a", "c", "e"]
    # where whole dates expire, no event is read
    monkeypatch.setattr(event_table, "_live", lambda *_, **__: pytest.fail("events are read"))
    event_table.purge_events(spark, path, datetime(2024, 3, 9), kinds + ", event_date date")
    monkeypatch.undo()
    assert table() == ["e"]


def test_many_exports_in_one_job(spark, sf_dir, tmp_path):
    table, folder = src.events(spark, sf_dir), str(tmp_path)
    requests = {
        "us": {"geo_country": "US"},
        "us-deny": {"geo_country": "US", "rule_action_summary": "deny"},
        "none": {"geo_country": "no such"},
    }
    now = datetime(2024, 2, 1)
    assert exports.run_exports(spark, table, folder, requests, as_of=now) == "complete"
    view = {r.id: r for r in exports.export_manifest(spark, folder).collect()}
    for name, criteria in requests.items():
        want = exports.export_rows(table, criteria).count()
        assert (view[name].status, view[name].actual_rows) == ("complete", want)
        found = list((tmp_path / "data").glob(f"*/export_id={name}/*.json"))
        assert sum(len(p.read_text().splitlines()) for p in found) == want
    assert exports.run_exports(spark, table, folder, requests, as_of=now) == "failed"
    assert all(r.status == "failed" for r in exports.export_manifest(spark, folder).collect())


def test_counts_are_written_by_many_tasks(spark, sf_dir, tmp_path):
    path, rows = str(tmp_path / "t"), src.arrivals(spark, sf_dir)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        event_table.merge_events(spark, path, rows, counts=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "t" / "counts").rglob("part-*"))) > 1


def test_no_events_or_counts_are_broadcast(spark, sf_dir):
    rows = src.arrivals(spark, sf_dir).withColumn("event_date", F.to_date("event_time"))
    rows = rows.filter("poll_no < 20").localCheckpoint()
    counts = event_table._changes(rows, rows.filter("poll_no < 10"))
    assert "SortMergeJoin" in plan_of(counts) and "BroadcastExchange" not in plan_of(counts)
    polls = rows.groupBy("config_id").agg(F.collect_set("batch_id").alias("poll_batch_ids"))
    totals = window_counts_from_batches(
        polls.withColumnRenamed("config_id", "window_id").localCheckpoint(), counts.localCheckpoint()
    )
    assert "SortMergeJoin" in plan_of(totals) and "BroadcastExchange" not in plan_of(totals)


def test_changes_read_what_is_counted(spark, sf_dir, tmp_path):
    path = str(tmp_path / "rows")
    src.arrivals(spark, sf_dir).withColumn("event_date", F.to_date("event_time")).write.parquet(path)
    rows = spark.read.parquet(path)
    plan = event_table._changes(rows, rows.filter("poll_no < 10"))._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: [^\n]*", plan)
    assert len(schemas) == 2 and all("client_ip:string" in s for s in schemas)
    assert not any(re.search(r"host:|request_id:|rule_message:|actions:", s) for s in schemas)


def test_compaction_shuffles_once(spark, sf_dir, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), src.arrivals(spark, sf_dir)
    schema = schema_of(rows)
    for part in range(3):
        event_table.merge_events(spark, path, rows.filter(F.col("poll_no") % 3 == part))
    before, write, plans = key(event_table.read_events(spark, path, schema)), event_table._write, []

    def watched(found, *args):
        plans.append(plan_of(found))
        write(found, *args)

    monkeypatch.setattr(event_table, "_write", watched)
    monkeypatch.setattr(event_table, "_staged", lambda *_: pytest.fail("rows are written twice"))
    event_table.compact_events(spark, path, schema=schema, file_rows=100)
    assert [(p.count("Exchange"), p.count("Sort [")) for p in plans] == [(1, 1)]
    _, lines = event_table.parts(spark, path)
    assert {p.kind for p in lines} == {"base", "batches"}
    assert sum(p.rows for p in lines) == len(before)
    assert key(event_table.read_events(spark, path, schema)) == before == key(upsert_events(rows))
    for file in (tmp_path / "t" / "data").rglob(f"commit={lines[-1].commit}/*/part-*"):
        ids = [r.id for r in spark.read.parquet(str(file)).select("id").collect()]
        assert ids == sorted(ids)


def test_many_rows_are_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 8)
    assert fan_out(rows, "id", task_rows=50).rdd.getNumPartitions() == 20
    assert fan_out(rows, "id").rdd.getNumPartitions() == 8
