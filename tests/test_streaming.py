"""Stream equals batch."""

import random
import re
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.operators.normalize import normalize_events
from wardline.operators.stats import (
    ip_sketches,
    unique_ips,
    unique_ips_from_sketches,
    value_counts,
    window_counts_from_batches,
    window_records,
    window_summary,
)
from wardline.operators.upkeep import upsert_events
from wardline.operators.windows import analysis_windows, poll_aggregate, window_polls
from wardline.plans import catalog
from wardline.plans import inputs as src
from wardline.schemas import EVENT
from wardline.settings import Settings
from wardline.sources import event_table
from wardline.sources.ndjson import event_docs, incremental_slice, parse_lines, read_raw_ndjson, tag_batch
from wardline.streaming import (
    ingest,
    ingest_stream,
    read_bronze,
    read_poll_log,
    read_slice,
    read_summaries,
    stream_polls,
    stream_raw_ndjson,
    stream_windows,
    summarise_stream,
)


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """The raw lines of a few hundred polls as files, one directory per poll and config."""
    path = str(tmp_path_factory.mktemp("landed") / "raw")
    src.raw_lines(spark, sf_dir).withColumn("day", F.floor((F.col("poll_epoch") - src.EPOCH_0) / 7200)).filter(
        "day = 1"
    ).repartition("config_id", "poll_epoch").sortWithinPartitions("poll_epoch", "line_pos").select(
        "value", "config_id", "poll_epoch"
    ).write.partitionBy("config_id", "poll_epoch").text(path)
    return path


def _ids(df):
    return sorted((r.id, r.batch_id) for r in df.select("id", "batch_id").collect())


def test_ingest_matches_batch(spark, sf_dir, landed, tmp_path):
    target = str(tmp_path)
    lines = stream_raw_ndjson(spark, landed, max_files_per_trigger=40)
    query = ingest_stream(lines, target, available_now=True)
    query.awaitTermination()
    assert query.exception() is None
    lo, hi = src.EPOCH_0 + 7200, src.EPOCH_0 + 14400
    expected = src.arrivals(spark, sf_dir).filter(
        F.unix_seconds("poll_time").between(lo, hi - 1)
    )
    got = read_bronze(spark, target)
    assert _ids(got) == _ids(expected)
    assert _ids(upsert_events(got)) == _ids(upsert_events(expected))

    polls = read_poll_log(spark, target)
    columns = ["batch_id", "event_count", "deny_count", "alert_count", "monitor_count"]
    assert sorted(map(tuple, polls.select(columns).collect())) == sorted(
        map(tuple, poll_aggregate(expected).select(columns).collect())
    )
    offsets = {r.batch_id: r.last_offset for r in polls.collect()}
    assert offsets == {
        r.batch_id: r.offset for r in expected.select("batch_id", "offset").collect()
    }
    # a restart on the same checkpoint finds nothing new
    again = ingest_stream(stream_raw_ndjson(spark, landed), target, available_now=True)
    again.awaitTermination()
    assert _ids(read_bronze(spark, target)) == _ids(expected)


def test_stream_feeds_the_table_once(spark, sf_dir, landed, tmp_path):
    """The table of the stream equals the batch view, also after the last micro-batch ran twice."""
    target, table = str(tmp_path / "out"), str(tmp_path / "table")

    def run():
        lines = stream_raw_ndjson(spark, landed, max_files_per_trigger=12)
        query = ingest_stream(lines, target, available_now=True, table=table, counts=True, file_rows=4)
        query.awaitTermination()
        assert query.exception() is None

    run()
    lo, hi = src.EPOCH_0 + 7200, src.EPOCH_0 + 14400
    arrived = src.arrivals(spark, sf_dir).filter(F.unix_seconds("poll_time").between(lo, hi - 1))
    expected = _ids(upsert_events(arrived))
    assert _ids(event_table.read_events(spark, table)) == expected
    commits = sorted((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert len(commits) >= 3
    counts = lambda df: sorted(map(repr, map(tuple, df.collect())))
    state = event_table.versions(spark, table), counts(event_table.read_counts(spark, table))
    # the driver was lost after the merge, before the stream noted the epoch
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert _ids(event_table.read_events(spark, table)) == expected
    assert _ids(read_bronze(spark, target)) == _ids(arrived)
    assert (event_table.versions(spark, table), counts(event_table.read_counts(spark, table))) == state
    # several files a day and epoch, each a range of ids
    files = list((tmp_path / "out" / "bronze").rglob("part-*.parquet"))
    assert len(files) > len({p.parent for p in files})
    live = event_table.read_events(spark, table)
    want = value_counts(live, key="batch_id").select(event_table.read_counts(spark, table).columns)
    assert state[1] == counts(want)


def test_lines_are_mapped_once(spark, landed, tmp_path, monkeypatch):
    """Bronze, poll log, sketches and the merge take one run of the normalisation."""
    mapped = spark.sparkContext.accumulator(0)

    def seen(_):
        mapped.add(1)
        return True

    counting = F.udf(seen, "boolean").asNondeterministic()
    monkeypatch.setattr(
        ingest, "normalize_events", lambda *args, **options: normalize_events(*args, **options).filter(counting("id"))
    )
    target, table = str(tmp_path / "out"), str(tmp_path / "table")
    query = ingest_stream(
        stream_raw_ndjson(spark, landed), target, available_now=True, table=table, counts=True, file_rows=100
    )
    query.awaitTermination()
    assert query.exception() is None
    assert mapped.value == read_bronze(spark, target).count() > 0


def test_files_that_land_twice(spark, tmp_path):
    """Within the remembered epochs a delivery is stored once; a later one is left to the merge."""
    raw, target, table = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "table")
    event = '{"httpMessage":{"requestId":"%s","start":"1704067200","status":"%s"}}'

    def land(epoch, name, *lines):
        folder = raw / "config_id=c" / f"poll_epoch={epoch}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("\n".join(lines))
        query = ingest_stream(
            stream_raw_ndjson(spark, str(raw)), target, available_now=True, table=table, remembered_epochs=2
        )
        query.awaitTermination()
        assert query.exception() is None

    stored = lambda: read_bronze(spark, target).count()
    land(100, "a", event % ("x", 200), event % ("y", 200), '{"total":2,"offset":"o1"}')
    land(100, "b", event % ("x", 200), event % ("z", 200))
    assert stored() == 3  # x came again in the next epoch
    land(200, "a", event % ("y", 500))
    assert stored() == 4  # a newer poll delivers y once more
    land(100, "c", event % ("x", 200))
    assert stored() == 5  # three epochs later x is stored again, and merged
    rows = {r.request_id: (r.batch_id, r.response_status) for r in event_table.read_events(spark, table).collect()}
    assert rows == {"x": ("c@100", "200"), "y": ("c@200", "500"), "z": ("c@100", "200")}
    log = {r.batch_id: r.event_count for r in read_poll_log(spark, target).collect()}
    assert log == {"c@100": 4, "c@200": 1}


def test_a_slice_reads_its_epochs(spark, sf_dir, landed, tmp_path):
    target = str(tmp_path)
    query = ingest_stream(stream_raw_ndjson(spark, landed, max_files_per_trigger=12), target, available_now=True)
    query.awaitTermination()
    log = read_poll_log(spark, target)
    bronze = read_bronze(spark, target)
    last = log.agg(F.max("poll_time")).first()[0]
    epochs = spark.read.parquet(f"{target}/poll_log").groupBy("epoch").agg(F.max("poll_time").alias("t"))
    newest = epochs.orderBy(F.desc("t"), "epoch").first().epoch
    # the offsets of the newest polls are missing: only from their first epoch on is read
    cut = epochs.where(F.col("epoch") < newest).agg(F.max("t")).first()[0] if newest else last
    for edge in (cut, last - timedelta(days=99)):
        some = log.withColumn("last_offset", F.when(F.col("poll_time") <= F.lit(edge), F.col("last_offset")))
        for as_of in (last, last + timedelta(days=60)):
            naive = as_of.replace(tzinfo=None)
            want = incremental_slice(bronze, some, naive)
            got = read_slice(spark, target, naive, log=some)
            assert _ids(got) == _ids(want)
    plan = read_slice(spark, target, last.replace(tzinfo=None))._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\n]*", plan)
    assert filters and not any(f.startswith("PartitionFilters: []") for f in filters) or "LocalTableScan" in plan


def test_records_are_stored_as_windows_close(spark, sf_dir, landed, tmp_path):
    """Poll log to windows to records, over restarts and a micro-batch of the ingest that ran twice."""
    raw, target, table = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "table")
    folders = sorted(Path(landed).glob("config_id=*/poll_epoch=*"), key=lambda p: int(p.name.split("=")[1]))
    some = Settings(event_count_threshold=2)

    def run(upto):
        for folder in folders[:upto]:
            new = raw / folder.relative_to(landed)
            if not new.exists():
                shutil.copytree(folder, new)
        query = ingest_stream(
            stream_raw_ndjson(spark, str(raw)), target, available_now=True, table=table, counts=True
        )
        query.awaitTermination()
        assert query.exception() is None
        closed = stream_windows(stream_polls(spark, target), settings=some)
        query = summarise_stream(closed, table, target, settings=some, available_now=True)
        query.awaitTermination()
        assert query.exception() is None

    assert read_summaries(spark, target) is None
    run(len(folders) // 2)
    commits = sorted((tmp_path / "out" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run(len(folders))
    got = read_summaries(spark, target)
    polls = poll_aggregate(read_bronze(spark, target))
    windows = analysis_windows(polls, settings=some)
    columns = ["window_id", "trigger_reason", "event_count", "deny_count", "closed_at"]
    rows = lambda df, cs: sorted(map(tuple, df.select(cs).collect()))
    assert rows(got, columns) == rows(windows, columns) and windows.count() > 20
    # windows whose events all stayed where they arrived have the records of the batch job
    batch = window_summary(windows, event_table.read_events(spark, table), settings=some)
    columns += ["stored_events", "unique_ips", "avg_bot_score", "severity", "model_used"]
    whole = lambda df: df.where("stored_events = event_count")
    assert rows(whole(batch), columns) == rows(whole(got.join(whole(batch).select("window_id"), "window_id")), columns)
    files = [f for f in window_records(windows, window_counts_from_batches(
        windows.limit(0).unionByName(got.select(windows.columns)), event_table.read_counts(spark, table)
    )).inputFiles() if "/table/data/" in f]
    assert files == []
    edge = got.agg(F.expr("percentile_approx(closed_at, 0.5)")).first()[0]
    late = read_summaries(spark, target, since=edge)
    assert 0 < late.count() < got.count()
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*closed_date", plan)


def test_a_config_is_no_task_of_its_own(spark, sf_dir):
    """Rows of a config meet its progress where they are, also where nothing is small enough to say so."""
    log = src.polls(spark, sf_dir).withColumn("last_offset", F.lit("o1"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = incremental_slice(src.arrivals(spark, sf_dir), log, datetime(2024, 1, 1, 12))
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_landed_files_are_compressed(spark, sf_dir):
    path = catalog._landed(spark, sf_dir)
    names = [r[0] for r in spark.read.text(path).select("_metadata.file_name").distinct().collect()]
    assert names and all(n.endswith(".gz") for n in names)
    keys = ["config_id", "poll_epoch", "value"]
    read, lines = read_raw_ndjson(spark, path).select(keys), src.raw_lines(spark, sf_dir).select(keys)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, lines.collect()))


def test_sketches_merge(spark):
    """Distinct addresses of windows from sketches per poll; the error against exact counts is small."""
    polls = [(f"b{i}", i) for i in range(8)]
    events = spark.range(200_000).select(
        F.concat(F.lit("b"), (F.col("id") % 8)).alias("batch_id"),
        F.concat(F.lit("a"), F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("client_ip"),
    )
    windows = spark.createDataFrame(
        [("w1", [b for b, _ in polls[:3]]), ("w2", [b for b, _ in polls[3:]]), ("w3", ["no"])],
        "window_id string, poll_batch_ids array<string>",
    )
    got = {r.window_id: r.unique_ips for r in unique_ips_from_sketches(windows, ip_sketches(events)).collect()}
    exact = unique_ips(events.join(window_polls(windows), "batch_id")).collect()
    assert set(got) == {"w1", "w2"}
    for r in exact:
        assert abs(got[r.window_id] - r.unique_ips) < 0.05 * r.unique_ips


def test_ingest_survives_idle_polls_and_keeps_every_event(spark, tmp_path):
    """First poll without events, one without metadata, an event that repeats a member."""
    raw, target = tmp_path / "raw", str(tmp_path / "out")

    def land(epoch, *lines):
        folder = raw / "config_id=c" / f"poll_epoch={epoch}"
        folder.mkdir(parents=True)
        (folder / "a.ndjson").write_text("\n".join(lines))

    def run():
        query = ingest_stream(stream_raw_ndjson(spark, str(raw)), target, available_now=True)
        query.awaitTermination()
        assert query.exception() is None

    event = '{"httpMessage":{"requestId":"%s","start":"1704067200","status":"200"}}'
    land(100, '{"total":0,"limit":10,"offset":"o9"}')
    run()
    assert read_bronze(spark, target).count() == 0
    land(200, event % "a", '{"httpMessage":{"requestId":"b","start":"1"},"httpMessage":'
         '{"requestId":"c","start":"1704067200"}}', "not json")
    run()
    land(300, '{"total":0,"limit":10,"offset":"o10"}', "")
    run()
    assert sorted(r.request_id for r in read_bronze(spark, target).collect()) == ["a", "c"]
    log = read_poll_log(spark, target).orderBy("poll_time").collect()
    assert [(r.event_count, r.last_offset) for r in log] == [(0, "o9"), (2, None), (0, "o10")]
    # progress survives the poll that named no offset
    left = incremental_slice(
        read_bronze(spark, target), read_poll_log(spark, target), datetime(1970, 1, 1, 0, 6)
    )
    assert left.count() == 0


def test_reading_before_the_first_micro_batch(spark, tmp_path):
    assert read_bronze(spark, str(tmp_path)).count() == 0
    assert read_poll_log(spark, str(tmp_path)).count() == 0


def test_event_schema_is_the_contract(spark, sf_dir):
    tagged = tag_batch(event_docs(parse_lines(src.raw_lines(spark, sf_dir))))
    contract = spark.createDataFrame([], EVENT).schema
    assert normalize_events(tagged).schema.simpleString() == contract.simpleString()


def test_stream_windows_match_batch(spark, sf_dir, tmp_path):
    polls = src.polls(spark, sf_dir).filter(F.unix_seconds("poll_time") < src.EPOCH_0 + 14400)
    folder = str(tmp_path / "polls")
    # three arrivals of files, in order
    for part in range(3):
        lo = src.EPOCH_0 + part * 4800
        polls.filter(F.unix_seconds("poll_time").between(lo, lo + 4799)).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        stream_windows(stream, settings=src.FIXTURE)
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("closed_windows")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert query.exception() is None
    batch = analysis_windows(polls, settings=src.FIXTURE)
    got = spark.table("closed_windows")
    assert got.columns == batch.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert rows(got) == rows(batch)
    assert got.count() > 50


def test_shuffled_and_split_polls_give_the_batch_windows(spark, sf_dir, tmp_path):
    """Files out of order by up to ten minutes; every fifth poll comes in two parts."""
    polls = src.polls(spark, sf_dir).filter(F.unix_seconds("poll_time") < src.EPOCH_0 + 14400)
    counters = ("event_count", "deny_count", "alert_count", "monitor_count")
    whole = sorted((r.asDict() for r in polls.collect()), key=lambda r: r["poll_time"])
    rng, arrivals = random.Random(4), []
    for i, r in enumerate(whole):
        parts = [r]
        if i % 5 == 0 and r["event_count"] > 1:
            first = {**r, **{c: r[c] // 2 for c in counters}}
            parts = [first, {**r, **{c: r[c] - first[c] for c in counters}}]
        arrivals += [(r["poll_time"].timestamp() + rng.uniform(0, 590), p) for p in parts]
    arrivals.sort(key=lambda a: a[0])
    folder = str(tmp_path / "polls")
    size = -(-len(arrivals) // 6)
    for at in range(0, len(arrivals), size):
        part = spark.createDataFrame([p for _, p in arrivals[at : at + size]], polls.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    # a last poll, ten minutes on, lets the waiting ones through; an idle one changes nothing
    last = max(r["poll_time"] for r in whole) + timedelta(minutes=10)
    ends = [
        {**r, "poll_time": last, "batch_id": f"end-{r['config_id']}"}
        for r in {r["config_id"]: r for r in whole}.values()
    ]
    ends += [{**ends[0], "batch_id": "idle", **{c: 0 for c in counters}}]
    extra = spark.createDataFrame(ends, polls.schema)
    extra.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (
        stream_windows(stream, lateness_seconds=600, settings=src.FIXTURE)
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("shuffled_windows")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert query.exception() is None
    batch = analysis_windows(polls.unionByName(extra), settings=src.FIXTURE)
    before = F.col("closed_at") <= F.lit(last - timedelta(minutes=10))
    rows = lambda df: sorted(map(tuple, df.filter(before).collect()), key=lambda r: r[0])
    got = rows(spark.table("shuffled_windows"))
    assert got == rows(batch) and len(got) > 50


def test_idle_flush_before_the_ceiling_is_refused(spark):
    with pytest.raises(ValueError):
        stream_windows(spark.range(1), idle_flush_seconds=10)


def test_idle_config_is_flushed(spark, sf_dir, tmp_path):
    """A quiet config's window closes by a timer, as the ceiling would close it."""
    import time

    polls = src.polls(spark, sf_dir).filter(F.unix_seconds("poll_time") == src.EPOCH_0 + 30)
    polls = polls.withColumn("deny_count", F.lit(0).cast("bigint"))
    folder = str(tmp_path / "polls")
    polls.coalesce(1).write.parquet(folder)
    expected = {r.config_id: r.event_count for r in polls.collect()}
    query = (
        stream_windows(
            spark.readStream.schema(polls.schema).parquet(folder),
            idle_flush_seconds=2,
            settings=Settings(time_ceiling_seconds=2),
        )
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("idle_windows")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        deadline = time.time() + 90
        while spark.table("idle_windows").count() < len(expected) and time.time() < deadline:
            time.sleep(1)
        rows = spark.table("idle_windows").collect()
    finally:
        query.stop()
    assert query.exception() is None
    assert {r.config_id: r.event_count for r in rows} == expected
    assert {r.trigger_reason for r in rows} == {"time_ceiling"}
    assert all((r.closed_at - r.window_start).total_seconds() == 2 for r in rows)
