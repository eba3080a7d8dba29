"""Seconds per headline query: the median of warm runs over ``$BENCH_SF_DIR``.

Prints one JSON line. Every run consumes the whole result (the ``noop`` sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardline.plans.catalog import QUERIES  # noqa: E402
from wardline.session import local_session  # noqa: E402

HEADLINE = (
    "read_raw_ndjson",
    "decode_fields",
    "map_fields",
    "poll_aggregate",
    "upsert_latest",
    "analysis_windows",
    "window_events",
    "top_ips",
    "top_rule_tags",
    "priority_sample",
    "window_summary",
    "batch_request",
    "complete_windows",
    "rule_tag_trend",
    "strategic_summary",
    "merge_events",
    "event_by_id",
    "query_events",
    "query_events_in_range",
    "ip_drilldown",
    "batch_page",
    "window_summary_from_counts",
    "export_csv",
    "analysis_stream",
    "daily_spend",
    "budget_gate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        # the first run compiles; it does not count
        seconds[name] = round(statistics.median(times[1:]), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
