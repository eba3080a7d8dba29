from wardline.streaming.ingest import (
    ingest_stream,
    read_bronze,
    read_poll_log,
    read_sketches,
    read_slice,
    stream_raw_ndjson,
)
from wardline.streaming.summaries import read_summaries, stream_polls, summarise_stream
from wardline.streaming.windows import STATE_STORE, stream_windows

__all__ = [
    "STATE_STORE",
    "ingest_stream",
    "read_bronze",
    "read_poll_log",
    "read_sketches",
    "read_slice",
    "read_summaries",
    "stream_polls",
    "stream_raw_ndjson",
    "stream_windows",
    "summarise_stream",
]
