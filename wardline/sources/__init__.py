from wardline.sources.ndjson import (
    incremental_slice,
    line_quality,
    parse_lines,
    read_raw_ndjson,
    split_batch_metadata,
    tag_batch,
)

__all__ = [
    "incremental_slice",
    "line_quality",
    "parse_lines",
    "read_raw_ndjson",
    "split_batch_metadata",
    "tag_batch",
]
