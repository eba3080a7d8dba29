"""Export files and their manifest.

The data files are written by the executors; the manifest is an append-only log of status
rows next to them, its current view being the latest row per export.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.times import utc_literal
from wardline.operators.upkeep import upsert_latest

# --- Fixed values: exported names, in this order -------------------------------------
EVENT_FIELDS = {
    "id": "id",
    "source": "source",
    "configId": "config_id",
    "policyId": "policy_id",
    "batchId": "batch_id",
    "clientIP": "client_ip",
    "decodedRules": "decoded_rules",
    "ruleActionSummary": "rule_action_summary",
    "requestId": "request_id",
    "eventTime": "event_time",
    "eventTimeEpoch": "event_time_epoch",
    "protocol": "protocol",
    "method": "method",
    "host": "host",
    "port": "port",
    "path": "path",
    "query": "query",
    "requestHeaders": "request_headers",
    "responseStatus": "response_status",
    "responseBytes": "response_bytes",
    "responseHeaders": "response_headers",
    "geoContinent": "geo_continent",
    "geoCountry": "geo_country",
    "geoCity": "geo_city",
    "geoRegion": "geo_region",
    "geoASN": "geo_asn",
    "botScore": "bot_score",
    "botResponseSegment": "bot_response_segment",
    "botClientData": "bot_client_data",
    "userRiskScore": "user_risk_score",
    "userRiskReasons": "user_risk_reasons",
    "userRiskUUID": "user_risk_uuid",
}
RULE_FIELDS = (
    "rule",
    "ruleVersion",
    "ruleMessage",
    "ruleTag",
    "ruleData",
    "ruleSelector",
    "ruleAction",
)
CSV_FIELDS = (
    "id",
    "clientIP",
    "method",
    "path",
    "ruleActionSummary",
    "geoCountry",
    "botScore",
    "userRiskScore",
    "eventTime",
    "responseStatus",
)
# --------------------------------------------------------------------------------------

_RULES_TYPE = f"array<struct<{','.join(f'{f}:string' for f in RULE_FIELDS)}>>"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
OPTIONS = {
    "ndjson": {"ignoreNullFields": "false", "timestampFormat": _ISO},
    "csv": {
        "header": "true",
        "escape": '"',
        "emptyValue": "",
        "nullValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampFormat": _ISO,
    },
}

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("requested_by_user_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("actual_rows", T.LongType()),
        T.StructField("data_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def export_rows(
    events: DataFrame, criteria: dict[str, str] | None = None, limit: int | None = None
) -> DataFrame:
    """All events matching the equality criteria on any columns, or any ``limit`` of them."""
    for column, value in (criteria or {}).items():
        events = events.filter(F.col(column) == value)
    return events if limit is None else events.limit(limit)


def export_fields(events: DataFrame, *more: str) -> DataFrame:
    present = [(out, col) for out, col in EVENT_FIELDS.items() if col in events.columns]
    return events.select(
        *more,
        *[
            F.col(col).cast(_RULES_TYPE).alias(out)
            if out == "decodedRules"
            else F.col(col).alias(out)
            for out, col in present
        ]
    )


def write_ndjson(events: DataFrame, path: str) -> None:
    """One JSON object per line, null members kept."""
    export_fields(events).write.mode("errorifexists").options(**OPTIONS["ndjson"]).json(path)


def csv_fields(events: DataFrame) -> DataFrame:
    return export_fields(events).select(*CSV_FIELDS)


def write_csv(events: DataFrame, path: str) -> None:
    """Ten fixed columns with header; null is empty, quotes are doubled, times are ISO."""
    csv_fields(events).write.mode("errorifexists").options(**OPTIONS["csv"]).csv(path)


WRITERS = {"ndjson": write_ndjson, "csv": write_csv}


def run_export(
    spark: SparkSession,
    events: DataFrame,
    folder: str,
    export_id: str,
    *,
    fmt: str = "ndjson",
    criteria: dict[str, str] | None = None,
    limit: int | None = None,
    requested_by_user_id: str | None = None,
    as_of: datetime,
    finished: datetime | None = None,
) -> str:
    """Write one export and its status rows; returns the final status."""
    data_path = f"{folder}/data/{export_id}"
    request = {"id": export_id, "format": fmt, "user": requested_by_user_id}
    _log(spark, folder, [(request, 0, "pending", {}), (request, 1, "processing", {})], as_of)
    done = {"completed_at": finished or as_of}
    try:
        counted = Observation(f"export-{export_id}")
        rows = export_rows(events, criteria, limit).observe(
            counted, F.count(F.lit(1)).alias("rows")
        )
        WRITERS[fmt](rows, data_path)
        done |= {"actual_rows": int(counted.get["rows"]), "data_path": data_path}
        status = "complete"
    except Exception as error:  # the manifest records any failure
        done |= {"error": str(error)}
        status = "failed"
    _log(spark, folder, [(request, 2, status, done)], as_of)
    return status


def run_exports(
    spark: SparkSession,
    events: DataFrame,
    folder: str,
    requests: dict[str, dict[str, str]],
    *,
    fmt: str = "ndjson",
    requested_by_user_id: str | None = None,
    as_of: datetime,
    finished: datetime | None = None,
) -> str:
    """Write many exports (id to equality criteria) in one job over the events.

    Every event is handed to the exports it matches, and each export is a folder of the one data
    set; an event matched by several is written to each. All succeed or fail together.
    """
    data_path = f"{folder}/data/{min(requests)}-{len(requests)}"
    all_of = [{"id": i, "format": fmt, "user": requested_by_user_id} for i in sorted(requests)]
    started = [(r, seq, s, {}) for r in all_of for seq, s in enumerate(("pending", "processing"))]
    _log(spark, folder, started, as_of)
    done = {"completed_at": finished or as_of}
    try:
        matched = []
        for export_id, criteria in sorted(requests.items()):
            fits = F.lit(True)
            for column, value in criteria.items():
                fits = fits & (F.col(column) == value)
            matched.append(F.when(fits, F.lit(export_id)))
        counted = Observation(f"exports-{min(requests)}")
        rows = events.withColumn("export_id", F.explode(F.array_compact(F.array(*matched))))
        counts = [F.count_if(F.col("export_id") == i).alias(i) for i in sorted(requests)]
        fields = CSV_FIELDS if fmt == "csv" else None
        tagged = _with_export_id(rows.observe(counted, *counts), fields)
        tagged.write.mode("errorifexists").partitionBy("export_id").options(**OPTIONS[fmt]).format(
            "csv" if fmt == "csv" else "json"
        ).save(data_path)
        ended = [
            (r, 2, "complete", done | {
                "actual_rows": int(counted.get[r["id"]]),
                "data_path": f"{data_path}/export_id={r['id']}",
            })
            for r in all_of
        ]
    except Exception as error:  # the manifest records any failure
        ended = [(r, 2, "failed", done | {"error": str(error)}) for r in all_of]
    _log(spark, folder, ended, as_of)
    return ended[0][2]


def _with_export_id(rows: DataFrame, fields: tuple[str, ...] | None) -> DataFrame:
    out = export_fields(rows, "export_id")
    return out.select(*fields, "export_id") if fields else out


def _log(spark: SparkSession, folder: str, entries: list[tuple], as_of: datetime) -> None:
    """Append status rows, (request, seq, status, more), in one write."""
    def row(request: dict, seq: int, status: str, more: dict):
        at = more.get("completed_at")
        return F.struct(
            F.lit(request["id"]).alias("id"),
            F.lit(seq).alias("seq"),
            F.lit(status).alias("status"),
            F.lit(request["format"]).alias("format"),
            F.lit(request["user"]).cast("string").alias("requested_by_user_id"),
            utc_literal(as_of).alias("created_at"),
            (utc_literal(at) if at else F.lit(None).cast("timestamp")).alias("completed_at"),
            F.lit(more.get("actual_rows")).cast("bigint").alias("actual_rows"),
            F.lit(more.get("data_path")).cast("string").alias("data_path"),
            F.lit(more.get("error")).cast("string").alias("error"),
        )

    rows = spark.range(1).select(F.inline(F.array(*(row(*e) for e in entries))))
    rows.write.mode("append").json(f"{folder}/manifest")


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Current state per export. The data itself stays out of the view; ``has_data`` tells
    whether there is any."""
    return manifest_view(spark.read.schema(MANIFEST).json(f"{folder}/manifest"))


def manifest_view(manifest_log: DataFrame) -> DataFrame:
    return (
        upsert_latest(manifest_log, ["id"], ["seq"])
        .withColumn("has_data", F.col("data_path").isNotNull())
        .drop("data_path", "seq")
    )
