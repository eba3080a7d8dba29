"""Column contracts of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

RULE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "rule",
            "rule_version",
            "rule_message",
            "rule_tag",
            "rule_data",
            "rule_selector",
            "rule_action",
        )
    ]
)

# The other tables as DDL, which needs no session.
# Normalised events, in the order `normalize_events` returns them.
EVENT = (
    "id string, source string, config_id string, policy_id string, batch_id string,"
    f" client_ip string, decoded_rules array<{RULE.simpleString()}>, rule_action_summary string,"
    " request_id string, event_time timestamp, event_time_epoch double, protocol string,"
    " method string, host string, port string, path string, query string, request_headers variant,"
    " response_status string, response_bytes string, response_headers variant,"
    " geo_continent string, geo_country string, geo_city string, geo_region string, geo_asn string,"
    " bot_score bigint, bot_response_segment bigint, bot_client_data variant,"
    " user_risk_score bigint, user_risk_reasons array<string>, user_risk_uuid string,"
    " has_deny boolean, has_tarpit boolean, rule_count int, actions array<string>,"
    " poll_time timestamp, line_pos struct<file:string,block_start:bigint,seq:bigint>"
)
# What the streaming ingest writes, with the columns of its folders.
BRONZE = EVENT + ", event_date date, epoch bigint"
POLL_LOG = (
    "config_id string, batch_id string, poll_time timestamp, event_count bigint,"
    " deny_count bigint, alert_count bigint, monitor_count bigint, last_offset string, epoch bigint"
)
SKETCHES = "batch_id string, sketch binary, epoch bigint"
