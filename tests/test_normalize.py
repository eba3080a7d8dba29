"""Golden pair and edge cases of decoding and normalising."""

import base64
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.functions import decode_field, json_text, lenient_float, lenient_int
from wardline.functions.coerce import epoch_timestamp
from wardline.operators.normalize import normalize_events, rules_long
from wardline.sources import ndjson

# The golden event; what it must become is in test_golden_event.
RAW = {
    "attackData": {
        "clientIP": "203.0.113.42",
        "rules": ["950002", "959073", "981243"],
        "ruleMessages": "U1FMIEluamVjdGlvbiBBdHRhY2s=;Q3Jvc3MtU2l0ZSBTY3JpcHRpbmc=;"
        "U1FMIEluamVjdGlvbiBBdHRhY2sgLSBDb21tb24gREIgTmFtZXM=",
        "ruleTags": "T1dBU1AvU1FMaQ==;T1dBU1AvWFNT;T1dBU1AvU1FMaQ==",
        "ruleData": "c2VsZWN0;PHNjcmlwdD4=;aW5mb3JtYXRpb25fc2NoZW1h",
        "ruleSelectors": "QVJHU19HRVQ6cQ==;QVJHU19HRVQ6cQ==;QVJHU19HRVQ6cQ==",
        "ruleActions": "ZGVueQ==;YWxlcnQ=;ZGVueQ==",
        "ruleVersions": "NA==;NA==;NA==",
        "policyId": "qik1_26545",
    },
    "httpMessage": {
        "requestId": "1a2b3c4d",
        "start": "1710950400",
        "protocol": "HTTP/1.1",
        "method": "GET",
        "host": "www.example.com",
        "port": "80",
        "path": "/api/users",
        "query": "id=1%20OR%201=1",
        "requestHeaders": {"User-Agent": "Mozilla/5.0", "Accept": "*/*"},
        "status": "403",
        "bytes": "1234",
        "responseHeaders": {"Content-Type": "text/html"},
        "clientIP": "203.0.113.42",
    },
    "geo": {"continent": "NA", "country": "US", "city": "ASHBURN", "regionCode": "VA", "asn": "14618"},
    "botScore": "82",
    "botResponseSegment": "3",
    "botData": {"anomalies": ["browser_fingerprint"]},
    "userRiskData": {
        "score": "75",
        "reasons": ["suspicious_ip", "credential_abuse"],
        "uuid": "risk-uuid-123",
    },
}


def normalized(spark, *docs, config="test-config-1"):
    lines = spark.createDataFrame(
        [(config, 1710950430, i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)],
        "config_id string, poll_epoch long, seq long, value string",
    ).select(
        "config_id",
        "poll_epoch",
        F.struct(F.lit("f").alias("file"), F.lit(0).alias("block_start"), "seq").alias("line_pos"),
        "value",
    )
    events = normalize_events(ndjson.tag_batch(ndjson.event_docs(ndjson.parse_lines(lines))))
    return sorted(events.drop("request_headers", "response_headers", "bot_client_data").collect(),
                  key=lambda r: r.line_pos.seq)


def test_golden_event(spark):
    (e,) = normalized(spark, RAW)
    # What the golden event becomes.
    assert e.id == "2ecf8294215b82d0af22c52bf8519e4f666706b01aacde217e0497652b95522b"
    assert [tuple(r) for r in e.decoded_rules] == [
        ("950002", "4", "SQL Injection Attack", "OWASP/SQLi", "select", "ARGS_GET:q", "deny"),
        ("959073", "4", "Cross-Site Scripting", "OWASP/XSS", "<script>", "ARGS_GET:q", "alert"),
        ("981243", "4", "SQL Injection Attack - Common DB Names", "OWASP/SQLi",
         "information_schema", "ARGS_GET:q", "deny"),
    ]
    assert e.rule_action_summary == "deny"
    assert (e.method, e.host, e.path, e.protocol) == ("GET", "www.example.com", "/api/users", "HTTP/1.1")
    assert (e.response_status, e.port, e.response_bytes) == ("403", "80", "1234")
    assert (e.geo_continent, e.geo_country, e.geo_city, e.geo_region, e.geo_asn) == (
        "NA", "US", "ASHBURN", "VA", "14618")
    assert (e.bot_score, e.bot_response_segment, e.user_risk_score) == (82, 3, 75)
    assert e.user_risk_reasons == ["suspicious_ip", "credential_abuse"]
    assert e.user_risk_uuid == "risk-uuid-123"
    assert e.event_time_epoch == 1710950400.0
    assert e.policy_id == "qik1_26545" and e.client_ip == "203.0.113.42"
    assert (e.has_deny, e.has_tarpit, e.rule_count, e.actions) == (True, False, 3, ["deny", "alert"])
    assert e.batch_id == "test-config-1@1710950430"


def test_open_objects_stay_open(spark):
    lines = spark.createDataFrame([("c", 1, json.dumps(RAW))], "config_id string, poll_epoch long, value string")
    events = normalize_events(
        ndjson.tag_batch(ndjson.parse_lines(lines.withColumn("line_pos", F.lit(1))))
    )
    row = events.select(
        F.variant_get("request_headers", "$['User-Agent']", "string").alias("ua"),
        F.variant_get("bot_client_data", "$.anomalies[0]", "string").alias("anomaly"),
    ).first()
    assert tuple(row) == ("Mozilla/5.0", "browser_fingerprint")


def test_other_config_other_id(spark):
    assert normalized(spark, RAW)[0].id != normalized(spark, RAW, config="other")[0].id


def test_missing_fields(spark):
    minimal, empty, null_attack = normalized(
        spark, {"httpMessage": {"requestId": "abc", "start": "1234567890"}}, {}, {"attackData": None}
    )
    assert minimal.client_ip == "" and minimal.geo_country == "" and minimal.bot_score is None
    assert minimal.user_risk_reasons == [] and minimal.decoded_rules == []
    assert minimal.rule_action_summary == "none" and minimal.event_time_epoch == 1234567890.0
    # neither request id nor start: one shared id per config
    assert empty.id == null_attack.id == hashlib.sha256(b":test-config-1:").hexdigest()
    assert empty.event_time is None


def test_falsy_values_fall_through(spark):
    doc = {
        "httpMessage": {"requestId": "", "start": 0, "port": 0, "status": "0", "bytes": 0.0, "clientIP": ""},
        "requestId": 77,
        "start": 1710950400.5,
        "clientIP": "198.51.100.9",
        "botScore": 0,
        "userRiskData": {"score": "12abc"},
    }
    (e,) = normalized(spark, doc)
    assert (e.request_id, e.client_ip, e.port, e.response_status, e.response_bytes) == (
        "77", "198.51.100.9", "", "0", "")
    assert e.event_time_epoch == 1710950400.5
    assert e.event_time.microsecond == 500_000
    assert e.bot_score is None and e.user_risk_score == 12
    assert e.id == hashlib.sha256(b"77:test-config-1:1710950400.5").hexdigest()


def b64(*values):
    return ";".join(base64.b64encode(v.encode()).decode() for v in values)


def test_rule_lists_align_by_position(spark):
    doc = {"attackData": {"rules": [1, "2", "3"], "ruleActions": b64("ALERT"), "ruleTags": b64("a", "b", "c", "d")}}
    (e,) = normalized(spark, doc)
    assert [(r.rule, r.rule_tag, r.rule_action, r.rule_message) for r in e.decoded_rules] == [
        ("1", "a", "ALERT", ""), ("2", "b", "", ""), ("3", "c", "", "")]
    assert e.rule_action_summary == "alert" and e.actions == ["alert", ""]


@pytest.mark.parametrize(
    "actions, summary",
    [(["monitor", "Tarpit", "slow"], "tarpit"), (["SLOW", "alert"], "slow"), (["other"], "none"), ([], "none")],
)
def test_action_priority(spark, actions, summary):
    doc = {"attackData": {"rules": list(range(len(actions))), "ruleActions": b64(*actions)}}
    assert normalized(spark, doc)[0].rule_action_summary == summary


def test_bad_and_metadata_lines(spark):
    good = {"httpMessage": {"requestId": "a"}}
    lines = [good, "{broken", "null", '{"total": 1, "offset": null}', '{"total": 5}', "17"]
    events = normalized(spark, *lines)
    # only documents with both members are metadata; a bare value is an event without fields
    assert [e.line_pos.seq for e in events] == [0, 4, 5]


def test_last_metadata_line_wins(spark):
    rows = [
        ("c", 1, i, v)
        for i, v in enumerate(['{"total":1,"offset":"o1"}', '{"a":1}', '{"total":2,"offset":"o2"}'])
    ]
    lines = spark.createDataFrame(rows, "config_id string, poll_epoch long, line_pos long, value string")
    events, metadata = ndjson.split_batch_metadata(ndjson.parse_lines(lines))
    assert events.count() == 1
    assert [tuple(r) for r in metadata.collect()] == [("c", 1, 2, "o2")]


def test_metadata_prefilter_misses_nothing(spark):
    lines = ['{"total":1,"offset":"o"}', '{"total":1,"\\u006fffset":"o"}', '{"total":1}']
    df = spark.createDataFrame([("c", 1, i, v) for i, v in enumerate(lines)],
                               "config_id string, poll_epoch long, line_pos long, value string")
    kept = df.filter(ndjson.may_be_metadata(F.col("value")))
    assert sorted(r.line_pos for r in kept.collect()) == [0, 1]
    both = [ndjson.parse_lines(d).filter(ndjson.is_metadata(F.col("doc"))).count() for d in (df, kept)]
    assert both == [2, 2]


def test_read_files(spark, tmp_path):
    folder = tmp_path / "config_id=c1" / "poll_epoch=100"
    folder.mkdir(parents=True)
    text = "\n".join(['{"httpMessage":{"requestId":"r1"}}', "", "   ", "{oops", '{"requestId":"r2"}'])
    (folder / "part.ndjson").write_text(text + "\n")
    lines = ndjson.read_raw_ndjson(spark, str(tmp_path))
    assert lines.count() == 3
    quality = ndjson.line_quality(lines).first()
    assert (quality.lines, quality.malformed, quality.metadata, quality.events) == (3, 1, 0, 2)
    ordered = ndjson.parse_lines(lines).orderBy("line_pos").select(
        F.coalesce(json_text(F.col("doc"), "$.httpMessage.requestId"), json_text(F.col("doc"), "$.requestId"))
    )
    assert [r[0] for r in ordered.collect()] == ["r1", "r2"]
    assert {(r.config_id, r.poll_epoch) for r in lines.collect()} == {("c1", 100)}


def decode(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", decode_field(F.col("v"))).collect())]


def test_decode_edges(spark):
    assert decode(
        spark, None, "", ";", "ZGVueQ==;YWxlcnQ", "dGVzdCt2YWx1ZQ==", "w6k%3D", "%zz;/w==", "ZGVue", "A", "QR=="
    ) == [[], [], ["", ""], ["deny", "alert"], ["test+value"], ["é"], ["�", "�"], ["den"], [""], ["A"]]
    assert len(decode(spark, "!!!invalid!!!")[0]) == 1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_decode_round_trip(spark, values):
    encoded = b64(*values)
    escaped = encoded.replace("=", "%3D").replace("+", "%2B")
    assert decode(spark, encoded, escaped) == ([values, values] if encoded else [[], []])


def test_lenient_numbers(spark):
    values = ["12", " 7x", "-5", "+3", "0", "", "abc", "0x1F", "99999999999", "1.9", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = sorted(df.select("i", lenient_int(F.col("v")), lenient_float(F.col("v"))).collect())
    assert [r[1] for r in rows] == [12, 7, -5, 3, None, None, None, 31, 99999999999, 1, None]
    assert [r[2] for r in rows] == [12.0, 7.0, -5.0, 3.0, None, None, None, None, 99999999999.0, 1.9, None]


def test_times_out_of_range_are_null(spark):
    df = spark.createDataFrame([(1e16,), (-1.5,), (1.0004,)], "s double")
    out = [r[0] for r in df.select(F.unix_micros(epoch_timestamp(F.col("s")))).collect()]
    assert out == [None, -1_500_000, 1_000_000]


def test_rules_long_keeps_events_without_rules(spark):
    df = spark.createDataFrame(
        [("a", [("1", "4", "", "t", "", "", "deny")]), ("b", [])],
        "id string, decoded_rules array<struct<rule:string,rule_version:string,rule_message:string,"
        "rule_tag:string,rule_data:string,rule_selector:string,rule_action:string>>",
    )
    rows = sorted((r.id, r.rule_pos, r.rule_tag) for r in rules_long(df).collect())
    assert rows == [("a", 0, "t"), ("b", None, None)]


def test_whole_documents_equal_single_paths(spark, sf_dir):
    """One walk over a document takes what every path by itself does, whatever stands there."""
    from wardline.plans import inputs as src

    odd = [
        json.dumps(RAW), "{}", "[]", "[{\"clientIP\": \"x\"}]", "7", '"text"', "true",
        '{"attackData": 1, "httpMessage": [1, {"host": "h"}], "geo": null, "userRiskData": "s"}',
        '{"attackData": null, "httpMessage": {"host": null, "port": 0, "status": 0.0, "bytes": false, "path": ["a"]}}',
        '{"attackData": {"rules": "950002", "ruleTags": {"a": 1}, "policyId": {"b": [2]}}, "clientIP": {"c": 3}}',
        '{"attackData": {"rules": [1, null, "x", [2], {"a": 3}, 1.5, true]}, "botScore": {}, "policyId": [4]}',
        '{"httpMessage": {"requestHeaders": null, "responseHeaders": [1], "bytes": 1e3, "start": 1704067200.5}}',
        '{"httpMessage": {"requestHeaders": "t", "requestId": 12345678901234567890, "start": 1e400}, "botData": 5}',
        '{"httpMessage": {"host": "a"}, "httpMessage": {"path": "/b"}, "requestId": "q", "requestId": true}',
        '{"userRiskData": {"reasons": ["a", null, 3, {"x": 1}], "score": "0x1F", "uuid": 1.0}, "botScore": 12.7}',
        '{"userRiskData": {"reasons": {"a": 1}, "score": -3}, "HTTPMESSAGE": {"HOST": "H"}, "GEO": {"country": "C"}}',
        '{"a.b": 1, "httpMessage.host": "dotted", "geo": {"country": "DE", "asn": 64500, "Country": "FR"}}',
    ]
    columns = "config_id string, poll_epoch bigint, line_pos struct<file:string,block_start:bigint,seq:bigint>, value string"
    rows = spark.createDataFrame([("c", 1704067200, ("f", 0, i), text) for i, text in enumerate(odd)], columns)
    for lines in (rows, src.raw_lines(spark, sf_dir)):
        tagged = ndjson.tag_batch(ndjson.event_docs(ndjson.parse_lines(lines)))
        one, each = (
            sorted(str(r.asDict(True)) for r in normalize_events(tagged, whole=w).withColumns(
                {c: F.to_json(c) for c in ("request_headers", "response_headers", "bot_client_data")}
            ).collect())
            for w in (True, False)
        )
        assert one == each and len(one) >= len(odd)


def test_direct_mapping_equals_parsed_lines(spark, sf_dir):
    """``inputs.arrivals`` is what parsing and normalising ``inputs.raw_lines`` gives."""
    from wardline.plans import inputs as src

    parsed = normalize_events(ndjson.tag_batch(ndjson.event_docs(ndjson.parse_lines(src.raw_lines(spark, sf_dir)))))
    direct = src.arrivals(spark, sf_dir)
    shared = [c for c in direct.columns if c in parsed.columns]
    assert len(shared) >= 24
    key = lambda r: str(r)
    left = sorted(map(tuple, parsed.select(shared).collect()), key=key)
    right = sorted(map(tuple, direct.select(shared).collect()), key=key)
    assert left == right
