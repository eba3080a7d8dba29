"""Operator inputs derived from the given tables.

``raw_lines`` turns every row of ``events`` into an undecoded NDJSON line of the raw shape,
with re-deliveries, damaged lines and one metadata line per poll. ``arrivals`` maps the same
rows straight to normalised form: it equals parsing and normalising ``raw_lines`` (a test
says so) and gives the later operators the plan they have over a stored event table.
"""

from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.normalize import DEFAULT_SOURCE
from wardline.operators.stats import window_summary
from wardline.operators.upkeep import upsert_events
from wardline.operators.windows import analysis_windows, poll_aggregate
from wardline.session import fan_out
from wardline.settings import Settings

# Thresholds for these tables: polls of half an hour hold few events each.
FIXTURE = Settings(event_count_threshold=30)
EPOCH_0 = 1_704_067_200
POLL_SPAN_SECONDS = 1_800
POLL_EVERY_SECONDS = 30
AS_OF = datetime(2024, 1, 31)

# Rules per event type: rule ids, actions, tags (a list may be shorter than the rules).
RULES = {
    "error": (["950002", "960010"], ["Deny", "alert"], ["INJECT/QUERY", "LEAK/LOGIN+é"]),
    "purchase": (["970001"], ["alert"], ["ODD/SHAPE"]),
    "click": (["990001"], ["monitor"], ["AUTO/CRAWL"]),
    "signup": (["973300", "973301"], ["alert", "monitor"], ["INJECT/MARKUP"]),
}
PATHS = ("/", "/account/enter", "/account/list", "/find", "/console", "/feed.xml", "")
COUNTRIES = ("US", "RU", "CN", "DE", "BR", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str) -> str:
    return "'" + value + "'"


def _list(values) -> str:
    return f"cast(array({', '.join(map(_text, values))}) as array<string>)"


def _per_type(render, default: str = "null") -> str:
    """SQL for a value per event type, from its rule ids, actions and tags."""
    arms = " ".join(f"when '{t}' then {render(*rules)}" for t, rules in RULES.items())
    return f"case event_type {arms} else {default} end"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivery of an event: every fiftieth is delivered again one poll later."""
    return (
        fan_out(table(spark, sf_dir, "events"), "event_id")
        .selectExpr(
            "event_id",
            "user_id",
            "event_type",
            "cast(get_json_object(props, '$.k') as int) as k",
            "floor(value / 5) as risk",
            "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) as _seconds",
            "explode(if(event_id % 50 = 0, array(0, 1), array(0))) as _late",
        )
        .selectExpr(
            "event_id",
            "event_type",
            "k",
            "risk",
            f"_seconds + {EPOCH_0} as epoch",
            f"_seconds div {POLL_SPAN_SECONDS} + _late as poll_no",
            f"{EPOCH_0} + {POLL_EVERY_SECONDS} * (_seconds div {POLL_SPAN_SECONDS} + _late)"
            " as poll_epoch",
            "concat('cfg-', user_id % 2) as config_id",
            "concat('req-', event_id) as request_id",
            "concat('198.51.', user_id div 256, '.', user_id % 256) as client_ip",
            f"get({_list(PATHS)}, cast(event_id % 7 as int)) as path",
            f"get({_list(COUNTRIES)}, cast(user_id % 6 as int)) as country",
        )
    )


def _line_pos(seq: str) -> str:
    return f"named_struct('file', '', 'block_start', 0L, 'seq', {seq}) as line_pos"


def _encoded(values: list[str]) -> str:
    """The delivered form of a rule list: ';'-joined base64 with '=' percent-encoded."""
    joined = ";".join(base64.b64encode(v.encode()).decode() for v in values)
    return _text(joined.replace("=", "%3D"))


# Where a field sits varies by event, so that every fall-through is taken; members that are
# null are left out of the JSON.
_DOCUMENT = f"""named_struct(
  'attackData', named_struct(
    'clientIP', if(event_id % 3 = 0, client_ip, null),
    'policyId', if(event_id % 2 = 0, 'pol-1', null),
    'rules', {_per_type(lambda ids, acts, tags: _list(ids))},
    'ruleActions', {_per_type(lambda ids, acts, tags: _encoded(acts))},
    'ruleTags', {_per_type(lambda ids, acts, tags: _encoded(tags))},
    'ruleMessages', {_per_type(lambda ids, a, t: _encoded([f"Rule {i} matched" for i in ids]))},
    'ruleVersions', {_per_type(lambda ids, acts, tags: _encoded(["4"] * len(ids)))}),
  'httpMessage', named_struct(
    'requestId', if(event_id % 5 <> 0, request_id, null),
    'start', if(event_id % 4 <> 0, cast(epoch as string), null),
    'protocol', 'HTTP/1.1',
    'method', if(event_id % 2 = 0, 'GET', 'POST'),
    'host', 'www.example.com',
    'port', '443',
    'path', path,
    'status', if(event_type = 'error', '403', '200'),
    'bytes', event_id % 5000,
    'requestHeaders', named_struct('User-Agent', 'Mozilla/5.0'),
    'clientIP', if(event_id % 3 = 1, client_ip, null)),
  'geo', named_struct('country', country),
  'requestId', if(event_id % 5 = 0, request_id, null),
  'start', if(event_id % 4 = 0, epoch, null),
  'clientIP', if(event_id % 3 = 2, client_ip, null),
  'policyId', if(event_id % 2 = 1, 'pol-2', null),
  'botScore', cast(k as string),
  'userRiskData', named_struct('score', cast(risk as string)))"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(config_id, poll_epoch, line_pos, value): undecoded lines as a poll delivers them."""
    d = deliveries(spark, sf_dir)
    # a damaged line repeats the first part of its event
    lines = d.selectExpr(
        "config_id",
        "poll_epoch",
        "event_id",
        f"to_json({_DOCUMENT}) as _text",
        "explode(if(event_id % 97 = 0, array(0, 1), array(0))) as _part",
    ).selectExpr(
        "config_id",
        "poll_epoch",
        _line_pos("event_id * 2 + _part"),
        "if(_part = 0, _text, substring(_text, 1, 40)) as value",
    )
    metadata = (
        d.groupBy("config_id", "poll_epoch", "poll_no")
        .agg(F.count("*").alias("total"))
        .selectExpr(
            "config_id",
            "poll_epoch",
            _line_pos(f"{2**62}L"),
            "to_json(named_struct('total', total, 'limit', 600000, 'offset', concat('o', poll_no)))"
            " as value",
        )
    )
    return lines.unionByName(metadata)


def _rule_structs(ids: list[str], actions: list[str], tags: list[str]) -> str:
    padded = tags + [""] * (len(ids) - len(tags))
    rules = ", ".join(
        f"named_struct('rule', '{rule}', 'rule_version', '4', 'rule_message', 'Rule {rule} matched',"
        f" 'rule_tag', '{tag}', 'rule_data', '', 'rule_selector', '', 'rule_action', '{action}')"
        for rule, action, tag in zip(ids, actions, padded)
    )
    return f"array({rules})"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events, one row per delivery."""
    actions = _per_type(
        lambda ids, acts, tags: _list([a.lower() for a in acts]), "cast(array() as array<string>)"
    )
    rules = _per_type(_rule_structs, f"cast(array() as {rules_type()})")
    summary = _per_type(lambda ids, acts, tags: _text(acts[0].lower()), "'none'")
    return (
        deliveries(spark, sf_dir)
        .selectExpr(
            "sha2(concat_ws(':', request_id, config_id, cast(epoch as string)), 256) as id",
            f"'{DEFAULT_SOURCE}' as source",
            "config_id",
            "if(event_id % 2 = 0, 'pol-1', 'pol-2') as policy_id",
            "concat_ws('@', config_id, cast(poll_epoch as string)) as batch_id",
            "client_ip",
            f"{rules} as decoded_rules",
            f"{summary} as rule_action_summary",
            "request_id",
            "timestamp_seconds(epoch) as event_time",
            "cast(epoch as double) as event_time_epoch",
            "'HTTP/1.1' as protocol",
            "if(event_id % 2 = 0, 'GET', 'POST') as method",
            "'www.example.com' as host",
            "'443' as port",
            "path",
            "if(event_type = 'error', '403', '200') as response_status",
            "country as geo_country",
            "nullif(cast(k as bigint), 0L) as bot_score",
            "nullif(cast(risk as bigint), 0L) as user_risk_score",
            "event_type = 'error' as has_deny",
            f"{actions} as actions",
            "timestamp_seconds(poll_epoch) as poll_time",
            _line_pos("event_id * 2"),
            "concat('o', poll_no) as offset",
            "poll_no",
        )
        .withColumn("rule_count", F.size("actions"))
    )


def rules_type() -> str:
    from wardline.schemas import RULE

    return f"array<{RULE.simpleString()}>"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table: the last delivery of every event."""
    return upsert_events(arrivals(spark, sf_dir))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poll_aggregate(arrivals(spark, sf_dir))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_windows(polls(spark, sf_dir), settings=FIXTURE)


def dated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows alone, dated like their records: enough for reports on counts."""
    return windows(spark, sf_dir).withColumn("created_at", F.col("closed_at"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window records with response fields that a rule derives from the statistics."""
    record = window_summary(windows(spark, sf_dir), events(spark, sf_dir), settings=FIXTURE)
    keys = F.transform("top_ips", lambda e: e["key"])
    return record.withColumns(
        {
            "analysis": F.concat(
                F.lit("Window "),
                "window_id",
                F.lit(": busiest [ip::"),
                F.coalesce(F.get(keys, F.lit(0)), F.lit("-")),
                F.lit("], then [ip::"),
                F.coalesce(F.get(keys, F.lit(1)), F.lit("-")),
                F.lit("]"),
            ),
            "flags": F.array("trigger_reason"),
            "notable_ips": F.slice(F.coalesce(keys, F.array().cast("array<string>")), 1, 3),
            "notable_patterns": F.transform(
                F.slice(F.col("top_rule_tags"), 1, 2), lambda e: e["key"]
            ),
        }
    )


def window_responses(window_rows: DataFrame) -> DataFrame:
    """A model's answers to three windows in four: fenced, bare with empty members, and plain; the
    plain one comes a second time and changes its mind."""
    kind = F.col("event_count") % 4
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Window "), "window_id").alias("analysis"),
            F.lit("high").alias("severity"),
            F.array("trigger_reason").alias("flags"),
            F.array(F.lit("198.51.0.1")).alias("notableIPs"),
        )
    )
    answers = window_rows.filter(kind < 3).select(
        "window_id",
        F.when(kind == 0, F.concat(F.lit("Result:\n```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.lit('{"analysis":"","severity":""}'))
        .otherwise("No verdict yet")
        .alias("response"),
        (F.col("event_count") * 300).alias("input_tokens"),
        (F.col("event_count") * 60).alias("output_tokens"),
        F.lit(1).alias("response_seq"),
    )
    again = answers.filter("response = 'No verdict yet'").withColumns(
        {"response": F.concat(F.lit("Quiet "), "window_id"), "response_seq": F.lit(2)}
    )
    return answers.unionByName(again)


def strategic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strategic record per config and hour of windows; every fifth hour failed."""
    hour = F.floor(F.unix_seconds("created_at") / 3600)
    return (
        dated_windows(spark, sf_dir)
        .groupBy("config_id", hour.alias("_hour"))
        .agg(
            F.sum("event_count").alias("total_events"),
            F.sum("deny_count").alias("total_denies"),
            F.max("created_at").alias("created_at"),
        )
        .select(
            F.concat_ws("-", F.lit("s"), "config_id", "_hour").alias("id"),
            "config_id",
            "created_at",
            F.when(F.col("_hour") % 5 == 0, "failed").otherwise("complete").alias("status"),
            F.lit("opus").alias("model"),
            F.when(F.col("total_denies") / F.col("total_events") >= 0.2, "medium")
            .otherwise("low")
            .alias("severity"),
            F.concat(F.lit("Hour of "), "config_id", F.lit(" with "), "total_events", F.lit(" events"))
            .alias("analysis"),
            "total_events",
            "total_denies",
        )
    )


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls from ``orders``: one per order, in order of the key."""
    tier = F.get(F.array(*[F.lit(t) for t in ("haiku", "sonnet", "opus", "unknown")]),
                 (F.col("o_orderkey") % 4).cast("int"))
    tokens = F.floor("o_totalprice").cast("bigint")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_seq"),
        F.col("o_orderdate").cast("timestamp").alias("call_ts"),
        tier.alias("tier"),
        tokens.alias("input_tokens"),
        F.floor(tokens / 4).alias("output_tokens"),
    )


def window_calls(window_rows: DataFrame) -> DataFrame:
    """The model call each window would make, sized by its events."""
    return window_rows.select(
        F.col("window_id").alias("call_seq"),
        F.col("closed_at").alias("call_ts"),
        F.when(F.col("was_escalated"), "sonnet").otherwise("haiku").alias("tier"),
        (F.col("event_count") * 300).alias("input_tokens"),
        (F.col("event_count") * 60).alias("output_tokens"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known users: the customers."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat("c_name", F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.lit("directory").alias("provider"),
        F.when(F.col("c_nationkey") == 0, "admin").otherwise("analyst").alias("role"),
        F.lit(None).cast("timestamp").alias("last_login_at"),
    )


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One login per order, by known and new emails; some lack the name, some the email."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("login_seq"),
            F.when(F.col("o_orderstatus") == "F", F.concat("c_name", F.lit("@example.com")))
            .when(F.col("o_orderstatus") == "O", F.concat("c_name", F.lit("@partner.example.com")))
            .alias("email"),
            F.when(
                F.col("o_orderpriority") != "5-LOW",
                F.concat("c_name", F.lit("/"), "o_orderstatus"),
            )
            .otherwise("")
            .alias("name"),
            F.lit("oidc").alias("provider"),
            F.col("o_orderdate").cast("timestamp").alias("login_at"),
        )
    )


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings changes from ``part``: the brand is the key, the size the value."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("key"),
        F.col("p_size").cast("string").alias("value"),
        F.col("p_partkey").alias("change_seq"),
        F.timestamp_seconds(F.lit(EPOCH_0) + F.col("p_partkey") * 60).alias("updated_at"),
        (F.col("p_partkey") % 1500).cast("string").alias("updated_by_user_id"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses around the text of ``conversations``: fenced, bare and plain."""
    kind = F.col("conv_id") % 3
    body = F.to_json(
        F.struct(
            F.concat(F.col("role"), F.lit(" turn [ip::198.51.0."), F.col("conv_id") % 256, F.lit("]"))
            .alias("analysis"),
            F.get(F.array(*[F.lit(s) for s in ("critical", "high", "")]), (F.col("turn") % 3).cast("int"))
            .alias("severity"),
            F.array(F.col("role")).alias("flags"),
            F.col("turn").alias("totalEvents"),
        )
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("response_id"),
        F.when(kind == 0, F.concat(F.lit("Assessment:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("  "), body, F.lit("\n")))
        .otherwise(F.col("text"))
        .alias("response"),
    )
