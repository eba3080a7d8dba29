"""Decode and flatten raw event documents into the event table.

Two projections: the first takes the raw texts out of the parsed document, each once; the
second derives every output column from them. Each output column is its own expression, so a
job that needs three columns extracts and decodes three: Catalyst drops the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.coerce import (
    decode_field,
    epoch_timestamp,
    first_text,
    lenient_float,
    lenient_int,
    present_text,
)
from wardline.settings import ACTION_PRIORITY

DEFAULT_SOURCE = "security-events"

# --- Fixed values: where the raw document keeps each field ----------------------------
RULE_LISTS = {
    "rule_version": "attackData.ruleVersions",
    "rule_message": "attackData.ruleMessages",
    "rule_tag": "attackData.ruleTags",
    "rule_data": "attackData.ruleData",
    "rule_selector": "attackData.ruleSelectors",
    "rule_action": "attackData.ruleActions",
}
# The first path with a value wins.
TEXT_FIELDS = {
    "policy_id": ("attackData.policyId", "policyId"),
    "client_ip": ("attackData.clientIP", "httpMessage.clientIP", "clientIP"),
    "protocol": ("httpMessage.protocol",),
    "method": ("httpMessage.method",),
    "host": ("httpMessage.host",),
    "path": ("httpMessage.path",),
    "query": ("httpMessage.query",),
    "geo_continent": ("geo.continent",),
    "geo_country": ("geo.country",),
    "geo_city": ("geo.city",),
    "geo_region": ("geo.regionCode",),
    "user_risk_uuid": ("userRiskData.uuid",),
}
# Texts that may arrive as numbers, where a zero means absent.
NUMERIC_TEXT_FIELDS = {
    "request_id": ("httpMessage.requestId", "requestId"),
    "start": ("httpMessage.start", "start"),
    "port": ("httpMessage.port",),
    "response_status": ("httpMessage.status",),
    "response_bytes": ("httpMessage.bytes",),
    "geo_asn": ("geo.asn",),
}
INT_FIELDS = {
    "bot_score": "botScore",
    "bot_response_segment": "botResponseSegment",
    "user_risk_score": "userRiskData.score",
}
OPEN_FIELDS = {
    "request_headers": "httpMessage.requestHeaders",
    "response_headers": "httpMessage.responseHeaders",
    "bot_client_data": "botData",
}
RULE_IDS = "attackData.rules"
RISK_REASONS = "userRiskData.reasons"
# ---------------------------------------------------------------------------------------


def _raw(path: str) -> Column:
    """The bound raw text of a path, or its open value or list."""
    return F.col(f"`_{path}`")


def _leaves() -> dict[str, str]:
    """The type that each path is taken out as."""
    texts = {
        *RULE_LISTS.values(),
        *INT_FIELDS.values(),
        *(p for paths in TEXT_FIELDS.values() for p in paths),
        *(p for paths in NUMERIC_TEXT_FIELDS.values() for p in paths),
    }
    return {
        **{p: "string" for p in sorted(texts)},
        **{p: "variant" for p in OPEN_FIELDS.values()},
        **{p: "array<string>" for p in (RULE_IDS, RISK_REASONS)},
    }


def _document_type(leaves: dict[str, str]) -> str:
    """One struct type over all the paths."""
    members: dict[str, dict[str, str]] = {}
    for path, kind in leaves.items():
        name, _, rest = path.partition(".")
        members.setdefault(name, {})[rest] = kind
    kinds = {name: below[""] if "" in below else _document_type(below) for name, below in members.items()}
    return f"struct<{', '.join(f'{name}: {kind}' for name, kind in kinds.items())}>"


def bind_texts(tagged: DataFrame, *, whole: bool = False) -> DataFrame:
    """Take every raw text out of ``doc`` once; unused ones are pruned.

    Looking up a path compares its names with those of the members before it. With ``whole``, for jobs that
    need most columns, one walk over the document takes all paths, and none is pruned.
    """
    leaves = _leaves()
    if whole:
        tagged = tagged.selectExpr("*", f"try_variant_get(doc, '$', '{_document_type(leaves)}') as _document")
    taken = "_document.{0}" if whole else "try_variant_get(doc, '$.{0}', '{1}')"
    bound = tagged.selectExpr(
        *[c for c in tagged.columns if c != "_document"],
        *[f"{taken.format(p, kind)} as `_{p}`" for p, kind in leaves.items()],
    )
    return bound.selectExpr(
        "*", f"transform(coalesce(`_{RULE_IDS}`, array()), r -> coalesce(r, 'null')) as _rule_ids"
    )


def text_field(name: str) -> Column:
    return first_text(*[_raw(p) for p in TEXT_FIELDS[name]])


def numeric_text_field(name: str) -> Column:
    return F.coalesce(
        *[
            present_text(_raw(p), F.try_variant_get("doc", f"$.{p}", "variant"))
            for p in NUMERIC_TEXT_FIELDS[name]
        ],
        F.lit(""),
    )


def int_field(name: str) -> Column:
    return lenient_int(_raw(INT_FIELDS[name]))


def rule_list(name: str) -> Column:
    return decode_field(_raw(RULE_LISTS[name]))


def _decoded(name: str) -> Column:
    """A decoded list; the actions, of which much is made, are bound by then."""
    return F.col("_rule_actions") if name == "rule_action" else rule_list(name)


def _at(values: Column, i: Column) -> Column:
    return F.coalesce(F.get(values, i), F.lit(""))


def assemble_rules() -> Column:
    """One struct per rule id. The lists align by position: short ones fill with '',
    surplus entries are dropped."""
    # One struct of decoded lists, bound once by the outer transform, so that no list is
    # decoded again per rule.
    bound = F.array(
        F.struct(
            F.col("_rule_ids").alias("ids"), *[_decoded(name).alias(name) for name in RULE_LISTS]
        )
    )
    return F.transform(
        bound,
        lambda b: F.transform(
            b["ids"],
            lambda rule, i: F.struct(
                rule.alias("rule"), *[_at(b[name], i).alias(name) for name in RULE_LISTS]
            ),
        ),
    )[0]


def rule_actions() -> Column:
    """Lower-cased action per rule, without decoding the other five lists."""
    bound = F.array(
        F.struct(F.col("_rule_ids").alias("ids"), _decoded("rule_action").alias("actions"))
    )
    return F.transform(
        bound,
        lambda b: F.transform(b["ids"], lambda _, i: F.lower(_at(b["actions"], i))),
    )[0]


def action_summary(actions: Column) -> Column:
    """The highest-priority action present, else 'none'."""
    summary = F.lit("none")
    for action in reversed(ACTION_PRIORITY):
        summary = F.when(F.array_contains(actions, action), action).otherwise(summary)
    return summary


def severity_indicators(actions: Column) -> dict[str, Column]:
    return {
        "has_deny": F.array_contains(actions, "deny"),
        "has_tarpit": F.array_contains(actions, "tarpit"),
        "rule_count": F.size(actions),
        "actions": F.array_distinct(actions),
    }


def event_id(request_id: Column, config_id: Column, start: Column) -> Column:
    return F.sha2(F.concat_ws(":", request_id, config_id, start), 256)


def _open(path: str) -> Column:
    """An open object, or null when it is missing or JSON null."""
    return F.when(~F.is_variant_null(_raw(path)), _raw(path))


def normalize_events(
    tagged: DataFrame, *, source: str = DEFAULT_SOURCE, whole: bool = False
) -> DataFrame:
    """Flat event rows from ``(config_id, batch_id, poll_time, line_pos, doc)``.

    ``whole``: for jobs that need most columns (see ``bind_texts``).
    """
    texts_bound = bind_texts(tagged, whole=whole).withColumn("_rule_actions", rule_list("rule_action"))
    bound = texts_bound.withColumns(
        {
            "_actions": rule_actions(),
            "_request_id": numeric_text_field("request_id"),
            "_start": numeric_text_field("start"),
        }
    )
    epoch = lenient_float(F.col("_start"))
    timed = bound.withColumn("event_time_epoch", epoch)
    indicators = severity_indicators(F.col("_actions"))

    def texts(*names: str) -> list[Column]:
        return [
            (text_field(n) if n in TEXT_FIELDS else numeric_text_field(n)).alias(n) for n in names
        ]

    return timed.select(
        event_id(F.col("_request_id"), F.col("config_id"), F.col("_start")).alias("id"),
        F.lit(source).alias("source"),
        "config_id",
        *texts("policy_id"),
        "batch_id",
        *texts("client_ip"),
        assemble_rules().alias("decoded_rules"),
        action_summary(F.col("_actions")).alias("rule_action_summary"),
        F.col("_request_id").alias("request_id"),
        epoch_timestamp(F.col("event_time_epoch")).alias("event_time"),
        "event_time_epoch",
        *texts("protocol", "method", "host", "port", "path", "query"),
        _open(OPEN_FIELDS["request_headers"]).alias("request_headers"),
        *texts("response_status", "response_bytes"),
        _open(OPEN_FIELDS["response_headers"]).alias("response_headers"),
        *texts("geo_continent", "geo_country", "geo_city", "geo_region", "geo_asn"),
        int_field("bot_score").alias("bot_score"),
        int_field("bot_response_segment").alias("bot_response_segment"),
        _open(OPEN_FIELDS["bot_client_data"]).alias("bot_client_data"),
        int_field("user_risk_score").alias("user_risk_score"),
        F.coalesce(_raw(RISK_REASONS), F.array().cast("array<string>")).alias("user_risk_reasons"),
        *texts("user_risk_uuid"),
        *[c.alias(name) for name, c in indicators.items()],
        "poll_time",
        "line_pos",
    )


def rules_long(events: DataFrame) -> DataFrame:
    """One row per (event, rule position); events without rules keep one row of nulls."""
    others = [c for c in events.columns if c != "decoded_rules"]
    return events.select(
        *others, F.posexplode_outer("decoded_rules").alias("rule_pos", "_rule")
    ).select(*others, "rule_pos", "_rule.*")
