"""Text helpers for reports and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: formats of model responses and the score bands ------------------
FENCE = r"```(?:json)?\s*\n([\s\S]*?)\n```"
MARKER = r"\[{kind}::([^\]]+)\]"
BANDS = ((80, "critical"), (60, "high"), (40, "medium"))
# ------------------------------------------------------------------------------------


def preview(text: Column, size: int = 500) -> Column:
    """Cut to ``size`` characters, with '...' only when something was cut."""
    text = F.coalesce(text, F.lit(""))
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def score_band(score: Column) -> Column:
    band = F.when(score.isNull(), "")
    for least, name in BANDS:
        band = band.when(score >= least, name)
    return band.otherwise("low")


def entity_refs(text: Column, kind: str) -> Column:
    """All X of ``[kind::X]`` markers, in order."""
    return F.regexp_extract_all(text, F.lit(MARKER.replace("{kind}", kind)), F.lit(1))


def fenced_json(text: Column) -> Column:
    """First fenced block of a response, or the whole response, as a parsed document.

    Null when that is no JSON document.
    """
    body = F.when(F.regexp_like(text, F.lit(FENCE)), F.regexp_extract(text, FENCE, 1)).otherwise(
        text
    )
    parsed = F.try_parse_json(F.btrim(body, F.lit(" \t\r\n")))
    return F.when(~F.is_variant_null(parsed), parsed)
