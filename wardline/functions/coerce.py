"""Column expressions for the loosely typed input: everything stays in the JVM.

Raw events carry numbers as strings, strings as numbers, and use '' / 0 / null for
"not there" interchangeably, so a field falls through to the next candidate when it is
any of those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First non-empty candidate, else ''."""
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def json_string(doc: Column, path: str) -> Column:
    """Raw text of a JSON member; null when missing."""
    return F.try_variant_get(doc, path, "string")


def present_text(text: Column, member: Column) -> Column:
    """``text`` unless it stands for "absent": empty, a zero or false.

    ``text`` is the raw text of ``member``. Only real zeros and booleans count as absent, the
    string "0" is kept; the member's type is looked up just for the spellings where it
    matters. Bind ``text`` in a projection of its own, as it is used several times.
    """
    kind = F.schema_of_variant(member)
    return (
        F.when(text == "", F.lit(None))
        .when(text.isin("0", "0.0", "false"), F.when(kind == "STRING", text))
        # a float such as 1e3 prints as 1000.0 here and as 1000 in the id hash
        .when(text.endswith(".0") & (kind == "DOUBLE"), F.regexp_replace(text, r"\.0$", ""))
        .otherwise(text)
    )


def json_text(doc: Column, path: str) -> Column:
    """Text of one JSON member; null when missing, empty, zero or false."""
    return present_text(json_string(doc, path), F.try_variant_get(doc, path, "variant"))


def json_int(doc: Column, path: str) -> Column:
    return lenient_int(json_string(doc, path))


def lenient_int(text: Column) -> Column:
    """Leading integer of a text; 0 and non-numbers become null."""
    hexadecimal = F.regexp_extract(text, r"^\s*[+-]?0[xX]([0-9a-fA-F]+)", 1)
    sign = F.when(F.ltrim(text).startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    decimal = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    value = F.when(
        hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("bigint") * sign
    ).otherwise(decimal.try_cast("bigint"))
    return F.nullif(value, F.lit(0).cast("bigint"))


def lenient_float(text: Column) -> Column:
    """Leading float of a text; 0 and non-numbers become null."""
    number = F.regexp_extract(
        text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    ).try_cast("double")
    return F.nullif(number, F.lit(0.0))


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds to a timestamp at millisecond precision; null beyond the date range."""
    millis = F.signum(seconds) * F.floor(F.abs(seconds * 1000))
    return F.when(F.abs(millis) <= F.lit(8.64e15), F.timestamp_millis(millis.cast("bigint")))


def half_up(col: Column, decimals: int) -> Column:
    """Round half up on the scaled double, as floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**decimals)
    return F.floor(col * scale + 0.5).cast("double") / scale


_WELL_FORMED = "^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def _repaired(segment: Column) -> Column:
    """Accept the url-safe alphabet, drop anything else, repair the length."""
    clean = F.translate(F.regexp_replace(segment, r"[^A-Za-z0-9+/_\-]", ""), "-_", "+/")

    def pad(c: Column) -> Column:
        usable = F.length(c) - (F.length(c) % 4 == 1).cast("int")
        return F.rpad(
            F.substring(c, F.lit(1), usable), (F.ceil(usable / 4) * 4).cast("int"), "="
        )

    # "let" over a one-element array: the cleaned text is used four times
    return F.transform(F.array(clean), pad)[0]


def _decode_segment(segment: Column) -> Column:
    base64 = F.when(segment.rlike(_WELL_FORMED), segment).otherwise(_repaired(segment))
    return F.make_valid_utf8(F.unbase64(base64).cast("string"))


def decode_field(encoded: Column) -> Column:
    """Percent-decode, split on ';', base64-decode each part. Null or '' gives [].

    Never throws: undecodable characters are dropped, bad UTF-8 is replaced.
    """
    # '+' is a base64 digit here, and a '%' not followed by two hex digits is literal.
    unescaped = F.when(encoded.contains("%"), F.try_url_decode(
        F.replace(
            F.regexp_replace(encoded, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
        )
    )).otherwise(encoded)
    return F.when(
        F.coalesce(encoded, F.lit("")) == "", F.array().cast("array<string>")
    ).otherwise(F.transform(F.split(unescaped, ";"), _decode_segment))
