from wardline.functions.blocked import next_value, running_sum
from wardline.functions.coerce import (
    decode_field,
    first_text,
    half_up,
    json_int,
    json_string,
    json_text,
    lenient_float,
    lenient_int,
    non_empty,
)
from wardline.functions.text import entity_refs, fenced_json, preview, score_band

__all__ = [
    "decode_field",
    "entity_refs",
    "fenced_json",
    "first_text",
    "half_up",
    "json_int",
    "json_string",
    "json_text",
    "lenient_float",
    "lenient_int",
    "next_value",
    "non_empty",
    "preview",
    "running_sum",
    "score_band",
]
