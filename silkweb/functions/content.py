"""Kinds of content, the gate by content type, and JSON bodies printed as the web's own serialiser prints them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches


def to_text(data: str | bytes | None) -> str:
    return data.decode("utf-8", "replace") if isinstance(data, (bytes, bytearray)) else data or ""


def classify_content_type(content_type: str | None) -> str:
    """html, json or text."""
    value = (content_type or "").lower()
    return next((kind for kind in ("json", "html") if kind in value), "text")


def content_kind(content_type: Column) -> Column:
    value = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(value.contains("json"), "json").when(value.contains("html"), "html").otherwise("text")


def gate_passes(content_type: Column, allowed: list[str]) -> Column:
    """Whether the type holds one of the allowed texts, in their case; missing and empty types don't."""
    out = F.lit(False)
    for kind in allowed:
        out = out | content_type.contains(kind)
    return F.coalesce((content_type != "") & out, F.lit(False))


def skip_reason(content_type: Column) -> Column:
    return F.concat(F.lit("content-type: "), F.coalesce(content_type, F.lit("none")))


# --- JSON --------------------------------------------------------------------------------------------------------------


def js_number(x: float) -> str:
    """Shortest digits that give the double, with an exponent from 1e21 on and below 1e-6."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[lead:].rstrip("0") or "0", point - lead
    sign, n = "-" if x < 0 else "", len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def js_string(text: str) -> str:
    return '"' + re.sub('["\\\\\x00-\x1f\ud800-\udfff]', lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def _index_key(key: str) -> bool:
    return key == "0" or (key.isascii() and key.isdigit() and key[0] != "0" and int(key) < 2**32 - 1)


def js_object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """Members in the order objects keep: index keys ascending, then the others as they came; the last value stays."""
    members = dict(pairs)
    index = sorted((k for k in members if _index_key(k)), key=int)
    return {k: members[k] for k in [*index, *(k for k in members if not _index_key(k))]}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_strict(text: str) -> object:
    """The value of a JSON text; numbers are doubles. ValueError if it is none."""
    if text.startswith("\ufeff"):
        raise ValueError("byte order mark")
    return json.loads(text, parse_constant=_no_constant, parse_int=float, parse_float=float, object_pairs_hook=js_object)


def stringify(value: object, indent: int | None = None, depth: int = 0) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return js_number(float(value))
    if isinstance(value, str):
        return js_string(value)
    around, colon = ("{}", ": " if indent else ":") if isinstance(value, dict) else ("[]", "")
    items = [f"{js_string(k)}{colon}{stringify(v, indent, depth + 1)}" for k, v in value.items()] if colon else [stringify(v, indent, depth + 1) for v in value]
    if not items:
        return around
    if not indent:
        return around[0] + ",".join(items) + around[1]
    pad = "\n" + " " * indent * (depth + 1)
    return around[0] + pad + ("," + pad).join(items) + "\n" + " " * indent * depth + around[1]


def parse_json(data: str | bytes) -> tuple[str | None, str]:
    """(compact JSON of the value or None, pretty-printed content). What isn't JSON is content as it stands."""
    text = to_text(data)
    try:
        value = parse_strict(text)
    except (ValueError, RecursionError):
        return None, text
    return (None if value is None else stringify(value)), stringify(value, 2)


@F.pandas_udf(T.StructType().add("data", T.StringType()).add("content", T.StringType()))
def _parse_json_udf(bodies: pd.Series) -> pd.DataFrame:
    made = [(None, None) if b is None else parse_json(b) for b in bodies]
    return pd.DataFrame(made, columns=["data", "content"])


def parse_json_column(body: Column) -> Column:
    """struct<data, content> of a column of bodies; null bodies give nulls."""
    small_batches()
    return _parse_json_udf(body)
