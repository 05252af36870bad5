"""Date, map and JSON expressions of requests and registry."""

from __future__ import annotations

import base64
import binascii
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def created_or_now(ts: Column) -> Column:
    return F.coalesce(ts, F.current_timestamp())


def merge_first(a: Column, b: Column) -> Column:
    """Union of two maps; the first one's values win."""
    return F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))


def merge_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def group_kind(group_id: Column, owner_id: Column) -> Column:
    return F.when(group_id == F.concat(F.lit("memory-"), owner_id), "memory").when(group_id == F.concat(F.lit("resonance-"), owner_id), "resonance").otherwise("document")


def billable(kind: Column) -> Column:
    return kind != "resonance"


REQUEST = "owner_id string, `group` struct<id: string, label: string>, `groups` array<struct<id: string>>, tags array<string>, aggregate boolean, scope string, request_id string"


def parse_request(json: Column) -> Column:
    """A request with its defaults: personal scope, no aggregate, no tags; the owner in lower case."""
    r = F.from_json(json, REQUEST)
    r = r.withField("owner_id", F.lower(r["owner_id"])).withField("scope", F.coalesce(r["scope"], F.lit("personal")))
    return r.withField("aggregate", F.coalesce(r["aggregate"], F.lit(False))).withField("tags", F.coalesce(r["tags"], F.array().cast("array<string>")))


def parse_inputs(json: Column) -> Column:
    """A string or an array of strings, as an array."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array(F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x")))


@F.pandas_udf(ArrayType(FloatType()))
def _from_base64(t: pd.Series) -> pd.Series:
    def one(x):
        try:
            raw = base64.b64decode(x, validate=True) if x else b""
        except (binascii.Error, ValueError):
            return None
        return np.frombuffer(raw, "<f4").tolist() if raw and len(raw) % 4 == 0 else None

    return t.map(one, na_action="ignore")


def parse_vector(json: Column) -> Column:
    """An array of numbers, or a string of base64 little-endian float32; anything else is null and isn't indexed."""
    text = F.get_json_object(F.concat(F.lit('{"x":'), json, F.lit("}")), "$.x")
    return F.when(F.trim(json).startswith("["), F.from_json(json, "array<float>")).when(F.trim(json).startswith('"'), _from_base64(text))


def values_as_sets(m: Column) -> Column:
    """A map whose values become arrays of one, as where an owner becomes a set of owners."""
    return F.transform_values(m, lambda _, v: F.array(v))


def request_body(fields: dict[str, Column]) -> Column:
    """A request as JSON; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))))


def query_items(fields: dict[str, Column]) -> Column:
    """A request as a query string, in order of name; null fields are left out, all else is percent-encoded."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20")))) for n, c in sorted(fields.items())]
    return F.concat_ws("&", *parts)


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def event_line(payload: Column, fields: list[str] | None = None) -> Column:
    """One server-sent event; with the names of the payload's fields, in snake case and sorted."""
    if fields is not None:
        payload = F.struct(*(payload[f].alias(snake(f)) for f in sorted(fields, key=snake)))
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))


def least_by(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The least value of each key, as a map built from pairs keeps it."""
    return rows.groupBy(*key).agg(F.min(value).alias(value))


def four_digits(x: Column) -> Column:
    return F.format_string("%.4f", x)
