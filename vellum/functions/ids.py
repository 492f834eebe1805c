"""Identifiers and lenient parsing of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of URLs in RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5) of a text, in built-in expressions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(doc: Column, model: Column, page: Column, kind: str, block: Column | None = None) -> Column:
    last = F.lit("page") if block is None else block.cast("string")
    return uuid5(F.concat_ws("|", doc, model, page.cast("string"), F.lit(kind), last))


def json_part(reply: Column) -> Column:
    """The JSON within a reply: without code fences, from the first { to the last }, else from [ to ]; null if there is none."""
    plain = F.regexp_replace(reply, r"(?m)^\s*```[A-Za-z]*\s*$", "")
    braces = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(braces != "", braces).otherwise(F.regexp_extract(plain, r"(?s)\[.*\]", 0)), F.lit(""))


def json_field(reply: Column, *names: str, kind: str = "string") -> Column:
    """The first of the named fields of a reply's JSON that is there; null where the JSON is broken."""
    v = F.try_parse_json(json_part(reply))
    return F.coalesce(*(F.try_variant_get(v, f"$.{n}", kind) for n in names))


def png_size(data: Column) -> Column:
    """STRUCT<width, height> of a PNG's header; null for other bytes."""
    ok = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    n = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("int")
    return F.when(ok, F.struct(n(17).alias("width"), n(21).alias("height")))


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.element_at(F.split(url, ",", 2), -1))


def int_or(value: Column, default: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("int"), default)
