"""Small value functions: hashes, media types, ratios, fences, citations, HTTP errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestral.functions.urls import strip


def content_hash(text: Column) -> Column:
    """SHA-256 of the text as it is; null for null."""
    return F.sha2(text, 256)


def media_type(content_type: Column) -> Column:
    return F.lower(strip(F.split_part(content_type, F.lit(";"), F.lit(1))))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def preview(claim: Column, size: int = 300) -> Column:
    return F.substring(claim, 1, size)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(F.bround(numerator / denominator, 4))


def retryable_status(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425, 429) | status.between(500, 599), F.lit(False))


def error_kind(status: Column) -> Column:
    return F.when(status.isNotNull(), "http_status").otherwise("transport")


def retryable(kind: Column, status: Column) -> Column:
    """Transport errors always, HTTP errors by status, anything else never."""
    return F.when(kind.isin("transport", "timeout"), True).when(kind == "http_status", retryable_status(status)).otherwise(False)


def unfence(c: Column) -> Column:
    """The body of a ``` or ```json fence, else the trimmed text."""
    value = strip(c)
    inner = F.regexp_extract(value, r"(?s)^```(?:json)?[ \t]*\r?\n(.*?)\r?\n?```$", 1)
    return F.when(value.rlike(r"(?s)^```(?:json)?[ \t]*\r?\n.*```$"), strip(inner)).otherwise(value)


def claims(c: Column) -> Column:
    """JSON array of claims of a response: a bare array, or an object with the sole key claims; else null."""
    body = F.try_parse_json(unfence(c))
    kind = F.schema_of_variant(body)
    wrapped = kind.startswith("OBJECT<claims: ARRAY<") & (F.size(F.json_object_keys(unfence(c))) == 1)
    return F.when(kind.startswith("ARRAY<"), body).when(wrapped, F.try_variant_get(body, "$.claims", "variant"))


def without_thoughts(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def citations(answer: Column) -> Column:
    """Numbers of the [S<n>] tokens in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[S([1-9][0-9]*)\]"), F.lit(1)), lambda x: x.cast("int")))


def token_count(text: Column) -> Column:
    """White-space separated tokens."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")).cast("long")


def valid_vector(v: Column, dimensions: int) -> Column:
    """Right size, all finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(prefix: str, order: Column) -> Column:
    """References such as D1, S2 from a 1-based order."""
    return F.concat(F.lit(prefix), order.cast("string"))
