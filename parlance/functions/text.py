"""Scalar text, time and conversion functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s   -     　\u0085\u001C-\u001F]"


def strip(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def first_filled(*xs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in xs])


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("bigint")


def segment_hash(text: Column, speaker: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.coalesce(speaker, F.lit(""))), 256)


def hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds; hours aren't wrapped."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def minutes_seconds(seconds: Column) -> Column:
    """M:SS, and a dash for nothing."""
    s = seconds.cast("bigint")
    return F.when(seconds.isNull() | (seconds == 0), F.lit("—")).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def file_size(size: Column) -> Column:
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", F.bround(size / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(size / (1024 * 1024), 1)))


def head_tail(x: Column, keep: int, marker: str) -> Column:
    """The first and last `keep` characters around a marker, where the text is longer than both."""
    return F.when(F.length(x) <= 2 * keep, x).otherwise(F.concat(F.substring(x, 1, keep), F.lit(marker), F.right(x, F.lit(keep))))


def stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def setting(kind: Column, value: Column) -> Column:
    """A setting's stored string as its kind writes it; text that means nothing becomes null."""
    low = F.lower(F.trim(value))
    return (
        F.when(kind == "bool", low.isin("true", "1", "yes", "on").cast("string"))
        .when(kind == "int", value.try_cast("bigint").cast("string"))
        .when(kind == "float", value.try_cast("double").cast("string"))
        .otherwise(F.when(low.isin("none", "null", ""), F.lit(None)).otherwise(value))
    )


def json_candidate(x: Column, first: str = "array") -> Column:
    """The JSON part of a model's answer: the text itself, else without fences, else the widest bracket pair."""
    bare = F.regexp_replace(F.trim(x), r"(?s)^```(?:json)?\s*|\s*```$", "")
    pair = [F.regexp_extract(x, r"(?s)\[.*\]", 0), F.regexp_extract(x, r"(?s)\{.*\}", 0)]
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(x), valid(bare), *[valid(p) for p in (pair if first == "array" else pair[::-1])])


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC normal form, which Spark has no function for."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def evaluation_text(x: Column) -> Column:
    return F.regexp_replace(nfkc(x), r"[。、！？,.!?]|\s+", "")


def collection_name(job_id: Column) -> Column:
    """What an index is called: the first eight characters of its job's id."""
    return F.substring(job_id.cast("string"), 1, 8)


def minutes_tenths(seconds: Column) -> Column:
    """M:SS.s, and a dash for nothing."""
    tenths = F.bround(seconds * 10, 0).cast("bigint")
    text = F.format_string("%d:%02d.%d", F.floor(tenths / 600), F.floor(tenths % 600 / 10), tenths % 10)
    return F.when(seconds.isNull() | (seconds == 0), F.lit("—")).otherwise(text)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC with the offset spelt out, and microseconds where there are any; the session's time zone has to be UTC."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def minute_stamp(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("—"))


def extensions(listed: Column) -> Column:
    """A comma-separated list of extensions as an array, lower-cased and each with its dot."""
    parts = F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(F.startswith(x, F.lit(".")), x).otherwise(F.concat(F.lit("."), x)))


def cache_key(model: Column, path: Column, extra: dict[str, Column] | None = None) -> Column:
    """SHA-256 of model, a bar, path, and the parameters as JSON with sorted keys."""
    parts = [model, F.lit("|"), path]
    if extra:
        pairs = [F.concat(F.lit(f'"{k}": '), F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)) for k, v in sorted(extra.items())]
        parts += [F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def json_or_empty(x: Column, schema: str) -> Column:
    """A JSON array, or an empty one where the text is null or broken."""
    return F.coalesce(F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), schema), F.from_json(F.lit("[]"), schema))
