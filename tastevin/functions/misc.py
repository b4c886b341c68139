"""Hashes, times and small helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the values joined by the unit separator; null, 0 and '' are all ''."""
    blank = [F.coalesce(F.when(c.cast("string").isin("0", "0.0"), "").otherwise(c.cast("string")), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *blank), 256)


def stable_hash(*columns: Column) -> Column:
    """SHA-256 of the compact JSON object of the columns, which the caller gives in order of name."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def parse_time(column: Column) -> Column:
    """Both stored formats: 'YYYY-MM-DD HH:MM:SS' and ISO with offset."""
    return F.coalesce(F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def parse_updated(column: Column) -> Column:
    """Dates as lists show them: ISO prefix, '16 May 2026' or '16 Sept 2026'."""
    text = F.trim(F.regexp_replace(column, "\\s+", " "))
    short = F.regexp_replace(text, "(?i)\\b(\\d{1,2}) ([a-z]{3})[a-z]* (\\d{4})\\b", "$1 $2 $3")
    iso = F.regexp_extract(text, "^(\\d{4}-\\d{1,2}-\\d{1,2})", 1)
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-M-d"), F.try_to_date(F.initcap(short), "d MMM yyyy"))


def present(column: Column) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))
