"""Sinks: snapshot chunks, CSV for spreadsheets, compact JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .files import gzipped


def chunked(rows: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Rows with the number of their chunk of `size` in order.

    The rank comes from ranges of the order, so no task sees all rows."""
    return shared.numbered(rows, order, "_turn").withColumn("chunk", F.floor((F.col("_turn") - 1) / size)).drop("_turn")


def packed(rows: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """chunk, n, value: gzip + base64 of each chunk's JSON array."""
    parts = chunked(rows, order, size)
    one = F.struct(*(F.col(c) for c in rows.columns))
    listed = parts.groupBy("chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*map(F.col, order), one.alias("row")))).alias("rows"))
    return listed.select("chunk", "n", F.base64(gzipped(F.to_json(F.transform("rows", lambda x: x["row"])))).alias("value"))


def compact_json(columns: list[Column]) -> Column:
    """JSON without nulls, empty strings and empty lists."""
    kept = []
    for c in columns:
        kept.append(F.nullif(c, F.lit("")) if not isinstance(c, tuple) else F.when(F.size(c[0]) > 0, c[0]))
    return F.to_json(F.struct(*kept))


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> None:
    """All fields quoted, quotes doubled, CRLF: what spreadsheets read; with a byte order mark before the header where wanted."""
    names = [f"\ufeff{c}" if mark and k == 0 else c for k, c in enumerate(rows.columns)]
    rows.toDF(*names).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="")


#: Columns of the export of search results: heading and the column it shows.
EXPORT = {
    "Place": "place", "Type": "type", "City": "city", "Country": "country", "Updated": "updated", "Matched line": "line", "Vintage": "vintage", "Original price": "price", "KRW": "krw", "Source": "source", "Source URL": "source_url", "PDF URLs": "pdf_urls", "List index URL": "index_url", "Official website URL": "website_url",
    "Map URL": "map_url",
}


def export_rows(groups: DataFrame, lines: DataFrame, key: str = "group_id") -> DataFrame:
    """A row of text for each line of each group, in the order of EXPORT; a group without lines has one row without a line."""
    both = groups.join(lines, key, "left")
    there = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in both.columns else F.lit("") for c in EXPORT.values()}
    return both.select(*(there[c].alias(title) for title, c in EXPORT.items()))


def pdf_path(country: Column, city: Column, name: Column, key: Column) -> Column:
    part = lambda c, other: F.coalesce(F.nullif(F.trim(F.regexp_replace(c, "[\\\\/:*?\"<>|\\x00-\\x1F]+", " ")), F.lit("")), F.lit(other))
    return F.concat(F.lit("pdfs/"), part(country, "country"), F.lit("/"), part(city, "city"), F.lit("/"), part(name, "list"), F.lit("-"), key, F.lit(".pdf"))
