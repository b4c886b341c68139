"""Venue grouping, offers in won, dedupe and source labels of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text


def venue_key(name: Column, city: Column, country: Column) -> Column:
    part = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))
    return F.concat_ws("|", part(text.clean_venue_name(name)), part(city), part(country))


def first_filled(column: str, order: Column) -> Column:
    """Value of the first row in order that has one; an order-free aggregate (min of a struct)."""
    c = F.col(column)
    filled = c.isNotNull() & (c.cast("string") != "")
    return F.min_by(F.when(filled, c), F.when(filled, order)).alias(column)


def grouped(rows: DataFrame, key: Column, order: Column, fields: list[str]) -> DataFrame:
    return rows.withColumn("venue_key", key).where(F.col("venue_key") != "").groupBy("venue_key").agg(
        *(first_filled(f, order) for f in fields), F.bool_or("needs_review").alias("needs_review"), F.count("*").alias("lines"))


def cheapest_offers(rows: DataFrame, group: list[str]) -> DataFrame:
    """The cheapest offer in won of each group, ties by id."""
    krw = money.to_krw(F.col("price").cast("double"), F.col("currency"))
    best = F.min(F.struct(krw.alias("krw"), F.col("id"))).alias("best")
    return rows.where(krw.isNotNull()).groupBy(*group).agg(best).select(*group, F.floor(F.col("best.krw") + 0.5).cast("long").alias("krw"), F.col("best.id").alias("id"))


def latest_updated(rows: DataFrame, group: str, updated: str, parsed: Column) -> DataFrame:
    """Latest list date of each group as it is written."""
    return rows.groupBy(group).agg(F.max(F.struct(parsed.alias("at"), F.col(updated).alias("as_written"))).alias("x")).select(group, F.col("x.as_written").alias(updated), F.col("x.at").alias("at"))


def merged_sources(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row of each key, the last in order; 'DB + Live' where both sources have it."""
    return rows.groupBy(*keys).agg(F.collect_set("source").alias("s"), F.max_by("id", order).alias("id")).select(
        *keys, "id", F.when(F.size("s") > 1, "DB + Live").otherwise(F.get("s", F.lit(0))).alias("source"))


def kpis(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("places"), F.sum("lines").alias("lines"), F.countDistinct("country").alias("countries"), F.sum(F.when(F.col("needs_review"), 1).otherwise(0)).alias("reviews"))
