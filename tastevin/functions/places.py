"""Countries, coordinates and locations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules
from .text import fold, fold_py

EARTH_KM = 6371.0088


def country_token(column: Column) -> Column:
    return F.trim(F.regexp_replace(fold(column), "[^\\p{L}\\p{N}]+", " "))


def token_py(name: str) -> str:
    """`country_token` on the driver."""
    return " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", fold_py(name))).split())


def _names(spark: SparkSession) -> dict[str, str]:
    locale = spark._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()} | rules.COUNTRY_DISPLAY


def country_codes(spark: SparkSession) -> dict[str, str]:
    """Code of every folded name and alias."""
    return {token_py(name): code for code, name in sorted(_names(spark).items())} | {token_py(a): code for a, code in rules.COUNTRY_ALIASES.items()}


def dim_country(spark: SparkSession) -> DataFrame:
    """token, code, name: ISO codes and English names from the platform's locale data, with the engine's own names and aliases.

    A few hundred rows whatever the data, so it may be broadcast."""
    names = _names(spark)
    return spark.createDataFrame([(t, c, names[c]) for t, c in sorted(country_codes(spark).items())], "token string, code string, name string")


def china_part(*hints: Column) -> Column:
    """Which of the countries that share a region a city, address or region means."""
    hint = country_token(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in hints), F.lit("")))
    return F.when(hint.contains("hong kong"), "HK").when(hint.contains("macau") | hint.contains("macao"), "MO").when(hint.rlike("|".join(rules.TAIWAN_HINTS)), "TW").otherwise("CN")


def with_country(df: DataFrame, column: str, city: str | None = None, address: str | None = None, region: str | None = None, prefix: str = "country") -> DataFrame:
    """df with {prefix}_code ('' if unknown) and {prefix}_name."""
    spark = df.sparkSession
    dim = dim_country(spark)
    upper = F.upper(F.trim(F.coalesce(F.col(column), F.lit(""))))
    codes = dim.select("code").distinct().withColumnRenamed("code", "_iso")
    hinted = china_part(*(F.col(c) for c in (city, address, region) if c))
    named = df.withColumn("_token", country_token(F.col(column))).join(F.broadcast(dim.select(F.col("token").alias("_token"), F.col("code").alias("_code"))), "_token", "left")
    coded = named.join(F.broadcast(codes), upper == F.col("_iso"), "left")
    code = F.coalesce(F.col("_iso"), F.when(F.col("_token") == rules.GREATER_CHINA, hinted), F.col("_code"), F.lit(""))
    shown = dim.groupBy("code").agg(F.first("name").alias("_name")).withColumnRenamed("code", "_named")
    out = coded.withColumn(f"{prefix}_code", code).join(F.broadcast(shown), F.col(f"{prefix}_code") == F.col("_named"), "left")
    return out.withColumn(f"{prefix}_name", F.coalesce("_name", F.trim(F.coalesce(F.col(column), F.lit(""))))).drop("_token", "_code", "_iso", "_named", "_name")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2))
    # least leaves out nulls, so a place without coordinates needs its own test
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def located(lat: Column, lng: Column) -> Column:
    """There are coordinates, and not (0, 0), which stands for none."""
    return lat.isNotNull() & lng.isNotNull() & ~((lat == 0) & (lng == 0))


def in_view(lat: Column, lng: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inside the bounds (clamped to the map), which may cross the antimeridian."""
    west, east = max(-180.0, min(180.0, west)), max(-180.0, min(180.0, east))
    south, north = sorted((max(-60.0, min(85.0, south)), max(-60.0, min(85.0, north))))
    across = lng.between(west, east) if west <= east else (lng >= west) | (lng <= east)
    return lat.between(south, north) & across & lat.between(-60, 85) & lng.between(-180, 180)


def city_and_country(location: Column) -> Column:
    """struct(city, country) of 'City, ..., Country'."""
    parts = F.filter(F.transform(F.split(F.coalesce(location, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("city"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("").alias("country"))


def list_country(df: DataFrame, column: str, city: str | None = None, address: str | None = None, us_hint: Column | None = None) -> DataFrame:
    """with_country for list indexes, which write state codes: they mean the United States where the hint holds, else ISO codes."""
    state = F.upper(F.trim(F.col(column))).isin(rules.US_STATES)
    written = F.when(state & (us_hint if us_hint is not None else F.lit(False)), F.lit("US")).otherwise(F.col(column))
    return with_country(df.withColumn("_written", written), "_written", city=city, address=address).drop("_written")
