"""Filters, orders and projections of searches and work lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc, places, rules, text
from ..sources import shared

#: Statuses that need no more work.
DONE = ("found", "no_wine_list")


def in_country(df: DataFrame, wanted: str, column: str = "country", city: str | None = None) -> DataFrame:
    """Rows whose country is the wanted one, however either is written: code, name or alias. Rows of a region that stands for
    several countries belong to the one their city gives away; the region itself is any of them."""
    tokens = places.country_codes(df.sparkSession)
    token = places.token_py(wanted)
    code = wanted.strip().upper() if wanted.strip().upper() in set(tokens.values()) else tokens.get(token, "")
    written, upper = places.country_token(F.col(column)), F.upper(F.trim(F.col(column)))
    if token == rules.GREATER_CHINA:
        names = sorted(t for t, c in tokens.items() if c in rules.GREATER_CHINA_PARTS)
        return df.where((written == token) | written.isin(names) | upper.isin(rules.GREATER_CHINA_PARTS))
    if not code:
        return df.where(written == token)
    test = (upper == code) | written.isin(sorted(t for t, c in tokens.items() if c == code))
    if code in rules.GREATER_CHINA_PARTS:
        test = test | (written == rules.GREATER_CHINA) & (places.china_part(F.col(city) if city else F.lit("")) == code)
    return df.where(test)


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids (of a live page, say). A semi join: Spark broadcasts the ids where they are few."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def by_products(merchants: DataFrame, products: DataFrame, status: str) -> DataFrame:
    """Merchants with a product ('found') or a number of them at least ('100', '200'); 'all' takes every one."""
    if status == "all":
        return merchants
    least = 1 if status == "found" else int(status)
    enough = products.groupBy(F.col("merchant_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return merchants.join(enough.select("id"), "id", "left_semi")


def due(rows: DataFrame, stale_before: Column) -> DataFrame:
    """Active rows with a website that were never checked or not since."""
    return rows.where(F.col("active") & misc.present(F.col("website")) & (F.col("checked_at").isNull() | (F.col("checked_at") < stale_before)))


def work_queue(rows: DataFrame, stale_before: Column, limit: int | None = None) -> DataFrame:
    """The rows that are due; the longest unchecked first."""
    out = due(rows, stale_before).orderBy(F.coalesce("checked_at", F.lit("")), "id")
    return out.limit(limit) if limit else out


def queue_turns(rows: DataFrame, stale_before: Column) -> DataFrame:
    """The rows that are due with their turn in the work queue."""
    return shared.numbered(due(rows, stale_before), [F.coalesce("checked_at", F.lit("")), "id"])


def needs_review(kind: str) -> Column:
    """Why a row needs a person: no file, no lines, or a price that is none."""
    return {
        "file": ~misc.present(F.col("url")),
        "lines": F.coalesce(F.col("line_count"), F.lit(0)) == 0,
        "price": F.col("price").isNull() | F.isnan(F.col("price").cast("double")) | (F.col("price") <= 0),
    }[kind]


#: What a list of venues may be ordered by: column, and whether it is a number (none counts as 0) or a text (none as '').
ORDERS = {"place": ("name", False), "city": ("city", False), "country": ("country", False), "updated": ("updated", False), "matches": ("matches", True), "krw": ("krw", True)}


def ordered(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Rows in order of one of ORDERS, ties by id; texts compare without case and accents."""
    column, number = ORDERS[by]
    key = F.coalesce(F.col(column), F.lit(0)) if number else text.fold(F.col(column).cast("string"))
    return df.orderBy(F.desc(key) if descending else F.asc(key), "id")


def turns(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """df with each row's turn in that order; numbers alone may fall."""
    column, number = ORDERS[by]
    if descending and not number:
        raise ValueError("texts are numbered in rising order")
    key = F.coalesce(F.col(column), F.lit(0)) if number else text.fold(F.col(column).cast("string"))
    return shared.numbered(df, [-key if descending else key, "id"])


def country_names(*columns: DataFrame) -> DataFrame:
    """Distinct names (name) of the countries that the one-column relations write, whatever the spelling."""
    out = None
    for df in columns:
        part = df.select(F.col(df.columns[0]).alias("written"))
        out = part if out is None else out.unionByName(part)
    return places.with_country(out.where(misc.present(F.col("written"))).distinct(), "written").select(F.col("country_name").alias("name")).distinct()


def result_record(rows: DataFrame) -> DataFrame:
    """Search results as their readers get them: renamed, with the venue and the list nested."""
    return rows.select(
        F.col("id").cast("string").alias("id"), F.col("text"), F.coalesce("vintage", F.lit("")).alias("vintage"), F.col("price").cast("double").alias("priceValue"),
        F.coalesce("currency", F.lit("")).alias("currency"), F.col("price").isNull().alias("availabilityOnly"),
        F.struct(F.col("venue_id").alias("id"), F.col("venue").alias("name"), "city", "country", "lat", "lng", F.coalesce(text.non_empty(F.col("website")), F.lit("")).alias("url")).alias("venue"),
        F.struct(F.col("list_id").alias("id"), F.coalesce("list_url", F.lit("")).alias("downloadUrl")).alias("wineList"),
    )


def snapshot_fallback(rows: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Rows of a snapshot whose columns go by several names: of each field the first that is there and not blank."""
    present = {c.lower() for c in rows.columns}
    pick = lambda names: text.non_empty(*(F.col(c).cast("string") for c in names if c.lower() in present)) if any(c.lower() in present for c in names) else F.lit(None).cast("string")
    return rows.select(*(F.coalesce(pick(names), F.lit("")).alias(field) for field, names in fields.items()))


def progress_counts(rows: DataFrame) -> DataFrame:
    """One row: total, found, none, pending and review counts of a snapshot's statuses; what has no status is pending."""
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("not_checked"))
    n = lambda test: F.count_if(test)
    return rows.agg(
        F.count("*").alias("total"), n(status == "found").alias("found"), n(status == "no_wine_list").alias("none"),
        n(status == "review").alias("review"), n(~status.isin(*DONE, "review")).alias("pending"))


def parsed_watches(spark: SparkSession, raw: str | None = None, path: str | None = None) -> DataFrame:
    """Watches (keyword, vintage) of a JSON list: of the text, else of the file, else the default ones. What isn't a list of
    objects with a keyword, or is switched off, is left out; a text or file that isn't JSON counts as none."""
    def items(body: str | None):
        try:
            found = json.loads(body) if body else None
        except json.JSONDecodeError:
            return None
        if not isinstance(found, list):
            return None
        return [(str(x["keyword"]).strip(), str(x.get("vintage") or "").strip()) for x in found if isinstance(x, dict) and str(x.get("keyword") or "").strip() and x.get("active", True)]

    found = items(raw)
    if found is None and path:
        try:
            found = items("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect()))
        except Exception as e:  # noqa: BLE001  no such file
            if "PATH_NOT_FOUND" not in str(e):
                raise
    rows = list(dict.fromkeys(found if found is not None else rules.DEFAULT_WATCHES))
    return spark.createDataFrame(rows, "keyword string, vintage string")


def retail_name(name: Column) -> Column:
    """A name with a word of the trade, or a part of one where words aren't divided."""
    low = F.lower(name)
    return text.has_word(low, rules.RETAIL_WORDS) | low.rlike(text.part_pattern(rules.RETAIL_PARTS))


def candidate_records(rows: DataFrame) -> DataFrame:
    """Retail candidates out of a directory's rows: why they are one, their category, an address put together where there is
    none, and a hash of the record. Rows without an id or a name, or of other trades, are left out."""
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    lead = F.lower(F.concat_ws(" ", "old_primary", "basic_category", "taxonomy_primary"))
    every = F.lower(F.concat_ws(" ", "old_primary", "categories_json", "basic_category", "taxonomy_primary", "taxonomy_json"))
    category = text.has_word(lead, rules.RETAIL_CATEGORIES)
    named = retail_name(F.col("name")) & ~text.has_word(every, rules.OTHER_TRADES)
    parts = F.filter(F.array(clean("city"), clean("region"), clean("postcode"), clean("country_code")), lambda x: x != "")
    out = rows.where(F.coalesce(category | named, F.lit(False)) & (clean("id") != "") & (clean("name") != "")).select(
        clean("id").alias("provider_place_id"), clean("name").alias("name"), F.when(category, "retail_primary_category").otherwise("retail_name").alias("candidate_reason"),
        F.coalesce("taxonomy_primary", "basic_category", "old_primary").alias("primary_category"), F.upper(clean("country_code")).alias("country_code"),
        F.coalesce(F.nullif(clean("address"), F.lit("")), F.array_join(parts, ", ")).alias("address"), "latitude", "longitude")
    return out.withColumn("raw_hash", misc.stable_hash(*(F.col(c) for c in sorted(out.columns))))


def with_coordinates(groups: DataFrame, exact: DataFrame, cities: DataFrame, geocoded: DataFrame) -> DataFrame:
    """groups (id, place_key, city_key, lat, lng) with the first coordinates there are: their own, the same place's (place_key),
    the geocoder's answer for it, the city's (city_key). approximate tells the last from the others."""
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        fine = df.where(places.located(F.col("lat"), F.col("lng")))
        return fine.groupBy(key).agg(F.min(F.struct("lat", "lng")).alias(name))

    joined = groups.join(side(exact, "place_key", "_exact"), "place_key", "left").join(side(geocoded, "place_key", "_geo"), "place_key", "left").join(side(cities, "city_key", "_city"), "city_key", "left")
    own = F.when(places.located(F.col("lat"), F.col("lng")), F.struct("lat", "lng"))
    best = F.coalesce(own, "_exact", "_geo", "_city")
    sure = F.coalesce(own, "_exact", "_geo").isNotNull()
    return joined.withColumn("_best", best).select("id", F.col("_best.lat").alias("lat"), F.col("_best.lng").alias("lng"), (~sure & F.col("_city").isNotNull()).alias("approximate"))
