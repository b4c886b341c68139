"""Search over list lines, site lines and shop products.

One predicate serves all arms (every token of the folded query, see functions.text.matches_all); what differs are the
columns, filters and ranking. Filters come before limits, so no candidate cap is needed, and price-first top-k is
TakeOrderedAndProject: a heap for each partition, no global sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text
from .selection import in_country

MOST = 5000


@dataclass(frozen=True)
class SearchParams:
    query: str = ""
    country: str = ""
    city: str = ""
    vintage: str = ""
    limit: int = MOST

    @property
    def tokens(self) -> list[str]:
        return text.search_tokens(self.query)

    @property
    def most(self) -> int:
        return max(1, min(self.limit, MOST))

    @property
    def anchor(self) -> str | None:
        """First token that isn't generic, for a second try upstream."""
        return next((t for t in self.tokens if t not in rules.GENERIC_WORDS), None)


def price_first(*ties: Column) -> list[Column]:
    return [F.asc_nulls_last("price"), *ties]


def filtered(df: DataFrame, p: SearchParams, hay: Column, raw: str = "name") -> DataFrame:
    """Rows of the query's tokens, country, city and vintage. A vintage may stand in its column or in the text."""
    out = df.where(text.matches_all(p.tokens, text.fold(hay)))
    if p.country:
        out = in_country(out, p.country, city="city" if "city" in out.columns else None)
    if p.city:
        out = out.where(text.fold("city").contains(text.fold_py(p.city)))
    if p.vintage:
        out = out.where((F.col("vintage") == p.vintage) | F.col(raw).contains(p.vintage))
    return out


def shop_search(products: DataFrame, merchants: DataFrame, p: SearchParams) -> DataFrame:
    """Products whose text together with the merchant's name has every token, cheapest first."""
    rows = products.join(merchants.where("active").select(F.col("id").alias("merchant_id"), F.col("name").alias("merchant"), "country", "city"), "merchant_id")
    found = filtered(rows, p, F.concat_ws(" ", "merchant", "name", "brand"))
    return found.orderBy(*price_first(F.col("seen_at").desc(), F.col("merchant"), F.col("id"))).limit(p.most)


def list_address(url: str, name: str, city: str, country: str) -> Column:
    """What makes a row's source the same: its list's address whatever the case, else its place."""
    address = F.lower(F.trim(F.coalesce(F.col(url), F.lit(""))))
    return F.when(address != "", address).otherwise(F.concat_ws("|", *(text.fold(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (name, city, country))))


def first_per_source(rows: DataFrame, p: SearchParams, source: Column | str, order: list[str], body: str) -> DataFrame:
    """Matches of a full scan, the first of each source: an aggregate, so a source of many rows is summed up where they lie."""
    hits = rows.where(text.matches_all(p.tokens, text.fold(body))).withColumn("_source", F.col(source) if isinstance(source, str) else source)
    first = hits.groupBy("_source").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return first.select("row.*").orderBy(*order).limit(p.most)


def ranked_union(arms: list[tuple[DataFrame, list[Column]]], limit: int) -> DataFrame:
    """The first rows of each arm in its own order, arms one after the other, no dedupe across them."""
    parts = []
    for k, (df, order) in enumerate(arms):
        top = df.orderBy(*order).limit(limit)  # a bounded handful, so one task may number it
        parts.append(top.withColumn("arm", F.lit(k)).withColumn("rank", F.row_number().over(W.partitionBy("arm").orderBy(*order))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def snapshot_search(rows: DataFrame, p: SearchParams, hay: Column) -> DataFrame:
    """Plain containment of every [a-z0-9] token in the normalised text."""
    plain = F.trim(F.regexp_replace(text.fold(hay), "[^a-z0-9]+", " "))
    out = rows
    import re

    for token in re.sub(r"[^a-z0-9]+", " ", text.fold_py(p.query)).split():
        out = out.where(plain.contains(token))
    if p.vintage:
        out = out.where((F.col("vintage") == p.vintage) | hay.contains(p.vintage))
    return out


def distinct_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row of each key in order."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def hosted_search(rows: DataFrame, p: SearchParams, keys: list[Column], order: list[Column]) -> DataFrame:
    """Filter, dedupe on the five-part key, price ascending with missing last, limit."""
    out = rows.where(F.col("text").rlike(rf"\b{p.vintage}\b")) if p.vintage else rows
    return distinct_by(out, keys, order).orderBy(F.asc_nulls_last(F.when(F.col("price") > 0, F.col("price"))), *order).limit(p.most)


def index_terms(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Posting list (term, key) of whole folded words: an index that equi-joins prune by."""
    return rows.select(key, F.explode(F.array_distinct(text.words_of(text.fold(body)))).alias("term"))


def index_search(postings: DataFrame, tokens: list[str], key: str, every: bool = True) -> DataFrame:
    """Keys that have every (or any) token as a whole word."""
    hits = postings.where(F.col("term").isin(tokens)).groupBy(key).agg(F.countDistinct("term").alias("n"))
    return hits.where(F.col("n") == len(set(tokens))).select(key) if every else hits.select(key)
