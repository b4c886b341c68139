"""What a shop's site is: whose business it is, whether a page is a catalogue, and which links to follow first.

All tests look at whole pages (profiles of operators.html.page_profiles), folded once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, text

#: Signals of another business that reject a site, and those that the reason names.
SIGNALS, NAMED = 3, 4


def _any_part(hay: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [hay.contains(p) for p in parts])


def _path(url: Column) -> Column:
    """The folded path, escapes resolved where they are sound, _ as -."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.replace(text.fold(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)), F.lit("_"), F.lit("-"))


def _link(link: Column) -> Column:
    return text.fold(F.concat_ws(" ", link["href"], link["text"]))


def rejection(profiles: DataFrame) -> DataFrame:
    """profiles with rejection: why the site belongs to another business, '' if nothing says so. A site that calls itself a shop of the
    trade, or links to a catalogue of it, isn't rejected."""
    said = F.concat_ws(" ", "url", "title", "meta", "body", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["href"], x["text"])), " "))
    seen = profiles.withColumn("_said", text.fold(said)).withColumn("_links", F.transform("links", _link))
    catalogue = F.exists("_links", lambda x: _any_part(x, rules.CATALOGUE) & _any_part(x, rules.CATALOGUE_WINE))
    reason = F.lit("")
    for business, signals in reversed(rules.OTHER_BUSINESS.items()):
        matched = F.array_sort(F.array_compact(F.array(*(F.when(F.col("_said").contains(s), s) for s in signals))))
        says = F.concat(F.lit(f"Official website is a {business}, not a wine retailer ("), F.array_join(F.slice(matched, 1, NAMED), ", "), F.lit(")."))
        reason = F.when(F.size(matched) >= SIGNALS, says).otherwise(reason)
    own = _any_part(F.col("_said"), rules.RETAIL_IDENTITY) | catalogue
    return seen.withColumn("rejection", F.when(own, "").otherwise(reason)).drop("_said", "_links")


def is_catalogue(profiles: DataFrame, products: str = "products", priced: str = "priced") -> DataFrame:
    """profiles with catalogue: whether the products read from the visible text (columns: how many, and how many with a price) are a shop's.

    A story is none. A catalogue's address needs a price or three products, a product's a price; any other page two prices and something
    that sells."""
    seen = profiles.withColumn("_path", _path(F.col("url"))).withColumn("_links", F.transform("links", _link))
    context = F.regexp_extract_all(F.concat_ws(" ", "_path", text.fold("title")), F.lit("[a-z0-9]+"), F.lit(0))
    has = lambda words: F.arrays_overlap(F.split("_path", "/"), F.array(*map(F.lit, words)))
    n, p = F.coalesce(products, F.lit(0)), F.coalesce(priced, F.lit(0))
    sells = _any_part(text.fold("body"), rules.BUYING) | F.exists("_links", lambda x: _any_part(x, rules.BUYING_LINKS))
    good = (has(rules.CATALOGUE) & ((p >= 1) | (n >= 3))) | (has(["wine", "product"]) & (p >= 1)) | ((p >= 2) & sells)
    return seen.withColumn("catalogue", (n > 0) & ~F.arrays_overlap(context, F.array(*map(F.lit, rules.STORY_WORDS))) & good).drop("_path", "_links")


def shop_link_priority(url: Column, label: Column) -> Column:
    """Eight for each word of the trade in a link, files up or down by these, pages of goods up, pages aside down."""
    hay, path = text.fold(F.concat_ws(" ", url, label)), F.lower(F.regexp_extract(url, "^[^?#]*", 0))
    words = reduce(lambda a, b: a + b, [F.when(hay.contains(w), 8).otherwise(0) for w in rules.SHOP_LINK])
    file = reduce(lambda a, b: a | b, [path.endswith(x) for x in rules.SHOP_FILES])
    add = lambda test, k: F.when(test, k).otherwise(0)
    return words + F.when(file, F.when(words > 0, 6).otherwise(-6)).otherwise(0) + add(_any_part(hay, rules.SHOP_PLACES), 3) + add(_any_part(hay, rules.SHOP_ASIDE), -12)


def best_links(links: DataFrame, site: str, most: int = 60) -> DataFrame:
    """The links (href, text) of each site that are followed first: `most` distinct addresses by priority, then address. A site's addresses are
    deduplicated before they are ranked."""
    scored = links.withColumn("priority", shop_link_priority(F.col("href"), F.col("text"))).groupBy(site, "href").agg(F.max("priority").alias("priority"))
    order = W.partitionBy(site).orderBy(F.desc("priority"), "href")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
