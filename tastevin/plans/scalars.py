"""Scalar functions over the tables; parsers are checked against the values that lines were built from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc, money, places, rules, text, web
from ..operators import selection
from .registry import query


# every fifth line ends in a percentage, every third has its price between page and size; a price under 10 is none, and it may look like a year
def _hard(lines):
    paged = F.concat(F.replace("text", F.concat(F.lit(", "), "currency"), F.concat(F.lit(", p. 14, "), "currency")), F.lit(", 75 cl"))
    return lines.withColumn("text", F.concat(F.when(F.col("id") % 3 == 0, paged).otherwise(F.col("text")), F.when(F.col("id") % 5 == 0, ", 100%").otherwise("")))


@query(["v_lines"], "select id, case when price >= 10 then price end::double as price_value, currency, case when price >= 10 then price::varchar else '' end as price_text from v_lines", heavy=True)
def x6_price_v2(lines):
    """Prices with their currency, among years, pages, sizes and percentages."""
    p = money.list_price(F.col("text"))
    return _hard(lines).select("id", p["price_value"].alias("price_value"), p["currency"].alias("currency"), p["price_text"].alias("price_text"))


@query(["v_lines"], "select id, case when price >= 10 then price end::double as price_value, currency from v_lines", heavy=True)
def x9_guide_price(lines):
    p = money.guide_price(F.col("text"))
    return _hard(lines).select("id", p["price_value"].alias("price_value"), p["currency"].alias("currency"))


@query(["v_lines"], "select id, price::double as price_value, currency from v_lines", heavy=True)
def x10_shop_price(lines):
    p = money.shop_price(F.concat(F.col("text"), F.lit(" 750 ml")))
    return _hard(lines).select("id", p["price_value"].alias("price_value"), p["currency"].alias("currency"))


@query(["v_lines"], "select id, currency from v_lines", heavy=True)
def x11_currency(lines):
    return lines.select("id", money.currency_in(F.col("text")).alias("currency"))


@query(["v_lines"], "select id, vintage from v_lines", heavy=True)
def x13_vintage(lines):
    return lines.select("id", money.vintage(F.col("text")).alias("vintage"))


@query(["v_lines"], """
  select id, case when price < 10 or price between 1900 and 2099 then null when id % 2 = 0 and price between 10000 and 500099 and price % 100 between 1 and 80 then price // 100 else price end::double as price_value from v_lines""", heavy=True)
def x7_hosted_price(lines):
    """Prices without a currency, apart from the glass price that may be written onto them, by country; a bare year is none."""
    bare = F.concat_ws(", ", "vintage", "name", F.col("price").cast("string"))
    country = F.when(F.col("id") % 2 == 0, "FR").otherwise("JP")
    return lines.select("id", money.hosted_price(bare, country)["price_value"].alias("price_value"))


@query(["v_lines"], "select id, [375, 500, 700, 750, 1000, 1500, 3000, 6000][id % 8 + 1] as size_ml from v_lines", heavy=True)
def x14_size(lines):
    sizes = F.array(*map(F.lit, [375, 500, 700, 750, 1000, 1500, 3000, 6000]))
    return lines.select("id", money.size_ml(F.concat_ws(" ", F.col("text"), F.get(sizes, (F.col("id") % 8).cast("int")).cast("string"), F.lit("ML"))).alias("size_ml"))


@query(["v_lines"], "select id, case when id % 2 = 0 then floor(price / 100) else price + 0.5 end::double as value from v_lines", heavy=True)
def x8_numbers(lines):
    """Written numbers with separators of both kinds and O for 0, back to their values."""
    cents = F.format_string("%.2f", F.floor(F.col("price") / 100).cast("double"))
    grouped = F.concat(F.replace(F.format_number(F.col("price"), 0), F.lit(","), F.lit(".")), F.lit(",50"))
    return lines.select("id", F.when(F.col("id") % 2 == 0, money.number_value(F.replace(cents, F.lit(".00"), F.lit(".OO")))).otherwise(money.number_value(grouped)).alias("value"))


@query(["part"], "select p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', ' ', 'g')) as name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(p_type) || '|' || lower(p_name) as key from part")
def x2_name_key(part):
    return part.select("p_partkey", text.normalize_name(F.concat_ws(" & ", "p_name", "p_brand")).alias("name"), text.target_key("p_brand", "p_type", "p_name").alias("key"))


@query(["part"], "select p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def x4_slug(part):
    return part.select("p_partkey", text.slugify(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("slug"))


@query(["documents"], "select doc_id, md5(strip_accents(replace(lower(text), 'ß', 'ss'))) as folded from documents", heavy=True)
def t1_fold(docs):
    return docs.select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query(["part"], "select p_partkey, case when p_retailprice = floor(p_retailprice) then p_retailprice::bigint::varchar else regexp_replace(printf('%.2f', p_retailprice), '\\.?0+$', '') end as shown from part")
def x12_display_price(part):
    return part.select("p_partkey", money.display_price(F.col("p_retailprice")).alias("shown"))


@query(["pages"], """
  with u as (select page_id, url, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 2) as host, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 1) as scheme, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 3) as path, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', 4) as q from pages)
  select page_id, lower(scheme) || '://' || lower(host) || regexp_replace(path, '/+$', '') || q as url, regexp_replace(lower(host), '^www\\.', '') as domain, array_to_string(string_split(regexp_replace(lower(host), '^www\\.', ''), '.')[-2:], '.') as root from u""")
def x25_url(pages):
    u = F.col("url")
    return pages.select("page_id", web.normalize_url(u).alias("url"), web.domain(u).alias("domain"), web.registrable_root(web.domain(u)).alias("root"))


@query(["v_merchants"], "select id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((radians(48.8566) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.8566)) * pow(sin((radians(2.3522) - radians(lng)) / 2), 2)))), 3) as km from v_merchants")
def x29_haversine(merchants):
    return merchants.select("id", F.round(places.haversine_km(F.col("lat"), F.col("lng"), F.lit(48.8566), F.lit(2.3522)), 3).alias("km"))


_COUNTRIES = "[('Hong Kong', '', 'HK', 'Hong Kong'), ('대한민국', '', 'KR', 'South Korea'), ('uk', '', 'GB', 'United Kingdom'), ('Greater China', 'Taipei', 'TW', 'Taiwan'), ('greater china', 'Shanghai', 'CN', 'China'), ('U.S.A.', '', 'US', 'United States'), ('fr', '', 'FR', 'France'), ('Côte d''Ivoire', '', 'CI', 'Cote d''Ivoire'), ('Nowhere', '', '', 'Nowhere')]"


@query(["customer"], f"with t as (select c_custkey, {_COUNTRIES}[c_custkey % 9 + 1] as x from customer) select c_custkey, x[3] as country_code, x[4] as country_name from t")
def x30_country(customers):
    spellings = F.array(*(F.struct(F.lit(a).alias("raw"), F.lit(b).alias("city")) for a, b in [("Hong Kong", ""), ("대한민국", ""), ("uk", ""), ("Greater China", "Taipei"), ("greater china", "Shanghai"), ("U.S.A.", ""), ("fr", ""), ("Côte d'Ivoire", ""), ("Nowhere", "")]))
    rows = customers.select("c_custkey", F.get(spellings, (F.col("c_custkey") % 9).cast("int")).alias("x")).select("c_custkey", "x.raw", "x.city")
    return places.with_country(rows, "raw", city="city").select("c_custkey", "country_code", "country_name")


@query(["part"], "select p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || case when p_size = 0 then '' else p_size::varchar end) as hash from part")
def x32_hash(part):
    return part.select("p_partkey", misc.content_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("hash"))


@query(["orders"], "select o_orderkey, case when o_orderkey % 4 = 3 then null else o_orderdate::date end as parsed from orders")
def x35_dates(orders):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(d, "d MMMM yyyy")).when(k == 2, F.date_format(d, "d  MMM yyyy")).otherwise("soon")
    return orders.select("o_orderkey", misc.parse_updated(written).alias("parsed"))


@query(["v_targets"], "select id, city, case when id % 3 = 0 then '' else country end as country from v_targets")
def x38_location(targets):
    loc = F.when(F.col("id") % 3 == 0, F.col("city")).otherwise(F.concat_ws(", ", F.col("city"), F.lit("Somewhere "), F.col("country")))
    x = places.city_and_country(loc)
    return targets.select("id", x["city"].alias("city"), x["country"].alias("country"))


@query(["v_targets"], "select id, case when status = 'found' then 'found' when status in ('no_wine_list', 'missing_website') then 'none' else 'pending' end as kind from v_targets")
def x42_kind(targets):
    return targets.select("id", F.when(F.col("status") == "found", "found").when(F.col("status").isin("no_wine_list", "missing_website"), "none").otherwise("pending").alias("kind"))


@query(["v_targets"], "select id, 'https://www.google.com/maps/search/?api=1&query=' || replace(replace(url_encode(name || ', ' || city), '%20', '+'), '%23', '%23') as url from v_targets")
def x39_maps_url(targets):
    return targets.select("id", F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.url_encode(F.concat_ws(", ", "name", "city"))).alias("url"))


@query(["v_merchants"], "select id from v_merchants where (regexp_matches(lower(name), 'supplier') and not regexp_matches(case id % 3 when 0 then 'bar' when 1 then 'shop' else 'hotel' end, '(^|[^a-z0-9_])(bar|pub|restaurant|winery|vineyard|hotel|lounge)($|[^a-z0-9_])')) or id % 5 = 0")
def f7_retail_candidates(merchants):
    """Primary category, or a retail name without a category of another trade."""
    category = F.when(F.col("id") % 3 == 0, "bar").when(F.col("id") % 3 == 1, "shop").otherwise("hotel")
    primary = F.when(F.col("id") % 5 == 0, "wine_shop").otherwise(F.lit(""))
    named = selection.retail_name(F.replace(F.lower("name"), F.lit("supplier#"), F.lit("fine wines ")))
    return merchants.where(text.has_word(primary, rules.RETAIL_CATEGORIES) | named & ~text.has_word(category, rules.OTHER_TRADES)).select("id")


@query(["v_targets"], "select id, list_sort(list_distinct(list_filter([name || ', ' || city || ', ' || country, name || ', ' || country, name, case when website <> '' then website end], lambda x: x is not null))) as queries from v_targets")
def p4_lookup_queries(targets):
    forms = [F.concat_ws(", ", "name", "city", "country"), F.concat_ws(", ", "name", "country"), F.col("name"), F.nullif("website", F.lit(""))]
    return targets.select("id", F.sort_array(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull()))).alias("queries"))


@query(["events"], "select event_id, event_type in ('click', 'purchase') or cast(props->>'k' as int) > 90 as food from events")
def f12_type_overlap(events):
    types = F.array("event_type")
    return events.select("event_id", (F.arrays_overlap(types, F.array(F.lit("click"), F.lit("purchase"))) | (F.get_json_object("props", "$.k").try_cast("int") > 90)).alias("food"))
