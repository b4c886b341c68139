"""Scalar functions on the lines, places and names they are meant for."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tastevin.functions import money, places, text, web


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("line, price, currency", [
    ('2019 Domaine Bizot Marsannay "Clos du Roy", $1875', 1875.0, "USD"),
    ("William Kelley, Foucheres, 2018, HK$12, 888", 12888.0, "HKD"),
    ("Moulin a Vent, 2021, William Kelley, 300, 100%Gamay", 300.0, None),
    ("Krug Grande Cuvee 750 ml EUR 68423.46", 68423.46, "EUR"),
    ("Corton 2015, price on request", None, None),
    ('P I N O T, N O I R, 2022, Domaine Bizot Marsannay "Clos du Roy", $1875', 1875.0, "USD"),
    ("Meursault 2018 p. 12", None, None), ("Meursault 2018, 0.75 l, 120,OO", 120.0, None), ("Chablis 1.5 l 37.5 cl 2020", None, None),
    ("Volnay 2019, EUR 1950", 1950.0, "EUR"), ("Volnay 2019, 1.950,50 €", 1950.5, "EUR"), ("EUR 80 Volnay 120 2019", 80.0, "EUR"), ("Volnay 5", None, None),
    ("Volnay 12, upon request", None, None), ("Volnay upon request 12", 12.0, None), ("Volnay 12, upon request now", None, None), ("Volnay 90 ask your sommelier", None, None), ("", None, None), (None, None, None),
])
def test_list_price(spark, line, price, currency):
    got = one(spark, line, money.list_price)
    assert (got["price_value"], got["currency"]) == (price, currency)


def test_list_price_country_default(spark):
    got = spark.createDataFrame([("Chablis 2020, 85", "FR")], "x string, c string").select(money.list_price(F.col("x"), F.col("c")).alias("y")).first()["y"]
    assert (got["price_text"], got["price_value"], got["currency"]) == ("85", 85.0, "EUR")


@pytest.mark.parametrize("line, price, currency", [("2021 Vosne-Romanee 750 ml HK$12,888", 12888.0, "HKD"), ("Moulin a Vent 2021 William Kelley 300, 100% Gamay", 300.0, ""), ("2011 Chateau Rayas CHF 1700", 1700.0, "CHF")])
def test_shop_price(spark, line, price, currency):
    got = one(spark, line, money.shop_price)
    assert (got["price_value"], got["currency"]) == (price, currency)


@pytest.mark.parametrize("line, country, price", [
    ("Corton 2015 35018", "FR", 350.0), ("Corton 2015 EUR 35018", "FR", 35018.0), ("Corton 2015 35018", "JP", 35018.0), ("Corton 2015 350,OO", "FR", 350.0), ("Corton 2015 35099", "FR", 35099.0),
])
def test_hosted_price(spark, line, country, price):
    got = spark.createDataFrame([(line, country)], "x string, c string").select(money.hosted_price(F.col("x"), F.col("c")).alias("y")).first()["y"]
    assert got["price_value"] == price


@pytest.mark.parametrize("line, raw, price, currency", [
    ("Krug 2008 on request", "", None, ""), ("Krug 2008", "", None, ""), ("Krug EUR 2008", "2008", 2008.0, "EUR"), ("Krug 12 % 1,250", "1,250", 1250.0, ""), ("Krug 9 CHF", "", None, "CHF"),
])
def test_guide_price(spark, line, raw, price, currency):
    got = one(spark, line, money.guide_price)
    assert (got["price_text"], got["price_value"], got["currency"]) == (raw, price, currency)


@pytest.mark.parametrize("raw, value", [("1,234", 1234.0), ("1.234,50", 1234.5), ("12,50", 12.5), ("12.OO", 12.0), ("12, 888", 12888.0), ("1 234 567", 1234567.0), ("85", 85.0), ("x", None), ("", None)])
def test_numbers(spark, raw, value):
    assert one(spark, raw, money.number_value) == value


def test_sizes_and_vintages(spark):
    assert one(spark, "2021 Vosne-Romanee 750 ml HK$12,888", money.size_ml) == 750
    assert one(spark, "Moulin a Vent 2021 300", money.vintage) == "2021"
    assert one(spark, "since 1939, bottled", money.shop_vintage) == ""


@pytest.mark.parametrize("raw, code", [("Hong Kong", "HK"), ("HK", "HK"), ("United States", "US"), ("UK", "GB"), ("대한민국", "KR"), ("일본", "JP"), ("Türkiye", "TR"), ("Atlantis", "")])
def test_country(spark, raw, code):
    assert places.with_country(spark.createDataFrame([(raw,)], "x string"), "x").first()["country_code"] == code


@pytest.mark.parametrize("city, code", [("Hong Kong", "HK"), ("Macau", "MO"), ("Taipei", "TW"), ("Shanghai", "CN")])
def test_greater_china(spark, city, code):
    df = spark.createDataFrame([("Greater China", city)], "x string, c string")
    assert places.with_country(df, "x", city="c").first()["country_code"] == code


def test_fold_is_nfkd_for_latin(spark):
    for s in ("Château Pétrus", "STRAẞE groß", "Œuvre Ærø", "ﬁn ﬂ", "Ångström", "éclair"):
        want = "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))
        assert one(spark, s, text.fold) == want


def test_fuzzy_tokens(spark):
    match = lambda s: one(spark, s, lambda c: text.matches_all(text.search_tokens("koji jaewha"), text.fold(c)))
    assert match("Domaine Koji et Jae Hwa Bourgogne") and not match("koji jaehwe")
    assert one(spark, "anything", lambda c: text.matches_all([], text.fold(c)))


def test_urls(spark):
    assert one(spark, " WWW.Shop.example.co.uk/a/ ", web.normalize_url) == "https://www.shop.example.co.uk/a"
    assert one(spark, "www.shop.example.co.uk", lambda c: web.registrable_root(web.domain(c))) == "example.co.uk"
    assert not one(spark, "http://127.0.0.1/x", web.is_safe_url)
    assert one(spark, '["a", {"url": "b"}, "a", ""]', web.json_strings) == ["a", "b"]
