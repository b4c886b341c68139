"""Filters, watch lists, records, files and exports that have no query of their own."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tastevin.functions import places, text, web
from tastevin.operators import merge, search, selection
from tastevin.sources import files, sinks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_country_filter_of_searches(spark):
    """Names, codes and regions meet, and the token filter holds beside."""
    rows = [(1, "Rayas 2011", "Hong Kong", "", "2011", 10.0), (2, "Rayas 2012", "HK", "", "2012", 5.0), (3, "Rayas", "Greater China", "Hong Kong", "", 1.0), (4, "Rayas", "Greater China", "Macau", "", 1.0), (5, "Rayas", "France", "Paris", "", 2.0), (6, "Krug", "HK", "", "", 2.0)]
    df = spark.createDataFrame(rows, "id long, name string, country string, city string, vintage string, price double")
    found = lambda country: sorted(r["id"] for r in search.filtered(df, search.SearchParams("rayas", country=country), F.col("name")).collect())
    assert found("HK") == found("Hong Kong") == [1, 2, 3]
    assert found("Macao") == [4] and found("Greater China") == [1, 2, 3, 4] and found("fr") == [5] and found("Atlantis") == [] and found("") == [1, 2, 3, 4, 5]


def test_orders_break_ties_by_id(spark):
    df = spark.createDataFrame([(1, "b", None, 2), (2, "É", 5.0, 2), (3, None, 7.0, None), (4, "a", 5.0, 9)], "id long, city string, krw double, matches long")
    ids = lambda *how: [r["id"] for r in selection.ordered(df, *how).collect()]
    assert ids("city") == [3, 4, 1, 2] and ids("krw", True) == [3, 2, 4, 1] and ids("matches", True) == [4, 1, 2, 3]


@pytest.mark.parametrize("raw, want", [
    ('[{"keyword": " Rayas ", "vintage": 2011}, {"keyword": ""}, 3, {"keyword": "x", "active": false}]', [("Rayas", "2011")]), ("[]", []), ("{broken", None), (None, None), ('{"keyword": "x"}', None),
])
def test_watch_lists(spark, tmp_path, raw, want):
    default = [tuple(r) for r in selection.parsed_watches(spark).collect()]
    assert len(default) == 2
    assert [tuple(r) for r in selection.parsed_watches(spark, raw).collect()] == (default if want is None else want)
    (tmp_path / "w.json").write_text(json.dumps([{"keyword": "Krug"}]))
    assert [tuple(r) for r in selection.parsed_watches(spark, raw, str(tmp_path / "w.json")).collect()] == ([("Krug", "")] if want is None else want)
    assert [tuple(r) for r in selection.parsed_watches(spark, None, str(tmp_path / "none.json")).collect()] == default


def test_entities(spark):
    for raw, want in (("a &amp;lt; b", "a &lt; b"), ("caf&eacute; &#8364;5 &#x20AC;", "café €5 €"), ("A&B &nosuch; &; &#0;", "A&B &nosuch; &; &#0;"), ("x&nbsp;&nbsp; y", "x y"), ("&#128512;", "😀"), ("", ""), (None, "")):
        assert one(spark, raw, text.clean_text) == want


def test_text_without_separators(spark):
    assert one(spark, "Domaine Jae-Hwa", lambda c: text.matches_stripped(["jaehwa", "domaine"], text.fold(c)))
    assert not one(spark, "Domaine Jae", lambda c: text.matches_stripped(["jaehwa"], text.fold(c)))


def test_first_that_is_not_blank(spark):
    df = spark.createDataFrame([(" ", "b"), (None, None), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(text.non_empty(F.col("x"), F.col("y"))).collect()] == ["b", None, "a"]


def test_coordinates_of_none(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 2.0)], "lat double, lng double")
    assert [r[0] for r in df.select(places.located(F.col("lat"), F.col("lng"))).collect()] == [False, True, False]
    assert [r[0] is None for r in df.select(places.haversine_km(F.col("lat"), F.col("lng"), F.lit(1.0), F.lit(1.0))).collect()] == [False, False, True]


def test_event_pages(spark):
    assert one(spark, "/en/Events/2026", web.is_event_page) and one(spark, "/wine-masterclass", web.is_event_page) and not one(spark, "/pressed", web.is_event_page)


def test_csv_cells_without_bound(spark, tmp_path):
    wide = ",".join(f"c{k}" for k in range(200))
    (tmp_path / "a.csv").write_bytes(("\ufeffname,price\r\n\"Rayas\n2011\",\"1,700\"\r\n,\r\n" + wide + "\r\n").encode())
    rows = files.csv_lines(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [r["line"] for r in rows] == ["name price", "Rayas 2011 1,700", wide.replace(",", " ")]


def test_store_pages(spark):
    woo = [{"name": "Rayas &amp; fils", "permalink": "u", "prices": {"price": "17050", "currency_code": "EUR", "currency_minor_unit": 2}}, {"name": "Krug", "permalink": "v", "prices": {"price": "300", "currency_code": "JPY", "currency_minor_unit": 0}}]
    got = files.woo_products(spark.createDataFrame([(json.dumps(woo),), ("broken",)], "value string")).collect()
    assert sorted(map(tuple, got)) == [("Krug", 300.0, "JPY", "v"), ("Rayas & fils", 170.5, "EUR", "u")]
    node = {"productId": "1", "productName": "Rayas", "pageItemUrl": "p", "product": {"nodes": [{"variants": {"nodes": [{"id": "a", "name": "75cl", "price": 20.0, "discountPrice": None, "pageItemUrl": None, "available": True}, {"id": "b", "name": None, "price": 90.0, "discountPrice": 80.0, "pageItemUrl": "q", "available": None}]}}]}}
    page = json.dumps({"data": {"searchVariantsV2": {"nodes": [node, node], "totalCount": 2}}})
    got = files.graph_products(spark.createDataFrame([(page,), (page,)], "value string")).collect()
    assert sorted(map(tuple, got)) == [("Rayas", "", 80.0, False, "q"), ("Rayas", "75cl", 20.0, True, "p")]


def test_cards(spark):
    html = 'head<div class="item" x><p class="rank">1</p><a href="/a"><h2>Chez&nbsp;<b>Paul</b></h2></a><p>Paris</p></div><div class="item"><a href="/b"><h2>Krug</h2></a></div>'
    fields = {"name": "<h2>(.*?)</h2>", "href": '<a[^>]+href="([^"]+)"', "city": "</a>\\s*<p>(.*?)</p>"}
    got = files.cards(spark.createDataFrame([(7, html), (8, None)], "id long, html string"), "id", '<div class="item"', fields).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(7, 1, "Chez Paul", "/a", "Paris"), (7, 2, "Krug", "/b", "")]


def test_json_ld(spark):
    deep = {"@graph": [{"@type": ["Thing", "Restaurant"], "name": "Paul", "address": {"addressLocality": "Paris", "addressCountry": "FR", "streetAddress": "1 Rue"}, "geo": {"latitude": "48.8", "longitude": 2.3}}, {"itemListElement": [{"@type": "Product", "name": "Chateau Rayas", "sku": 9, "offers": [{"price": "1,700.50", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}]}, {"@type": "Product", "name": "Glass"}]}]}
    html = f'<script type="application/ld+json">{json.dumps(deep)}</script><script type="application/ld+json">{{broken</script>'
    nodes = files.json_ld_nodes(spark.createDataFrame([(1, html), (2, "<p>"), (3, None)], "id long, html string"), "id")
    (place,) = files.json_ld_places(nodes).collect()
    assert (place["id"], place["name"], place["city"], place["country"], place["street"], place["lat"], place["lng"]) == (1, "Paul", "Paris", "FR", "1 Rue", 48.8, 2.3)
    (product,) = files.json_ld_products(nodes).collect()
    assert (product["name"], product["sku"], product["price_value"], product["currency"], product["availability"]) == ("Chateau Rayas", "9", 1700.5, "EUR", "InStock")


def test_place_scan_filters_reach_the_files(spark, tmp_path):
    for k, code in enumerate(("FR", "JP")):
        spark.createDataFrame([(f"{code}{j}", code, float(j), float(10 * j)) for j in range(4)], "id string, country_code string, latitude double, longitude double").write.parquet(str(tmp_path / f"release={k}"))
    found = files.place_scan(spark, str(tmp_path / "release=*"), {"id": "string", "name": "string"}, country="fr", bbox=(5.0, 0.0, 25.0, 2.0))
    assert sorted(map(tuple, found.collect())) == [("FR1", None), ("FR2", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(country_code,FR), Gr" in plan


def test_json_fallback_of_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    assert files.json_or(spark, str(tmp_path / "a.json"), "x int").count() == 0
    assert files.json_or(spark, str(tmp_path / "none.json"), "x int").count() == 0


def test_export(spark, tmp_path):
    groups = spark.createDataFrame([(1, "Chez \"P\"", "Paris"), (2, "Krug", None)], "group_id long, place string, city string")
    lines = spark.createDataFrame([(1, "Rayas", "2011"), (1, "Corton", None)], "group_id long, line string, vintage string")
    out = sinks.export_rows(groups, lines)
    assert len(out.columns) == 15 and out.count() == 3 and out.where("Place = 'Krug' and `Matched line` = ''").count() == 1
    sinks.write_csv(out.coalesce(1), str(tmp_path / "x"), mark=True)
    (part,) = [p for p in (tmp_path / "x").iterdir() if p.name.startswith("part-")]
    raw = part.read_bytes()
    assert raw.startswith(b'\xef\xbb\xbf') or raw.startswith('"\ufeff'.encode())
    assert b'\r\n' in raw and b'"Chez ""P"""' in raw and gzip is not None


def test_staged_publish_into_a_version(spark, tmp_path):
    live = {"targets": spark.createDataFrame([(1, "a", "raw")], "id long, name string, country_raw string"), "sources": spark.createDataFrame([(1,)], "id long"), "entries": spark.createDataFrame([(1,)], "id long"), "runs": spark.createDataFrame([(1, "x")], "id long, status string")}
    staged = {"targets": spark.createDataFrame([(1, None), (2, "b")], "id long, name string"), "sources": spark.createDataFrame([(9,)], "id long"), "entries": spark.createDataFrame([], "id long"), "runs": spark.createDataFrame([(1, "y")], "id long, status string")}
    merge.publish(spark, merge.staged_publish(live, staged), str(tmp_path), "v1")
    read = lambda name: sorted(map(tuple, merge.published(spark, str(tmp_path), name).collect()), key=repr)
    assert read("targets") == [(1, None, "raw"), (2, "b", None)] and read("sources") == [(9,)] and read("entries") == [] and read("runs") == [(1, "y")]


def test_cross_store_join(spark):
    """Rows of one store against keys of another: two frames, a semi join."""
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "id long, parent long"), spark.createDataFrame([(5,)], "id long")
    assert [r["id"] for r in merge.with_parent(a, b, "parent").collect()] == [1]
