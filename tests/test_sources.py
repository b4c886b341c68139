"""Sources, names and the smaller functions."""

from pyspark.sql import functions as F

from tastevin.functions import money, text
from tastevin.operators import search, venues
from tastevin.sources import files, sinks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_place_scan_fills_missing_columns(spark, tmp_path):
    spark.range(2).select("id", F.lit("n").alias("name")).write.parquet(str(tmp_path / "p"))
    rows = files.place_scan(spark, str(tmp_path / "p"), {"id": "string", "basic_category": "string"}).collect()
    assert sorted(map(tuple, rows)) == [("0", None), ("1", None)]


def test_sitemap_keeps_its_own_domain(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://www.a.example/x</loc></url><url><loc> https://b.example/y </loc></url></urlset>")
    assert [r["url"] for r in files.sitemap_urls(spark, str(tmp_path / "s.xml"), "https://a.example").collect()] == ["https://www.a.example/x"]


def test_catalogue_variants(spark):
    df = spark.createDataFrame([('{"products":[{"title":"Rayas","variants":[{"title":"75cl","price":"170.00"},{"title":"magnum","price":"x"}]}]}',)], "value string")
    assert sorted(map(tuple, files.catalogue_variants(df).collect())) == [("Rayas", "75cl", 170.0), ("Rayas", "magnum", None)]


def test_names_and_paths(spark):
    assert one(spark, "✕ Chez Paul ", text.clean_venue_name) == "Chez Paul" and one(spark, "❌x", text.venue_needs_review) and not one(spark, "x", text.venue_needs_review)
    assert one(spark, "a&amp;b &nbsp; c", text.clean_text) == "a&b c"
    assert one(spark, "Domaine A Domaine A 2019Rully", text.repeated_phrase_removed).endswith("2019 Rully")
    assert one(spark, 'a/b:"c"', lambda c: sinks.pdf_path(c, F.lit(""), c, F.lit("7"))) == "pdfs/a b c/city/a b c-7.pdf"
    assert one(spark, "Chez ✕", lambda c: venues.venue_key(c, F.lit("Paris"), F.lit("FR"))) == "chez|paris|fr"


def test_collapsed_price(spark):
    df = spark.createDataFrame([(12018.0, "12018", "FR", False), (12018.0, "12018", "JP", False), (12018.0, "12018", "FR", True)], "v double, n string, c string, has boolean")
    assert [r[0] for r in df.select(money.collapsed_price(F.col("v"), F.col("n"), F.col("c"), F.col("has"))).collect()] == [120.0, 12018.0, 12018.0]


def test_anchor_and_limits():
    p = search.SearchParams("Château Margaux", limit=10**9)
    assert p.anchor == "margaux" and p.most == search.MOST and search.SearchParams(limit=0).most == 1
