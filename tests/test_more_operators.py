"""Product lines, embedded records, page text, links, crawl order, timing."""

from pyspark.sql import functions as F

from tastevin.functions import places
from tastevin.operators import dashboard, extract


def test_product_lines(spark):
    lines = ["2011 Chateau Rayas CHF 1700", "Moulin a Vent 2021 William Kelley 300, 100% Gamay", "Welcome to our Burgundy dinner", "window.burgundy = 2011", "Plain text 2011 EUR 20"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(extract.product_line(F.col("x"))).collect()]
    assert (got[0]["price_value"], got[0]["vintage"], got[0]["currency"]) == (1700.0, "2011", "CHF")
    assert got[1]["price_value"] == 300.0 and got[1]["vintage"] == "2021"
    assert got[2:] == [None, None, None]


def test_embedded_products(spark):
    html = '<script>"[{\\"fields\\":{\\"Name\\":\\"Rayas\\",\\"Vintage\\":\\"2011\\",\\"Price\\":170.5,\\"Producer Name\\":[\\"Reynaud\\"]}}]"</script>'
    (got,) = spark.createDataFrame([(html,)], "x string").select(extract.embedded_products(F.col("x")).alias("p")).first()["p"]
    assert (got["name"], got["vintage"], got["producer"], got["price"]) == ("Rayas", "2011", "Reynaud", 170.5)


def test_visible_lines(spark):
    df = spark.createDataFrame([(1, 0, "Chablis"), (1, 1, "EUR 90"), (1, 2, "end"), (2, 0, "x" * 90)], "d long, pos int, line string")
    assert sorted(map(tuple, extract.visible_lines(df, "d").collect())) == [(1, 0, "Chablis EUR 90"), (1, 2, "end"), (2, 0, "x" * 90)]


def test_external_site(spark):
    rows = [(1, "https://dir.example.com", "https://dir.example.com/a", "more"), (1, "https://dir.example.com", "https://facebook.com/x", "f"), (1, "https://dir.example.com", "https://shop.example.org/en/home", "Website"), (1, "https://dir.example.com", "https://z.example.org", "other")]
    df = spark.createDataFrame(rows, "id long, own string, href string, text string")
    assert extract.external_site(df, "id", "own").first()["site"] == "https://shop.example.org/en/home"


def test_best_first(spark):
    rows = [("s", None, "root", 1.0), ("s", "root", "menu", 10.0), ("s", "root", "wine", 80.0), ("s", "wine", "list", 100.0), ("s", "list", "deep", 1.0)]
    df = spark.createDataFrame(rows, "site string, source string, url string, score double")
    assert [r["url"] for r in extract.best_first(df, pages=4).orderBy("turn").collect()] == ["root", "wine", "list", "menu"]
    assert extract.best_first(df, depth=1).count() == 3


def test_phase_eta(spark):
    rows = [("r", 180, 30, 100, "p"), ("r", 200, 50, 100, "p"), ("r", 100, 0, 100, "old")]
    df = spark.createDataFrame(rows, "run string, s long, processed long, total long, phase string").withColumn("ts", F.timestamp_seconds("s"))
    got = dashboard.phase_eta(df, "run").first()
    assert (round(got["left"]), round(got["per_minute"])) == (50, 60)
    one = spark.range(1).select(dashboard.stalled(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:16:00").cast("timestamp")).alias("x"), *dashboard.timing(F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200)), F.lit(100), F.lit(50))).first()
    assert one["x"] and (one["elapsed"], one["left"]) == (100.0, 100.0)


def test_list_country(spark):
    df = spark.createDataFrame([("CA", True), ("CA", False), ("UK", False)], "c string, us boolean")
    assert [r["country_code"] for r in places.list_country(df, "c", us_hint=F.col("us")).orderBy(F.desc("us"), "c").collect()] == ["US", "CA", "GB"]


def test_small_helpers(spark):
    """Titles, stored times, hashes, totals nearby, first hits of sources, targets whose parts are all there."""
    from tastevin.functions import misc, web
    from tastevin.operators import search
    from tastevin.streaming import offers

    one = lambda value, expr: spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]
    assert one("<head><title lang=en> A &amp; B\n</title>", web.html_title) == "A & B"
    assert one("2026-05-16 10:00:00", misc.parse_time) == one("2026-05-16T10:00:00+00:00", misc.parse_time) is not None and one("soon", misc.parse_time) is None
    assert one("a", lambda c: misc.stable_hash(c, F.lit(None).cast("string").alias("y"))) != one("b", lambda c: misc.stable_hash(c, F.lit(None).cast("string").alias("y")))
    points = spark.createDataFrame([(48.85, 2.35), (48.86, 2.35), (50.0, 2.35), (None, None)], "lat double, lng double")
    assert dashboard.nearby_total(points, 48.85, 2.35, 5.0).first()["n"] == 2
    rows = spark.createDataFrame([(1, "a", "Rayas"), (2, "a", "Rayas"), (3, "b", "Krug"), (4, "b", "rayas 2")], "id long, source string, text string")
    assert [r["id"] for r in search.first_per_source(rows, search.SearchParams("rayas"), "source", ["id"], "text").collect()] == [1, 4]
    parts = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "k long, expected int")
    assert [r["k"] for r in offers.complete_targets(parts, "k", "expected").collect()] == [1]
