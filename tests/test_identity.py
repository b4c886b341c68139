"""Whose site it is, what counts as a catalogue and which links come first."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from tastevin.functions import rules, web
from tastevin.operators import html, identity


def profiles(spark, pages):
    return html.page_profiles(spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "id long, url string, html string"), "id", "url")


def test_rejection(spark):
    late = "filler " * 20_000 + "<p>Harness racing, race results, raceway</p>"
    pages = [
        ("https://a.example", "<title>Harness Racing</title><h1>Race results</h1><p>post position"), ("https://a.example", "<p>harness racing, race results, racetrack. Wine & Spirits"),
        ("https://a.example", "<p>harness racing, race results"), ("https://a.example/race-results", "<meta name=description content='Horse Racing'><a href='/raceway'>x</a>"),
        ("https://a.example", "<p>harness racing, race results, racetrack <a href='/shop/wines'>all</a>"), ("https://a.example", late), (None, None), ("", ""), ("https://a.example", "<script>harness racing race results raceway</script>"),
    ]
    got = [r["rejection"] for r in identity.rejection(profiles(spark, pages)).orderBy("id").collect()]
    wrong = "Official website is a horse-racing business, not a wine retailer ({})."
    assert got == [wrong.format("harness racing, post position, race results"), "", "", "", "", wrong.format("harness racing, race results, raceway"), "", "", ""]


def test_catalogue(spark):
    cases = [
        ("https://a.example/shop/red", "", 1, 1, True), ("https://a.example/shop/red", "", 2, 0, False), ("https://a.example/shop/red", "", 3, 0, True), ("https://a.example/wine/x", "", 1, 1, True), ("https://a.example/wine/x", "", 5, 0, False),
        ("https://a.example/x", "", 2, 2, False), ("https://a.example/x", "<p>Add to cart", 2, 2, True), ("https://a.example/x", "<a href=/cart>c</a>", 2, 2, True), ("https://a.example/x", "<p>Add to cart", 2, 1, False),
        ("https://a.example/blog/shop", "<p>Add to cart", 9, 9, False), ("https://a.example/shop", "<title>Latest NEWS</title>", 9, 9, False), ("https://a.example/wine_list", "", 1, 1, True), ("https://a.example/wine%2Dlist", "", 1, 1, True),
        ("https://a.example/100%", "", 1, 1, False), ("https://a.example/shop", "", 0, 0, False), (None, None, None, None, False),
    ]
    rows = profiles(spark, [(u, h) for u, h, *_ in cases]).join(spark.createDataFrame([(k, n, p) for k, (_, _, n, p, _) in enumerate(cases)], "id long, products int, priced int"), "id")
    assert [r["catalogue"] for r in identity.is_catalogue(rows).orderBy("id").collect()] == [c[-1] for c in cases]


def test_link_priority_and_top(spark):
    def plain(url, label):
        hay = f"{url} {label}".lower()
        words = 8 * sum(w in hay for w in rules.SHOP_LINK)
        file = url.split("?")[0].split("#")[0].lower().endswith(tuple(rules.SHOP_FILES))
        return words + (0 if not file else 6 if words else -6) + 3 * any(w in hay for w in rules.SHOP_PLACES) - 12 * any(w in hay for w in rules.SHOP_ASIDE)

    links = [("/wine-list.pdf", ""), ("/a.PDF", ""), ("/a.pdf?x=1", "Wine"), ("/shop", ""), ("/cart", "Shop wine"), ("/x", "Price-List"), ("/login", ""), ("/a.pdfx", "")]
    frame = spark.createDataFrame(links, "href string, text string")
    got = [r["p"] for r in frame.select(identity.shop_link_priority(F.col("href"), F.col("text")).alias("p")).collect()]
    assert got == [plain(*x) for x in links]
    many = spark.range(500).select((F.col("id") % 2).alias("site"), F.concat(F.lit("/wine/"), (F.col("id") % 300).cast("string")).alias("href"), F.lit("").alias("text"))
    best = identity.best_links(many, "site").collect()
    assert len(best) == 120 and all(r["rank"] <= 60 for r in best) and len({(r["site"], r["href"]) for r in best}) == 120


def test_websites_and_joined_addresses(spark):
    sites = [("https://www.place.example", True), ("place.example/a", True), ("https://m.facebook.com/x", False), ("http://www.tripadvisor.fr/a", False), ("", False), (None, False), ("https://guide.michelin.com", False)]
    got = spark.createDataFrame(sites, "u string, ok boolean").select(web.valid_website(F.col("u")).alias("got"), "ok").collect()
    assert all(r["got"] == r["ok"] for r in got)
    bases = ["https://a.example/x/y.html?q=1", "https://a.example", "http://a.example/x/"]
    hrefs = ["b.html", "/c", "../d", "../../e/", "./f", "?p=2", "#top", "//other.example/z", "https://o.example/p#f", "g/./h/../i", "..", "a?x=../y", "j/"]
    rows = [(b, h, urljoin(b, h).split("#")[0]) for b in bases for h in hrefs] + [(bases[0], x, "") for x in ("mailto:a@b.example", "javascript:void(0)", "TEL:1", "", None)] + [("", "a", ""), (None, "/a", "")]
    got = spark.createDataFrame(rows, "b string, h string, want string").select("b", "h", web.joined_url(F.col("b"), F.col("h")).alias("got"), "want").collect()
    assert [(r["b"], r["h"], r["got"]) for r in got] == [(r["b"], r["h"], r["want"]) for r in got]
