"""The HTML tokenizer on hostile pages, against the standard library's parser where both are defined, and its two Spark forms."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tastevin.operators import html

HOSTILE = (
    "<!doctype html><html><head><title>A &amp; <b>b</title><meta name=Description content='it&#39;s \"so\"'><meta property=\"og:title\" content=OG><meta name=x><link rel='shortcut CANONICAL' href=/c?a=1&amp;b=2>"
    "<style>.x{} </p></style><script>var a = '<p>no</p>';</script><script type=application/ld+json>{\"a\": \"</p>\"}</script></head>"
    "<body><noscript><a href='/hidden'>no</a></noscript><a href='/X'>X <i>y</i></a><a href=/y>Y</a><A HREF = \"/z\" title='a > b'>Z</A><a>none</a><a href=''>empty</a>"
    "<h1 class=h>Head<br>line</h1><h2></h2><p>one<p>two<!-- <p>three</p> -->four</div>1 < 2 &lt; 3 &nosuch; &#x41;<td>cell</td><td>next</td><textarea><b>raw</b></textarea><br/>end<a href=/open>never closed"
)


def test_hostile_page():
    assert html.visible_lines(HOSTILE) == ["A & <b>b X y Y Z none empty", "Head", "line", "one", "two four", "1 < 2 < 3 &nosuch; A cell next <b>raw</b>", "end never closed"]
    assert html.facts(HOSTILE) == [
        ("title", "", "A & <b>b"), ("meta", "description", "it's \"so\""), ("meta", "og:title", "OG"), ("canonical", "", "/c?a=1&b=2"), ("json_ld", "", '{"a": "</p>"}'),
        ("link", "/X", "X y"), ("link", "/y", "Y"), ("link", "/z", "Z"), ("heading", "h1", "Head line"),
    ]


def test_nothing_and_broken_ends():
    for page in (None, "", "<", "<a", "<a href", "<a href=", "<a href='x", "<!--", "<!", "</", "</p", "<script>", "<title", "&", "<a/>", "< p>", "<<p>>", "<p\x00>"):
        html.facts(page)
        html.visible_lines(page)
    assert html.visible_lines("a<b") == ["a"] and html.visible_lines("a < b") == ["a < b"]


def test_same_tags_as_the_standard_parser():
    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            self.found.append(("open", tag, {k: v or "" for k, v in reversed(attrs)}))

        def handle_endtag(self, tag):
            self.found.append(("close", tag, {}))

    rng = random.Random(3)
    pieces = ["<p>", "</p>", "<a href=x>", "<a href='q w'>", '<a href="q&amp;w" b>', "</a>", "text ", "&amp;", "<!-- c -->", "<br>", "<div class=a id='b'>", "</div>", "\n", "<h1>", "</h1>", "é", "<i title=\"a>b\">"]
    for _ in range(300):
        page = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        parser = Parser()
        parser.feed(page)
        parser.close()
        assert [t for t in html.tokens(page) if t[0] != "text"] == parser.found


def test_spark_forms(spark):
    pages = spark.createDataFrame([(1, HOSTILE, "k"), (2, None, "k"), (3, "", "k"), (1, HOSTILE, "again")], "page_id long, html string, kind string")
    want = [(1, k, *f) for _ in range(2) for k, f in enumerate(html.facts(HOSTILE))]
    assert sorted(tuple(r) for r in html.page_facts(pages, "page_id").collect()) == sorted(want)
    joined = pages.select("page_id", "html").lateralJoin(html.html_facts(F.col("html").outer())).drop("html")
    assert sorted(tuple(r) for r in joined.collect()) == sorted(want)
    html.register(spark)
    pages.createOrReplaceTempView("some_pages")
    lines = spark.sql("select page_id, line_no, line from some_pages, lateral html_lines(html)")
    assert sorted(tuple(r) for r in lines.collect()) == sorted(tuple(r) for r in html.page_lines(pages, "page_id").collect()) == sorted((1, k, x) for _ in range(2) for k, x in enumerate(html.visible_lines(HOSTILE)))
    assert html.page_lines(pages.limit(0), "page_id").collect() == []


#: A page cut inside an entity, as large tables have them: the SQL resolves what ends in a semicolon.
CUT = "<title>A&amp;&amp</title><p>B &copy; &copy C&am</p><h1>D&quot;&lt</h1>"


def test_entities_without_an_end():
    assert html.visible_lines(CUT, closed=True) == ["A&&amp", "B © &copy C&am", 'D"&lt'] and html.visible_lines(CUT) == ["A&&", "B © © C&am", 'D"<']
    assert html.visible_lines("&#65;&#x42;&#67 &notit; &amp;lt; &#0;", closed=True) == ["AB&#67 &notit; &lt; \ufffd"]


def against_sql(spark, tmp_path, name, rows):
    import duckdb

    from tastevin.plans import registry

    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = sorted((tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr)
    return got


def test_exact_text_equals_its_sql(spark, tmp_path):
    got = against_sql(spark, tmp_path, "s5_exact_text", [(1, "u", CUT), (2, "u", None), (1, "u", "<p>again</p>"), (None, "u", "<p>x</p>"), (None, "u", "<p>y</p>"), (3, "u", "<p> </p>")])
    assert len(got) == 4


def test_page_facts_equal_their_sql(spark, tmp_path):
    rows = [(1, "u", CUT + '<a href="/x?a=1&amp;b&amp">Go &amp</a>'), (2, "u", None), (1, "u", CUT), (None, "u", CUT)]
    assert ("link", "/x?a=1&b&amp", "Go &amp") in {r[1:4] for r in against_sql(spark, tmp_path, "s6_page_facts", rows)}
