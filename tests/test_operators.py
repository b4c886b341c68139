"""Operators on small tables: invariants, merges, streams, files."""

import base64
import gzip
import json
import re
import unicodedata
import zipfile

from pyspark.sql import functions as F

from tastevin.operators import dashboard, extract, matching, merge, search
from tastevin.sources import files, sinks
from tastevin.streaming import offers


def test_filter_comes_before_limit(spark):
    rows = [(k, 1, f"decoy {k}", "b", 1.0, "2020", 0) for k in range(2001)] + [(9999, 1, "the rayas", "b", 99.0, "2011", 0)]
    products = spark.createDataFrame(rows, "id long, merchant_id long, name string, brand string, price double, vintage string, seen_at int")
    merchants = spark.createDataFrame([(1, "Shop", "CH", "Geneva", True)], "id long, name string, country string, city string, active boolean")
    got = search.shop_search(products, merchants, search.SearchParams("Räyas shop", limit=1)).collect()
    assert [r["id"] for r in got] == [9999]


def test_adding_a_token_never_adds_rows(spark):
    df = spark.createDataFrame([("red wine",), ("red",), ("wine red old",)], "name string").withColumn("vintage", F.lit(""))
    count = lambda q: search.filtered(df, search.SearchParams(q), F.col("name")).count()
    assert count("") >= count("red") >= count("red wine") >= count("red wine old") == 1


def test_clusters_cover_every_row(spark):
    rows = [(i, 40.7 + (i % 10) / 1000, -74 + (i % 15) / 1000, "found" if i % 3 == 0 else "review") for i in range(320)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, status string")
    for zoom in (0, 6, 12, 16):
        c = dashboard.assert_covered(dashboard.grid_clusters(df, zoom), 320)
        assert c.agg(F.sum("n")).first()[0] == 320


def test_sample_is_balanced(spark):
    df = spark.createDataFrame([(i, "US") for i in range(20)] + [(50, "FR"), (60, "JP")], "id long, country string")
    assert {r["country"] for r in dashboard.balanced_sample(df, "country", 3).collect()} == {"US", "FR", "JP"}
    assert dashboard.balanced_sample(df, "country", 10).count() == 10


def test_merge_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "", "x")], "id long, name string, note string")
    new = spark.createDataFrame([(2, "b", ""), (3, "c", "z")], "id long, name string, note string")
    how = {"name": merge.non_empty_incoming_wins, "note": merge.keep_old_unless_empty}
    once = merge.upsert(old, new, ["id"], how)
    assert sorted(map(tuple, once.collect())) == [(1, "a", None), (2, "b", "x"), (3, "c", "z")]
    assert sorted(map(tuple, merge.upsert(once, new, ["id"], how).collect())) == sorted(map(tuple, once.collect()))


def test_publish_swaps_whole_versions(spark, tmp_path):
    root = str(tmp_path / "live")
    merge.publish(spark, {"t": spark.range(2)}, root, "v1")
    merge.publish(spark, {"t": spark.range(3)}, root, "v2")
    assert merge.published(spark, root, "t").count() == 3


def test_reconcile_uses_each_line_once(spark):
    lines = "id long, g long, text string, vintage string, price double"
    a = spark.createDataFrame([(1, 1, "chablis dauvissat 2019", "2019", 90.0), (2, 1, "chablis dauvissat", "", 80.0)], lines)
    b = spark.createDataFrame([(7, 1, "dauvissat chablis 2019", "2019", 90.0)], lines)
    assert [(r["id"], r["other_id"]) for r in matching.reconcile(a, b, "g").collect()] == [(1, 7)]


def test_line_score_and_rejects(spark):
    score = lambda s: spark.createDataFrame([(s,)], "x string").select(extract.line_score(F.col("x"))).first()[0]
    assert score("2019 Domaine Leroy Vosne-Romanee EUR 1500") >= 7
    assert score("Wine pairing dinner 2019 EUR 150") == 0 and score("short") == 0


def test_sections_stop_at_the_next_header(spark):
    lines = spark.createDataFrame([(1, 0, "Domaine Cave"), (1, 1, "2019 Chablis 90"), (1, 2, "Other house"), (1, 3, "2018 Volnay 80"), (2, 0, "2017 Rully 70")], "d long, pos int, line string")
    assert [r["text"] for r in extract.section_rows(lines, "d", ["cave"]).collect()] == ["Domaine Cave, 2019 Chablis 90"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿wine,price\r\nRayas,1700\r\n".encode())
    assert [r["line"] for r in files.csv_lines(spark, str(tmp_path / "a.csv")).collect()] == ["wine price", "Rayas 1700"]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Rayas</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>1700</v></c></row></sheetData></worksheet>')
    assert [r["line"] for r in files.xlsx_lines(spark, str(tmp_path / "a.xlsx")).collect()] == ["Rayas 1700"]
    packed = base64.b64encode(gzip.compress(json.dumps([{"a": 1}, {"a": 2}]).encode())).decode()
    assert [r["a"] for r in files.packed_chunks(spark.createDataFrame([(packed,)], "value string"), "struct<a:int>").collect()] == [1, 2]
    assert files.json_or(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_snapshot_chunks_round_trip(spark):
    df = spark.range(120).select(F.col("id"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("text"))
    parts = sinks.packed(df, ["id"], 50)
    assert sorted(r["n"] for r in parts.collect()) == [20, 50, 50]
    assert files.packed_chunks(parts, "struct<id:long,text:string>").count() == 120


def test_csv_sink(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([('a "b"', 1)], "t string, n int").coalesce(1), str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert body == b'"t","n"\r\n"a ""b""","1"\r\n'


def test_streamed_offers_equal_the_batch(spark, tmp_path):
    rows = [(1, "a", 5.0, "2024-01-01 00:00:00"), (1, "a", 5.0, "2024-01-01 00:05:00"), (2, "b", 7.0, "2024-01-01 00:10:00")]
    df = spark.createDataFrame(rows, "product_id long, status string, price double, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    history = str(tmp_path / "history")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(offers.append_exactly(spark, history)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = spark.read.parquet(history)
    assert got.count() == 2 == offers.offer_history(df).count()


def test_watches_never_meet_all_lines(spark):
    """20,000 watches: an equi-join, with the hits that all pairs give."""
    from tastevin.operators import watch

    words = ["red", "blue", "old", "new", "widget", "bolt", "gear", "é8", "x"]
    lines = [(k, f"{words[k % 9].title()} {words[k % 7]}-{k % 50}, {1990 + k % 20}") for k in range(300)]
    watches = [(f"{words[k % 9]} {k % 70}", str(1990 + k % 20) if k % 3 == 0 else "") for k in range(20_000)] + [("", ""), ("--", "")]
    a, b = spark.createDataFrame(lines, "id long, text string"), spark.createDataFrame(watches, "keyword string, vintage string").distinct()
    for how in ("tokens", "phrase", "plain"):
        hits = watch.matches(a, b, how=how)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    hits = watch.matches(a, b).select("id", "keyword", "watch_vintage")
    fold = lambda s: re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFD", s.lower()).encode("ascii", "ignore").decode()).strip()
    want = {(k, w, v) for k, t in lines for w, v in set(watches) if fold(w) and all(x in fold(t) for x in fold(w).split()) and v in t}
    assert sorted(map(tuple, hits.collect())) == sorted(want)


def test_watch_report_shows_the_first_names(spark):
    from tastevin.operators import watch

    rows = [("k", "", f"r{j:02d}", j % 2, j) for j in range(60)] + [("k", "", None, 1, 1), ("k", "", "r01", 0, 0), ("z", "1", None, 0, 0)]
    hits = spark.createDataFrame(rows, "keyword string, watch_vintage string, restaurant string, first_seen int, last_seen int").withColumn("checked_at", F.lit(5))
    got = {r["keyword"]: r for r in watch.report(hits, F.lit(0), F.lit(5)).collect()}
    k = got["k"]
    assert (k["match_count"], k["restaurant_count"], k["new_count"], k["stale_count"]) == (62, 60, 30, 5)
    assert k["new_restaurants"] == ";".join(f"r{j:02d}" for j in range(1, 40, 2)) and k["stale_restaurants"] == ";".join(f"r{j:02d}" for j in range(5))
    assert (got["z"]["match_count"], got["z"]["restaurant_count"], got["z"]["new_restaurants"]) == (1, 0, "")
