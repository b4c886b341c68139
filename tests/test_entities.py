"""Entities, the review queue and tiles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tastevin.operators import dashboard, entities, reviews, tiles
from tastevin.sources import shared


def united(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng, n = random.Random(2), 300
    links = {"chain": [(i, i + 1) for i in range(0, 250)], "star": [(299, i) for i in range(100)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(160)]}[shape]
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in entities.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = united(n, links)
    assert got == {x: want[x] for link in links for x in link}


def test_entities_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None, ""]), rng.choice(["", None, *(f"d{k}" for k in range(40))]), rng.choice([None, *[rng.randrange(-60, 60) / 2000] * 9]), rng.randrange(-60, 60) / 2000) for i in range(160)]
    links = []
    for i, n, d, x, y in rows:
        for j, m, e, u, v in rows:
            near = n and n == m and x is not None and u is not None and abs(x - u) <= 0.003 and abs(y - v) <= 0.003
            if i < j and ((d and d == e) or near):
                links.append((i, j))
    got = {r["id"]: r["entity"] for r in entities.entities(spark.createDataFrame(rows, "id long, name string, domain string, lat double, lng double")).collect()}
    assert got == dict(enumerate(united(160, links)))
    assert len(set(got.values())) > 10


def test_a_hot_place_is_no_pairs(spark):
    rows = spark.range(3000).select("id", F.lit("a").alias("name"), F.lit("").alias("domain"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    assert entities.near(rows, "name", 0.003).count() == 2999


def test_review_cycle(spark):
    schema = "merchant_id long, status string, error string"
    runs = [
        ([(1, "review", "timeout"), (2, "rejected", ""), (3, "found", "")], "2026-01-01"),
        ([(1, "review", "timeout again"), (2, "found", ""), (4, "review", None)], "2026-01-02"),
        ([(1, "found", ""), (1, "found", ""), (2, "rejected", "other shop")], "2026-01-03"),
        ([(1, "review", "down")], "2026-01-04"),
    ]
    queue = spark.createDataFrame([], reviews.SCHEMA)
    for rows, at in runs:
        queue = reviews.after_run(queue, spark.createDataFrame(rows, schema), F.lit(at).cast("timestamp"))
    day = lambda t: None if t is None else t.day
    got = sorted(((r["merchant_id"], r["reason"], r["detail"], day(r["opened_at"]), day(r["valid_from"]), day(r["valid_to"]), r["status"]) for r in queue.collect()), key=str)
    fetch, other = reviews.FETCH, reviews.IDENTITY
    assert got == sorted([
        (1, fetch, "timeout", 1, 1, 2, "refreshed"), (1, fetch, "timeout again", 1, 2, 3, "resolved"), (1, fetch, "down", 4, 4, None, "open"),
        (2, other, "Official website belongs to a different business.", 1, 1, 3, "refreshed"), (2, other, "other shop", 1, 3, None, "open"), (4, fetch, "Unknown error", 2, 2, None, "open"),
    ], key=str)


def test_tiles(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-60, 85), rng.uniform(-180, 180), rng.choice(["found", "no_wine_list", "review", None])) for i in range(900)] + [(900, 10.0, 180.0, "found"), (901, 10.0, -180.0, "found"), (902, None, 3.0, "found")]
    points = spark.createDataFrame(rows, "id long, lat double, lng double, status string")
    tiles.write(tiles.pyramid(points, 8), str(tmp_path / "tiles"))
    kept = spark.read.parquet(str(tmp_path / "tiles"))
    assert {r["n"] for r in kept.groupBy("zoom").agg(F.sum("n").alias("n")).collect()} == {902}
    # a cell's key is its parent's with two bits more
    keys = {z: {r["key"] for r in kept.where(F.col("zoom") == z).collect()} for z in (7, 8)}
    assert {k >> 2 for k in keys[8]} == keys[7]
    plain = lambda df: sorted((r["lat_key"], r["lng_key"], r["n"], round(r["lat"], 9), round(r["lng"], 9), r["found"], r["none"], r["pending"], r["kind"], r["point_id"]) for r in df.collect())
    placed = points.where("lat is not null")
    for zoom in (0, 3, 8):
        assert plain(tiles.clusters(kept.where(F.col("zoom") == zoom))) == plain(dashboard.grid_clusters(placed, zoom))
    for zoom, west, south, east, north in ((3, -180, -60, 180, 85), (4, 20, -60, 10, 85), (2, -75.3, -41.7, 120.2, 80.1)):
        seen = placed.where(tiles.places.in_view(F.col("lat"), F.col("lng"), west, south, east, north))
        assert plain(tiles.view(kept, points, zoom, west, south, east, north)) == plain(dashboard.grid_clusters(seen, zoom))
    few = tiles.view(kept, points, 3, 0, 0, 20, 20).collect()
    assert 0 < len(few) <= 250 and all(r["n"] == 1 and r["lat_key"] is None for r in few)


def test_numbering(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc")) for i in range(500)]
    got = shared.numbered(spark.createDataFrame(rows, "id long, k string").repartition(7), ["k", "id"]).collect()
    assert [(r["id"], r["k"]) for r in sorted(got, key=lambda r: r["turn"])] == sorted(rows, key=lambda r: (r[1], r[0]))
    assert sorted(r["turn"] for r in got) == list(range(1, 501))
    assert shared.numbered(spark.createDataFrame([], "id long"), ["id"]).collect() == []
