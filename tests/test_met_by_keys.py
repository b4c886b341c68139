"""Joins by keys and bounds against all pairs: fuzzy names, watches of any number, joined and swapped words."""

import math
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tastevin.functions import places, text
from tastevin.operators import matching, watch


def test_best_names_equal_all_pairs(spark):
    rng = random.Random(7)
    words = ["Le", "Grand", "Café", "bistro", "Wine", "Bar", "du", "Port", "No. 5", "", "x"]
    row = lambda i: (i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice("ab"), rng.choice([None, "", "https://s"]), rng.choice([None, "Road 1"]))
    left, right = [row(i) for i in range(60)], [row(i) for i in range(1000, 1080)]
    plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()

    def score(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    want = {}
    for i, name, block, *_ in left:
        found = [(score(plain(name), plain(n)), (0.25 if w else 0) + (0.15 if a else 0), -j) for j, n, k, w, a in right if k == block]
        good = [x for x in found if x[0] >= 0.55]
        if good:
            best = max(good, key=lambda x: (x[0] + x[1], x[2]))
            want[i] = (-best[2], pytest.approx(best[0]))
    schema = "id long, name string, block string, website string, address string"
    got = matching.best_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "block").collect()
    assert {r["id"]: (r["match_id"], r["score"]) for r in got} == want and len(want) > 20


def test_only_near_names_are_scored(spark, monkeypatch):
    """Names that differ by a letter are found without a look at all others of the block."""
    real, far = matching.name_score, lambda a, b: F.raise_error(F.concat(F.lit("scored: "), F.col(a), F.col(b)))
    monkeypatch.setattr(matching, "name_score", lambda a, b: F.when(F.levenshtein(F.col(a), F.col(b)) > 2, far(a, b).cast("double")).otherwise(real(a, b)))
    row = lambda i, end: (i, f"Wine bar {i % 1000:05d}{end}", "a", "https://s")
    left, right = (spark.createDataFrame(rows, "id long, name string, block string, website string") for rows in ([row(i, "a") for i in range(300)], [row(i, "b") for i in range(1000, 1300)]))
    assert {r["id"]: r["match_id"] for r in matching.best_names(left, right, "block").collect()} == {i: i + 1000 for i in range(300)}


def test_best_names_long_short_and_one_in_another(spark):
    rng = random.Random(11)
    some = lambda: "".join(rng.choice("abc 1") for _ in range(rng.choice([1, 3, 8, 9, 10, 62, 64, 65, 70])))
    names = [some() for _ in range(60)]
    names += [n[1:] + "c" for n in names[:20]] + [n[: len(n) // 2] for n in names[:20]] + [n + some() for n in names[:20]]
    rng.shuffle(names)
    rows = [(i, n, "k", rng.choice(["", "https://s"])) for i, n in enumerate(names)]
    left, right = rows[:50], rows[50:]
    plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")
    want = {}
    for i, name, *_ in left:
        a = plain(name)
        good = []
        for j, n, _, w in right:
            b = plain(n)
            score = 0.0 if not a or not b else 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
            if score >= 0.55:
                good.append((score + (0.25 if w else 0.0), -j, score))
        if good:
            want[i] = (-max(good)[1], max(good)[2])
    schema = "id long, name string, block string, website string"
    got = matching.best_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "block").collect()
    assert {r["id"]: (r["match_id"], r["score"]) for r in got} == want and len(want) > 30


def test_first_at_location_equals_all_pairs_and_looks_near(spark, monkeypatch):
    rng = random.Random(12)
    spots = [(48.85, 2.35), (48.8541, 2.35), (48.859, 2.351), (0.0, 179.9999), (0.0, -179.9999), (89.9999, 0.0), (89.9999, 180.0), (-45.0, 10.0), (None, 2.0), (float("nan"), 2.0), (10.0, 20.0)]
    row = lambda i: (i, rng.choice(["a", "b", None]), *rng.choice(spots), rng.choice(["", "FR", "fr", "DE", None]), rng.choice(["", "", "Road 1", "road 1", None]))
    left, right = [row(i) for i in range(150)], [row(i) for i in range(1000, 1120)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    def same(x, y):
        c, d, e, f = (text.fold_py(v) for v in (x[4], y[4], x[5], y[5]))
        close = None not in (*x[2:4], *y[2:4]) and km(*x[2:4], *y[2:4]) <= 1.0
        return x[1] is not None and x[1] == y[1] and not (c and d and c != d) and ((e != "" and e == f) or close)

    want = {x[0]: min(found) for x in left if (found := [y[0] for y in right if same(x, y)])}
    real = places.haversine_km
    monkeypatch.setattr(places, "haversine_km", lambda a, b, c, d: F.when(F.abs(a - c) > 1, F.raise_error(F.lit("far places met")).cast("double")).otherwise(real(a, b, c, d)))
    schema = "id long, name string, lat double, lng double, country string, address string"
    got = matching.first_at_location(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["name"]).collect()
    assert {r["id"]: r["match_id"] for r in got} == want and len(got) == len(want) > 60


@pytest.mark.parametrize(("few", "literal"), [(64, 1000), (1, 1000), (1, 2)], ids=["one by one", "literal", "joined"])
def test_watches_by_any_number(spark, monkeypatch, few, literal):
    monkeypatch.setattr(watch, "FEW", few)
    monkeypatch.setattr(watch, "LITERAL", literal)
    rng = random.Random(8)
    parts = ["red", "blue", "wine", "Château", "no", "1999", "2001", "x", "ab"]
    lines = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(200, None)]
    watches = [("red wine", ""), ("chateau", "1999"), ("x", ""), ("ab no", "2001"), ("", ""), ("zzz", "")]
    got = watch.matches(spark.createDataFrame(lines, "id long, text string"), spark.createDataFrame(watches, "keyword string, vintage string")).collect()
    want = {(i, k, v) for i, body in lines if body for k, v in watches if k and all(t in text.fold_py(body) for t in k.split()) and v in body}
    assert {(r["id"], r["keyword"], r["watch_vintage"]) for r in got} == want and len(got) == len(want)


def test_long_tokens_have_small_patterns():
    assert max(map(len, text.run_patterns("abcdefghijklmnopqrstuvwxyz"))) < 40_000


def test_tokens_equal_the_definition(spark):
    rng = random.Random(9)
    bodies = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["a a a a a", "aab-aa", "é_x", ""]

    def matches(token, body):
        if token in body:
            return True
        ws = re.findall(r"\w+", body)
        runs = {"".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)}
        return len(token) >= 5 and any(s in runs for s in [token, *(token[:k] + token[k + 1] + token[k] + token[k + 2 :] for k in range(len(token) - 1))])

    tokens = ["".join(rng.choice("ab") for _ in range(n)) for n in (2, 4, 5, 5, 6, 6, 7, 8)] + ["aaaaa"]
    frame = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = frame.select("id", *(text.matches_all([t], text.fold("body")).alias(f"t{k}") for k, t in enumerate(tokens))).orderBy("id").collect()
    for r, body in zip(got, bodies, strict=True):
        assert [r[f"t{k}"] for k in range(len(tokens))] == [matches(t, text.fold_py(body)) for t in tokens], body
