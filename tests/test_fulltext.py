"""The kept index against plain Python over the merged rows."""

import random
import re
import zlib

import pytest

from tastevin.functions import text
from tastevin.operators.fulltext import KeptIndex


def words(body):
    return re.findall(r"\w+", text.fold_py(body))


def token_matches(token, body):
    folded, ws = text.fold_py(body), words(body)
    if token in folded:
        return True
    runs = {"".join(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1)}
    return len(token) >= 5 and any(token[:k] + token[k + 1] + token[k] + token[k + 2 :] in runs or token in runs for k in range(len(token) - 1))


ROWS = [
    (1, "Château Margaux 1998"), (2, "cha teau mar gaux"), (3, "Chateua Margaux, second"), (4, "Red, red wine"), (5, ""), (6, None), (7, "Straße nach Süden"),
    (8, "mo et chan don"), (9, "moëtchandon"), (10, "abc de fgh"), (11, "a b c"), (12, "margaux"),
]


def both(spark, index, now):
    rng = random.Random(1)
    for tokens in (["margaux"], ["chateau", "margaux"], ["red", "wine"], ["strasse"], ["nothing"]):
        want = {k for k, b in now.items() if set(tokens) <= set(words(b))}
        assert {r["key"] for r in index.search(tokens).collect()} == want, tokens
        assert {r["key"] for r in index.search(tokens, every=False).collect()} == {k for k, b in now.items() if set(tokens) & set(words(b))}
    queries = {0: ["chateau", "margaux"], 1: ["moetchandon"], 2: ["moetchadnon"], 3: ["re"], 4: ["ar", "gau"], 5: ["zzz", "margaux"], 6: ["abcdefgh"], 7: ["chaetau"], 8: ["abc"], 9: [], 10: ["new"], 11: ["qq"]}
    for k in range(20, 40):
        queries[k] = rng.sample(["ar", "mar", "red", "1998", "wine", "chateau", "second", "nach", "et"], 2)
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "q int, token string")
    got = {(r["q"], r["key"]) for r in index.batch(asked, "q", "token").collect()}
    assert got == {(q, k) for q, ts in queries.items() if ts for k, b in now.items() if all(token_matches(t, b) for t in ts)}


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id long, body string")
    return KeptIndex(spark, str(tmp_path_factory.mktemp("index") / "kept"), 8).build(rows, "id", "body")


def test_build_and_search(spark, filled):
    both(spark, filled, dict(ROWS))


def test_a_search_opens_its_buckets(filled):
    found = filled.search(["margaux"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*bucket#\d+ = {zlib.crc32(b'margaux') % 8}\)", plan), plan


def test_merge_delete_compact(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "kept"), 8).build(spark.createDataFrame(ROWS, "id long, body string"), "id", "body")
    now = dict(ROWS)
    changes = [(1, "Chateau Latour new"), (13, "new margaux"), (5, "red")]
    index.merge(spark.createDataFrame(changes, "id long, body string"), "id", "body", deleted=spark.createDataFrame([(12,), (99,)], "id long"))
    now.update(changes)
    now.pop(12)
    both(spark, index, now)
    again = [(13, "wine"), (12, "back: margaux")]
    index.merge(spark.createDataFrame(again, "id long, body string"), "id", "body")
    now.update(again)
    both(spark, index, now)
    assert index.live == [0, 1, 2]
    index.compact().vacuum()
    assert index.live == [3]
    both(spark, index, now)


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kept")
    rows = spark.createDataFrame(ROWS[:2], "id long, body string")
    KeptIndex(spark, path, 4).build(rows, "id", "body")
    slow = KeptIndex(spark, path, 4)
    seen = slow._versions()
    KeptIndex(spark, path, 4).merge(spark.createDataFrame([(1, "other")], "id long, body string"), "id", "body")
    monkeypatch.setattr(slow, "_versions", lambda: seen)
    with pytest.raises(RuntimeError):
        slow.merge(spark.createDataFrame([(1, "late")], "id long, body string"), "id", "body")
    assert {r["key"] for r in KeptIndex(spark, path, 4).search(["other"]).collect()} == {1}


def test_nothing_indexed(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "none"), 4)
    assert index.search(["a"]).collect() == [] and index.live == []
    empty = index.build(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert empty.search(["a"]).collect() == []
    assert empty.batch(spark.createDataFrame([(1, "ab")], "q int, token string"), "q", "token").collect() == []


def test_runs_of_asked_tokens_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "red wi ne of the house"), (2, "redwine"), (3, "re dw ien"), (4, "nothing here at all"), (5, None)], "id long, text string")
    queries = spark.createDataFrame([(7, "redwine"), (8, "ofthe"), (8, "red"), (9, "at")], "q long, token string")
    whole = KeptIndex(spark, str(tmp_path / "whole"), 4).build(rows, "id", "text")
    asked = KeptIndex(spark, str(tmp_path / "asked"), 4).build(rows, "id", "text", tokens=queries)
    found = lambda index: sorted(tuple(r) for r in index.batch(queries, "q", "token").collect())
    assert found(asked) == found(whole) == [(7, 1), (7, 2), (7, 3), (8, 1), (9, 4)]
    kept = lambda index: {r["term"] for r in index._table("runs").collect()}
    assert kept(asked) == {"redwine", "redwien", "ofthe"} and kept(asked) < kept(whole)
