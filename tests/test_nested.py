"""The VARIANT walk against a walk of the parsed documents."""

import json
import random

from tastevin.operators import nested


def walk(key, value, path="$", parent=None, name=None, depth=0):
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "string" if isinstance(value, str) else "number"
    text = value if kind == "string" else json.dumps(value) if kind in ("number", "boolean") else None
    yield key, depth, parent, path, kind, name, text
    if kind == "object":
        for k, v in value.items():
            yield from walk(key, v, f"{path}.{k}", path, k, depth + 1)
    elif kind == "array":
        for k, v in enumerate(value):
            yield from walk(key, v, f"{path}[{k}]", path, None, depth + 1)


def made(rng, depth):
    kinds = ["s", "n", "b", "x", "d"] + (["o", "a"] * 3 if depth else [])
    kind = rng.choice(kinds)
    if kind == "o":
        return {rng.choice("abcdé") + str(k): made(rng, depth - 1) for k in range(rng.randint(0, 4))}
    if kind == "a":
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {"s": rng.choice(["", "x", "é \" \\ \n", "null"]), "n": rng.randint(-(10**12), 10**12), "b": rng.random() < 0.5, "x": None, "d": 0.5}[kind]


def test_walk(spark):
    rng = random.Random(4)
    documents = [made(rng, 5) for _ in range(60)] + [{"a": [[[[[[[[1]]]]]]]]}, [], {}, "only", 3]
    rows = [(k, json.dumps(d, ensure_ascii=k % 2 == 0)) for k, d in enumerate(documents)] + [(1000, None), (1001, ""), (1002, "{broken"), (1003, "null")]
    got = sorted((tuple(r) for r in nested.nodes(spark.createDataFrame(rows, "k long, body string"), "k", "body").select("k", "depth", "parent", "path", "kind", "name", "value").collect()), key=str)
    want = sorted([x for k, d in enumerate(documents) for x in walk(k, d)] + [(1003, 0, None, "$", "null", None, None)], key=str)
    assert got == want


def test_objects(spark):
    body = json.dumps({"@graph": [{"name": "A", "offers": [{"price": 3, "name": None}]}, {"name": "B", "geo": {"name": "deep"}}], "name": "top"})
    found = nested.nodes(spark.createDataFrame([(1, body), (2, "[]")], "k long, body string"), "k", "body")
    got = sorted((r["path"], r["name"], r["price"]) for r in nested.objects(found, "k", ["name", "price"]).collect())
    assert got == [("$", "top", None), ("$.@graph[0]", "A", None), ("$.@graph[0].offers[0]", None, "3"), ("$.@graph[1]", "B", None), ("$.@graph[1].geo", "deep", None)]
    assert nested.nodes(spark.createDataFrame([], "k long, body string"), "k", "body").collect() == []
