"""Best-first order of all sites at once against a heap for each."""

import heapq
import random

from tastevin.operators.extract import best_first


def heaped(links, pages, depth):
    out = {}
    for site in {s for s, *_ in links}:
        found = {}
        for s, source, url, score in links:
            if s == site:
                found.setdefault(source, []).append((-score, url))
        heap = [(p, 0, u) for p, u in found.get(None, [])]
        heapq.heapify(heap)
        seen = []
        while heap and len(seen) < pages:
            _, d, u = heapq.heappop(heap)
            if u in {x for x, _ in seen}:
                continue
            seen.append((u, d))
            if d < depth:
                for p, v in found.get(u, []):
                    heapq.heappush(heap, (p, d + 1, v))
        out.update({(site, k + 1): x for k, x in enumerate(seen)})
    return out


def test_same_order_as_a_heap(spark):
    rng = random.Random(11)
    links = []
    for site in ("a", "b", "c"):
        names = [f"/{k}" for k in range(12)]
        links += [(site, None, rng.choice(names), float(rng.randint(0, 5))) for _ in range(2)]
        links += [(site, rng.choice(names), rng.choice(names), float(rng.randint(0, 5))) for _ in range(45)]
    links += [("hub", None, "/", 1.0), *(("hub", "/", f"/{k}", float(k % 3)) for k in range(400))]
    got = best_first(spark.createDataFrame(links, "site string, source string, url string, score double"), pages=6, depth=3).collect()
    assert {(r["site"], r["turn"]): (r["url"], r["depth"]) for r in got} == heaped(links, 6, 3)


def test_no_start(spark):
    frame = spark.createDataFrame([("a", "/x", "/y", 1.0)], "site string, source string, url string, score double")
    assert best_first(frame, 3).collect() == []
