"""Periodic runs against a brute-force search of all stretches and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tastevin.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, exponent=3):
    """Every period's maximal stretches, those of a smaller period left out."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def samples():
    rng = random.Random(5)
    texts = [[], ["a"] * 23, ["a"] * 24, ["a"] * 200, list("ab") * 12, list("ab") * 11 + ["a"], list("abcdefgh") * 3, list("abcdefghi") * 3, list("abcdefghi") * 3 + ["a"], list("abcdefghi") * 2 + list("abcdefgh")]
    for k in range(300):
        n, letters = rng.randint(0, 160), rng.choice([1, 2, 3, 5, 40])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:letters]) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            block = [rng.choice("abcxyz") for _ in range(rng.randint(1, 14))]
            at = rng.randint(0, len(words))
            words[at:at] = (block * rng.randint(2, 30))[: rng.randint(20, 120)]
        texts.append(words)
    return texts


@pytest.mark.parametrize("worth", [0.0, 2.0, 1e9], ids=["heavy", "as set", "light"])
def test_runs_equal_brute_force(monkeypatch, worth):
    monkeypatch.setattr(periodic, "WORTH", worth)
    texts = samples()
    names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    code, at = np.array([names[w] for t in texts for w in t]), np.cumsum([0] + [len(t) for t in texts])
    for least, exponent in ((24, 3), (6, 2)):
        for words, got in zip(texts, periodic.runs_of(code, at, least, exponent), strict=True):
            assert got == brute(words, least, exponent)


def test_counts_are_exact_either_way(monkeypatch):
    rng = np.random.default_rng(3)
    code, at = rng.integers(0, 3, 4000), np.array([0, 1500, 1500, 4000])
    want = []
    for a, b in ((0, 1500), (1500, 4000)):
        want.append([0] + [int((code[a : b - q] == code[a + q : b]).sum()) for q in range(1, (b - a) // 3 + 1)])
    for worth in (0.0, 1e9):
        monkeypatch.setattr(periodic, "WORTH", worth)
        lags = periodic.Lags(code, at, 3)
        for text, counts in ((0, want[0]), (2, want[1])):
            assert lags.count[lags.slot[text] + 1 : lags.slot[text + 1]].tolist() == counts[1:]


def test_one_word_takes_one_scan(monkeypatch):
    scanned = []
    plain = periodic.Lags.islands
    monkeypatch.setattr(periodic.Lags, "islands", lambda self, lag, *a: scanned.append(lag) or plain(self, lag, *a))
    assert periodic.runs_of(np.zeros(30_000, np.int64), np.array([0, 30_000])) == [[(0, 30_000, 1)]]
    assert scanned == [1]


def test_operator_rows(spark):
    rows = [
        (1, "x " + "b c " * 20 + "y", "k", 1), (1, "x " + "b c " * 20 + "y", "k", 1), (2, None, None, 2), (3, "", "k", 3), (4, " \t\r\n\x0b\x0c ", "k", 4),
        (None, "a b " * 30, "k", 5), (5, "z" * 300_000 + " " + "q " * 400_000, "k", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, periodic_text int")
    got = sorted(periodic.periodic_runs(docs).collect(), key=lambda r: (r["periodic_text"], r["doc_id"] or 0))
    assert got[0]["runs"] == got[1]["runs"] and [tuple(r) for r in got[0]["runs"]] == [(1, 40, 2)] and got[0]["collapsed"] == "x b c y"
    assert all(got[k]["runs"] == [] and got[k]["collapsed"] == "" for k in (2, 3, 4))
    assert got[5]["collapsed"] == "a b" and [tuple(r) for r in got[5]["runs"]] == [(0, 30, 1)]
    assert [tuple(r) for r in got[6]["runs"]] == [(1, 400_000, 1)] and got[6]["collapsed"].endswith("z q")
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 400)))) for k in range(150)] + [(None, "p q r " * 40), (7, None), (20, ""), (38, "one  two\tthree")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text in rows:
        h, words = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), WORD.findall(text or "")
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        line = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(line), sha(collapsed(words, runs))))
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 5
