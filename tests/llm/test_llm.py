"""The training-data operators on small tables: hard cases, brute force, round trips, held-out accuracy."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tastevin.llm import embedding_dup, language, mixing, near_dup, quality_classifier, quality_rules, registry, sampling, spm, suffix_dedup, token_counts, toxicity
from tastevin.llm.textbatch import shingles, utf8

SF = "/root/testdata/sf0.001"
#: Names that operators use themselves, for columns, keys and outputs.
CLASHES = "id score size turn copy copies spans h1 h2 n_removed letters component kept lang_pred near_id u v bin cls rank times taken label fold digest content n_tokens exact kept_text carried_0 key bucket".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES)
random.seed(5)
WORDS = [f"w{k}" for k in range(400)]


def prose(n, seed=None):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = prose(4000, 1)
    rows = [
        (1, prose(80, 2), "en", "a"), (2, prose(80, 2), "en", "a"), (2, prose(80, 2), "en", "a"), (3, "", "en", None), (4, None, None, "b"), (None, prose(60, 3), None, "b"),
        (None, None, None, None), (5, long, "fr", "b"), (6, long + " tail of it", "fr", "b"), (7, "one two", "fr", "c"), (8, "é ß 日本 \t\n *** ### x", "de", ""), (9, "same line\nsame line\n" * 40, "de", "c"),
    ]
    return spark.createDataFrame([(*r, 1, *(1000 * k + j for j in range(len(CLASHES)))) for k, r in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return hard(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0 == mixing.applied(none).count()
    out = mixing.applied(docs)
    assert out.columns == docs.columns
    # every copy is a row of docs with all its values, as often as the mix takes it
    given, times = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert all(r in given for r in times)
    taken, sizes = Counter(), Counter()
    for r in got:
        taken[(r["doc_id"], r["source"])] += r["taken"]
    for r, n in times.items():
        sizes[(r[0], r[3])] += n * len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert +taken == +sizes
    again = mixing.mix(docs).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_reaches_targets(spark):
    df = spark.createDataFrame([(k, "x " * (1 + k % 30), f"s{k % 3}") for k in range(3000)], "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r["n"] - r["t"]) <= 30


def test_targets_by_brute_force(spark):
    """Shares dealt by weight, the excess of full sources dealt again until none is above, for more sources than ranges."""
    rng = random.Random(2)
    rows = [(k % 50 == 49, f"s{rng.randrange(10**9):09d}", rng.choice([0, 3, 50, 7000, rng.randrange(1, 10**6)])) for k in range(300)]
    with mixing.Scratch() as scratch:
        got = {(r["source_null"], r["source_key"]): (r["weight"], r["target"]) for r in mixing.targets(spark.createDataFrame(rows, "source_null boolean, source_key string, words long"), (5, 2, 1), 1.5, 2, scratch).collect()}
    rows.sort()
    weight = {r[:2]: (5, 2, 1)[k % 3] for k, r in enumerate(rows)}
    cap, left, full = {r[:2]: 2 * r[2] for r in rows}, 1.5 * sum(r[2] for r in rows), set()
    while True:
        level = (left - sum(cap[k] for k in full)) / sum(w for k, w in weight.items() if k not in full)
        more = {k for k in cap if k not in full and level * weight[k] > cap[k]}
        if not more:
            break
        full |= more
    for k in cap:
        assert got[k][0] == weight[k] and abs(got[k][1] - (cap[k] if k in full else level * weight[k])) < 1e-6 * max(level, 1)
    assert len(got) == len(rows)


def test_rules(docs, none):
    counted = {r["doc_id"]: r for r in quality_rules.rules(docs).collect()}
    assert quality_rules.rules(none).count() == 0
    for r in docs.where("doc_id is not null").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = counted[r["doc_id"]]
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"], got["n_dup_lines"]) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {name_} as select * from '{SF}/{name_}.parquet'")
    got = registry.queries()[name](spark, SF)
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_language(spark, docs, none):
    got = language.predict(docs, docs, "doc_id", "lang")
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "de", "und")
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (3, 4))
    assert {r["lang_pred"] for r in language.predict(docs, none, "doc_id").collect()} == {"und"}
    assert language.predict(none, docs, "doc_id").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables aren't here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = language.op4_language(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for query, label in ((toxicity.op3_toxicity, "toxic"), (quality_classifier.op5_quality, "quality")):
        rows = query(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").where(F.col(label).isin(0, 1))
        share = {r[label]: r["right"] for r in rows.groupBy(label).agg(F.avg((F.col(label) == F.col("predicted")).cast("int")).alias("right")).collect()}
        assert share[1] >= 0.8 and share[0] >= 0.9, (label, share)
    assert docs.count()


def test_samples_are_exact(spark):
    """Bounds hold whatever the ids; copies count once; reruns and other partitions draw the same."""
    rows = [(None, f"text {k % 3000}", "en") for k in range(9000)] + [(7, f"autre {k}", "fr") for k in range(30)] + [(8, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for each in (10, 400, 2999, 5000):
        got = sampling.texts(df.where("lang is not null"), "lang", each)
        assert {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"en": min(each, 3000), "fr": min(each, 30)}
    draw = lambda d: sorted(map(tuple, sampling.texts(d.where("lang is not null"), "lang", 50).collect()))
    assert draw(df) == draw(df.repartition(7))
    assert sampling.texts(df.where("lang is not null"), "lang", 400, most=1).select("lang").distinct().count() == 1
    assert sampling.texts(df.where("lang is not null"), "lang", 400, total=100).groupBy("lang").count().agg(F.max("count")).first()[0] == 50
    learned = language.predict(df, df, "lang").where("lang is not null")
    assert learned.where("lang = lang_pred").count() == learned.count()


def in_sample_order(spark, texts):
    """Spark's digests of the texts, which order and deal samples."""
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return {r["k"]: r for r in df.select("k", F.xxhash64("text").alias("digest"), F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("fold")).collect()}


def test_language_by_brute_force(spark):
    """Kernel by sets, Nystroem map and ridge by the textbook, in double precision."""
    rng = random.Random(4)
    alphabets = {"aa": "abcde ", "bb": "cdefgh ", "cc": "mnoép ", "dd": "xyzß "}
    texts, langs = [], []
    for lang, letters in alphabets.items():
        for _ in range(45):
            texts.append("".join(rng.choices(letters, k=rng.choice([5, 40, 300]))) + "a")
            langs.append(lang)
    df = spark.createDataFrame([(k, t, a) for k, (t, a) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(df, df.where("doc_id % 3 <> 0"), "doc_id").collect()}

    def grams(t):
        b = [x if 128 <= x or chr(x).islower() else 32 for x in t.lower().encode()]
        two = {((x << 8 | y) * 2654435761 % 2**32) >> 20 for x, y in zip(b, b[1:], strict=False)}
        three = {(((x << 8 | y) << 8 | z) * 2246822519 % 2**32) >> 19 for x, y, z in zip(b, b[1:], b[2:], strict=False)}
        return set(b), two, three

    sets = [grams(t) for t in texts]
    kernel = lambda i, j: sum(len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5 for a, b in zip(sets[i], sets[j], strict=True))
    digest = in_sample_order(spark, texts)
    fit = [k for k in range(len(texts)) if k % 3]
    seen, learned = set(), []
    for k in sorted(fit, key=lambda k: (langs[k], digest[k]["digest"])):
        if (langs[k], texts[k]) not in seen:
            seen.add((langs[k], texts[k]))
            learned.append(k)
    names, each = sorted(set(langs)), language.LANDMARKS // len(set(langs))
    marks = [k for name in names for k in [j for j in learned if langs[j] == name][:each]]
    values, vectors = np.linalg.eigh(np.array([[kernel(i, j) for j in marks] for i in marks]))
    good = values > 1e-6 * values.max()
    phi = np.array([[kernel(i, j) for j in marks] for i in range(len(texts))]) @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.array([[1.0 if langs[k] == name else -1.0 for name in names] for k in learned])
    weight = np.array([1 / sum(langs[j] == langs[k] for j in learned) for k in learned])
    mean, offset = np.average(phi[learned], 0, weight), np.average(y, 0, weight)
    c = (phi[learned] - mean) * weight[:, None]
    w = np.linalg.solve(c.T @ (phi[learned] - mean) / weight.sum() + language.RIDGE * np.eye(phi.shape[1]), c.T @ (y - offset) / weight.sum())
    margin = (phi - mean) @ w + offset
    p = np.exp(language.SHARPNESS * (margin - margin.max(1, keepdims=True)))
    for k in range(len(texts)):
        assert abs(got[k][1] - p[k].max() / p[k].sum()) < 2e-3
        two = np.sort(margin[k])[-2:]
        assert got[k][0] == names[margin[k].argmax()] or two[1] - two[0] < 1e-3


def plain_statistics(t):
    """The statistics of one text, one by one."""
    raw, words = t.encode(), [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    n, share = len(words), lambda a, b: a / max(b, 1)
    again = lambda items: sum(Counter(items).values()) - len(set(items))
    letter = lambda b: any(x >= 128 or chr(x).isalpha() for x in b)
    lines = [x for x in raw.split(b"\n") if x]
    sizes = [len(w) for w in words]
    mean = share(sum(sizes), n)
    return [
        np.log1p(n), np.log1p(len(raw)), *(share(sum(raw.count(bytes([c])) for c in chars), len(raw)) for chars in quality_classifier._CLASSES.values()),
        mean, max(share(sum(s * s for s in sizes), n) - mean**2, 0) ** 0.5, share(sum(not letter(w) for w in words), n), share(again(words), n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        share(again(list(zip(words, words[1:], words[2:], strict=False))), n), share(again(lines), len(lines)), np.log1p(share(len(raw), len(lines))), np.log1p(len(lines)),
    ]


def test_quality_by_brute_force(spark):
    """Statistics one by one, ridge without each part by itself, isotonic fit by its min-max formula."""
    rng = random.Random(6)
    texts = [prose(rng.randrange(20, 80), k) + (" ### $$$ !!!" * rng.randrange(0, 6) if k % 2 else "\nA line.") for k in range(120)] + ["", "word", "a\na\na"]
    label = [k % 2 if k % 11 else 1 - k % 2 for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, label, strict=True))], "doc_id long, text string, label int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(df, df.where("doc_id % 4 <> 0"), "doc_id").collect()}
    q, digest = quality_classifier, in_sample_order(spark, texts)
    x = np.array([plain_statistics(t) for t in texts])
    data, at = utf8(pa.array(texts))
    assert np.allclose(x, q.statistics(data, at))
    fit = [k for k in range(len(texts)) if k % 4]
    n, ones = len(fit), sum(label[k] for k in fit)
    z = q.Features(x[fit].mean(0), x[fit].std(0))(x)
    rate = {0: n / (2 * (n - ones)), 1: n / (2 * ones)}

    def solved(rows):
        gram = sum(rate[label[k]] * np.outer(z[k], z[k]) for k in rows) / n
        return np.linalg.solve(gram + q.RIDGE / q.RANDOM * np.eye(q.RANDOM), sum(rate[label[k]] * z[k] * (2 * label[k] - 1) for k in rows) / n)

    part = {k: digest[k]["digest"] % q.PARTS for k in fit}
    without = {p: solved([k for k in fit if part[k] != p]) for p in set(part.values())}
    s, y = np.array([z[k] @ without[part[k]] for k in fit]), np.array([label[k] for k in fit], float)
    order = np.lexsort((y, s))
    s, y = s[order], y[order]
    level = np.array([max(min(y[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    knots = sorted({round(v, 12): s[np.isclose(level, v)].mean() for v in level}.items())
    want = np.interp(z @ solved(fit), [b for _, b in knots], [a for a, _ in knots])
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-6)


def test_toxicity_by_brute_force(spark):
    """Counts by sets, every lexicon and calibration by the formulas, segments by their definition."""
    rng = random.Random(8)
    bad = ["vile", "scumbag", "moronic"]
    texts, label = [], []
    for k in range(90):
        words = rng.choices(WORDS[:120], k=rng.randrange(6, 40))
        if k % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s"]))
        texts.append(" ".join(words))
        label.append(int(k % 3 == 0 and k % 15 != 0))
    texts, label = [*texts, "", "vile"], [*label, 0, 1]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, label, strict=True))], "doc_id long, text string, label int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, df.where("doc_id % 5 <> 0"), "doc_id").collect()}
    t, fold = toxicity, {k: r["fold"] for k, r in in_sample_order(spark, texts).items()}
    runs = [re.findall(r"[a-z]+", x.lower()) for x in texts]
    kinds = lambda w: {(len(w), w), *((s, w[:s] + "*") for s in t.STEMS if len(w) > s)}
    terms = [set().union(*map(kinds, r)) if r else set() for r in runs]
    fit = [k for k in range(len(texts)) if k % 5]

    def lexicon(rows, z):
        n = {y: Counter(x for k in rows if label[k] == y for x in terms[k]) for y in (0, 1)}
        nt, nc = sum(n[1].values()), sum(n[0].values())
        weight, gains, p = t.PRIOR * min(nt, nc), {}, {}
        for x in n[0] | n[1]:
            both = n[0][x] + n[1][x]
            prior = weight * both / (nt + nc)
            gain = np.log((n[1][x] + prior) / (nt + weight - n[1][x] - prior)) - np.log((n[0][x] + prior) / (nc + weight - n[0][x] - prior))
            if gain / (1 / (n[1][x] + prior) + 1 / (n[0][x] + prior)) ** 0.5 >= z and gain > t.DRIFT:
                gains[x], p[x] = gain, (n[0][x] + prior) / (nc + weight)
        f = lambda m: sum(p[x] * np.expm1(m * gains[x]) for x in gains) + (1 - sum(p.values())) * np.expm1(-t.DRIFT * m)
        low, high = 1e-6, 50.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return gains, low

    def sums(k, gains):
        score = np.array([max((gains[x] for x in kinds(w) if x in gains), default=-t.DRIFT) for w in runs[k]])
        return [s for _, _, s in every_maximal_segment(score)]

    def evidence(k, s, lam, chance):
        return sum(v for v in (lam * x - np.log(chance * max(len(runs[k]), 1)) for x in s) if v >= -np.log(t.SIGNIFICANT))

    def calibrated(gains, lam, null):
        found = {k: sums(k, gains) for k in range(len(texts))}
        chance = 1 / np.mean([max(len(runs[k]), 1) * np.exp(-lam * max(found[k], default=0.0)) for k in null]) if null else 1.0
        return {k: evidence(k, found[k], lam, chance) for k in found}

    best = None
    for z in reversed(t.THRESHOLDS):
        x = {}
        for f in range(t.FOLDS):
            own = [k for k in fit if fold[k] == f]
            e = calibrated(*lexicon([k for k in fit if fold[k] != f], z), [k for k in own if not label[k]])
            x |= {k: e[k] for k in own}
        a, b = t._logistic(np.array([x[k] for k in fit]), np.array([label[k] for k in fit], float))
        q = np.array([1 / (1 + np.exp(-(a * min(x[k], 20) / 20 + b))) for k in fit])
        y = np.array([label[k] for k in fit])
        loss = -np.log(np.where(y == 1, q, 1 - q)).mean()
        if best is None or loss < best[0] - 1e-12:
            best = (loss, z, a, b)
    _, z, a, b = best
    e = calibrated(*lexicon(fit, z), [k for k in fit if not label[k]])
    want = [1 / (1 + np.exp(-(a * min(e[k], 20) / 20 + b))) for k in range(len(texts))]
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-6)


def test_classifiers_on_hard_rows(docs, none):
    labelled = docs.select("text", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))
    for module in (toxicity, quality_classifier):
        rows = module.score(docs, labelled, "doc_id", "lang").collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(none, labelled, "doc_id").count() == 0
        assert module.score(docs, labelled.where("label = 1"), "doc_id").count() == docs.count()
        assert module.score(docs, none.select("text", "label"), "doc_id").count() == docs.count()


def every_maximal_segment(score):
    """By the definition: the segment of the greatest sum, shortest first, and the same to its left and to its right."""
    best, n = None, len(score)
    for i in range(n):
        total = 0.0
        for j in range(i, n):
            total += score[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    return every_maximal_segment(score[:i]) + [(i, j, total)] + [(a + j + 1, b + j + 1, s) for a, b, s in every_maximal_segment(score[j + 1 :])]


def test_all_segments_by_definition():
    rng = np.random.default_rng(2)
    for n in [1, 5, 20, 40] * 15:
        score = np.where(rng.random(n) < 0.4, rng.random(n) * 3, -toxicity.DRIFT)
        place = np.flatnonzero(score > 0)
        found, want = toxicity.maximal_segments(place, score[place]), every_maximal_segment(score)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in found], [s for _, _, s in want])


def test_segments_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        place = np.arange(n) * 40  # no two hits join
        start = time.perf_counter()
        assert len(toxicity.maximal_segments(place, np.linspace(1, 2, n))) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 0.5 and took[1] < 12 * took[0] + 0.02


def test_segments_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        score = np.where(rng.random(30) < 0.3, rng.random(30) * 3, -toxicity.DRIFT)
        place = np.flatnonzero(score > 0)
        found = toxicity.maximal_segments(place, score[place])
        best = max((score[i : j + 1].sum() for i in range(30) for j in range(i, 30)), default=0)
        if len(place):
            assert abs(max(s for _, _, s in found) - best) < 1e-9
            assert all(abs(score[a : b + 1].sum() - s) < 1e-9 for a, b, s in found)
            assert all(found[k][1] < found[k + 1][0] for k in range(len(found) - 1))


def test_dart_signatures_estimate_similarity():
    texts = []
    for k in range(60):
        words = random.Random(k).choices(WORDS, k=200)
        other = list(words)
        for _ in range(k // 2):
            other[random.Random(k).randrange(200)] = "new"
        texts += [" ".join(words), " ".join(other)]
    data, at = utf8(pa.array(texts))
    owner, element, count = shingles(data, at)
    signature, _ = near_dup.signatures(owner, element, count.astype(float), len(texts))
    sets = near_dup.Sets(pa.array(texts))

    def jaccard(a, b):
        x, y = (Counter(tuple(t.split()[i : i + 5]) for i in range(196)) for t in (a, b))
        return sum((x & y).values()) / sum((x | y).values())

    exact = np.array([jaccard(texts[k], texts[k + 1]) for k in range(0, 120, 2)])
    agree = (signature[::2] == signature[1::2]).mean(1)
    assert abs((agree - exact).mean()) < 0.03
    for k, j in zip(range(0, 120, 2), exact, strict=True):
        assert sets.similar(k, np.array([k + 1]))[0] == (j >= near_dup.SIMILAR)


def test_near_duplicates(spark, docs, none):
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    of = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert of[2]["component"] == 1 and not of[2]["kept"] and of[6]["component"] == 5 and of[1]["kept"]
    assert near_dup.near_duplicates(none).count() == 0
    one = near_dup.one_of_each(docs)
    assert one.columns == docs.columns and one.where("doc_id in (2, 6)").count() == 0


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for k in range(25):
        base = rng.choices(WORDS, k=rng.choice([4, 30, 120]))
        for _ in range(rng.choice([1, 2, 6])):
            new = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                new[rng.randrange(len(new))] = f"z{rng.random()}"
            texts.append(" ".join(new))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes(texts)


def brute_classes(texts):
    """Classes by all pairs."""
    words = [t.split() for t in texts]
    runs = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else []) for w in words]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, x in enumerate(runs):
        for j in {j for e in x for j in holders.get(e, ())}:
            if find(i) != find(j) and sum((x & runs[j]).values()) / sum((x | runs[j]).values()) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for e in x:
            holders.setdefault(e, []).append(i)
    return {k: find(k) for k in range(len(texts))}


def family(n, changed, seed=1):
    """Texts that differ from one base in so many words each."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    out = []
    for k in range(n):
        words = list(base)
        for p in rng.sample(range(200), changed):
            words[p] = f"n{k}.{p}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("changed", [3, 4, 6])
def test_near_duplicates_of_one_family(spark, monkeypatch, changed):
    """Pairs just above and just below the similarity asked for; what is written grows with the members, not with their pairs."""
    kept = near_dup.Scratch.stored
    for n in (150, 600):
        written = Counter()

        def counted(self, df, label, written=written):
            out = kept(self, df, label)
            written[label] = max(written[label], out.count())
            return out

        monkeypatch.setattr(near_dup.Scratch, "stored", counted)
        texts = family(n, changed)
        got = {r["doc_id"]: r["component"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == brute_classes(texts)
        assert max(written.values()) <= 2 * near_dup.BANDS * n


@pytest.mark.parametrize("block", [7, 40])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "GROUP", block)
    texts = family(120, 4) + family(60, 2, 2)
    got = {r["doc_id"]: r["component"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def brute_repeats(rows):
    """rows: (doc_id, bytes) in order; removed flags for each."""
    first, out = {}, []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in first:
                gone[i : i + 100] = b"\1" * 100
            else:
                first[w] = d
        out.append(gone)
    return out


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 400])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(7)
    parts = [prose(60, k) for k in range(6)] + ["ab" * 200, "日本語 テキスト " * 20]
    texts = [" ".join(rng.choice(parts)[rng.randrange(40) :] for _ in range(rng.choice([1, 2, 4]))) for _ in range(40)] + ["", "short", parts[0], parts[0]]
    got = {r["doc_id"]: r for r in suffix_dedup.strip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id").collect()}
    raw = [(k, t.encode()) for k, t in enumerate(texts)]
    for (k, b), gone in zip(raw, brute_repeats(raw), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), k


def test_suffix_dedup_of_short_periodic_runs(spark):
    units = ["a", "ab", "-", "=-", "xyz", "0123456", "ABCDEFGHIJK", "pqrstuvwxyzPQRSTUVWXYZ!", "é", "日本"]
    texts = []
    for k, unit in enumerate(units):
        for n in (100, 101, 110, 123, 150, 199):
            # each run of its own bytes, so that no other text shares it
            run = (f"{chr(0x100 + 8 * k + n % 7)}{unit}" * n).encode()[:n].decode("utf-8", "ignore")
            texts += [run, f"{prose(30, 1000 + n + 200 * k)} {run} {prose(30, 9000 + n + 200 * k)}"]
    texts += ["c" * 150, "de" * 75, f"{prose(30, 77)} {'~' * 110} {prose(30, 78)}"]
    got = {r["doc_id"]: r for r in suffix_dedup.strip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id").collect()}
    raw = [(k, t.encode()) for k, t in enumerate(texts)]
    for (k, b), gone in zip(raw, brute_repeats(raw), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[k]["n_removed"], got[k]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest()), (k, texts[k])
    assert [got[len(texts) - i]["n_removed"] for i in (3, 2, 1)] == [149, 148, 109]


def test_suffix_dedup_on_hard_rows(docs, none):
    rows = suffix_dedup.strip(docs, "doc_id", "lang", keep_text=True).collect()
    assert len(rows) == docs.count() and suffix_dedup.strip(none, "doc_id").count() == 0
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [len(prose(80, 2))] * 2


def test_suffix_order_and_prefixes():
    data = np.frombuffer(b"banana bandana banana band" * 3, np.uint8)
    end = np.full(len(data), len(data))
    raw = data.tobytes()
    order = suffix_dedup.suffix_order(data, end)
    assert [raw[k : k + 100] for k in order] == sorted(raw[k : k + 100] for k in range(len(raw)))
    shared = suffix_dedup.common_prefixes(data, order, end)
    for a, b in zip(order[:-1], order[1:], strict=True):
        assert shared[b] == min(100, len(os.path.commonprefix([raw[a:], raw[b:]])))


def test_token_counts(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path, cache = token_counts.tokenizer_path(), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    odd = docs.unionByName(spark.createDataFrame([(20, "It's 2024<|endoftext|>  naïve ΣΑΣ é   x", None, None, 1, *[None] * len(CLASHES))], DOCS))
    for _ in range(2):  # the second time all come from the cache
        for r in token_counts.count_tokens(odd, path, cache, "doc_id", "text").collect():
            assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("digest").distinct().count()
    assert token_counts.count_tokens(none, path, cache, "doc_id").count() == 0


def test_sentencepiece(docs, none):
    import sentencepiece

    path = spm.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = spm.encoded(docs, path, "doc_id", "text").collect()
    assert len(rows) == docs.count() and spm.encoded(none, path, "doc_id").count() == 0
    for r in rows:
        assert list(r["token_ids"]) == library.encode(r["text"] or "") and r["exact"]
    back = spm.decoded(spm.encoded(docs, path, "text").withColumnRenamed("text", "was"), path, "was")
    assert all((r["was"] or "") == r["text"] for r in back.collect())


def test_decoding_of_nothing(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [5], None)], "doc_id long, token_ids array<int>, text string")
    got = {r["doc_id"]: r["text"] for r in spm.decoded(rows, spm.model_path(), "doc_id", "text").collect()}
    assert got[1] == got[2] == "" and isinstance(got[3], str)


def test_language_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(k, "same words here", a) for k in range(6) for a in ("bb", "aa")] + [(9, "same words here", None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], round(r["score"], 6)) for r in language.predict(df, df, "doc_id").collect()} == {("aa", 0.5)}


def test_viterbi_by_brute_force():
    p = spm.pieces(spm.model_path())
    scores = {bytes(p.bytes[p.offsets[i] : p.offsets[i + 1]]): s for i, s in zip(p.ids, p.scores, strict=True)}
    for text in ("hello", " world", "überall", "x", " zq日本"):
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for k in range(end):
                s = scores.get(text[k:end].encode(), p.penalty if end - k == 1 else -np.inf)
                best[end] = max(best[end], best[k] + s)
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = np.array([[len(text[:k].encode()) for k in range(len(text) + 1)]])
        from tastevin.llm.textbatch import prefix_sums

        ((_, found),) = spm.viterbi(p, prefix_sums(data), cuts)
        raw = text.encode()
        got = sum(scores.get(raw[a:b], p.penalty) for a, b in zip(found[0][:-1], found[0][1:], strict=True))
        assert abs(got - best[-1]) < 1e-6


def test_long_units_like_the_library():
    import sentencepiece

    path = spm.model_path()
    p, library = spm.pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["x" * 300, "thequickbrownfox" * 30, "ab" * 200 + " " * 50, "日本語テキスト" * 40, "a\n\nb\tc"]
    data, at = utf8(pa.array(texts))
    ids, ends = spm.encode(p, data, at)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == library.encode(texts)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base, base[:6] + rng.normal(size=(6, 16)) * 0.05, base[:2], base[:1] * 3])
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)]
    bad = [(100, None, 1), (101, [], 1), (102, [0.0] * 16, 1), (103, [float("nan")] * 16, 1), (104, [None] * 16, 1), (105, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    got = {r["vec_id"]: r for r in embedding_dup.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, links int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    lab = np.arange(len(x))
    for _ in range(20):
        lab = np.array([lab[link[k]].min() for k in range(len(x))])
    assert all(got[k]["n_links"] == link[k].sum() - 1 and got[k]["component_id"] == lab[k] and got[k]["kept"] == (lab[k] == k) for k in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(100, 106))
    assert embedding_dup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("block", [embedding_dup.BLOCK, 3])
def test_vectors_of_one_direction(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dup, "BLOCK", block)
    rng = np.random.default_rng(4)
    near = rng.normal(size=16) + rng.normal(size=(11, 16)) * 0.002
    x = np.concatenate([near, near[:2], near[:1] * 3])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (u @ u.T).min() > 0.999
    got = embedding_dup.near_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(k, len(x) - 1, 0, k == 0) for k in range(len(x))]


@pytest.mark.parametrize("n", [2, 3])
def test_vectors_of_few_pivots(spark, n):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.eye(16)[k] + rng.normal(size=(4, 16)) * 0.002 for k in range(n)])
    got = embedding_dup.near_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(k, 3, k // 4 * 4) for k in range(4 * n)]


@pytest.mark.parametrize("n", [300, 6000])
def test_vector_recall(spark, n):
    """Planted pairs just above the similarity, among vectors of no direction in common."""
    import pandas as pd

    rng = np.random.default_rng(1)
    base = rng.normal(size=(n, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(200, 32))
    other -= (other * base[:200]).sum(1, keepdims=True) * base[:200]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    x = np.concatenate([base, 0.952 * base[:200] + np.sqrt(1 - 0.952**2) * other])
    got = embedding_dup.near_vectors(spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": list(x)}))).toPandas().set_index("vec_id").n_links
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert (got.loc[range(len(x))].to_numpy() <= want).all() and got.sum() >= 0.97 * want.sum() > 0


def test_vectors_whose_pivots_tie(spark):
    """Vectors along the axes: every other pivot is as far as the next."""
    x = [np.eye(40)[k % 40] * (1 + k // 40) for k in range(120)]
    got = {r["vec_id"]: r for r in embedding_dup.near_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert all((got[k]["n_links"], got[k]["component_id"]) == (2, k % 40) for k in range(120))


def test_vectors_of_extreme_length(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    x = np.concatenate([base, base * 1e-200, base * 1e200, base[:5] * -1])
    got = {r["vec_id"]: r for r in embedding_dup.near_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    u = np.concatenate([u, u, u, -u[:5]])
    assert [got[k]["n_links"] for k in range(len(x))] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_pipeline(spark, docs, none, tmp_path):
    """Every stage keeps columns of any names with their values, and takes an empty table."""
    import corpus_pipeline

    for label, start in (("all", docs), ("none", none)):
        start.write.parquet(str(tmp_path / label / "documents.parquet"))
        now = spark.read.parquet(str(tmp_path / label / "documents.parquet"))
        extra = {tuple(r[c] for c in CLASHES) for r in start.collect()}
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path / label))
            out.write.parquet(str(tmp_path / label / f"stage{k}"))
            last, now = now, spark.read.parquet(str(tmp_path / label / f"stage{k}"))
            assert now.count() > 0 or label == "none"
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == start.columns
                assert {tuple(r[c] for c in CLASHES) for r in now.collect()} <= extra
                if name != "suffix_dedup":
                    assert set(map(tuple, now.collect())) <= set(map(tuple, last.collect()))
        assert now.where("not exact").count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """The stages after language ID against plain Python on texts of one language."""
    import corpus_pipeline
    import sentencepiece

    texts = family(12, 2) + family(12, 30, 2) + [prose(60, k) for k in range(20)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = sorted(k for k, c in brute_classes(texts).items() if k == c)
    raw = [(k, texts[k].encode()) for k in kept]
    left = {k: bytes(x for x, g in zip(b, gone, strict=True) if not g).decode() for (k, b), gone in zip(raw, brute_repeats(raw), strict=True)}
    model = sentencepiece.SentencePieceProcessor(model_file=spm.model_path())
    assert {r["doc_id"] for r in got} <= set(kept)
    assert all(list(r["token_ids"]) == model.encode(left[r["doc_id"]]) and r["n_chars"] == len(left[r["doc_id"]]) for r in got)
    stripped = spark.createDataFrame([(k, left[k], f"s{k % 3}") for k in kept], "doc_id long, text string, source string")
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(stripped).collect()}
    times = Counter(r["doc_id"] for r in got)
    assert all(size * times[k] == taken for k, (size, taken) in sizes.items())
