"""Queries over all their rows and the whole text: by brute force on small tables."""

import re
import unicodedata

from tastevin.functions import rules
from tastevin.operators import extract, matching
from tastevin.plans import aggregates, extraction, joins
from pyspark.sql import functions as F


def test_fanout_counts_of_every_target(spark):
    targets = spark.createDataFrame([(k,) for k in range(1, 21)], "id long")
    sources = [(100 + k, k % 7) for k in range(15)]
    entries = [(500 + k, k % 9) for k in range(40)]
    got = joins.j4_fanout_counts(targets, spark.createDataFrame(sources, "id long, target_id long"), spark.createDataFrame(entries, "id long, target_id long"))
    want = []
    for t in range(1, 21):
        lists, lines = sum(x == t for _, x in sources), sum(x == t for _, x in entries)
        want.append((t, lists, lines, lines * max(lists, 1)))
    assert sorted(map(tuple, got.select("id", "lists", "entries", "fanned").collect())) == want


def test_evidence_is_capped_by_document(spark):
    docs = [(k, "the " * (k % 9), f"s{k % 2}", "en") for k in range(400)] + [(400, None, "s0", None)]
    got = aggregates.a19_evidence_counts(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    want = {s: sum(min(t.count("the"), 4) for _, t, x, _ in docs if x == s and t) for s in ("s0", "s1")}
    assert min(want.values()) > 400
    assert {r["source"]: r["evidence"] for r in got.collect()} == want


def test_source_confidence_uses_prices(spark):
    lines = {
        1: ["token 2011 EUR 100"] * 9,  # one distinct line
        2: [f"plain token thing row {chr(97 + k)}" for k in range(9)],
        3: [f"plain row, EUR {k}00" for k in range(1, 10)],
        4: [f"that thing row, {k}50" for k in range(1, 10)],
        5: [f"that thing 201{k}, EUR {k}50" for k in range(1, 10)],
    }
    docs = spark.createDataFrame([(k, "\n".join(x)) for k, x in lines.items()], "doc_id long, text string")
    evidence = extract.source_evidence(extract.document_lines(docs, "doc_id"), "doc_id", vocabulary=extraction._WORDS)
    out = extract.source_confidence(evidence, F.lit(False), F.lit(True), F.lit(False), F.col("doc_id") % 90)
    got = {r["doc_id"]: (r["reason"], r["score"]) for r in out.collect()}
    assert {k: r for k, (r, _) in got.items() if k < 4} == {1: "few lines", 2: "few prices", 3: "weak identity"}
    assert got[5] == ("", 5 + 40 + 9 * 12 + 30 + 20 + 20 + 45)


def test_source_confidence_reaches_every_branch(spark):
    names = ("lines", "priced", "core", "producer", "prestige", "kind", "vintage", "currency")
    rows, want = [], []
    for k, (n, pdf, signal, generic, link, reason) in enumerate([
        ((4, 4, 4, 0, 0, 4, 4, 4), False, True, False, 7, "few lines"), ((6, 4, 6, 0, 0, 6, 6, 6), False, True, False, 7, "few prices"), ((6, 6, 1, 2, 0, 6, 6, 6), False, True, False, 7, "weak identity"),
        ((6, 6, 6, 0, 0, 6, 2, 2), False, True, False, 7, "weak vintage"), ((6, 6, 6, 0, 0, 6, 6, 6), False, True, True, 7, "generic page"), ((6, 6, 6, 0, 0, 6, 6, 6), False, False, False, 7, "no list address"),
        ((6, 6, 6, 0, 0, 6, 6, 6), True, True, True, 7, ""), ((9, 9, 0, 3, 0, 0, 3, 0), False, False, False, -60, "low score"), ((12, 12, 2, 0, 0, 2, 2, 3), False, False, False, 0, ""),
    ]):
        rows.append((k, *n, pdf, signal, generic, link))
        full = link + 30 * pdf + 40 * signal + 12 * min(n[0], 10) + 30 * (n[0] >= 3) + 20 * (n[7] >= 2) + 20 * (n[6] >= 2) + 45 * (n[2] >= 1) + 35 * (n[5] >= 2)
        want.append((k, reason, full if reason in ("", "low score") else link))
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"n_{c} int" for c in names) + ", pdf boolean, signal boolean, generic boolean, link int")
    got = extract.source_confidence(df, *map(F.col, ("pdf", "signal", "generic", "link"))).select("id", "reason", "score")
    assert sorted(map(tuple, got.collect())) == want


def test_line_tokens_of_every_language(spark):
    docs = [(1, "Grand Cru of the house", "en"), (2, "Été à la forêt, forêt", "fr"), (3, "Straße und Grüße", "de"), (4, "El niño pequeño", "es"), (5, None, None), (6, "", "fr"), (7, "plain words", None)]

    def tokens(s):
        plain = "".join(c for c in unicodedata.normalize("NFKD", (s or "").casefold()) if not unicodedata.combining(c))
        return {w for w in re.findall("[a-z0-9]+", plain) if len(w) >= 3 and w not in rules.LINE_STOP_WORDS}

    got = extraction.x37_line_tokens(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, got.collect())) == [(k, len(tokens(t))) for k, t, _ in docs]


def test_section_headers_are_whole(spark):
    turns = [(1, 0, "user", "the same twenty characters, then one end"), (1, 1, "assistant", "a"), (1, 2, "user", "the same twenty characters, then another"), (1, 3, "assistant", "b")]
    got = extraction.x19_sections(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert [r["header"] for r in got.orderBy("turn").collect()] == [None, turns[0][3], turns[0][3], turns[2][3]]


def test_bonuses_decide_between_names(spark):
    left = spark.createDataFrame([(1, "Chez Marie", "fr"), (2, "Zur Post", "de")], "id long, name string, block string")
    right = "id long, name string, block string, website string, address string"
    rows = [(10, "Chez Marie", "fr", "", None), (11, "Chez Mario", "fr", "https://m.example.com", None), (12, "Chez Marlo", "fr", None, "1 Road"), (20, "Quux", "de", "https://q.example.com", "2 Road")]
    best = lambda r: {x["id"]: x["match_id"] for x in matching.best_names(left, spark.createDataFrame(r, right), "block").collect()}
    assert best(rows) == {1: 11}  # bonuses choose between names that are good enough, and make none good enough
    assert best([(10, "Chez Marie", "fr", " ", ""), (13, "Chez Mariel", "fr", None, "1 Road"), (14, "Chez Mario", "fr", None, "1 Road")]) == {1: 13}
    assert best(rows[:1] + rows[2:3]) == {1: 10}  # 0.8 and an address are less than 1
