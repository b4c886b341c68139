"""Quality rules with adaptive thresholds (DataFrame functions only).

Each document gets measures; for every language and source, mergeable quantile sketches of the measures give quartiles,
and a document is dropped where a measure lies beyond the far fence of its group: outside
[q25 - FENCE * spread, q75 + FENCE * spread], spread = greatest(q75 - q25, least spread of that measure).

The sketch is a log-linear histogram of whole numbers: values under 64 have a bin of their own, larger ones keep their six
leading bits (a relative error under 1/32). Bins are counts, so sketches of partitions, sources and languages merge by
addition, in any order, to the same result. A group's quartiles are drawn towards its language's as by SMALL documents
more, and the language's in the same way towards those of all documents; so small groups lean on larger ones, without a
size at which the rule changes.

Edge cases: null text counts as a text without words (base_failed); null lang or source form groups of their own; null or
repeated doc_id are rows like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, stored, table, text_or_empty

SYMBOLS = "#*$%&|<>"
SMALL = 50
FENCE = 3
#: measure -> (expression in SQL over the base counts, per 10,000 or hundredths; least spread; sides that count)
MEASURES = {
    "symbols": ("n_symbols * 10000 div greatest(word_chars, 1)", 100, "high"),
    "dup_lines": ("n_dup_lines * 10000 div greatest(n_words, 1)", 100, "high"),
    "repeats": ("n_repeat_words * 10000 div greatest(n_words, 1)", 500, "high"),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 50, "both"),
}


def _blank_free(column: Column) -> Column:
    return F.translate(column, " \t\n\x0b\x0c\r", "")


def base_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """The base counts of every text, each within its row: no shuffle."""
    text = docs.select(*carry, text_or_empty().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(_blank_free(x)) > 0)
    words = text.select(
        *carry,
        F.filter(F.split("text", f"[{SPACE}]+"), lambda x: x != "").alias("words"),
        F.length(_blank_free(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    counted = words.select(
        *carry, "words", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    # windows of three words by 64-bit digest, each with its place; sorting puts equal ones side by side
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    hashed = counted.withColumn("windows", F.transform(places, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).drop("words")
    ordered = hashed.withColumn("ordered", F.sort_array("windows"))
    # a document whose windows all differ, as most do, needs no places
    again = ordered.withColumn("any_twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = again.withColumn("placed", F.when(F.col("any_twice"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("windows", "ordered")
    twice = placed.withColumn(
        "twice",
        F.sort_array(F.transform(F.filter("placed", lambda x, k: (x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"])), lambda x: x["i"])),
    ).drop("placed")
    covered = F.aggregate(
        "twice", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
    )["n"]
    return twice.select(*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("any_twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def sketch_bin(value: Column) -> Column:
    """Bin of a whole number >= 0: the number itself under 64, else its six leading bits and their place."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 64 + F.shiftrightunsigned(value, 0) / F.pow(F.lit(2.0), shift)).cast("long")


def _least_of(code: str) -> str:
    """Smallest value in the bin."""
    return f"({code} % 64) * cast(pow(2, {code} div 64) as bigint)"


def thresholds(measured: DataFrame) -> DataFrame:
    """low and high for each measure, lang and source, from sketches of that pair, its language or all documents."""
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(m)).alias("bin")) for m in MEASURES)))
    cells = measured.select("lang", "source", one.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    by_lang = cells.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))

    def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
        upto = F.sum("n").over(W.partitionBy(*keys, "measure").orderBy("bin"))
        run = sketch.withColumn("upto", upto).withColumn("total", F.sum("n").over(W.partitionBy(*keys, "measure")))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
        return run.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), at(1).alias("c25"), at(3).alias("c75")).select(
            *keys, "measure", "docs", F.expr(_least_of("c25")).alias("q25"), F.expr(_least_of("c75")).alias("q75"))

    pairs = quartiles(cells, "lang", "source").alias("p")
    langs = quartiles(by_lang, "lang").alias("l")
    both = quartiles(by_all).alias("g")
    drawn = lambda c: F.expr(f"(p.docs * p.{c} + {SMALL} * ((l.docs * l.{c} + {SMALL} * g.{c}) div (l.docs + {SMALL}))) div (p.docs + {SMALL})").alias(c)
    chosen = pairs.join(langs, F.col("p.lang").eqNullSafe(F.col("l.lang")) & (F.col("p.measure") == F.col("l.measure"))).join(both, F.col("p.measure") == F.col("g.measure")).select("p.lang", "p.source", "p.measure", drawn("q25"), drawn("q75"))
    least = F.create_map(*(F.lit(x) for m, (_, s, _) in MEASURES.items() for x in (m, s)))
    spread = F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")]) * FENCE
    fences = chosen.select("lang", "source", "measure", (F.col("q25") - spread).alias("low"), (F.col("q75") + spread).alias("high"))
    only = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return fences.groupBy("lang", "source").agg(*(only(m, c) for m in MEASURES for c in ("low", "high")))


def rules(docs: DataFrame) -> DataFrame:
    """Base counts, measures, base_failed and kept for each document."""
    counts = stored(base_counts(docs, "doc_id", "lang", "source"), "rules-counts")
    measured = counts.withColumns({m: F.expr(sql) for m, (sql, _, _) in MEASURES.items()})
    fences = thresholds(measured).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    beyond = F.lit(False)
    for m, (_, _, side) in MEASURES.items():
        beyond = beyond | (F.col(m) > F.col(f"{m}_high"))
        if side == "both":
            beyond = beyond | (F.col(m) < F.col(f"{m}_low"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


_CODE = "greatest(length(bin({m})) - 6, 0) * 64 + ({m} >> greatest(length(bin({m})) - 6, 0))"
SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), t as (select rid, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
k as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from t),
r as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from k where n > 1) group by rid),
b as (
  select d.rid, doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
  from d left join r using (rid)
), m as (
  select *, n_symbols * 10000 // greatest(word_chars, 1) as symbols, n_dup_lines * 10000 // greatest(n_words, 1) as dup_lines,
    n_repeat_words * 10000 // greatest(n_words, 1) as repeats, word_chars * 100 // greatest(n_words, 1) as word_length
  from b
), x as (
  select lang, source, 'symbols' as measure, CODE_symbols as bin from m union all select lang, source, 'dup_lines', CODE_dup_lines from m
  union all select lang, source, 'repeats', CODE_repeats from m union all select lang, source, 'word_length', CODE_word_length from m
), c as (select lang, source, measure, bin, count(*) as n from x group by all),
p0 as (select *, sum(n) over (partition by lang, source, measure order by bin) as upto, sum(n) over (partition by lang, source, measure) as total from c),
p as (select lang, source, measure, max(total) as docs, min(bin) filter (where upto * 4 >= total) as c25, min(bin) filter (where upto * 4 >= total * 3) as c75 from p0 group by all),
l0 as (select lang, measure, bin, sum(n) as n from c group by all),
l1 as (select *, sum(n) over (partition by lang, measure order by bin) as upto, sum(n) over (partition by lang, measure) as total from l0),
l as (select lang, measure, max(total) as docs, min(bin) filter (where upto * 4 >= total) as c25, min(bin) filter (where upto * 4 >= total * 3) as c75 from l1 group by all),
g0 as (select measure, bin, sum(n) as n from c group by all),
g1 as (select *, sum(n) over (partition by measure order by bin) as upto, sum(n) over (partition by measure) as total from g0),
g as (select measure, min(bin) filter (where upto * 4 >= total) as c25, min(bin) filter (where upto * 4 >= total * 3) as c75 from g1 group by all),
s0 as (
  select p.lang, p.source, p.measure, p.docs as pn, l.docs as ln, P25 as p25, L25 as l25, G25 as g25, P75 as p75, L75 as l75, G75 as g75
  from p join l on p.lang is not distinct from l.lang and p.measure = l.measure join g on p.measure = g.measure
), s1 as (
  select lang, source, measure, (pn * p25 + 50 * ((ln * l25 + 50 * g25) // (ln + 50))) // (pn + 50) as q25, (pn * p75 + 50 * ((ln * l75 + 50 * g75) // (ln + 50))) // (pn + 50) as q75 from s0
),
s as (select *, 3 * greatest(q75 - q25, case measure when 'repeats' then 500 when 'word_length' then 50 else 100 end) as spread from s1),
f as (
  select lang, source, max(q75 + spread) filter (where measure = 'symbols') as s_high, max(q75 + spread) filter (where measure = 'dup_lines') as d_high,
    max(q75 + spread) filter (where measure = 'repeats') as r_high, max(q75 + spread) filter (where measure = 'word_length') as w_high,
    max(q25 - spread) filter (where measure = 'word_length') as w_low
  from s group by all
), o as (
  select m.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, symbols > s_high or dup_lines > d_high or repeats > r_high or word_length > w_high or word_length < w_low as beyond
  from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not beyond as kept from o
"""
for _t in "plg":
    for _q in ("25", "75"):
        SQL = SQL.replace(f"{_t.upper()}{_q} as", f"({_t}.c{_q} % 64) * (1::bigint << ({_t}.c{_q} // 64)::int) as")
for _m in MEASURES:
    SQL = SQL.replace(f"CODE_{_m}", f"({_CODE.format(m=_m)})")
