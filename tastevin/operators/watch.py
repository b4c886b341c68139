"""Keyword watches against lines.

A watch can only hit a line that has the first letters (a gram) of its longest token. Lines and watches meet by an equi-join on
grams; all tokens and the vintage are tested on the pairs that meet. Up to LITERAL distinct grams, counted first, are part of the
plan: a line looks for these alone and is copied once for each that it has. With more of them lines are joined by all
their runs of characters that long, whatever the number of watches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

#: Characters that lines and watches are joined by.
GRAM = 3
#: Distinct grams of watches that lines look for one by one, and that a plan holds at most.
FEW, LITERAL = 64, 1000


def normalized(column: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text.fold(column), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def squeezed(column: Column) -> Column:
    """White space collapsed, case folded: the export's whole-keyword matcher."""
    return F.trim(F.regexp_replace(F.lower(column), "\\s+", " "))


def plain(column: Column) -> Column:
    """The collector's matcher: letters with accents break words."""
    return text.normalize_name(column)


def _grams(hay: Column, sizes: list[int]) -> Column:
    """Distinct runs of characters of the sizes."""
    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(hay) - n + 1, F.lit(1))), lambda k: F.substring(hay, k, F.lit(n)))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def matches(lines: DataFrame, watches: DataFrame, body: str = "text", how: str = "tokens") -> DataFrame:
    """Lines x watches that hit: all tokens as substrings (tokens), or the whole keyword (phrase, plain); and the vintage, if any, in the text."""
    normal = {"tokens": normalized, "phrase": squeezed, "plain": plain}[how]
    words = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    w = watches.withColumn("needle", normal(F.col("keyword"))).withColumnRenamed("vintage", "watch_vintage").where("needle <> ''").withColumn("tokens", words(F.col("needle")))
    longest = F.get(F.array_sort("tokens", lambda x, y: F.length(y) - F.length(x)), F.lit(0))
    w = w.withColumn("gram", F.substring(longest, 1, GRAM))
    known = [r[0] for r in w.select("gram").distinct().limit(LITERAL + 1).collect()]  # LITERAL + 1 short strings at most
    if not known:
        return lines.join(w.drop("gram", "needle", "tokens"), F.lit(False))
    hay, asked = F.col("hay"), F.array(*map(F.lit, sorted(known)))
    if len(known) <= FEW:
        grams = F.filter(asked, lambda g: F.contains(hay, g))
    elif len(known) <= LITERAL:
        grams = F.array_intersect(_grams(hay, sorted({len(g) for g in known})), asked)
    else:
        sizes = sorted(r[0] for r in w.select(F.length("gram")).distinct().collect())  # three values at most
        grams = _grams(hay, sizes)
    test = F.forall("tokens", lambda t: F.contains(F.col("hay"), t)) if how == "tokens" else F.contains(F.col("hay"), F.col("needle"))
    year = (F.col("watch_vintage") == "") | F.contains(F.col(body), F.col("watch_vintage"))
    seen = lines.withColumn("hay", normal(F.col(body)))
    met = seen.withColumn("gram", F.explode(grams)).join(w, "gram")
    return met.where(test & year).drop("hay", "needle", "tokens", "gram")


def report(hits: DataFrame, completed_at: Column, running_at: Column, shown: int = 20) -> DataFrame:
    """For each watch: matches, restaurants, those new since the last completed run, those checked in the running one and not seen again.

    Hits are summed by restaurant first; the first names are ranked, so no watch's restaurants are one row's array."""
    new = F.col("first_seen") > completed_at
    stale = (F.col("checked_at") >= running_at) & (F.col("last_seen") < running_at)
    watch = ["keyword", "watch_vintage"]
    flag = lambda test: F.max(F.coalesce(test, F.lit(False)))
    each = hits.groupBy(*watch, "restaurant").agg(F.count("*").alias("n"), flag(new).alias("new"), flag(stale).alias("stale"))
    known = F.col("restaurant").isNotNull()
    counts = each.groupBy(*watch).agg(
        F.sum("n").alias("match_count"), F.count_if(known).alias("restaurant_count"), F.count_if(known & F.col("new")).alias("new_count"), F.count_if(known & F.col("stale")).alias("stale_count"))
    kinds = F.explode(F.array(F.struct(F.lit("new").alias("kind"), F.col("new").alias("on")), F.struct(F.lit("stale").alias("kind"), F.col("stale").alias("on")))).alias("k")
    named = each.where(known).select(*watch, "restaurant", kinds).where("k.on").select(*watch, "restaurant", F.col("k.kind").alias("kind"))
    first = named.withColumn("rank", F.row_number().over(W.partitionBy(*watch, "kind").orderBy("restaurant"))).where(F.col("rank") <= shown)
    names = lambda kind: F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("restaurant")))), ";").alias(f"{kind}_restaurants")
    shown_names = first.groupBy(*watch).agg(names("new"), names("stale"))
    out = counts.alias("c").join(shown_names.alias("s"), [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in watch], "left")
    return out.select("c.*", *(F.coalesce(f"{kind}_restaurants", F.lit("")).alias(f"{kind}_restaurants") for kind in ("new", "stale")))
