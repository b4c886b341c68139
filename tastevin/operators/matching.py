"""Entity resolution: nearest and distance joins, fuzzy names, variants, line reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import places, rules, text
from ..sources import shared


def nearest_by_name(left: DataFrame, right: DataFrame, name: str, box: float = 0.003) -> DataFrame:
    """For each left row the nearest right row (in summed degrees) of the same name within the box, ties by id.

    An equi join on name and grid cell: right rows are put into the nine cells around theirs, so that a name that many
    rows share doesn't meet itself everywhere."""
    cell = lambda c: F.floor(F.col(c) / box).cast("long")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    r = right.select(F.col("id").alias("match_id"), F.col(name).alias("_name"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).withColumn("_d", around)
    r = r.select("match_id", "_name", "_lat", "_lng", (F.floor(F.col("_lat") / box) + F.col("_d.a")).cast("long").alias("_x"), (F.floor(F.col("_lng") / box) + F.col("_d.b")).cast("long").alias("_y"))
    near = left.join(r, (F.col(name) == F.col("_name")) & (cell("lat") == F.col("_x")) & (cell("lng") == F.col("_y")))
    inside = near.where((F.abs(F.col("lat") - F.col("_lat")) <= box) & (F.abs(F.col("lng") - F.col("_lng")) <= box))
    best = inside.groupBy(left["id"]).agg(F.min(F.struct((F.abs(F.col("lat") - F.col("_lat")) + F.abs(F.col("lng") - F.col("_lng"))).alias("degrees"), F.col("match_id"))).alias("best"))
    return best.select("id", F.col("best.match_id").alias("match_id"), F.col("best.degrees").alias("degrees"))


def same_location(country: Column, other_country: Column, address: Column, other_address: Column, distance_km: Column, most_km: float = 1.0) -> Column:
    """Countries don't contradict each other, and addresses agree or the distance is small."""
    a, b = text.fold(country), text.fold(other_country)
    x, y = text.fold(address), text.fold(other_address)
    return ~((a != "") & (b != "") & (a != b)) & (((x != "") & (x == y)) | F.coalesce(distance_km <= most_km, F.lit(False)))


def first_at_location(left: DataFrame, right: DataFrame, keys: list[str], most_km: float = 1.0) -> DataFrame:
    """For each left row the first right row by id with equal keys at the same location, as in `same_location`.

    Rows don't meet one by one. Of an address, by country, the least id stands for all its rows; so it does for those of one place. Places
    meet those of the cubes around theirs, `most_km` wide and taken in space, where poles and the date line are places like others."""
    k, plain = [f"_k{n}" for n in range(len(keys))], [F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)]
    spot = [*k, "_country", "_lat", "_lng"]
    folded = lambda df: df.select("id", *plain, text.fold("country").alias("_country"), text.fold("address").alias("_address"), F.col("lat").cast("double").alias("_lat"), F.col("lng").cast("double").alias("_lng"))
    lefts, rights = folded(left), folded(right).withColumnRenamed("id", "match_id")
    least = F.min("match_id").alias("match_id")
    # a country meets itself and none, none meets every country ('*')
    own, other = F.array(F.col("_country"), F.lit("*")), F.when(F.col("_country") == "", F.array(F.lit("*"))).otherwise(F.array(F.col("_country"), F.lit("")))
    there = rights.where("_address <> ''").groupBy(*k, "_address", "_country").agg(least).withColumn("_c", F.explode(own)).groupBy(*k, "_address", "_c").agg(least)
    by_address = lefts.where("_address <> ''").withColumn("_c", F.explode(other)).join(there, [*k, "_address", "_c"]).select("id", "match_id")

    def cubed(df: DataFrame) -> DataFrame:
        a, b, side = F.radians("_lat"), F.radians("_lng"), most_km * (1 + 1e-6)
        at = {"_x": F.cos(a) * F.cos(b), "_y": F.cos(a) * F.sin(b), "_z": F.sin(a)}
        found = df.withColumns(at).where(" and ".join(f"{c} is not null and not isnan({c})" for c in at))
        return found.withColumns({c: F.floor(F.col(c) * places.EARTH_KM / side).cast("long") for c in at})

    around = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))))
    cubes = cubed(rights.groupBy(*spot).agg(least)).withColumn("_d", around)
    cubes = cubes.select(*k, "match_id", F.col("_country").alias("_c"), F.col("_lat").alias("_la"), F.col("_lng").alias("_ln"), *((F.col(f"_{c}") + F.col(f"_d.{c}")).alias(f"_{c}") for c in "xyz"))
    met = cubed(lefts.select(*spot).distinct()).join(cubes.hint("merge"), [*k, "_x", "_y", "_z"])
    near = met.where(((F.col("_country") == "") | (F.col("_c") == "") | (F.col("_country") == F.col("_c"))) & (places.haversine_km(F.col("_lat"), F.col("_lng"), F.col("_la"), F.col("_ln")) <= most_km))
    by_place = lefts.join(near.groupBy(*spot).agg(least), spot).select("id", "match_id")
    return by_address.unionByName(by_place).groupBy("id").agg(least)


def variants(rows: DataFrame, name: Column, order: list[Column], key: list[str], most: int = 8) -> DataFrame:
    """Up to `most` rows of a normalised name in order of priority, one for each key."""
    named = rows.withColumn("name_key", name)
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("name_key").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.withColumn("rn", F.row_number().over(W.partitionBy("name_key", *key).orderBy("rank"))).where("rn = 1").drop("rn")


@F.pandas_udf(T.DoubleType())
def name_score(left: pd.Series, right: pd.Series) -> pd.Series:
    """1 where one name contains the other, else the ratio of matching blocks."""
    from difflib import SequenceMatcher

    def one(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def _characters(name: Column) -> Column:
    """How often each character of a normalised name is in it, in a fixed order."""
    return F.transform(F.split(F.lit("abcdefghijklmnopqrstuvwxyz0123456789 "), ""), lambda c: F.length(name) - F.length(F.replace(name, c)))


#: Names of up to so many characters are found by what is left of them with a few characters off, and by their parts.
SHORT = 64
#: So many characters may be off.
MOST_OFF = 2
_NAMES = ["_block", "_name"]
_NEAR = 1e-9


def _fewer(name: Column, most: int) -> Column:
    """The name with up to `most` characters taken out, each outcome once."""
    out = now = F.array(name)
    for _ in range(most):
        now = F.array_distinct(F.flatten(F.transform(now, lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))))))
        out = F.concat(out, now)
    return F.array_distinct(out)


def _parts(name: Column, lengths: Column) -> Column:
    """The name's substrings of these lengths, each once; none is longer than the name."""
    return F.array_distinct(F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(name, i, k)))))


def _inside(whole: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """whole with each `part` of its block that its name contains, of names up to SHORT; parts has its length as {part}_n."""
    there = parts.where(F.col(f"{part}_n") <= SHORT).groupBy("_block").agg(F.collect_set(f"{part}_n").alias("_all"))  # up to SHORT numbers a block
    sized = whole.where(F.length(name) <= SHORT).join(there, "_block").withColumn("_all", F.filter("_all", lambda k: k <= F.length(name)))
    return sized.select(*whole.columns, F.explode(_parts(F.col(name), F.col("_all"))).alias(part))


def best_names(left: DataFrame, right: DataFrame, block: str, least: float = 0.55) -> DataFrame:
    """For each left row the best right row of its block: of those whose name score is good enough the one of greatest score
    with bonuses, a quarter for a website and 0.15 for an address (where right has these columns). The score given is the name's.

    Names meet once however many rows have them. Names that contain one another meet by equal parts, then names that differ by one, and by two,
    characters of either by what is left without them. What two names that haven't met yet can score at most follows from their lengths: matching
    blocks are characters that both have in the same order. A name looks further only where that reaches the best it has. In the end
    names meet all others of the lengths that are still open for them, and pairs that the characters' counts keep under `least`, or
    under what is found, aren't scored."""
    spark = left.sparkSession
    has = lambda c, k: F.when(F.trim(c) != "", k).otherwise(0.0) if c in right.columns else F.lit(0.0)
    keyed = lambda df: df.withColumns({"_block": F.col(block), "_name": text.normalize_name("name")}).where(F.col("_block").isNotNull())
    lefts, rights = keyed(left).select("id", "_block", "_name"), keyed(right).select(F.col("id").alias("match_id"), "_block", F.col("_name").alias("_other"), (has("website", 0.25) + has("address", 0.15)).alias("_bonus"))
    # of the rows of a name the one with the greatest bonus, then the least id, is the best for all
    rights = rights.groupBy("_block", "_other").agg(F.max(F.struct("_bonus", (-F.col("match_id")).alias("id"))).alias("r")).select("_block", "_other", F.col("r._bonus").alias("_bonus"), (-F.col("r.id")).alias("match_id"))
    named = lambda df, c: df.where(F.col(c) != "").withColumns({f"{c}_n": F.length(c), f"{c}_k": F.xxhash64("_block", c)})
    asked = shared.stored(named(lefts.select("_block", "_name").distinct(), "_name"), "names-asked")
    given = shared.stored(named(rights, "_other"), "names-given")
    tasks = 4 * spark.sparkContext.defaultParallelism  # short rows that cost much: sizes in bytes would give them few tasks
    lengths = given.groupBy("_block", "_other_n").agg(F.max("_bonus").alias("_top"))
    done = [asked, given]

    def ranked(found: DataFrame) -> DataFrame:
        """The best right row for each left name, with what it reaches."""
        best = found.groupBy(*_NAMES).agg(F.max_by(F.struct("match_id", "score", "_sum"), F.struct("_sum", -F.col("match_id"))).alias("b"))
        done.append(shared.stored(best.select(*_NAMES, "b.*"), "names-best"))
        return done[-1]

    def opened(best: DataFrame, off: int) -> DataFrame:
        """Left names with the lengths of right ones that may reach more than is found, if up to `off` characters of either were tried."""
        n, m = F.col("_name_n"), F.col("_other_n")
        common = F.least(n, m, F.greatest(n, m) - off - 1)
        bound = F.when(F.greatest(n, m) > SHORT, 1.0).otherwise(2.0 * common / (n + m))
        far = asked.join(best.select(*_NAMES, F.col("_sum").alias("_best")), _NAMES, "left").join(lengths, "_block").withColumn("_bound", bound)
        return far.where((F.col("_bound") >= least - _NEAR) & (F.col("_best").isNull() | (F.col("_bound") + F.col("_top") >= F.col("_best") - _NEAR)))

    def scored(pairs: DataFrame) -> DataFrame:
        """Of pairs that may reach more than is found those that are good enough."""
        found = pairs.select(*_NAMES, "_other", "_bonus", "match_id").withColumn("score", name_score("_name", "_other")).where(F.col("score") >= least)
        return found.select(*_NAMES, "match_id", "score", (F.col("score") + F.col("_bonus")).alias("_sum"))

    may = F.col("_best").isNull() | (F.col("_bound") + F.col("_bonus") >= F.col("_best") - _NEAR)
    # names in one another score 1: those of one part need only their best
    longer = _inside(given.select("_block", "_other", "_bonus", "match_id"), "_other", asked, "_name").groupBy(*_NAMES).agg(F.max(F.struct("_bonus", (-F.col("match_id")).alias("id"))).alias("r"))
    longer = asked.select(*_NAMES).join(longer.hint("merge"), _NAMES).select(*_NAMES, F.col("r._bonus").alias("_bonus"), (-F.col("r.id")).alias("match_id"))
    shorter = _inside(asked.select(*_NAMES), "_name", given, "_other").hint("merge").join(given, ["_block", "_other"]).select(*_NAMES, "_bonus", "match_id")
    best = ranked(longer.unionByName(shorter).where(F.lit(1.0) >= least).select(*_NAMES, "match_id", F.lit(1.0).alias("score"), (F.lit(1.0) + F.col("_bonus")).alias("_sum")))
    for off in range(1, MOST_OFF + 1):
        far = opened(best, off - 1).where((F.greatest("_name_n", "_other_n") <= SHORT) & (F.abs(F.col("_name_n") - F.col("_other_n")) <= off))
        wanted = given.join(far.select("_block", "_other_n").distinct(), ["_block", "_other_n"], "left_semi")
        cut = lambda df, c: df.select("_block", c, f"{c}_k").distinct().repartition(tasks, f"{c}_k").select(f"{c}_k", F.explode(_fewer(F.col(c), off)).alias("_cut"), "_block").select(f"{c}_k", F.xxhash64("_block", "_cut").alias("_cut"))  # noqa: B023, E731
        met = cut(far, "_name").hint("merge").join(cut(wanted, "_other"), "_cut").select("_name_k", "_other_k").distinct()
        pairs = met.hint("merge").join(far, "_name_k").join(given.drop("_other_n"), ["_block", "_other_k"]).where((F.col("_other_n") == F.length("_other")) & may)
        best = ranked(best.unionByName(scored(pairs)))
    inside = F.contains("_name", F.col("_other")) | F.contains("_other", F.col("_name"))
    both = F.col("_name_n") + F.col("_other_n")
    shared_n = F.aggregate(F.zip_with("_name_c", "_other_c", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    far = opened(best, MOST_OFF).withColumn("_name_c", _characters(F.col("_name")))
    rest = far.join(given.withColumn("_other_c", _characters(F.col("_other"))), ["_block", "_other_n"]).where(may)
    rest = rest.withColumn("_bound", F.when(inside, 1.0).otherwise(2.0 * shared_n / both)).where((F.col("_bound") >= least - _NEAR) & may)
    best = ranked(best.unionByName(scored(rest)))
    shared.removed(spark, *(t.stored_at for t in done[:-1]))
    return lefts.join(best, _NAMES).select("id", "match_id", "score")


def line_tokens(column: Column) -> Column:
    plain = F.trim(F.regexp_replace(text.fold(column), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda t: (F.length(t) >= 3) & ~t.isin(rules.LINE_STOP_WORDS))


def line_words(column: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text.fold(column), "[^a-z0-9]+", " ")), " ")


def line_score(tokens: Column, words: Column, same_vintage: Column, same_price: Column) -> Column:
    """Share of the index line's tokens among the other's words, a quarter for the vintage and a fifth for the price."""
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))
    bonus = F.when(same_vintage, 0.25).otherwise(0.0) + F.when(same_price, 0.2).otherwise(0.0)
    return F.when(F.size(tokens) > 0, hits / F.size(tokens) + bonus).otherwise(0.0)


def reconcile(index: DataFrame, other: DataFrame, group: str, least: float = 0.55) -> DataFrame:
    """Greedy one-to-one matches within each group: index lines in order take the best other line that is left.

    Each line's words are taken once, before lines meet. As the bonuses don't reach the threshold alone, only lines that share
    a word are scored, and only pairs that reach it go to the greedy step, a group at a time."""
    i = index.select(F.col(group).alias("_group"), "id", "vintage", "price", line_tokens(F.col("text")).alias("_tokens"))
    o = other.select(F.col(group).alias("_group"), F.col("id").alias("other_id"), line_words(F.col("text")).alias("_words"), F.col("vintage").alias("_vintage"), F.col("price").alias("_price"))
    met = i.join(o, "_group").where(F.arrays_overlap("_tokens", "_words"))
    pairs = met.withColumn("score", line_score(F.col("_tokens"), F.col("_words"), F.col("vintage") == F.col("_vintage"), F.col("price") == F.col("_price")))

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come in order of group, index line and falling score: one pass, the state is the current group's
        now, done, used = None, None, set()
        for pdf in batches:
            out = []
            for g, i, j, score in zip(*(pdf[c].to_numpy() for c in ("_group", "id", "other_id", "score")), strict=True):
                if g != now:
                    now, done, used = g, None, set()
                if i != done and j not in used:
                    done = i
                    used.add(j)
                    out.append((g, i, j, score))
            yield pd.DataFrame(out, columns=["_group", "id", "other_id", "score"])

    kept = pairs.where(F.col("score") >= least).select(F.col("_group").cast("long").alias("_group"), "id", "other_id", "score")
    ordered = kept.repartition(F.xxhash64("_group")).sortWithinPartitions("_group", "id", F.desc("score"), "other_id")
    return ordered.mapInPandas(greedy, "_group long, id long, other_id long, score double").withColumnRenamed("_group", group)
