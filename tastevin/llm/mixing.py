"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A source's target is a number of words. Within a source each document expects a number of copies that grows with its
size class, capped; the whole part of it is certain, and the fraction is the inclusion probability p of one copy
more. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a number in (0, 1) fixed by doc_id and seed, and taken in
that order until the words that are left of the target are used: a sample of fixed size, in words.

Nothing sorts a whole source in one task: the rank is cut into BINS bins, words are summed by bin, and only the bin in
which the budget ends is ordered row by row.

Edge cases: null text or a text without words has size 0 and takes 0; null source is a source of its own, last in order;
a null or repeated doc_id is a row like any other (rows alike in doc_id and size are interchangeable); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Carried, Scratch, stored, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BINS = 4096
SEED = "pareto-1"
#: Stands for a null source in joins; the flag beside it keeps it apart from a source of that name.
_KEY = ["source_null", "source_key"]


def _measures() -> dict[str, Column]:
    """From doc_id, source and text: size in words, source key, random number."""
    return {
        "size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
        "source_null": F.col("source").isNull(),
        "source_key": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "u": _uniform(),
    }


def _class() -> Column:
    return F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).cast("int").alias("cls")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, size class, random number; one narrow row for each document."""
    return docs.select("doc_id", "source", *(c.alias(n) for n, c in _measures().items())).select("*", _class())


def _uniform() -> Column:
    """In (0, 1), from 52 bits of a digest of doc_id: the same in every run and on every engine."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty().cast("binary"))))
    digest = F.md5(F.concat_ws(":", F.lit(SEED), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def running(df: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """df with turn, its row's number in order (a key), and for each name of sums the sum of that column over the rows before.

    Rows are dealt to ranges of the order, numbered and summed within each, and the ranges' totals are added up: no task sees
    more than its range, however many rows there are."""
    ranged = scratch.stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range
    totals = ranged.groupBy("part").agg(F.count("*").alias("part_n"), *(F.sum(c).alias(f"part_{n}") for n, c in sums.items()))
    starts = totals.select("part", *(F.coalesce(F.sum(f"part_{n}").over(before), F.lit(0)).alias(f"part_{n}") for n in ("n", *sums)))
    within = W.partitionBy("part").orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumns({"turn": F.row_number().over(within), **{n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}}).join(starts, "part")
    return rows.withColumns({"turn": F.col("turn") + F.col("part_n"), **{n: F.col(n) + F.col(f"part_{n}") for n in sums}}).drop("part", "part_n", *(f"part_{n}" for n in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int, scratch: Scratch) -> DataFrame:
    """A row for each source: its words, weight and target. sizes: (source_null, source_key, words), a row for each source.

    The share of all words is dealt by weight; a source over its cap (most times its words) keeps the cap and the excess
    is dealt again. In order of cap / weight the capped sources come first, so the level of the others is a prefix sum.
    """
    turn = F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1
    dealt = (
        running(sizes, _KEY, {}, scratch)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long")).drop("turn")
        .withColumn("cap", F.lit(most) * F.col("words"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    levelled = scratch.stored(running(dealt, ["ratio", *_KEY], {"caps": "cap", "weighed": "weight"}, scratch), "mix-levels")
    whole = levelled.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    theta = (F.lit(share) * F.lit(whole["words"] or 0) - F.col("caps")) / (F.lit(whole["weight"] or 0) - F.col("weighed"))
    first = levelled.withColumn("theta", theta).where("theta <= ratio").agg(F.min(F.struct("ratio", *_KEY, "theta"))["theta"].alias("level")).first()
    cap = F.col("cap").cast("double")
    target = cap if first["level"] is None else F.least(cap, F.lit(first["level"]) * F.col("weight"))
    return levelled.select(*_KEY, "words", "weight", target.alias("target"))


def copies(classes: DataFrame, goal: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """For each source and size class: certain copies, inclusion probability p of one more, and the source's word budget for those.

    A class expects least(most, c * class) copies, c such that the words come to the target; classes that reach the cap are
    a prefix in falling order of class.
    """
    falling = W.partitionBy(*_KEY).orderBy(F.desc("cls"))
    whole = W.partitionBy(*_KEY)
    c = (
        classes.where("cls > 0").join(goal.select(*_KEY, "target"), _KEY)
        .withColumn("before", F.coalesce(F.sum("words").over(falling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after", F.sum(F.col("words") * F.col("cls")).over(falling.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("c", (F.col("target") - F.lit(most) * F.col("before")) / F.col("after"))
        .withColumn("c", F.min(F.when(F.col("c") * F.col("cls") <= most, F.struct(-F.col("cls"), F.col("c").alias("c")))).over(whole)["c"])
        .withColumn("expected", F.when(F.col("c").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("c") * F.col("cls")))))
        .withColumn("copies", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("copies"))
    )
    return c.withColumn("budget", F.first("target").over(whole) - F.sum(F.col("words") * F.col("copies")).over(whole)).select(*_KEY, "cls", "copies", "p", "budget")


def _ranked(rows: DataFrame, rule: DataFrame) -> DataFrame:
    """Rows with their rule; v orders them within their source as the odds do, and is null for what can't be sampled."""
    q = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return rows.join(rule, [*_KEY, "cls"], "left").withColumn("q", q).withColumn("v", F.col("q") / (1 + F.col("q")))


def _planned(docs: DataFrame, weights, share: float, bins: int, scratch: Scratch):
    """The measured rows with rank and decision, the rule for each source and class, and each source's target."""
    rows = scratch.stored(measured(docs), "mix-sizes")
    classes = scratch.stored(rows.groupBy(*_KEY, "cls").agg(F.sum("size").alias("words")), "mix-classes")
    goal = scratch.stored(targets(classes.groupBy(*_KEY).agg(F.sum("words").alias("words")), weights, share, MOST_COPIES, scratch), "mix-targets")
    rule = scratch.stored(copies(classes, goal), "mix-rule")
    ranked = _ranked(rows, rule).withColumn("bin", F.floor(F.col("v") * bins).cast("int"))
    sums = ranked.where("bin is not null").groupBy(*_KEY, "bin").agg(F.sum("size").alias("inside"))
    before = F.coalesce(F.sum("inside").over(W.partitionBy(*_KEY).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = scratch.stored(sums.withColumn("before", before), "mix-edges")
    placed = ranked.join(edges, [*_KEY, "bin"], "left")
    split = F.coalesce((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("inside") > F.col("budget")), F.lit(False))
    inside = placed.where(split).withColumn(
        "within", F.coalesce(F.sum("size").over(W.partitionBy(*_KEY, "bin").orderBy("v", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("sampled", (F.col("before") + F.col("within") + F.col("size") / 2 <= F.col("budget")).cast("long"))
    outside = placed.where(~split).withColumn("sampled", F.coalesce((F.col("before") + F.col("inside") <= F.col("budget")).cast("long"), F.lit(0)))
    return inside.drop("within").unionByName(outside), rule, goal


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, bins: int = BINS) -> DataFrame:
    """One row for each document: size, source_size, target, copies certain and sampled, words taken."""
    with Scratch() as scratch:
        rows, _, goal = _planned(docs, weights, share, bins, scratch)
        certain = F.coalesce("copies", F.lit(0))
        out = rows.join(goal, _KEY).select(
            "doc_id", "source", "size", F.col("words").alias("source_size"), "target", certain.cast("long").alias("certain"), F.coalesce("p", F.lit(0.0)).alias("inclusion"), "sampled",
            (F.col("size") * (certain + F.col("sampled"))).alias("taken"),
        )
        return stored(out, "mix-taken")


#: Rules (one for each source and size class) that are broadcast at most; more go through an ordinary join.
MOST_RULES = 100_000


def applied(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, bins: int = BINS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with docs' columns."""
    carried = Carried(docs, docs.columns)
    with Scratch() as scratch:
        rows, rule, _ = _planned(docs.select("doc_id", "source", "text"), weights, share, bins, scratch)
        order = F.struct("v", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size")
        # what is taken last of each source, and how many of the rows just like it (copies of a row under one id) are
        last = rows.where("sampled = 1").groupBy(*_KEY).agg(F.max(order).alias("cut"))
        alike = rows.join(last, _KEY).where(order == F.col("cut")).groupBy(*_KEY).agg(F.sum("sampled").alias("cut_taken"), F.count("*").alias("cut_rows"))
        whole = rule.join(last, _KEY, "left").join(alike, _KEY, "left")
        rule = stored(whole, "mix-cuts")
    if rule.limit(MOST_RULES + 1).count() <= MOST_RULES:
        rule = F.broadcast(rule)
    facts = docs.select(*carried.columns, "doc_id", "source", "text").withColumns({n: c for n, c in _measures().items()}).drop("source", "text").withColumn("cls", _class())
    ranked = _ranked(facts, rule).where("size > 0").withColumn("rank", order)
    sure = F.coalesce((F.col("rank") < F.col("cut")) | (F.col("rank") == F.col("cut")) & (F.col("cut_taken") == F.col("cut_rows")), F.lit(False)) & F.col("v").isNotNull()
    torn = F.coalesce((F.col("rank") == F.col("cut")) & (F.col("cut_taken") < F.col("cut_rows")), F.lit(False)) & F.col("v").isNotNull()
    times = F.coalesce("copies", F.lit(0)).cast("int")
    taken = ranked.where(~torn).withColumn("times", times + sure.cast("int"))
    if rule.where("cut_taken < cut_rows").limit(1).count():
        turn = F.row_number().over(W.partitionBy(*_KEY).orderBy("rank"))
        some = ranked.where(torn).withColumn("turn", turn).withColumn("times", times + (F.col("turn") <= F.col("cut_taken")).cast("int")).drop("turn")
        taken = taken.unionByName(some)
    return taken.where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*carried.back)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: {docs} is the relation to mix; the same steps in the same order, so that doubles agree to the last bit.
MIX_SQL = r"""
m0 as (
  select doc_id, source, coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, ''))) as name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from {docs}
), m1 as (
  select *, source is null as source_null, coalesce(source, '') as source_key, case when size > 0 then length(bin(size)) else 0 end as cls,
    (('0x' || substr(md5('pareto-1:' || name), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from m0
), cl as (select source_null, source_key, cls, sum(size)::bigint as words from m1 group by all),
sr as (select source_null, source_key, sum(words)::bigint as words from cl group by all),
w as (select *, [5, 2, 1][(row_number() over (order by source_null, source_key) - 1) % 3 + 1] as weight, 2 * words as cap from sr),
w2 as (select *, cap / weight as ratio from w),
w3 as (
  select *, (1.5::double * sum(words) over ()::bigint - coalesce(sum(cap) over (order by ratio, source_null, source_key rows between unbounded preceding and 1 preceding), 0)::bigint)
    / sum(weight) over (order by ratio, source_null, source_key rows between current row and unbounded following)::bigint as theta
  from w2
), lv as (select arg_min(theta, (ratio, source_null, source_key)) filter (where theta <= ratio) as level from w3),
goal as (select source_null, source_key, words, case when level is null then cap::double else least(cap::double, level * weight) end as target from w3, lv),
c1 as (
  select cl.*, target, (target - 2 * coalesce(sum(cl.words) over (partition by source_null, source_key order by cls desc rows between unbounded preceding and 1 preceding), 0)::bigint)
    / sum(cl.words * cls) over (partition by source_null, source_key order by cls desc rows between current row and unbounded following)::bigint as c
  from cl join goal using (source_null, source_key) where cls > 0
), c2 as (select source_null, source_key, arg_max(c, cls) filter (where c * cls <= 2) as c from c1 group by all),
c3 as (select c1.source_null, c1.source_key, cls, words, target, case when c2.c is null then 2.0::double else least(2.0::double, greatest(0.0::double, c2.c * cls)) end as expected from c1 join c2 using (source_null, source_key)),
c4 as (select *, floor(expected)::bigint as copies from c3),
c5 as (select *, expected - copies as p, target - sum(words * copies) over (partition by source_null, source_key)::bigint as budget from c4),
r1 as (
  select m1.*, copies, p, budget, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from m1 left join c5 using (source_null, source_key, cls)
), r2 as (select *, q / (1 + q) as v from r1),
r3 as (select *, coalesce(sum(size) over (partition by source_null, source_key, q is null order by v, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as prior from r2),
mixed as (
  select doc_id, source, size, goal.words as source_size, goal.target as target,
    (size * (coalesce(copies, 0) + case when q is not null and prior + size / 2 <= budget then 1 else 0 end))::bigint as taken
  from r3 join goal using (source_null, source_key)
)
"""
SQL = f"with {MIX_SQL.replace('{docs}', 'documents')} select doc_id, size, source_size, target, taken from mixed"
