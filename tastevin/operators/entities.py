"""Entities inside a batch: records that share a website, or a name within a small box, are one, and so on through all links.

No group is written out as its pairs. Records of a website, and of a name at one place, are tied to the least id among them; places of a
name meet places of the eight cells around theirs and of their own, each cell half a box wide standing for all its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared


def tied(records: DataFrame, key: list[str], given: Column) -> DataFrame:
    """Edges (a, b) from each record to the least id with its key."""
    rows = records.where(given)
    least = rows.groupBy(*key).agg(F.min("id").alias("a"))
    return rows.join(least, key).where("id <> a").select("a", F.col("id").alias("b"))


def near(records: DataFrame, name: str, box: float) -> DataFrame:
    """Edges (a, b) that join what is linked by equal names and places at most `box` degrees apart in both directions.

    Records in one cell of half a box are all within reach and tied to the least id. Of two cells that may reach each other the places of
    the one are looked up in the other, place by place."""
    half = box / 2
    cell = lambda c: F.floor(F.col(c) / half).cast("long")
    rows = records.where(F.col(name).isNotNull() & (F.col(name) != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns({"x": cell("lat"), "y": cell("lng")})
    inside = tied(rows, [name, "x", "y"], F.lit(True))
    places = rows.groupBy(name, "x", "y", "lat", "lng").agg(F.min("id").alias("id"))
    # up to three cells away (the third for what rounding puts there), each pair of cells from its lesser side alone
    steps = [(a, b) for a in range(4) for b in range(-3, 4) if (a, b) > (0, 0)]
    others = places.select(F.col(name).alias("_name"), "x", "y", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("id").alias("_id"))
    reach = others.withColumn("s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))))
    reach = reach.withColumns({"x": F.col("x") - F.col("s.a"), "y": F.col("y") - F.col("s.b")}).drop("s").withColumnsRenamed({"x": "_x", "y": "_y"})
    met = places.join(reach, (F.col(name) == F.col("_name")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    close = met.where((F.abs(F.col("lat") - F.col("_lat")) <= box) & (F.abs(F.col("lng") - F.col("_lng")) <= box))
    return inside.unionByName(close.select(F.least("id", "_id").alias("a"), F.greatest("id", "_id").alias("b")).distinct())


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(id, component) of every id in an edge: the least id that it is linked with, through any number of edges.

    Every id points to a lesser one. In a round an id, and the one that it points to, take the least that a neighbour's pointer points to,
    and pointers skip one on their way, so the rounds grow with the logarithm of the longest way. Pointers only fall: their sum tells
    when nothing moves. Rounds are tables in the shared folder; the last one stays."""
    spark = edges.sparkSession
    both = shared.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "entity-edges")
    now = shared.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("to")), "entity-pointers")
    total = lambda df: df.agg(F.sum(F.col("to").cast("decimal(38,0)"))).first()[0]
    before = total(now)
    for _ in range(most):
        beyond = now.join(now.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", "to", "beyond")
        around = both.join(beyond.select(F.col("id").alias("b"), "beyond"), "b").groupBy(F.col("a").alias("id")).agg(F.min("beyond").alias("low"))
        told = beyond.join(around, "id").select(F.explode(F.array(F.struct("id", F.least("low", "beyond").alias("to")), F.struct(F.col("to").alias("id"), F.col("low").alias("to")))).alias("t"))
        then = shared.stored(told.select("t.*").unionByName(now).groupBy("id").agg(F.min("to").alias("to")), "entity-pointers")
        shared.removed(spark, now.stored_at)
        now, after = then, total(then)
        if after == before:
            shared.removed(spark, both.stored_at)
            return now.withColumnRenamed("to", "component")
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")


def entities(records: DataFrame, name: str = "name", website: str = "domain", box: float = 0.003) -> DataFrame:
    """records with entity, the least id of all that are one with it; a record without links is its own."""
    edges = tied(records, [website], F.coalesce(F.col(website) != "", F.lit(False))).unionByName(near(records, name, box))
    return records.join(components(edges), "id", "left").withColumn("entity", F.coalesce("component", "id")).drop("component")
