"""Nested JSON as rows, by VARIANT: every value of a document at any depth, level by level, without Python.

A level's objects and arrays are exploded into the next one until none is left, so there are as many rounds as the deepest document has
levels, each a lateral explosion without a shuffle. A document that isn't JSON has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: Deeper documents are an error, not cut off.
DEEPEST = 500


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    number = schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(number, "number").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("null")
    )


def nodes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth (0: the document), parent and path (steps .name and [k] from $), kind (object, array, string, number, boolean, null), name (of an
    object's member), and value: a scalar's text, null for objects, arrays and null. A table in the shared folder for each level."""
    spark = rows.sparkSession
    top = rows.select(F.col(key), F.lit(None).cast("string").alias("parent"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(json)).alias("v")).where(F.col("v").isNotNull())
    out = None
    for depth in range(DEEPEST):
        level = shared.stored(top.withColumn("kind", _kind(F.col("v"))), "json-level")
        scalar = F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).when(F.col("kind").isin("number", "boolean"), F.to_json("v"))
        here = level.select(key, F.lit(depth).alias("depth"), "parent", "path", "kind", "name", scalar.alias("value"))
        out = here if out is None else out.unionByName(here)
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return out
        inside = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("member"), F.col("value").alias("inner")))
        step = F.when(F.col("kind") == "array", F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("member")))
        top = inside.select(F.col(key), F.col("path").alias("parent"), F.concat("path", step).alias("path"), F.col("member").alias("name"), F.col("inner").alias("v"))
    raise ValueError(f"JSON deeper than {DEEPEST} levels")


def objects(found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each object of `nodes`, at whatever depth, with its scalar members of these names, null where there is none."""
    members = found.where(F.col("parent").isNotNull() & F.col("name").isin(fields)).select(key, F.col("parent").alias("path"), "name", "value")
    wide = members.groupBy(key, "path").pivot("name", fields).agg(F.first("value", ignorenulls=True))
    return found.where("kind = 'object'").select(key, "depth", "path").join(wide, [key, "path"], "left")
