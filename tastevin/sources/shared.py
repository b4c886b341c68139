"""The folder that driver and executors share, and tables that are kept in it while a job needs them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tastevin.core.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tastevin-core-")
        spark.conf.set("tastevin.core.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tastevin-core/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read from there: it outlives lost executors and cuts the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    where, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where, fs = _at(spark, path)
        fs.delete(where, True)


def claimed(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; False if another has: the commit of a version that only one writer can make."""
    where, fs = _at(spark, path)
    fs.mkdirs(where.getParent())
    return fs.createNewFile(where)


def numbered(rows: DataFrame, order: list[Column | str], name: str = "turn") -> DataFrame:
    """rows with their number in rising order, from 1. order has to be total for the numbers to be the same in every run.

    Ranges of the order are written with their number and counted; the counts before a range are summed over the ranges, so no
    task sees more than its range, and a lost executor changes nothing."""
    keys = {f"_o{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    ranged = stored(rows.withColumns(keys).repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    within = F.row_number().over(W.partitionBy("_p").orderBy(*keys))
    return ranged.withColumn("_w", within).join(before, "_p").withColumn(name, (F.col("_before") + F.col("_w")).cast("long")).drop("_p", "_w", "_before", *keys)
