"""Shared helpers: table access, durable intermediate tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates words in every operator of this package: ASCII white space.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary
    folder of its own; on a cluster that is an error, as executors elsewhere couldn't read it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tastevin.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tastevin-")
        spark.conf.set("tastevin.shared.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tastevin/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def removed(*paths: str, spark: SparkSession) -> None:
    """Delete tables that nothing reads any more."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(path: str, spark: SparkSession) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Stored tables that go when the block ends; what a caller reads afterwards is stored by `stored` itself."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for df in self.tables.values():
            removed(df.stored_at, spark=df.sparkSession)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        back = stored(df, label)
        self.tables[back.stored_at] = back
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            removed(self.tables.pop(df.stored_at).stored_at, spark=df.sparkSession)


class Carried:
    """Columns that go through an operator under names of its own, so that none of theirs can clash with the operator's.

    `columns` are to be selected, `schema` is their part of an output schema, and `back` gives them their names again. An
    operator's output takes the place of a carried column of the same name (in any case)."""

    def __init__(self, df: DataFrame, names, outputs=()):
        taken = {x.lower() for x in outputs}
        names = list(dict.fromkeys(names))
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        self.all = [f"carried_{k}" for k in range(len(names))]
        self.columns = [df[quoted(n)].alias(c) for c, n in zip(self.all, names, strict=True)]
        self.schema = [f"{c} {kinds[n]}" for c, n in zip(self.all, names, strict=True)]
        self.back = [F.col(c).alias(n) for c, n in zip(self.all, names, strict=True) if n.lower() not in taken]

    def __getstate__(self):
        return {"all": self.all}  # what workers need

    def of(self, batch) -> dict:
        return {c: batch.column(c) for c in self.all}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc32_sql(text: str) -> str:
    """DuckDB's SQL of the CRC-32 of an ASCII string, for oracles."""
    steps = f"flatten(list_transform(range(length({text})), lambda i: [unicode(substr({text}, i + 1, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {steps}), lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end), 4294967295::bigint)"


def components(edges: DataFrame, label: str, scratch: Scratch, most: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) by alternating large-star and small-star steps.

    Returns (id, component), component the smallest id reached, one row for each id in an edge (loops included), as a table of
    scratch. The edges of every step are a table in the shared folder, and the one before goes. Each step only moves edges
    to smaller ids, and the number of steps grows with the logarithm of the longest path; a hub's edges are grouped with
    map-side minima.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = given = scratch.stored(pair(edges), f"{label}-edges")
    state = None
    for _ in range(most):
        with Scratch() as step:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # tables of their own, so that a hub's rows are in a plain shuffle, which Spark can split
            least = step.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least")
            # large star: every larger neighbour of a moves to the least id around a
            large = step.stored(pair(both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))), f"{label}-large")
            # small star: the smaller neighbours of b, and b itself, move to the least of them
            down = large.where("a < b").select(F.col("b").alias("k"), F.col("a").alias("v"))
            low = step.stored(down.groupBy("k").agg(F.min("v").alias("m")), f"{label}-low")
            small = down.join(low, "k").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
            last, now = now, scratch.stored(pair(small), f"{label}-edges")
        if last is not given:
            scratch.drop(last)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    ids = given.select(F.col("a").alias("id")).unionByName(given.select(F.col("b").alias("id"))).distinct()
    root = now.where("a < b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    out = scratch.stored(ids.join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component")), f"{label}-found")
    scratch.drop(now, given)
    return out
