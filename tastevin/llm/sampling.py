"""Bounded samples of labelled rows to fit on, and the folds that the queries hold out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

#: Values of a label that are learned at most, the most frequent ones: with `each` it bounds every sample.
MOST_VALUES = 250


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text; a null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def drawn(keys: DataFrame, by: str, each: int, most: int = MOST_VALUES, total: int | None = None) -> DataFrame:
    """Exactly `each` rows of every value of `by` (all where there are fewer), those of the least hashes; keys: distinct rows.
    With `total`, every value gets its even part of it where that is less than `each`.

    The counts are of all rows. A rate a little above each / count leaves few rows, so that ranking them needs no large sort;
    the choice doesn't depend on the partitions."""
    columns = keys.columns
    counts = keys.groupBy(by).agg(F.count("*").alias("drawn_n")).orderBy(F.desc("drawn_n"), by).limit(most)
    found = counts.collect()  # `most` rows
    each = min(each, max(total // max(len(found), 1), 1)) if total else each
    counts = keys.sparkSession.createDataFrame(found, counts.schema)
    hashed = keys.withColumn("drawn_h", F.xxhash64(*columns, F.lit("fit")))
    rate = (each + 6.0 * each**0.5 + 20) / F.col("drawn_n")
    few = hashed.join(F.broadcast(counts), by).where(F.pmod("drawn_h", F.lit(1 << 30)) / float(1 << 30) < rate)
    rank = F.row_number().over(W.partitionBy(by).orderBy("drawn_h", *columns))
    return few.withColumn("drawn_k", rank).where(F.col("drawn_k") <= each).select(*columns)


def texts(rows: DataFrame, by: str, each: int, most: int = MOST_VALUES, total: int | None = None) -> DataFrame:
    """(by, text, digest) of at most `each` distinct texts of every value of `by`. Copies, whatever their ids, count once."""
    rows = rows.select(by, text_or_empty().alias("text")).withColumns({"digest": F.xxhash64("text"), "digest2": F.xxhash64(F.lit(1), "text")})
    chosen = drawn(rows.select(by, "digest", "digest2").distinct(), by, each, most, total)
    # bounded by each x most narrow rows
    return rows.join(F.broadcast(chosen), [by, "digest", "digest2"]).dropDuplicates([by, "digest", "digest2"]).select(by, "text", "digest")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """label, text, digest of at most `each` texts of each label (0, 1) of those that may be learned from.

    docs: doc_id, text; labels: doc_id and the label's column. An id with both labels counts as 1."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(3, 1))
    ids = drawn(known.groupBy("doc_id").agg(F.max("label").alias("label")), "label", each)
    return texts(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "label", each)
