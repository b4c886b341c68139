"""Token counts through a digest cache.

The content of a text is normalised as the tokenizer itself does first (runs of ASCII white space to one blank, none at
the ends) and digested. The cache is a table (version, digest, n_tokens), version a digest of the tokenizer file. Where there is a
cache, distinct digests alone are joined to it; the texts of those that it lacks are then picked out where they lie, if these
are at most FEW, else by a shuffle. One text of each new digest is encoded, and the new counts are appended to the cache.

The encoder counts with the library itself. As the tokenizer drops white space and no piece of it reaches across, a text's
count is the sum over its blank-separated words, and counts of words are kept in a bounded table in each worker.

Edge cases: null counts as empty (0 tokens); null or repeated doc_id are rows like any other; an empty table gives an
empty result and leaves the cache as it is; a carried column named n_bytes or n_tokens gives way to the output.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACE, Carried, exists, removed, shared_dir, stored, table, text_or_empty

TOKENIZER = "word_bpe_49k.json"
OVER = 2048
#: Words whose counts a worker keeps at most; beyond it the table starts anew.
KEPT_WORDS = 400_000
#: New digests (64 bytes each) that are sent to all executors at most; with more of them texts are shuffled to theirs.
FEW = 100_000
CACHE = StructType([StructField("version", StringType()), StructField("digest", StringType()), StructField("n_tokens", LongType())])


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]


_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """Counter of the tokens of texts, kept for the life of the worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _encoders[path] = (tokenizer, {})
    tokenizer, known = _encoders[path]

    def counts(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            words = text.split(" ") if text else []
            new = [w for w in set(words) if w not in known]
            if new:
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = list(set(words))
                known.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            out.append(sum(map(known.__getitem__, words)))
        return out

    return counts


def count_tokens(docs: DataFrame, path: str, cache_dir: str, *carry: str) -> DataFrame:
    """carry, n_bytes, n_tokens for every row of docs; new counts are appended to the table at cache_dir."""
    spark, version = docs.sparkSession, version_of(path)
    carried = Carried(docs, carry, ["n_bytes", "n_tokens"])
    content = F.trim(F.regexp_replace(text_or_empty(), f"[{SPACE}]+", " "))
    digested = docs.select(*carried.columns, F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), content.alias("content")).withColumn("digest", F.sha2("content", 256))

    def cached() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_dir).where(F.col("version") == version)

    def encode(batches):
        counts = encoder(path)
        for batch in batches:
            found = counts(batch.column("content").to_pylist())
            yield pa.record_batch({"version": pa.array([version] * len(found)), "digest": batch.column("digest"), "n_tokens": pa.array(found, pa.int64())})

    texts, new = digested.select("digest", "content"), None
    if exists(cache_dir, spark):
        # narrow first: where few digests are new, all other texts stay where they lie
        new = stored(texts.select("digest").distinct().join(cached().select("digest").distinct().hint("merge"), "digest", "left_anti"), "token-new")
        few = new.limit(FEW + 1).count() <= FEW
        texts = texts.join(F.broadcast(new) if few else new.hint("merge"), "digest", "left_semi")
    misses = texts.dropDuplicates(["digest"])
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache_dir)
    if new is not None:
        removed(new.stored_at, spark=spark)
    counted = cached().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # a table of its own, so that both sides of the join are plain shuffles, of which Spark can split a hot digest
    counted = stored(counted, "token-counts")
    return digested.drop("content").join(counted, "digest").select(*carried.back, "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call has a cache of its own, so that a run never profits from an earlier one; `count_tokens` keeps the one it is given."""
    cache = f"{shared_dir(spark)}/tastevin/token-cache-{uuid.uuid4().hex}"
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), cache, "doc_id")
    removed(cache, spark=spark)
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER)
