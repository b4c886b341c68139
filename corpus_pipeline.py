"""Corpus pipeline: language ID, near-duplicates, repeated passages, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as Parquet and
read again as the next one's docs. All stages but the last keep the columns of documents, whatever their names. The table
of a stage goes when the next one's is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tastevin.llm import language, mixing, near_dup, spm, suffix_dedup
from tastevin.llm.common import removed, shared_dir
from tastevin.llm.sampling import held_out

#: A document whose best language has less than this share of the belief is rejected, as is one without a letter.
LEAST_BELIEF = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (null or without a letter) or in none of the learned ones with any certainty."""
    return language.accepted(docs, docs.where(~held_out(4, 2)), LEAST_BELIEF)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dup.one_of_each(docs)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier document or place has; a document that loses everything stays, with an empty text."""
    return suffix_dedup.stripped(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it."""
    return mixing.applied(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars with the token ids of the text."""
    return spm.encoded(docs, spm.model_path(), "doc_id", "lang", "source", "n_chars")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_bytes),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_tokens),
]

#: Kernel language ID and signatures of hashed darts are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, last = f"{shared_dir(spark)}/tastevin/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        if last:
            removed(last, spark=spark)
        last = f"{top}/{name}"
        docs = spark.read.parquet(last)
    return docs
