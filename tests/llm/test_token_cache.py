"""What a kept cache of token counts saves, and that it changes no count."""

import pytest

from tastevin.llm import token_counts


@pytest.mark.parametrize("few", [100_000, 0], ids=["picked out", "shuffled"])
def test_warm_cache(spark, tmp_path, monkeypatch, few):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_counts, "FEW", few)
    path, cache = token_counts.tokenizer_path(), str(tmp_path / "cache")
    first = spark.createDataFrame([(k, f"some words {k % 20}") for k in range(60)] + [(100, None), (101, "")], "doc_id long, text string")
    more = first.unionByName(spark.createDataFrame([(200, "other words"), (201, " other  words\n"), (202, "some words 3")], "doc_id long, text string"))
    counts = lambda df: sorted(tuple(r) for r in token_counts.count_tokens(df, path, cache, "doc_id").collect())
    cold = counts(first)
    assert spark.read.parquet(cache).count() == 21
    assert counts(first) == cold and spark.read.parquet(cache).count() == 21
    warm = counts(more)
    assert warm[: len(cold)] == cold and spark.read.parquet(cache).count() == 22
    fresh = token_counts.count_tokens(more, path, str(tmp_path / "other"), "doc_id")
    assert sorted(tuple(r) for r in fresh.collect()) == warm
