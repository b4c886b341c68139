"""A kept full-text index: posting tables in buckets by term, with delta generations, tombstones and compaction.

Three tables lie in the index's folder, each by generation (g) and bucket of its key column: `words` (a folded word and a row's
key), `runs` (two or three neighbouring words joined, five letters or more) and `grams` (two and three letters of a word,
and the word, once for all rows). A merge adds a generation with the postings of new and changed rows and, in `gone`, the
keys that changed or went: a posting counts if no later generation has its key there. Compaction writes what counts as one
generation. A generation counts once the file that lists the live ones is there; its name is claimed by one writer alone,
readers never see half of it, and a merge that lost an executor or its driver leaves folders that nothing lists.

A search opens the buckets of its words alone. A batch of queries is a table; it meets the index in equi-joins: words that
contain a token are found by the token's rarest letters, misspelt and divided ones by the token's spellings (it, and from five
letters on each swap of neighbours) among words and runs. The rarest token of each query gives its candidates and
the others are looked up among these, so a frequent word costs no list of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared

def grams(word: Column) -> Column:
    """Distinct runs of two and three characters."""
    of = lambda k: F.when(F.length(word) >= k, F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substring(word, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def spellings(token: Column) -> Column:
    """The token and, from text.LOOSE letters on, the token with each pair of neighbours swapped."""
    n = F.length(token)
    swap = lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.lit(1)), F.substring(token, i, F.lit(1)), F.substring(token, i + 2, n))
    return F.array_distinct(F.concat(F.array(token), F.when(n >= text.LOOSE, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), swap)).otherwise(F.array().cast("array<string>"))))


def loose_forms(tokens: DataFrame) -> DataFrame:
    """(token, term): the spellings of the tokens that may be divided or misspelt."""
    return tokens.where(F.length("token") >= text.LOOSE).select("token", F.explode(spellings(F.col("token"))).alias("term"))


class KeptIndex:
    """The index in a folder. rows have a key column and a text; keys are unique.

    A bucket is written by up to `splits` tasks, so a frequent term is none's alone; both numbers should grow with the rows. Without `runs`
    the index is a third as large and no batch finds divided words in it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, splits: int = 8, runs: bool = True):
        self.spark, self.path, self.buckets, self.splits, self.runs = spark, path.rstrip("/"), buckets, splits, runs

    # what is there

    def _versions(self) -> list[tuple[int, list[int]]]:
        """(version, live generations) by their files' names, v_<version>_<generation>_..."""
        found = [n.split("_")[1:] for n in shared.names(self.spark, f"{self.path}/_live") if n.startswith("v_")]
        return sorted((int(v), [int(x) for x in g]) for v, *g in found)

    @property
    def live(self) -> list[int]:
        versions = self._versions()
        return versions[-1][1] if versions else []

    def _table(self, name: str, live: list[int] | None = None) -> DataFrame | None:
        folders = [f"{self.path}/{name}/g={g}" for g in (self.live if live is None else live)]
        paths = [p for p in folders if any(n.startswith(("bucket=", "part-")) for n in shared.names(self.spark, p))]  # a generation without rows has none
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def _counting(self, postings: DataFrame) -> DataFrame:
        """Without the postings of rows that changed or went in a later generation."""
        gone = self._table("gone")
        if gone is None:
            return postings
        later = gone.select(F.col("key").alias("gone_key"), F.col("g").alias("gone_g"))
        return postings.join(later, (F.col("key") == F.col("gone_key")) & (F.col("gone_g") > F.col("g")), "left_anti")

    # writing

    def _bucket(self, term: str) -> Column:
        return (F.crc32(F.col(term).cast("binary")) % self.buckets).cast("int")

    def _write(self, df: DataFrame, name: str, g: int, term: str) -> None:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(self.splits))
        df.withColumn("bucket", self._bucket(term)).repartition("bucket", salt).sortWithinPartitions("bucket", term).write.partitionBy("bucket").parquet(f"{self.path}/{name}/g={g}")

    def _postings(self, rows: DataFrame, key: str, body: str, g: int, asked: DataFrame | None = None) -> None:
        split = shared.stored(rows.select(F.col(key).alias("key"), text.words_of(text.fold(body)).alias("w")), "index-words")
        self._write(split.select("key", F.explode(F.array_distinct("w")).alias("term")), "words", g, "term")
        if self.runs:
            runs = split.select("key", F.explode(text.joined_runs(F.col("w"))).alias("term"))
            self._write(runs if asked is None else runs.join(asked, "term", "left_semi"), "runs", g, "term")
        shared.removed(self.spark, split.stored_at)
        self._grams(self._table("words", [g]), g)

    def _grams(self, words: DataFrame | None, g: int) -> None:
        if words is not None:
            self._write(words.select("term").distinct().select("term", F.explode(grams(F.col("term"))).alias("gram")), "grams", g, "gram")

    def _next(self) -> int:
        """A generation's number that no folder has, left by whatever writer."""
        taken = [int(n[2:]) for t in ("words", "gone") for n in shared.names(self.spark, f"{self.path}/{t}") if n.startswith("g=")]
        return max([*taken, -1]) + 1

    def _commit(self, seen: list[tuple[int, list[int]]], live: list[int]) -> None:
        version = seen[-1][0] + 1 if seen else 0
        claim = f"{self.path}/_claims/{version}"
        if not shared.claimed(self.spark, claim):
            raise RuntimeError(f"version {version} of {self.path} is another writer's: merge again")
        shared.claimed(self.spark, f"{self.path}/_live/v_{version:09d}_{'_'.join(map(str, live))}")

    def build(self, rows: DataFrame, key: str, body: str, tokens: DataFrame | None = None) -> KeptIndex:
        """The first generation. With tokens (token, of all batches to come) its runs are those alone that spell one, which no other
        token finds; words are all there."""
        if tokens is None:
            return self.merge(rows, key, body)
        asked = shared.stored(loose_forms(tokens.select("token").distinct()).select("term").distinct(), "index-forms")
        self.merge(rows, key, body, asked=asked)
        shared.removed(self.spark, asked.stored_at)
        return self

    def merge(self, changed: DataFrame, key: str, body: str, deleted: DataFrame | None = None, asked: DataFrame | None = None) -> KeptIndex:
        """Inserts the rows of new keys, replaces those of known ones, takes out deleted ones (a frame with the key). asked: the runs (term)
        that are kept, where not all are."""
        seen, g = self._versions(), self._next()
        live = seen[-1][1] if seen else []
        if live:
            gone = changed.select(F.col(key).alias("key"))
            gone = gone if deleted is None else gone.unionByName(deleted.select(F.col(key).alias("key")))
            gone.distinct().write.parquet(f"{self.path}/gone/g={g}")
        self._postings(changed, key, body, g, asked)
        self._commit(seen, [*live, g])
        return self

    def compact(self) -> KeptIndex:
        """One generation of all that counts. The old folders stay for searches that read them; `vacuum` takes them away."""
        seen, g = self._versions(), self._next()
        for name in ("words", "runs"):
            found = self._table(name)
            if found is not None:
                self._write(self._counting(found).select("key", "term"), name, g, "term")
        self._grams(self._table("words", [g]), g)
        self._commit(seen, [g])
        return self

    def vacuum(self) -> None:
        """Folders of generations that the last version doesn't list go."""
        live = set(self.live)
        for name in ("words", "runs", "grams", "gone"):
            old = [n for n in shared.names(self.spark, f"{self.path}/{name}") if n.startswith("g=") and int(n[2:]) not in live]
            shared.removed(self.spark, *(f"{self.path}/{name}/{n}" for n in old))

    # reading

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "key long")

    def search(self, tokens: Iterable[str], every: bool = True) -> DataFrame:
        """Keys of the rows that have every token (or any) as a whole word. The buckets of the tokens are all that is read."""
        tokens = sorted(set(tokens))
        words = self._table("words")
        if words is None or not tokens:
            return self._empty()
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in tokens})
        hits = self._counting(words.where(F.col("bucket").isin(buckets) & F.col("term").isin(tokens)))
        if not every:
            return hits.select("key").distinct()
        return hits.groupBy("key").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(tokens)).select("key")

    def matched_terms(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(token, term) of words that contain a token or are a spelling of it, and of runs that are one. tokens: token, distinct."""
        forms = loose_forms(tokens)
        all_grams = self._table("grams").select("gram", "term").distinct()
        # of its longest letters the rarest; a token with letters that no word has is in none
        longest = F.when(F.length("token") >= 3, 3).otherwise(2)
        asked = tokens.select("token", F.explode(grams(F.col("token"))).alias("gram")).where(F.length("gram") == longest)
        counted = asked.join(all_grams.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
        rarest = counted.groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("token", "g.gram")
        inside = rarest.join(all_grams, "gram").where(F.col("term").contains(F.col("token"))).select("token", "term")
        return inside.unionByName(forms).distinct(), forms

    def batch(self, queries: DataFrame, query: str, token: str) -> DataFrame:
        """(query, key) of the rows that match every token of a query. queries: a row for each query's folded token, of two letters or
        more; a token matches as in text.matches_all."""
        words, runs = self._table("words"), self._table("runs")
        if words is None or self._table("grams") is None:
            return queries.select(query).limit(0).crossJoin(self._empty())
        asked = queries.select(F.col(query).alias("query"), F.col(token).alias("token")).distinct()
        terms, forms = (shared.stored(x, "batch-terms") for x in self.matched_terms(asked.select("token").distinct()))
        words = self._counting(words).select("key", "term")
        runs = None if runs is None else self._counting(runs).select("key", "term")
        per_term = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        in_words = terms.join(per_term, "term").select("token", "n")
        in_runs = None if runs is None else forms.join(runs, "term").groupBy("token").agg(F.count("*").alias("n"))
        sizes = (in_words if in_runs is None else in_words.unionByName(in_runs)).groupBy("token").agg(F.sum("n").alias("n"))
        ranked = asked.join(sizes, "token", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"), F.count("*").alias("tokens"))
        lead = shared.stored(ranked.select("query", F.col("t.token").alias("token"), "tokens"), "batch-lead")

        def found(of: DataFrame, pairs: DataFrame) -> DataFrame:
            return pairs.join(of, "term").select("token", "key")

        leading = lead.select("token").distinct()
        first = found(words, terms.join(leading, "token", "left_semi"))
        first = first if runs is None else first.unionByName(found(runs, forms.join(leading, "token", "left_semi")))
        candidates = shared.stored(lead.join(first.distinct(), "token").select("query", "key", "tokens"), "batch-candidates")
        keys = candidates.select("key").distinct()
        has = found(words.join(keys, "key", "left_semi"), terms)
        has = has if runs is None else has.unionByName(found(runs.join(keys, "key", "left_semi"), forms))
        full = candidates.join(asked, "query").join(has.distinct(), ["key", "token"]).groupBy("query", "key").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))
        return full.where("n = tokens").select(F.col("query").alias(query), "key")
