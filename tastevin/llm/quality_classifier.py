"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Every text gives STATISTICS numbers. Standardised, they pass through RANDOM cosine features whose inner products approximate
a Gaussian kernel. The labelled sample is dealt to PARTS parts by the texts' digests; each sums its normal equations, in order
of digest (their number and size are fixed, and reruns add in the same order), and the sums are added and solved. Ridge
scores for the calibration come from the equations without the row's own part, so that no row is calibrated by a fit
that saw it; pool-adjacent-violators turns them into probabilities.

The fit takes at most EACH texts of each label (documented bound); every text is scored whole.

Edge cases: null counts as empty; an empty text has zero statistics and is scored like any other; null or repeated doc_id are
rows like any other; without labels of both kinds every score is the labelled share of ones (0.5 without labels); an empty
table gives an empty result; a carried column named score gives way to the output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, Scratch, table, text_or_empty
from .sampling import held_out, labelled_texts
from .textbatch import _LETTER, chunks, grouped, mix, per_text, prefix_sums, span_hashes, spans, words

EACH = 6000
#: Parts whose normal equations are summed, each RANDOM x RANDOM doubles.
PARTS = 8
RANDOM = 192
WIDTH = 2.5
RIDGE = 1e-3
SEED = 11
_CLASSES = {
    "symbol": b"#*$%&|<>", "mark": b"!?", "digit": b"0123456789", "point": b".,;:'\"()-", "upper": bytes(range(65, 91)), "space": b" \t\n\r\x0b\x0c", "high": bytes(range(128, 256)), "other": b"@=_+/\\[]{}~^`",
}
STATISTICS = 19


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    n = len(at) - 1
    length = np.diff(at).astype(float)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]).astype(float)
    share = lambda a, b: a / np.maximum(b, 1)
    table_of = np.zeros((len(_CLASSES), 256), bool)
    for k, chars in enumerate(_CLASSES.values()):
        table_of[k, list(chars)] = True
    ratios = [share(sums(t[data]), length) for t in table_of]
    start, end, owner = words(data, at)
    count = per_text(owner, n).astype(float)
    prefix = prefix_sums(data)
    h = span_hashes(prefix, start, end)
    lettered = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    bare = lettered[end] == lettered[start]
    mean = share(per_text(owner, n, (end - start).astype(float)), count)
    spread = np.sqrt(np.maximum(share(per_text(owner, n, (end - start).astype(float) ** 2), count) - mean**2, 0))

    def repeats(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Items that their text had before, by hash."""
        if not len(hashes):
            return np.zeros(n)
        key = mix(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        ordered = key[order]
        same = np.zeros(len(key), bool)
        twin = ordered[1:] == ordered[:-1]
        same[order[1:][twin]] = True
        return per_text(of, n, same.astype(float))

    next_same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) if len(h) else np.zeros(0, bool)
    triple = owner[2:] == owner[:-2] if len(h) > 2 else np.zeros(0, bool)
    three = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))[triple] if len(h) > 2 else h[:0]
    lines, line_end, line_owner = spans(data != 10, at)
    n_lines = per_text(line_owner, n).astype(float)
    return np.column_stack([
        np.log1p(count), np.log1p(length), *ratios, mean, spread, share(per_text(owner, n, bare.astype(float)), count),
        share(repeats(h, owner), count), share(per_text(owner[1:], n, next_same.astype(float)), count) if len(h) else np.zeros(n),
        share(repeats(three, owner[:-2][triple] if len(h) > 2 else owner[:0]), count),
        share(repeats(span_hashes(prefix, lines, line_end), line_owner), n_lines), np.log1p(share(length, n_lines)), np.log1p(n_lines),
    ])


class Features:
    """Random cosine features of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(len(mean), RANDOM - 1)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, RANDOM - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2.0 / (RANDOM - 1)), np.ones(len(x))])


def _xy(rows) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return x, rows.column("label").to_numpy().astype(float)


def _summed(rows: DataFrame, of, width: int) -> np.ndarray:
    """PARTS x width: sums over each part of the flat arrays that of(x, y) gives for its statistics and labels."""

    def part(batches):
        for table in grouped(batches, ["part"]):
            yield pa.record_batch({"part": table.column("part")[:1].combine_chunks(), "sums": pa.array([of(*_xy(table)).tobytes()], pa.binary())})

    out = np.zeros((PARTS, width))
    for r in rows.repartition(PARTS, "part").sortWithinPartitions("part", "digest", "label").mapInArrow(part, "part int, sums binary").collect():
        out[r["part"]] = np.frombuffer(r["sums"])
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on score (pool adjacent violators), at the pools' mean scores."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, s2 = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][2] += s2
    a = np.array(pools)
    return a[:, 2] / a[:, 1], a[:, 0] / a[:, 1]


def learn(labelled: DataFrame):
    """labelled: text, label. Returns a function of statistics to probabilities."""

    def measure(batches):
        for batch, data, at in chunks(batches):
            x = statistics(data, at)
            yield pa.record_batch({"label": batch.column("label").cast(pa.int32()), "digest": batch.column("digest"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))})

    with Scratch() as scratch:
        rows = labelled.select("text", "label", F.xxhash64("text").alias("digest")).mapInArrow(measure, "label int, digest long, x array<double>")
        rows = scratch.stored(rows.withColumn("part", F.pmod("digest", F.lit(PARTS)).cast("int")), "quality-sample")
        d = STATISTICS
        moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]), 2 + 2 * d).sum(0)
        n, ones = moments[:2]
        if not 0 < ones < n:
            share = ones / n if n else 0.5
            return lambda x: np.full(len(x), share)
        mean = moments[2 : 2 + d] / n
        features = Features(mean, np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 0)))
        rate = np.array([n / (2 * (n - ones)), n / (2 * ones)])

        def normal(x, y):
            z, w = features(x), rate[y.astype(int)]
            return np.concatenate([((z * w[:, None]).T @ z).ravel(), (z * w[:, None]).T @ (2 * y - 1)])

        def solved(sums):
            gram, right = sums[: RANDOM * RANDOM].reshape(RANDOM, RANDOM), sums[RANDOM * RANDOM :]
            return np.linalg.solve(gram / n + RIDGE / RANDOM * np.eye(RANDOM), right / n)

        sums = _summed(rows, normal, RANDOM * RANDOM + RANDOM)
        weights = solved(sums.sum(0))
        without = [solved(np.delete(sums, k, 0).sum(0)) for k in range(PARTS)]

        def ridge_scores(batches):
            for batch in batches:
                if batch.num_rows:
                    x, _ = _xy(pa.Table.from_batches([batch]))
                    z, part = features(x), batch.column("part").to_numpy()
                    yield pa.record_batch({"label": batch.column("label"), "s": np.column_stack([z @ w for w in without])[np.arange(len(z)), part]})

        fitted = rows.mapInArrow(ridge_scores, "label int, s double").orderBy("s", "label").toArrow()  # as many as the sample's bound
    knots, levels = isotonic(fitted.column("s").to_numpy(), fitted.column("label").to_numpy().astype(float))
    return lambda x: np.interp(features(x) @ weights, knots, levels)


def score(docs: DataFrame, labelled: DataFrame, *carry: str) -> DataFrame:
    """carry and score for every row of docs."""
    model = learn(labelled)
    carried = Carried(docs, carry, ["score"])

    def run(batches):
        for batch, data, at in chunks(batches):
            yield pa.record_batch({**carried.of(batch), "score": pa.array(model(statistics(data, at)), pa.float64())})

    return docs.select(*carried.columns, text_or_empty().alias("text")).mapInArrow(run, ", ".join([*carried.schema, "score double"])).select(*carried.back, "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", EACH)
    scored = score(docs.withColumn("held_out", held_out(3, 1)), labelled, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
