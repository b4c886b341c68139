"""Toxicity by maximum-scoring segments.

Words are runs of letters (ASCII lower case). Terms are whole words and their first STEMS bytes, for languages that inflect.
From the labelled rows that may be learned from, every term gets a log-odds ratio between toxic and other texts with an
informative Dirichlet prior (the prior's mean is the term's share of all terms), and its z-score; a text counts a term once.
Terms with a z of the threshold or more and a positive ratio form the lexicon; a word scores its best term, all others
-DRIFT. In every text the linear-time scan of Ruzzo and Tompa finds all maximal-scoring segments. As only lexicon words
score above zero, the scan runs over their places, the cost of a gap being its length times DRIFT.

Chance segments follow an extreme-value law: the chance of one of score S in n words is about 1 - exp(-K n exp(-lambda S)).
lambda solves sum p exp(lambda s) = 1 on the words of the non-toxic texts (prior included), K is the reciprocal mean of
n exp(-lambda S) there. Segments whose expected number E = K n exp(-lambda S) is at most SIGNIFICANT are passages; a text's
evidence x is the sum of -ln E over its passages (0 without one), and a logistic fit of labels on x gives the score.

The threshold and the logistic fit come from evidence out of fold: the sample is dealt to FOLDS folds, each is scored
with the lexicon and the calibration of the others, and the threshold of THRESHOLDS with the least logarithmic loss is taken
(the largest of equal ones). So few labels give a lexicon as large as they support.

The fit takes at most EACH texts of each label (documented bound; counts stay on the executors, and the driver gets the terms
that some threshold admits). Every text is scored whole.

Edge cases: null and empty texts have x = 0 and the score of a text without passages; null or repeated doc_id are rows like
any other; without labels of both kinds every score is 0; an empty table gives an empty result; a carried column named
score or passages gives way to the output.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, Scratch, table, text_or_empty
from .sampling import held_out, labelled_texts
from .textbatch import LOWER, chunks, letter_runs, mix, prefix_sums, span_hashes

EACH = 8000
#: Weight of the prior as a share of the smaller class.
PRIOR = 1.0
STEMS = (4, 5, 6)
THRESHOLDS = (2.0, 2.5, 3.0, 3.5, 4.0, 5.0)
FOLDS = 4
DRIFT = 0.25
SIGNIFICANT = 0.3


def terms(data: np.ndarray, at: np.ndarray):
    """Spans and texts of the words; for each kind of term the numbers of the words that have one, and its hashes."""
    start, end, owner = letter_runs(data, at)
    sums = prefix_sums(LOWER[data])
    out = [(np.arange(len(start)), span_hashes(sums, start, end))]
    for k in STEMS:
        long = np.flatnonzero(end - start > k)
        out.append((long, mix(span_hashes(sums, start[long], start[long] + k) + np.uint64(k))))
    return start, end, owner, out


def maximal_segments(place: np.ndarray, gain: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a text as (first place, last place, score): place and gain of the words above zero,
    each other word costs drift.

    A candidate keeps the sums before (low) and after (high) it and a link to the last candidate before it of a lower low.
    A search goes along the links; what it passes no later search meets again, so the scan is linear in the hits."""
    first, last, low, high, link = [], [], [], [], []
    total, before = 0.0, -1
    for p, g in zip(place.tolist(), gain.tolist(), strict=True):
        total -= drift * (p - before - 1)
        start, down, total, before = p, total, total + g, p
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= down:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            start, down, k = first[j], low[j], link[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j = k
        first.append(start)
        last.append(p)
        low.append(down)
        high.append(total)
        link.append(j)
    return [(a, b, h - s) for a, b, s, h in zip(first, last, low, high, strict=True)]


def _counted(batches):
    """Terms of a chunk with the numbers of toxic and other texts of each fold that have them."""
    for batch, data, at in chunks(batches):
        _, _, owner, kinds = terms(data, at)
        h, of = np.concatenate([x for _, x in kinds]), np.concatenate([owner[k] for k, _ in kinds])
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[once], of[once]
        cell = batch.column("fold").to_numpy(zero_copy_only=False)[of] * 2 + batch.column("label").to_numpy(zero_copy_only=False)[of]
        words, code = np.unique(h, return_inverse=True)
        n = np.zeros((len(words), 2 * FOLDS), np.int64)
        np.add.at(n, (code, cell), 1)
        yield pa.record_batch({"word": words.view(np.int64), **{f"n{k}": n[:, k] for k in range(2 * FOLDS)}})


class Lexicon:
    """Sorted word hashes and their scores."""

    def __init__(self, words: np.ndarray, gains: np.ndarray):
        order = np.argsort(words)
        self.words, self.gains = words[order], gains[order]

    def scored(self, kinds, n: int) -> np.ndarray:
        """The gain of each of n words, 0 for those without a term."""
        gain = np.zeros(n)
        for of, h in kinds if len(self.words) else []:
            k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = np.flatnonzero(self.words[k] == h)
            gain[of[hit]] = np.maximum(gain[of[hit]], self.gains[k[hit]])
        return gain

    def segments(self, owner, kinds, first) -> list[list[tuple[int, int, float]]]:
        """For each text its segments (first word, last word, score); first: number of each text's first word, and the end."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(first) - 1)]
        gain = self.scored(kinds, len(owner))
        hits = np.flatnonzero(gain)
        for group in np.split(hits, np.flatnonzero(np.diff(owner[hits])) + 1) if len(hits) else []:
            d = owner[group[0]]
            out[d] = maximal_segments(group - first[d], gain[group])
        return out


def words_of(data: np.ndarray, at: np.ndarray):
    """Number of words of each text, number of its first one (and the end), and what `terms` gives."""
    start, end, owner, kinds = terms(data, at)
    n = np.bincount(owner, minlength=len(at) - 1)
    return n, np.concatenate([[0], np.cumsum(n)]), start, end, owner, kinds


def log_odds(t, c, nt: float, nc: float, log=np.log, sqrt=np.sqrt):
    """Gain and z-score of terms that t toxic and c other texts have, of nt and nc term counts; t, c: arrays or Columns."""
    weight = PRIOR * min(nt, nc)
    prior = (t + c) * (weight / max(nt + nc, 1.0))
    gain = log((t + prior) / (nt + weight - t - prior)) - log((c + prior) / (nc + weight - c - prior))
    return gain, gain / sqrt(1 / (t + prior) + 1 / (c + prior))


def lexicon_of(words: np.ndarray, t: np.ndarray, c: np.ndarray, nt: float, nc: float, z: float) -> tuple[Lexicon, float]:
    """The terms of the threshold z, and lambda of the extreme-value law for the other texts."""
    some = t + c > 0
    words, t, c = words[some], t[some].astype(float), c[some].astype(float)
    if not len(words) or not nt or not nc:
        return Lexicon(words[:0], np.zeros(0)), 1.0
    gain, score = log_odds(t, c, nt, nc)
    good = (score >= z) & (gain > DRIFT)
    weight = PRIOR * min(nt, nc)
    p = ((c + weight * (t + c) / (nt + nc)) / (nc + weight))[good]
    s = gain[good]
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.expm1(np.minimum(mid * s, 700))).sum() + (1 - p.sum()) * math.expm1(-DRIFT * mid) < 0 else (low, mid)
    return Lexicon(words[good], s), low


def rate_of_chance(lam: float, n: np.ndarray, top: np.ndarray) -> float:
    """K from the words and the best segments of non-toxic texts."""
    return float(1.0 / np.mean(np.maximum(n, 1) * np.exp(-lam * top))) if len(n) else 1.0


def learn(labelled: DataFrame) -> tuple[Lexicon, dict]:
    """labelled: text, label. The lexicon and the figures of the calibration."""
    none = {"lambda": 1.0, "k": 1.0, "a": 0.0, "b": 0.0, "empty": True}
    cells = [f"n{k}" for k in range(2 * FOLDS)]
    with Scratch() as scratch:
        sample = scratch.stored(labelled.select("text", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")
        counts = scratch.stored(sample.mapInArrow(_counted, ", ".join(["word long", *(f"{c} long" for c in cells)])).groupBy("word").agg(*(F.sum(c).alias(c) for c in cells)), "toxic-counts")
        total = np.array([x or 0 for x in counts.agg(*(F.sum(c) for c in cells)).first()], float)
        seen = {(r["fold"], r["label"]) for r in sample.select("fold", "label").distinct().collect()}
        nt, nc = total[1::2].sum(), total[::2].sum()
        if {y for _, y in seen} != {0, 1} or not nt or not nc:
            return Lexicon(np.zeros(0, np.uint64), np.zeros(0)), none
        # the counts that a lexicon is made of: all folds (-1), or all but one
        within = {f: [k for k in range(FOLDS) if k != f] for f in range(-1, FOLDS)}
        admitted = F.lit(False)
        for folds in within.values():
            t, c = (sum((F.col(f"n{2 * k + y}") for k in folds), F.lit(0)) for y in (1, 0))
            sums = [sum(total[2 * k + y] for k in folds) for y in (1, 0)]
            if all(sums):
                gain, z = log_odds(t, c, *sums, log=F.log, sqrt=F.sqrt)
                admitted = admitted | F.coalesce(F.when(t + c > 0, (z >= THRESHOLDS[0] - 1e-6) & (gain > DRIFT)), F.lit(False))
        found = counts.where(admitted).toArrow()
        words = found.column("word").to_numpy().astype(np.int64).view(np.uint64)
        n = np.array([found.column(c).to_numpy() for c in cells]).reshape(2 * FOLDS, -1)

        def made(fold: int, z: float) -> tuple[Lexicon, float]:
            of = within[fold]
            return lexicon_of(words, n[[2 * k + 1 for k in of]].sum(0), n[[2 * k for k in of]].sum(0), sum(total[2 * k + 1] for k in of), sum(total[2 * k] for k in of), z)

        tried = [(f, z, *made(f, z)) for f in range(FOLDS) for z in THRESHOLDS]

        def segmented(lexicons):
            """For each text the segments' scores by each lexicon that isn't of its fold's own making."""

            def run(batches):
                for batch, data, at in chunks(batches):
                    size, first, _, _, owner, kinds = words_of(data, at)
                    fold = batch.column("fold").to_numpy()
                    for k, (f, lexicon) in enumerate(lexicons):
                        rows = np.flatnonzero((fold == f) | (f < 0))
                        found = lexicon.segments(owner, kinds, first)
                        yield pa.record_batch({"k": np.full(len(rows), k, np.int32), "fold": fold[rows], "label": batch.column("label").to_numpy()[rows], "n": size[rows].astype(np.int64), "sums": pa.array([[x for _, _, x in found[r]] for r in rows], pa.list_(pa.float64()))})

            return run

        schema = "k int, fold int, label int, n long, sums array<double>"
        out = sample.mapInArrow(segmented([(f, x) for f, _, x, _ in tried]), schema).toArrow().to_pydict()
        rows = [[] for _ in tried]
        for k, y, m, v in zip(out["k"], out["label"], out["n"], out["sums"], strict=True):
            rows[k].append((v, m, y))
        best = None
        for z in reversed(THRESHOLDS):
            x, y = [], []
            for k, (_, other, _, lam) in enumerate(tried):
                if other == z:
                    own = rows[k]
                    chance = rate_of_chance(lam, np.array([m for _, m, label in own if not label]), np.array([max(v, default=0.0) for v, _, label in own if not label]))
                    x += [evidence(v, m, {"lambda": lam, "k": chance}) for v, m, _ in own]
                    y += [label for _, _, label in own]
            order = np.lexsort((y, x))
            x, y = np.array(x)[order], np.array(y, float)[order]
            a, b = _logistic(x, y)
            p = 1 / (1 + np.exp(-(a * np.minimum(x, 20.0) / 20.0 + b)))
            loss = -np.log(np.where(y == 1, p, 1 - p)).mean()
            if best is None or loss < best[0] - 1e-12:
                best = (loss, z, a, b)
        lexicon, lam = made(-1, best[1])
        out = sample.where("label = 0").mapInArrow(segmented([(-1, lexicon)]), schema).select("n", F.coalesce(F.array_max("sums"), F.lit(0.0)).alias("top")).orderBy("n", "top").toArrow()
    model = {"lambda": lam, "k": rate_of_chance(lam, out.column("n").to_numpy(), out.column("top").to_numpy()), "a": best[2], "b": best[3], "threshold": best[1], "empty": False}
    return lexicon, model


def evidence(scores: list[float], n: float, model: dict) -> float:
    """Sum of -ln E over the significant segments."""
    logs = [model["lambda"] * s - math.log(model["k"] * max(n, 1)) for s in scores]
    return sum(v for v in logs if v >= -math.log(SIGNIFICANT))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton steps on capped evidence."""
    z = np.column_stack([np.minimum(x, 20.0) / 20.0, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
    return float(w[0]), float(w[1])


def probability(x: float, model: dict) -> float:
    return 0.0 if model["empty"] else 1 / (1 + math.exp(-(model["a"] * min(x, 20.0) / 20.0 + model["b"])))


def score(docs: DataFrame, labelled: DataFrame, *carry: str) -> DataFrame:
    """carry, score, passages (first and last byte, score, expected number by chance) for every row of docs."""
    lexicon, model = learn(labelled)
    carried = Carried(docs, carry, ["score", "passages"])

    def run(batches):
        for batch, data, at in chunks(batches):
            n, first, start, end, owner, kinds = words_of(data, at)
            scores, passages = [], []
            for d, found in enumerate(lexicon.segments(owner, kinds, first)):
                scores.append(probability(evidence([s for _, _, s in found], n[d], model), model))
                rated = [(int(start[first[d] + a] - at[d]), int(end[first[d] + b] - at[d]), s, model["k"] * float(n[d]) * math.exp(-model["lambda"] * s)) for a, b, s in found]
                passages.append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in rated if e <= SIGNIFICANT])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.record_batch({**carried.of(batch), "score": pa.array(scores, pa.float64()), "passages": pa.array(passages, kind)})

    schema = ", ".join([*carried.schema, "score double", "passages array<struct<start:long,end:long,score:double,expected:double>>"])
    return docs.select(*carried.columns, text_or_empty().alias("text")).mapInArrow(run, schema).select(*carried.back, "score", "passages")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = labelled_texts(docs, table(spark, sf_dir, "labels"), "toxic", EACH)
    scored = score(docs.withColumn("held_out", held_out(3, 1)), labelled, "doc_id", "held_out")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")
