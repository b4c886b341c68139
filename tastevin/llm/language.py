"""Language identification by string kernels.

A text is the set of its byte n-grams (n = 1, 2, 3; ASCII lower case, other ASCII than letters taken as a blank), hashed to
DIMS places. The blended-spectrum presence kernel is the sum over n of |A n B| / sqrt(|A| |B|). LANDMARKS texts span a
Nystroem approximation, on which kernel ridge regression is fitted one language against the rest. As the kernel is linear in
the scaled presence vector, landmarks and coefficients fold into one matrix; scoring is a product of batches with it.

The fit takes at most EACH distinct texts of every language, ALL in all, of the most frequent languages (documented bounds);
every text is scored whole. A tie goes to the language first in order of code points.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows with null lang are scored, not learned;
null or repeated doc_id are rows like any other; without a labelled row every text is `und`; an empty table gives an empty
result. `predict` carries the columns it is told to (lang_pred and score give way to its own), `accepted` all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, table, text_or_empty
from .sampling import held_out, texts
from .textbatch import _LETTER, LOWER, chunks

EACH = 400
ALL = 3200
LANDMARKS = 160
RIDGE = 1e-3
SHARPNESS = 6.0
PARTS = (256, 4096, 8192)
DIMS = sum(PARTS)
UNKNOWN = "und"
#: Texts that are worked on at once: each takes five bytes a dimension.
ROWS = 256

_FOLD = np.where(_LETTER, LOWER, np.uint8(32)).astype(np.uint8)


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    n = len(at) - 1
    out = np.zeros(n * DIMS, np.uint8)
    b = _FOLD[data].astype(np.uint32)
    base = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(at))
    out[base + b] = 1
    if len(b) > 1:
        two = (b[:-1] << np.uint32(8)) | b[1:]
        same = base[:-1] == base[1:]
        place = (two * np.uint32(2654435761)) >> np.uint32(20)
        out[(base[:-1] + PARTS[0] + place)[same]] = 1
        if len(b) > 2:
            three = ((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(2246822519)
            same = base[:-2] == base[2:]
            out[(base[:-2] + PARTS[0] + PARTS[1] + (three >> np.uint32(19)))[same]] = 1
    return out.reshape(n, DIMS)


def scaled(x: np.ndarray) -> np.ndarray:
    """Presence vectors whose inner products are the kernel."""
    x = x.astype(np.float32)
    low = 0
    for width in PARTS:
        part = x[:, low : low + width]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1))
        low += width
    return x


def fit(bits: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix (DIMS + 1) x languages, the last row the offset."""
    names = sorted(set(langs))
    y = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    x = scaled(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)[:, :DIMS])
    each = max(1, LANDMARKS // len(names))
    seen: dict[str, int] = {}
    marks = [k for k, a in enumerate(langs) if (seen.__setitem__(a, seen.get(a, 0) + 1), seen[a] <= each)[1]]
    z = x[marks]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ z.T) @ root
    weight = 1.0 / np.array([langs.count(a) for a in langs])
    mean, offset = np.average(phi, 0, weight), np.average(y, 0, weight)
    c = phi - mean
    gram = (c * weight[:, None]).T @ c / weight.sum()
    w = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), (c * weight[:, None]).T @ (y - offset) / weight.sum())
    return names, np.vstack([z.T @ (root @ w), offset - mean @ w]).astype(np.float32)


def _sampled(batches):
    for batch, data, at in chunks(batches, rows=ROWS):
        packed = np.packbits(presence(data, at), axis=1)
        yield pa.record_batch({"lang": batch.column("lang"), "digest": batch.column("digest"), "bits": pa.array([r.tobytes() for r in packed], pa.binary())})


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray | None]:
    """labelled: text, lang. Languages and the matrix of `fit`, from a sample in an order that is always the same."""
    chosen = texts(labelled.where("lang is not null and text is not null"), "lang", EACH, total=ALL)
    rows = chosen.mapInArrow(_sampled, "lang string, digest long, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["digest"], bytes(r["bits"])))
    return fit([bytes(r["bits"]) for r in rows], [r["lang"] for r in rows]) if rows else ([], None)


def _scored(docs: DataFrame, labelled: DataFrame, carried: Carried) -> DataFrame:
    """The carried columns, lang_pred, score."""
    names, matrix = learn(labelled)

    def score(batches):
        for batch, data, at in chunks(batches, rows=ROWS):
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            pred, best = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if names:
                margin = scaled(presence(data, at)) @ matrix[:-1] + matrix[-1]
                p = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
                pred = np.where(known, np.array(names, object)[margin.argmax(1)], UNKNOWN)
                best = np.where(known, p.max(1) / p.sum(1), 0.0)
            yield pa.record_batch({**carried.of(batch), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(best, pa.float64())})

    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    return docs.select(*carried.columns, text_or_empty().alias("text"), letters).mapInArrow(score, ", ".join([*carried.schema, "lang_pred string", "score double"]))


def predict(docs: DataFrame, labelled: DataFrame, *carry: str) -> DataFrame:
    """carry, lang_pred, score for every row of docs; learned from labelled (text, lang)."""
    carried = Carried(docs, carry, ["lang_pred", "score"])
    return _scored(docs, labelled, carried).select(*carried.back, "lang_pred", "score")


def accepted(docs: DataFrame, labelled: DataFrame, least: float) -> DataFrame:
    """The rows of docs, with docs' columns, whose language is known with a score of `least` or more."""
    carried = Carried(docs, docs.columns)
    return _scored(docs, labelled, carried).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*carried.back)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    return predict(docs, docs.where("not held_out"), "doc_id", "held_out")
