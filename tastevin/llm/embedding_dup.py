"""Near-duplicate vectors through a pivot-permutation index.

Pivots are spread by farthest-first choice out of a sample of at most SAMPLE distinct vectors (the documented bound of the fit;
every vector is indexed). Their number grows as the root of the number of vectors, so lists keep their length. A vector
is described by its nearest pivots in order. An inverted list holds the vectors that have both of two pivots among their first
`width`; so vectors that meet in a list share at least two. Lists get ids and permutations only: shared-pivot counts over
the longer permutations (DEPTH pivots) come from products of indicator rows, and vectors go only to blocks for which they have
candidates, to be verified by cosine in double precision. A pair counts in the first list that both are in, so it counts once.

Lists longer than BLOCK are cut into blocks, and pairs of blocks go to separate tasks: nothing is capped. Only a number of
links for each vector and a spanning set of edges leave a task. Exact copies are one row, with their count.

Edge cases: vectors that are null or empty, of another length than the most common one, zero, or with null or non-finite
components link with nothing; null vec_id or repeated vec_id are rows like any other (a null id has no component of its own: its
component is the least id it links to, else null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, stored, table
from .textbatch import complete

SIMILAR = 0.95
#: Bounds of the number of pivots, of the sample they are chosen from, and of either in bytes.
PIVOTS = (16, 8192)
SAMPLE = 16384
FIT_BYTES = 16 << 20
BLOCK = 1024
#: Small lists are worked on together until there are so many rows.
TOGETHER = 192


def unit(rows: pa.Array) -> np.ndarray:
    """Rows of length 1. The largest component is scaled to about 1 first (by a power of two, exactly), so that no square
    over- or underflows."""
    x = np.array(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)
    if not len(x):
        return x
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n rows."""
    best, chosen = x @ x[0], [0]
    while len(chosen) < min(n, len(x)):
        k = int(best.argmin())
        if best[k] > 0.999:
            break
        chosen.append(k)
        best = np.maximum(best, x @ x[k])
    return x[chosen]


def pivots_for(n: int, dims: int) -> tuple[int, int]:
    """How many pivots for n vectors, and how large the sample is."""
    most = max(FIT_BYTES // (8 * dims), 1)
    return min(max(PIVOTS[0], int(np.sqrt(n))), PIVOTS[1], most), min(SAMPLE, most)


#: Nearest pivots that are counted.
DEPTH = 16


def widths(pivots: int) -> tuple[int, int, int]:
    """Pivots that lists are made of, pivots that are counted, and how many of these a pair must share.

    The more pivots, the fewer of the nearest two near vectors have in common, so the last falls with their logarithm. Measured
    on pairs of cosine 0.9505 planted among 10,256 and 51,282 vectors of 64 dimensions: recall 0.989 and 0.993, while of
    vectors without a near one but a few in a hundred have a candidate."""
    size = np.log2(max(pivots, 2))
    width, depth = min(round(2 + size / 2), pivots), min(DEPTH, pivots)
    return width, depth, min(depth, max(2, round(DEPTH + 0.5 - size)))


def nearest(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest pivots of every row, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :n]


class Lists:
    """Whole (blocks of) lists: candidate pairs by their shared pivots."""

    def __init__(self, rows: pa.Table, width: int, least: int):
        lists, lefts, rights, self.side = (rows.column(c).to_numpy() for c in ("list", "left", "right", "side"))
        n = len(lists)
        new = np.ones(n, bool)
        new[1:] = (lists[1:] != lists[:-1]) | (lefts[1:] != lefts[:-1]) | (rights[1:] != rights[:-1])
        group, same = np.cumsum(new), lefts == rights
        near = np.frombuffer(b"".join(rows.column("near").to_pylist()), np.uint16).reshape(n, -1).astype(np.int64)
        names, code = np.unique(near, return_inverse=True)
        code = code.reshape(near.shape)
        mark = np.zeros((n, len(names)), np.float32)
        np.put_along_axis(mark, code, 1, 1)
        first = np.zeros((n, len(names)), np.float32)
        np.put_along_axis(first, code[:, :width], 1, 1)
        # of the lists of both, the first: no shared pivot up to the list's second one but its two
        upto = first * (names[None, :] <= (lists & 0xFFFF)[:, None])
        left = np.flatnonzero(self.side == 0)
        right = np.flatnonzero(same | (self.side == 1))
        pairs = (mark[left] @ mark[right].T >= least) & (upto[left] @ first[right].T == min(2, width)) & (group[left][:, None] == group[right][None, :])
        pairs &= ~(same[left][:, None] & (right[None, :] <= left[:, None]))
        i, j = np.nonzero(pairs)
        self.i, self.j, self.n = left[i], right[j], n


def _candidates(width: int, least: int):
    def run(batches):
        """The rows that have a candidate."""
        for rows in complete(batches, ["list", "left", "right"], TOGETHER):
            found = Lists(rows, width, least)
            wanted = np.zeros(found.n, bool)
            wanted[found.i] = wanted[found.j] = True
            if wanted.any():
                yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def _linked(width: int, least: int):
    def run(batches):
        """Links of the candidates: how many for each vector, and edges that span them."""
        for rows in complete(batches, ["list", "left", "right"], TOGETHER):
            found = Lists(rows, width, least)
            ids, copies = (rows.column(c).to_numpy() for c in ("id", "copies"))
            x = unit(rows.column("embedding").combine_chunks())
            good = np.zeros(len(found.i), bool)
            for k in range(0, len(good), 1 << 16):
                part = slice(k, k + (1 << 16))
                good[part] = np.einsum("nd,nd->n", x[found.i[part]], x[found.j[part]]) >= SIMILAR
            i, j = found.i[good], found.j[good]
            links = np.bincount(i, copies[j], found.n) + np.bincount(j, copies[i], found.n)
            root = np.arange(found.n)
            while True:  # least place that links reach
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            touched = np.flatnonzero(links)
            if len(touched):
                yield pa.record_batch({"a": ids[root[touched]], "b": ids[touched], "links": links[touched].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce((F.size("embedding") > 0) & fine, F.lit(False)))
    size = rows.where("fine").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rows = rows.withColumn("fine", F.col("fine") & (F.size("embedding") == size["d"]))
    rows = rows.select("vec_id", "embedding", *(F.when(F.col("fine"), F.xxhash64(F.lit(k), "embedding")).alias(f"h{k}") for k in (1, 2)))
    with Scratch() as s:
        # distinct vectors: their copies and the least id of these
        one = s.stored(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id()), "vectors-one")
        n = one.count()
        many, sampled = pivots_for(n, size["d"])
        # the least hashes, of those below a rate that leaves enough: no partition sends more than its part
        rate = (sampled + 6 * sampled**0.5 + 20) / n
        drawn = one.where(F.pmod("h1", F.lit(1 << 30)) / float(1 << 30) < rate).withColumn("at", F.pmod("h1", F.lit(1 << 30))).orderBy("at", "h1", "h2").limit(sampled).select("embedding").toArrow().column("embedding").combine_chunks()
        pivots = spread(unit(drawn), many)
        width, depth, least = widths(len(pivots))

        def described(batches):
            for batch in batches:
                near = nearest(unit(batch.column("embedding")), pivots, depth).astype(np.uint16)
                top = np.sort(near[:, :width].astype(np.int64), axis=1)
                codes = np.column_stack([top[:, a] << 16 | top[:, b] for a, b in combinations(range(width), 2)]) if width > 1 else np.zeros((len(near), 1), np.int64)
                yield pa.record_batch({"id": batch.column("id"), "near": pa.array([r.tobytes() for r in near], pa.binary()), "lists": pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), codes.shape[1]).cast(pa.list_(pa.int64()))})

        index = s.stored(one.select("id", "embedding").mapInArrow(described, "id long, near binary, lists array<long>"), "vectors-index")
        placed = index.select("id", "near", F.explode("lists").alias("list"))
        long = s.stored(placed.groupBy("list").agg(F.count("*").alias("n")).where(f"n > {BLOCK}").select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vectors-long")
        inside = placed.join(long, "list", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
        paired = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "list", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "near")
        deal = lambda df: df.repartition("list", "left", "right").sortWithinPartitions("list", "left", "right")
        columns = "list long, left int, right int, side int, id long, near binary"
        wanted = s.stored(deal(paired).mapInArrow(_candidates(width, least), columns), "vectors-wanted")
        full = deal(wanted.join(one.select("id", "copies", "embedding"), "id").select(*wanted.columns, "copies", "embedding"))
        links = s.stored(full.mapInArrow(_linked(width, least), "a long, b long, links long"), "vectors-links")
        counts = links.groupBy(F.col("b").alias("id")).agg(F.sum("links").alias("links"))
        comp = components(links.where("a <> b").select("a", "b"), "vectors", s)
        named = one.select("id", "h1", "h2", "copies", "least").join(counts, "id", "left").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        least_id = named.groupBy("component").agg(F.min("least").alias("component_id"))
        known = stored(named.join(least_id, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vectors-known")
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, for small tables.
SQL = r"""
with recursive v as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
f as (select r, vec_id, e, len(e) as d from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
g as (select r, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as u from f where d = (select d from f group by d order by count(*) desc, d limit 1)),
l as (select a.r as a, b.r as b from g a join g b on a.r <> b.r where list_dot_product(a.u, b.u) >= 0.95),
c(r, t) as (select r, r from v union select c.r, l.b from c join l on c.t = l.a),
k as (select c.r, min(v.vec_id) as component_id from c join v on v.r = c.t group by c.r),
n as (select a as r, count(*) as n from l group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, k.component_id, coalesce(v.vec_id = k.component_id, false) as kept from v join k on k.r = v.r left join n on n.r = v.r
"""
