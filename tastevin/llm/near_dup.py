"""MinHash near-duplicates: DartMinHash signatures, banded joining, exact verification, classes.

Elements of a text are its runs of five words (all words where there are fewer), weighted by their counts; similarity is the
weighted Jaccard index, sum of minima over sum of maxima, and 0.8 or more links two texts.

Darts: every element has a region for each band of weight, (0, 1], (1, 2], (2, 4] ...; hashes of element and band throw a
Poisson stream of darts into it, in rising rank, each with a weight and one of COORDINATES. A text of total weight W looks at
ranks up to DARTS / W, keeps the darts under its elements' weights, and of those the earliest for each coordinate. Two
texts agree on a coordinate with chance equal to their weighted Jaccard index. BANDS bands of coordinates are hashed; texts
that share a band are candidates. At similarity 0.8 a pair shares none of 16 bands of 4 with a chance of 0.0002.

No bucket is written out as its pairs. Exact copies are one row from the start. In each bucket the member that shares most
(the largest sum of the sizes of its buckets) leads, and every member is compared with its leaders alone: first by
signature (agreement on LIKELY of the coordinates), then on whole texts, in groups bounded in rows and bytes. Where a
bucket's members end in different components, those outside its largest component meet all others of the bucket inside a
task, first by signature; the members of pairs that agree (members, not pairs) get their texts, and a second task compares
these exactly and gives only links that join two components. So what is written grows with the number of bucket
memberships, and no link between candidates of different components is lost. A bucket with more than BLOCK such
members is dealt in blocks, each with each. Components come from star contraction on tables in the shared folder.

Edge cases: null and empty texts have no elements: copies of each other, they are never linked to others; rows that share a
doc_id count as one document; a null doc_id stands for a negative number made of the text's hash; an empty table gives an empty
result. `near_duplicates` keeps further columns, except those named component or kept, whose place its own take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, Scratch, components, stored, table, text_or_empty
from .textbatch import chunks, grouped, mix, shingles, utf8

WIDTH = 5
SIMILAR = 0.8
COORDINATES = 64
BANDS = 16
DARTS = COORDINATES * (float(np.log(COORDINATES)) + 3)
#: A group holds about so many rows, or bytes of text, at most (a longer text is a group of its own).
GROUP = 512
GROUP_BYTES = 1 << 20
BLOCK = 2048
BLOCK_BYTES = 2 << 20
#: Agreement below which a pair isn't compared: at similarity 0.8 a pair is below with a chance of 0.0002.
LIKELY = 0.62
_U = np.uint64


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x COORDINATES dart names of 32 bits, and which texts have elements."""
    total = np.bincount(owner, weight, minlength=n)
    filled = total > 0
    best = np.full(n * COORDINATES, ~_U(0))
    reach = DARTS / np.maximum(total, 1e-300)
    # a row for each element and band of weight: (low, high]
    steps = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(owner)), steps)
    step = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
    low, high = np.where(step == 0, 0.0, 2.0 ** (step - 1)), 2.0**step
    seed = mix(element[of] * _U(0x9E3779B97F4A7C15) + step.astype(np.uint64))
    text, top = owner[of], weight[of]
    todo = filled.copy()
    while todo.any():
        on = np.flatnonzero(todo[text])
        rank, limit, k = np.zeros(len(on)), reach[text[on]], 0
        while len(on):
            k += 1
            a = mix(seed[on] + _U(2 * k * 0xD1B54A32D192ED03 % 2**64))
            rank = rank - np.log(((a >> _U(11)).astype(float) + 0.5) / 2**53) / (high[on] - low[on])
            live = rank <= limit
            on, rank, limit, a = on[live], rank[live], limit[live], a[live]
            b = mix(a + _U(0x632BE59BD9B4E019))
            at = low[on] + (high[on] - low[on]) * ((b >> _U(11)).astype(float) + 0.5) / 2**53
            hit = at <= top[on]
            place = text[on[hit]] * COORDINATES + ((b[hit] & _U(0x7FF)) % _U(COORDINATES)).astype(np.int64)
            earliest = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(best, place, (earliest << _U(32)) | (mix(b[hit]) >> _U(32)))
        todo = filled & (best.reshape(n, COORDINATES) == ~_U(0)).any(1)
        reach[todo] *= 2
    return (best & _U(0xFFFFFFFF)).reshape(n, COORDINATES), filled


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes, of which each also tells its band."""
    parts = signature.reshape(len(signature), BANDS, -1)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def _signed(batches):
    for batch, data, at in chunks(batches):
        owner, element, count = shingles(data, at, WIDTH)
        signature, filled = signatures(owner, element, count.astype(float), len(at) - 1)
        bands = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(signature).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        yield pa.record_batch({"id": batch.column("id"), "h1": batch.column("h1"), "h2": batch.column("h2"), "bands": bands, "sketch": pa.array([r.tobytes() for r in signature.astype(np.uint16)], pa.binary()), "filled": filled, "size": np.diff(at).astype(np.int64)})


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _agreeing(batches):
    """Pairs whose signatures agree on LIKELY of the coordinates."""
    for batch in batches:
        if batch.num_rows:
            good = (_sketches(batch.column("sketch")) == _sketches(batch.column("other"))).mean(1) >= LIKELY
            yield batch.select(["leader", "id", "size"]).filter(pa.array(good))


class Sets:
    """Elements and counts of texts, the elements numbered."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        batches = pa.table({"text": texts}).to_batches()
        parts, rows = [], 0
        for _, data, at in chunks(iter(batches)):
            owner, element, count = shingles(data, at, WIDTH)
            parts.append((owner + rows, element, count))
            rows += len(at) - 1
        owner, element, self.count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        self.names, self.code = np.unique(element, return_inverse=True)
        self.size = np.bincount(owner, minlength=rows)
        self.first = np.cumsum(self.size) - self.size
        self.total = np.bincount(owner, self.count, minlength=rows).astype(np.int64)
        self.mark = np.zeros(len(self.names), np.int64)

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are SIMILAR to text i or more, by weighted Jaccard index."""
        out = np.zeros(len(others), bool)
        some = np.flatnonzero((self.size[others] > 0) & (SIMILAR * self.total[others] <= self.total[i]) & (SIMILAR * self.total[i] <= self.total[others]))
        if not len(some) or not self.total[i]:
            return out
        own = slice(self.first[i], self.first[i] + self.size[i])
        self.mark[self.code[own]] = self.count[own]
        for k in range(0, len(some), 256):
            part = others[some[k : k + 256]]
            n = self.size[part]
            at = np.cumsum(n) - n
            pick = np.repeat(self.first[part] - at, n) + np.arange(n.sum())
            common = np.add.reduceat(np.minimum(self.mark[self.code[pick]], self.count[pick]), at)
            out[some[k : k + 256]] = common / (self.total[i] + self.total[part] - common) >= SIMILAR
        self.mark[self.code[own]] = 0
        return out


def _led(batches):
    """Links of the members of a group with its leader. The leader's row comes first."""
    for rows in grouped(batches, ["leader", "part"]):
        ids, leads = rows.column("id").to_numpy(), rows.column("leads").to_numpy()
        sets = Sets(rows.column("text"))
        rest = np.flatnonzero(~leads)
        good = np.zeros(len(rest), bool)
        for head in np.flatnonzero(leads):
            good |= sets.similar(int(head), rest)
        found = ids[rest[good]]
        if len(found):
            yield pa.record_batch({"a": pa.array([rows.column("leader")[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


class Block:
    """Rows of one bucket: side 0 is outside the bucket's largest component, and meets side 1 (inside it) and side 2 (outside)."""

    def __init__(self, rows: pa.Table):
        self.ids, self.component, self.side = (rows.column(c).to_numpy() for c in ("id", "component", "side"))
        self.bands = np.array(rows.column("bands").combine_chunks().flatten()).reshape(len(self.ids), BANDS)
        self.sketch = _sketches(rows.column("sketch"))
        self.here = int((self.bands[0] == rows.column("bucket")[0].as_py()).argmax())
        self.left, self.right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side > 0)

    def likely(self, i: int, root: np.ndarray) -> np.ndarray:
        """Rows of the right that i is to be compared with: of another root, agreeing on LIKELY of the coordinates."""
        j = self.right[((self.side[self.right] == 1) | (self.ids[self.right] > self.ids[i])) & (root[self.right] != root[i])]
        j = j[(self.sketch[j] == self.sketch[i]).mean(1) >= LIKELY] if len(j) else j
        # a pair that shares several bands is taken from the first of them
        return j[(self.bands[j] == self.bands[i]).argmax(1) == self.here] if len(j) else j


def _blocked(batches):
    """Of each block, the rows that are in a likely pair of different components."""
    for rows in grouped(batches, ["bucket", "left", "right"]):
        block = Block(rows)
        wanted = np.zeros(len(block.ids), bool)
        for i in block.left.tolist():
            j = block.likely(i, block.component)
            wanted[j] = True
            wanted[i] |= len(j) > 0
        if wanted.any():
            yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches()


def _settled(batches):
    """Links between different components among a block's likely pairs, on whole texts: as many as join them."""
    for rows in grouped(batches, ["bucket", "left", "right"]):
        block, sets = Block(rows), Sets(rows.column("text"))
        root = np.unique(block.component, return_inverse=True)[1]
        a, b = [], []
        for i in block.left.tolist():
            j = block.likely(i, root)
            j = j[sets.similar(i, j)] if len(j) else j
            if len(j):
                joined, one = np.unique(root[j], return_index=True)
                a += [block.ids[i]] * len(one)
                b += block.ids[j[one]].tolist()
                root[np.isin(root, joined)] = root[i]
        if a:
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def document_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(text_or_empty()), 2))


def _verified(pairs: DataFrame, bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the pairs (leader, id, size), by exact similarity of whole texts; bodies: (id, text).

    A leader's pairs are dealt to parts bounded in rows and bytes, each with a copy of its text, so that no leader's pairs are
    one task's."""
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_BYTES)).cast("int").alias("parts")
    parts = scratch.stored(pairs.groupBy("leader").agg(parts), "near-parts")
    lists = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.lit(False).alias("leads"))
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("id"), F.lit(True).alias("leads"))
    full = scratch.stored(lists.unionByName(heads), "near-lists").join(bodies.hint("merge"), "id")
    return scratch.stored(full.repartition("leader", "part").sortWithinPartitions("leader", "part", F.desc("leads")).mapInArrow(_led, "a long, b long"), "near-led")


def classes(docs: DataFrame) -> DataFrame:
    """id and component for each document id; component is the smallest document id of the class."""
    text = docs.select(document_id().alias("id"), text_or_empty().alias("text"))
    with Scratch() as s:
        hashed = text.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
        signed = s.stored(hashed.mapInArrow(_signed, "id long, h1 long, h2 long, bands array<long>, sketch binary, filled boolean, size long"), "near-signed")
        copies = s.stored(signed.groupBy("h1", "h2").agg(F.min("id").alias("copy_of")), "near-copies")
        # distinct first: the join then stands alone in its stage, where Spark can split a text with many copies
        same = s.stored(signed.select("id", "h1", "h2").distinct().join(copies, ["h1", "h2"]).select("id", "h1", "h2", "copy_of"), "near-same")
        first = same.where("id = copy_of").select("id", "h1", "h2")
        one = s.stored(signed.where("filled").dropDuplicates(["id", "h1", "h2"]).join(first, ["id", "h1", "h2"]).select("id", "h1", "bands", "sketch", "size"), "near-texts")

        placed = one.select("id", "h1", "size", F.explode("bands").alias("bucket"))
        sizes = s.stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
        members = s.stored(placed.join(sizes, "bucket"), "near-members")
        shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
        ranked = members.join(shared, "id").groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("id")).alias("id"))).alias("top"))
        leaders = s.stored(ranked.select("bucket", (-F.col("top.id")).alias("leader")), "near-leaders")
        pairs = s.stored(members.join(leaders, "bucket").where("id <> leader").groupBy("leader", "id").agg(F.max("size").alias("size")), "near-pairs")
        sketches = one.select("id", "sketch")
        both = pairs.join(sketches, "id").join(sketches.select(F.col("id").alias("leader"), F.col("sketch").alias("other")), "leader")
        agreeing = s.stored(both.select("leader", "id", "size", "sketch", "other").mapInArrow(_agreeing, "leader long, id long, size long").groupBy("leader", "id").agg(F.max("size").alias("size")), "near-agreeing")
        # texts of those that share a bucket, once for both comparisons; the same plan at every size: a small list of ids would
        # be broadcast, a large one not
        texts = text.withColumn("h1", F.xxhash64("text")).dropDuplicates(["id", "h1"])
        bodies = s.stored(texts.join(members.select("id", "h1").distinct().hint("merge"), ["id", "h1"]).select("id", "text"), "near-bodies")
        links = _verified(agreeing, bodies, s)

        found = components(links, "near", s)
        comps = s.stored(one.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "near-components")
        state = members.join(comps, "id").select("bucket", "id", "size", "component")
        # in a bucket of two the only pair was compared already; members of a bucket's largest component needn't meet each other
        groups = state.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", (-F.col("component")).alias("c"), "bytes")).alias("top"))
        blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
        open_ = groups.where("top.n < n and n > 2").select("bucket", (-F.col("top.c")).alias("main"), blocks(F.col("n"), F.col("bytes")).alias("rights"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("lefts"))
        inside = state.join(s.stored(open_, "near-open"), "bucket")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
        outside = inside.where("component <> main").select("bucket", "id", "component", F.lit(0).alias("side"), own("lefts").alias("left"), every("rights").alias("right"))
        whole = inside.select("bucket", "id", "component", F.when(F.col("component") == F.col("main"), 1).otherwise(2).alias("side"), every("lefts").alias("left"), own("rights").alias("right"))
        paired = s.stored(outside.unionByName(whole), "near-paired")
        deal = lambda df: df.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
        columns = "bucket long, left int, right int, side int, id long, component long, bands array<long>, sketch binary"
        spread = deal(paired.join(one, "id").select(*(c.split()[0] for c in columns.split(", "))))
        likely = s.stored(spread.mapInArrow(_blocked, columns), "near-likely")
        full = likely.join(bodies.hint("merge"), "id").select(*likely.columns, "text")
        more = s.stored(deal(full).mapInArrow(_settled, "a long, b long"), "near-more")

        # an id with several texts ties these together; all other copies just follow their text
        several = same.groupBy("id").agg(F.min("copy_of").alias("a"), F.max("copy_of").alias("b")).where("a < b")
        ties = several.select(F.col("a"), F.col("b")).unionByName(several.select(F.col("a"), F.col("id").alias("b")))
        final = components(links.unionByName(more).unionByName(ties), "near-all", s)
        follow = same.select(F.col("id").alias("row"), "copy_of").distinct().join(final.withColumnRenamed("id", "copy_of"), "copy_of", "left")
        return stored(follow.groupBy(F.col("row").alias("id")).agg(F.min(F.coalesce("component", "copy_of")).alias("component")), "near-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs with component (class id) and kept: whether the row stands for its class."""
    carried = Carried(docs, docs.columns, ["component", "kept"])
    rows = docs.select(*carried.columns, document_id().alias("near_id"))
    out = rows.join(classes(docs), F.col("near_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "near_id"))
    return out.select(*carried.back, "component", (F.col("component") == F.col("near_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, that of the smallest doc_id, with docs' columns."""
    carried = Carried(docs, docs.columns)
    rows = docs.select(*carried.columns, document_id().alias("near_id")).dropDuplicates(["near_id"])
    return rows.join(classes(docs).where("id <> component").select("id"), F.col("near_id") == F.col("id"), "left_anti").select(*carried.back)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("component").alias("class_id"), "kept")


#: Every pair that shares a run, for small tables.
SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select text, any_value(w) as w, min(doc_id) as doc_id from d group by text),
x as (select doc_id as t, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s, len(w) as words from t),
s as (select t, s, count(*) as n from x group by t, s), z as (select t, sum(n) as n from s group by t),
p as (select a.t as a, b.t as b, sum(least(a.n, b.n)) as common from s a join s b on a.s = b.s and a.t < b.t group by 1, 2),
l as (select a, b from p join z y on y.t = a join z q on q.t = b where common >= 0.8::double * (y.n + q.n - common)),
e as (select a, b from l union select b, a from l),
c(r, m) as (select doc_id, doc_id from t union select c.r, e.b from c join e on c.m = e.a),
k as (select r, min(m) as class_id from c group by r)
select d.doc_id, k.class_id, d.doc_id = k.class_id as kept from d join t on t.text = d.text join k on k.r = t.doc_id
"""
