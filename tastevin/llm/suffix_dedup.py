"""Suffix-array removal of repeated byte strings.

Every text is its UTF-8 bytes. A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document
of smaller doc_id, or earlier in the same document. Within a shard bytes are compared; between shards strings are equal if
their names are, two independent 64-bit hashes (among 10^12 strings a false match has a chance of about 10^-14).

1. Routing. Of every LENGTH bytes in a row the least of the hashed GRAM-byte strings is an anchor, so equal strings have equal
   anchors. Anchors of about PART bytes of text are a part. Parts send each anchor once, with the place of its first
   holder, to the bucket of its hash; an anchor that comes again is answered to its parts with a key, the first
   holder's place cut to PLACE bytes. So copies of a passage meet under few keys, in whole stretches, and the
   rest of the text goes no further. A hash that collides costs time, never exactness.
2. Shards. Stretches are dealt by key, and a key of more than SHARD bytes by document too. A task builds shards of about SHARD bytes
   and their suffix arrays: a sort of the first five bytes, then Larsson-Sadakane doubling of the groups that are not single
   yet, up to LENGTH bytes. Common prefixes follow in text order along Kasai's neighbours, eight bytes at a time. Suffixes with
   LENGTH bytes in common form a class, in order of document and place: all but its first are repeats.
3. Merging. Where a key has several shards, the strings that are first in theirs go as sorted 128-bit names to buckets, in
   which binary search finds each name's earliest holder.
4. Texts that are copies of an earlier one need none of this: they go whole, if LENGTH bytes long.

Edge cases: null counts as empty; rows of equal doc_id don't repeat each other (each is a document), and a null doc_id counts as a
negative number made of the text's hash; an empty table gives an empty result. `strip` carries the columns it is told to (those with
names of its outputs give way), `stripped` all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, Scratch, stored, table, text_or_empty
from .near_dup import document_id
from .textbatch import chunks, grouped, mix, powers, prefix_sums

LENGTH = 100
GRAM = 24
PART = 16 << 20
SHARD = 1 << 20
PLACE = 4096
_U = np.uint64
_GONE = ~_U(0)
_REACH = LENGTH - GRAM


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit hashes of the least grams of all windows of LENGTH bytes."""
    m, width = len(data) - GRAM + 1, _REACH + 1
    if m < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    h = mix((sums[GRAM:] - sums[:m]) * powers(len(data) + 1)[1][:m])
    for k in range(1, GRAM):  # grams that run into the next text
        x = at[1:-1] - k
        h[x[(x >= 0) & (x < m)]] = _GONE
    ranked = (h & ~_U((1 << 28) - 1)) | np.arange(m, dtype=np.uint64)
    blocks = np.concatenate([ranked, np.full(-m % width, _GONE)]).reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(from_right[: m - width + 1], from_left[width - 1 : m]) & _U((1 << 28) - 1)).astype(np.int64)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    least = least[h[least] != _GONE]
    return least, h[least] >> _U(16)


def _parts(batches):
    """A row for each part: its documents, their numbers of anchors, and the anchors' hashes and places."""
    number, bulk, pieces = TaskContext.get().partitionId() << 24, 0, []

    def flush():
        ids, h1, counts, hashes, places = (np.concatenate(x) for x in zip(*pieces, strict=True))
        blob = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        return pa.record_batch({"part": pa.array([number], pa.int64()), "ids": [ids], "h1s": [h1], "counts": [counts.astype(np.int32)], "hashes": pa.array([blob], pa.binary()), "places": pa.array([places.astype("<u4").tobytes()], pa.binary()), "n": pa.array([len(hashes)], pa.int64())})

    for batch, data, at in chunks(batches):
        place, h = anchors(data, at)
        owner = np.searchsorted(at, place, "right") - 1
        pieces.append((batch.column("id").to_numpy(), batch.column("h1").to_numpy(), np.bincount(owner, minlength=len(at) - 1), h, place - at[owner]))
        bulk += len(data)
        if bulk >= PART:
            yield flush()
            number, bulk, pieces = number + 1, 0, []
    if pieces:
        yield flush()


def _hashes(blob) -> np.ndarray:
    raw = np.zeros((len(blob) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return raw.view("<u8").ravel()


def _sent(buckets: int):
    def run(batches):
        """Each anchor of a part once: hash, whether it comes again in the part, number of its first document, place there."""
        for batch in batches:
            for row in batch.to_pylist():
                h, place = _hashes(row["hashes"]), np.frombuffer(row["places"], "<u4")
                doc = np.repeat(np.arange(len(row["counts"])), row["counts"])
                order = np.argsort(h, kind="stable")
                s = h[order]
                edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
                again = np.diff(np.append(edge, len(s))) > 1
                first = order[edge]
                entry = np.zeros(len(edge), [("h", "<u8"), ("doc", "<u4"), ("place", "<u4"), ("again", "u1")])
                entry["h"], entry["doc"], entry["place"], entry["again"] = s[edge], doc[first], place[first] // PLACE, again
                to = (mix(s[edge]) % _U(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                entry, to = entry[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
                ends = np.append(cut[1:], len(to)) if len(to) else []
                yield pa.record_batch({"bucket": pa.array(to[cut] if len(to) else [], pa.int64()), "part": pa.array([row["part"]] * len(cut), pa.int64()), "entries": pa.array([_pack(entry[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())})

    return run


def _pack(entry: np.ndarray) -> bytes:
    """Columns one after the other, hashes without their two empty bytes, documents and places in two bytes where they fit."""
    small = not len(entry) or max(int(entry["doc"].max()), int(entry["place"].max())) < 65536
    kind = "<u2" if small else "<u4"
    h = np.ascontiguousarray(entry["h"]).view(np.uint8).reshape(-1, 8)[:, :6]
    return bytes([small]) + len(entry).to_bytes(4, "little") + h.tobytes() + entry["doc"].astype(kind).tobytes() + entry["place"].astype(kind).tobytes() + entry["again"].tobytes()


def _unpack(blob: bytes):
    small, n = blob[0], int.from_bytes(blob[1:5], "little")
    kind, w, p = ("<u2", 2, 5) if small else ("<u4", 4, 5)
    h = _hashes(blob[p : p + 6 * n])
    p += 6 * n
    doc, place = np.frombuffer(blob, kind, n, p), np.frombuffer(blob, kind, n, p + w * n)
    return h, doc.astype(np.uint64), place.astype(np.uint64), np.frombuffer(blob, np.uint8, n, p + 2 * w * n)


def _answered(batches):
    """For a bucket's anchors that come again: to each of their parts, hash and key."""
    for group in grouped(batches, ["bucket"]):
        parts, blobs = group.column("part").to_numpy(), group.column("entries").to_pylist()
        opened = [_unpack(b) for b in blobs]
        h, doc, place, again = (np.concatenate(x) for x in zip(*opened, strict=True))
        part = np.repeat(parts, [len(x[0]) for x in opened])
        order = np.lexsort((part, h))
        h, doc, place, again, part = h[order], doc[order], place[order], again[order], part[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(edge, len(h)))
        shared = np.repeat((size > 1) | (np.maximum.reduceat(again, edge) > 0), size)
        key = np.repeat(mix(mix(part[edge].astype(np.uint64)) + (doc[edge] << _U(32)) + place[edge]), size)
        order = np.flatnonzero(shared)
        order = order[np.argsort(part[order], kind="stable")]
        p = part[order]
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else []
        out = [(int(p[a]), h[order[a:b]].tobytes(), key[order[a:b]].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(p)) if len(p) else [], strict=True)]
        if out:
            yield pa.record_batch({"part": pa.array([x[0] for x in out], pa.int64()), "again": pa.array([x[1] for x in out], pa.binary()), "keys": pa.array([x[2] for x in out], pa.binary())})


def _stretches(batches):
    """Stretches of the part's documents around anchors of one key. The part's own row comes first."""
    for group in grouped(batches, ["part"]):
        rows = group.to_pylist()
        own = [r for r in rows if r["hashes"] is not None]
        told = [r for r in rows if r["again"] is not None]
        if not own or not told:
            continue
        row = own[0]
        h, place = _hashes(row["hashes"]), np.frombuffer(row["places"], "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(row["counts"])), row["counts"])
        known, keys = np.concatenate([np.frombuffer(r["again"], "<u8") for r in told]), np.concatenate([np.frombuffer(r["keys"], "<u8") for r in told])
        order = np.argsort(known)
        known, keys = known[order], keys[order]
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[k] == h
        doc, place, key = doc[hit], place[hit], keys[k[hit]]
        start, end = np.maximum(place - _REACH, 0), place + LENGTH
        order = np.lexsort((start, key, doc))
        doc, start, end, key = doc[order], start[order], end[order], key[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > end[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        if len(first):
            yield pa.record_batch({"id": np.array(row["ids"])[doc[first]], "h1": np.array(row["h1s"])[doc[first]], "key": key[first].view(np.int64), "start": start[first], "end": end[last]})


def suffix_order(data: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places in order of their first `length` bytes (not beyond `end`, the end of the stretch each place is in), ties in
    order of place: a prefix sort, Larsson-Sadakane doubling of groups that are not single, and a last step to `length`."""
    n, place = len(data), np.arange(len(data))
    bits = max(int(n + 1).bit_length(), 1)
    packed = 3 * bits <= 64
    first = np.zeros(n, np.uint64)
    for k in range(5):  # the end of a stretch sorts before every byte
        here = place + k < end
        byte = np.zeros(n, np.uint64)
        byte[here] = data[(place + k)[here]].astype(np.uint64) + _U(1)
        first = first * _U(257) + byte
    if packed and bits <= 22:
        s = np.sort((first << _U(bits)) | place.astype(np.uint64))
        order = (s & _U((1 << bits) - 1)).astype(np.int64)
        s = s >> _U(bits)
    else:
        order = np.argsort(first, kind="stable")
        s = first[order]
    rank = np.zeros(n + 1, np.int64)
    edge = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.zeros(0, bool)
    rank[order] = np.flatnonzero(edge)[np.cumsum(edge) - 1] + 1 if n else 0
    depth = 5
    while depth < length and n:
        step = depth if 2 * depth <= length else length - depth
        size = np.diff(np.append(np.flatnonzero(edge), n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        p = order[at]
        q = p + step
        second = np.where(q < end[p], rank[np.minimum(q, n)], 0)
        if packed:
            key = np.sort((rank[p].astype(np.uint64) << _U(2 * bits)) | (second.astype(np.uint64) << _U(bits)) | p.astype(np.uint64))
            p = (key & _U((1 << bits) - 1)).astype(np.int64)
            head = key >> _U(bits)
            new = np.concatenate([[True], head[1:] != head[:-1]])
        else:
            by = np.lexsort((p, second, rank[p]))
            p, second = p[by], second[by]
            r = rank[p]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (second[1:] != second[:-1])])
        order[at] = p
        edge[at] = new
        rank[p] = at[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        depth += step
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, end: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For every place, the bytes (at most `most`) it shares with its predecessor in `order`.

    In text order, as Kasai's algorithm goes: a place shares at least one byte less than the place before it, if the latter's
    predecessor moved on by one still precedes (ties of cut prefixes may swap). Places are taken in eight interleaved
    sweeps, so that each sweep starts from that bound, and words of eight bytes are compared."""
    n = len(data)
    turn = np.empty(n + 1, np.int64)
    turn[order], turn[n] = np.arange(n), n
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    shared = np.zeros(n, np.int64)
    room = np.where(before >= 0, np.minimum(np.minimum(end - np.arange(n), end[before] - before), most), 0)
    for sweep in range(8):
        i = np.arange(sweep, n, 8)
        if sweep:
            holds = (before[i - 1] >= 0) & (turn[before[i - 1] + 1] < turn[i])
            shared[i] = np.where(holds, np.minimum(np.maximum(shared[i - 1] - 1, 0), room[i]), 0)
        i = i[shared[i] < room[i]]
        while len(i):
            k = shared[i]
            a, b = words[i + k].view("<u8").ravel(), words[before[i] + k].view("<u8").ravel()
            x = a ^ b
            low = x & (~x + _U(1))
            same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(float)) // 8).astype(np.int64))
            shared[i] = np.minimum(k + same, room[i])
            i = i[(same == 8) & (shared[i] < room[i])]
    return shared


class Shard:
    """Stretches of documents as one text, in order of document and place; overlapping ones are joined."""

    def __init__(self, ids, rows, starts, texts: list[bytes]):
        order = np.lexsort((starts, rows, ids))
        pieces, spans, last = [], [], None
        size = 0
        for k in order.tolist():
            t, s = texts[k], int(starts[k])
            if last and last[0] == ids[k] and last[1] == rows[k] and s <= last[2]:
                t = t[last[2] - s :]
                last[2] += len(t)
            else:
                last = [int(ids[k]), int(rows[k]), s + len(t)]
                spans.append((last[0], last[1], s, size))
            pieces.append(t)
            size += len(t)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.ids, self.rows, self.starts, offsets = (np.array(x, np.int64) for x in zip(*spans, strict=True))
        self.of = np.repeat(np.arange(len(spans)), np.diff(np.append(offsets, size)))
        self.shift = self.starts - offsets
        self.end = np.append(offsets[1:], size)[self.of]

    def repeats(self) -> np.ndarray:
        """Whether each place begins a string of LENGTH bytes that also starts earlier."""
        n = len(self.data)
        order = suffix_order(self.data, self.end)
        shared = common_prefixes(self.data, order, self.end)[order] >= LENGTH
        out = np.zeros(n, bool)
        first = order[np.flatnonzero(~shared)[np.cumsum(~shared) - 1]]  # of each class
        doc, previous = self.of[order], np.concatenate([[0], self.of[order[:-1]]])
        same_row = (self.ids[doc] == self.ids[previous]) & (self.rows[doc] == self.rows[previous])
        out[order] = shared & ((self.ids[doc] != self.ids[self.of[first]]) | same_row)
        return out

    def covered(self, place: np.ndarray):
        """id, row, start and end of the runs of bytes under strings that begin at the places, which are rising."""
        if not len(place):
            return [np.zeros(0, np.int64)] * 4
        doc = self.of[place]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + LENGTH)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        doc = doc[first]
        return self.ids[doc], self.rows[doc], place[first] + self.shift[doc], place[last] + LENGTH + self.shift[doc]


def _runs(ids, rows, start, end, names=()):
    """Rows of the shards' output: a run of repeated bytes, or a bucket of names (bucket is null for runs)."""
    n, m = len(ids), len(names)
    return pa.record_batch({
        "id": pa.array([*ids, *[None] * m], pa.int64()), "h1": pa.array([*rows, *[None] * m], pa.int64()), "start": pa.array([*start, *[None] * m], pa.int64()), "end": pa.array([*end, *[None] * m], pa.int64()),
        "bucket": pa.array([*[None] * n, *[x[0] for x in names]], pa.int64()), "names": pa.array([*[None] * n, *[x[1] for x in names]], pa.binary()),
    })


RUNS = "id long, h1 long, start long, end long, bucket long, names binary"
_NAME = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("h1", "<i8"), ("start", "<i8")])


def _named(shard: Shard, repeated: np.ndarray, buckets: int):
    """Names of the strings that begin at places without an earlier copy here, by bucket."""
    place = np.flatnonzero(~repeated & (shard.end - np.arange(len(repeated)) >= LENGTH))
    out = np.zeros(len(place), _NAME)
    sums = prefix_sums(shard.data)
    down = powers(len(shard.data) + 1)[1]
    raw = (sums[place + LENGTH] - sums[place]) * down[place]
    other = prefix_sums(shard.data ^ np.uint8(0xA5))
    second = (other[place + LENGTH] - other[place]) * down[place]
    doc = shard.of[place]
    out["a"], out["b"], out["id"], out["h1"], out["start"] = mix(raw), mix(second + _U(0x51ED270B)), shard.ids[doc], shard.rows[doc], place + shard.shift[doc]
    to = (out["a"] % _U(buckets)).astype(np.int64)
    order = np.lexsort((out["start"], out["h1"], out["id"], out["b"], out["a"], to))
    out, to = out[order], to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else []
    return [(int(to[a]), out[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(to)) if len(to) else [], strict=True)]


def _sharded(buckets: int):
    def run(batches):
        waiting, bulk = [], 0

        def work(tables):
            whole = pa.concat_tables(tables)
            ids, rows, starts = (whole.column(c).to_numpy() for c in ("id", "h1", "start"))
            shard = Shard(ids, rows, starts, whole.column("bytes").to_pylist())
            repeated = shard.repeats()
            names = _named(shard, repeated, buckets) if whole.column("shards")[0].as_py() > 1 else ()
            return _runs(*(x.tolist() for x in shard.covered(np.flatnonzero(repeated))), names)

        for group in grouped(batches, ["key", "shard"]):
            if group.column("shards")[0].as_py() > 1:
                yield work([group])
                continue
            waiting.append(group)
            bulk += int(group.column("size")[0].as_py())
            if bulk >= SHARD:
                yield work(waiting)
                waiting, bulk = [], 0
        if waiting:
            yield work(waiting)

    return run


def _merged(batches):
    """Repeats among the names of a bucket: each shard's sorted names are looked up in the sorted names of all."""
    for group in grouped(batches, ["bucket"]):
        shards = [np.frombuffer(b, _NAME) for b in group.column("names").to_pylist()]
        every = np.concatenate(shards)
        every = every[np.lexsort((every["start"], every["h1"], every["id"], every["b"], every["a"]))]
        heads = every[np.concatenate([[True], (every["a"][1:] != every["a"][:-1]) | (every["b"][1:] != every["b"][:-1])])]
        for names in shards:
            k = np.searchsorted(heads["a"], names["a"])
            while True:  # heads that share the first half of a name
                other = (heads["b"][k] != names["b"]) & (heads["a"][k] == names["a"])
                if not other.any():
                    break
                k = k + other
            late = names[heads["id"][k] < names["id"]]
            if len(late):
                late = late[np.lexsort((late["start"], late["h1"], late["id"]))]
                same = (late["id"][1:] == late["id"][:-1]) & (late["h1"][1:] == late["h1"][:-1]) & (late["start"][1:] <= late["start"][:-1] + LENGTH)
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                last = np.append(first[1:], len(late)) - 1
                yield _runs(late["id"][first].tolist(), late["h1"][first].tolist(), late["start"][first].tolist(), (late["start"][last] + LENGTH).tolist())


def repeated_runs(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, spans) of texts with repeated bytes, spans possibly overlapping; and rows (id, h1) of copies of an earlier text."""
    spark = docs.sparkSession
    text = docs.select(document_id().alias("id"), text_or_empty().alias("text"))
    long = text.where(F.octet_length("text") >= LENGTH).withColumn("h1", F.xxhash64("text"))
    found = scratch.stored(long.mapInArrow(_parts, "part long, ids array<long>, h1s array<long>, counts array<int>, hashes binary, places binary, n long"), "suffix-parts")
    total = found.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    sent = found.mapInArrow(_sent(buckets), "bucket long, part long, entries binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = sent.mapInArrow(_answered, "part long, again binary, keys binary")
    none = lambda kind: F.lit(None).cast(kind)
    both = found.drop("n").select("*", none("binary").alias("again"), none("binary").alias("keys")).unionByName(
        answers.select("part", none("array<long>").alias("ids"), none("array<long>").alias("h1s"), none("array<int>").alias("counts"), none("binary").alias("hashes"), none("binary").alias("places"), "again", "keys"))
    stretches = scratch.stored(both.repartition("part").sortWithinPartitions("part").mapInArrow(_stretches, "id long, h1 long, key long, start long, end long"), "suffix-stretches")

    names = long.select("id", "h1", F.xxhash64(F.lit(1), "text").alias("h2"))
    least = scratch.stored(names.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "suffix-copies")
    copies = scratch.stored(names.join(least, ["h1", "h2"]).where("id > least").select("id", "h1").distinct(), "suffix-later")

    own = stretches.join(copies, ["id", "h1"], "left_anti").distinct()
    own = scratch.stored(own, "suffix-own")
    # a lone stretch can repeat itself as soon as it holds two strings, which may overlap
    sizes = scratch.stored(own.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("size"), F.count("*").alias("n")).where((F.col("n") > 1) | (F.col("size") > LENGTH)).drop("n"), "suffix-sizes")
    dealt = own.join(sizes, "key").withColumn("shards", F.ceil(F.col("size") / (2 * SHARD)).cast("int")).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    bytes_ = F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    cut = dealt.join(long, ["id", "h1"]).select("key", "shard", "shards", "size", "id", "h1", "start", bytes_.alias("bytes"))
    spread = cut.repartition("key", "shard").sortWithinPartitions("key", "shard")
    runs = scratch.stored(spread.mapInArrow(_sharded(buckets), RUNS), "suffix-runs")
    merged = scratch.stored(runs.where("bucket is not null").select("bucket", "names").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged, RUNS), "suffix-merged")
    every = runs.where("bucket is null").unionByName(merged).groupBy("id", "h1").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return every, copies


def _cleaned(carried, keep_text):
    def run(batches):
        for batch in batches:
            spans, copy, texts = batch.column("spans").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").to_pylist()
            size, gone, count, digest, left = [], [], [], [], []
            for t, s, c in zip(texts, spans, copy, strict=True):
                raw = (t or "").encode()
                size.append(len(raw))
                runs: list[list[int]] = [[0, len(raw)]] if c else []
                for x in sorted((x["start"], x["end"]) for x in s or ()) if not c else ():
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                gone.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                kept, last = [], 0
                for a, b in runs:
                    kept.append(raw[last:a])
                    last = b
                kept = b"".join([*kept, raw[last:]])
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(None if t is None or not keep_text else kept.decode("utf-8", "ignore"))
            out = {**carried.of(batch), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": digest}
            yield pa.record_batch(out | ({"kept_text": pa.array(left, pa.string())} if keep_text else {}))

    return run


def _stripped(docs: DataFrame, carried: Carried, keep_text: bool) -> DataFrame:
    with Scratch() as scratch:
        spans, copies = repeated_runs(docs, scratch)
        marks = spans.select("id", "h1", "spans", F.lit(False).alias("copy")).join(copies, ["id", "h1"], "left_anti").unionByName(copies.select("id", "h1", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(True).alias("copy")))
        marks = stored(marks, "suffix-marks")
    rows = docs.select(*carried.columns, F.col("text").cast("string").alias("text"), document_id().alias("id"))
    rows = rows.withColumn("h1", F.when(F.octet_length("text") >= LENGTH, F.xxhash64("text")))
    joined = rows.join(marks, ["id", "h1"], "left").select(*carried.all, "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = ", ".join([*carried.schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept_text string"] if keep_text else [])])
    return joined.mapInArrow(_cleaned(carried, keep_text), schema)


def strip(docs: DataFrame, *carry: str, keep_text: bool = False) -> DataFrame:
    """carry, n_bytes, n_removed, n_spans, kept_sha256 for every row; with keep_text also what is left, without characters cut in two."""
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
    carried = Carried(docs, carry, out)
    return _stripped(docs, carried, keep_text).select(*carried.back, *out)


def stripped(docs: DataFrame) -> DataFrame:
    """The rows of docs with docs' columns, text without what is repeated (null stays null), n_chars its length where docs has it."""
    new = {"text": F.col("kept_text"), "n_chars": F.coalesce(F.length("kept_text"), F.lit(0)).cast("long")}
    carried = Carried(docs, [c for c in docs.columns if c.lower() not in new])
    back = dict(zip([c for c in docs.columns if c.lower() not in new], carried.back, strict=True))
    return _stripped(docs, carried, True).select(*(back[c] if c in back else new[c.lower()].alias(c) for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


#: Every string of 100 bytes by its digest, for small tables.
SQL = r"""
with d as (select row_number() over (order by doc_id) as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
q as materialized (select r, doc_id, i, case when 2 * i + 200 <= length(h) then md5(substr(h, 2 * i + 1, 200)) end as s, substr(h, 2 * i + 1, 2) as x from (select r, doc_id, h, unnest(range(n)) as i from d)),
o as (select s, min(doc_id) as first_doc from q where s is not null group by s having count(*) > 1),
w as (select q.r, q.i, q.doc_id > o.first_doc as later, min(q.i) over (partition by q.r, q.s) as first from q join o on o.s = q.s),
b as (select r, i from w where later or i > first),
g as (select q.r, q.i, q.x, coalesce(q.i - max(b.i) over (partition by q.r order by q.i) < 100, false) as gone from q left join b on b.r = q.r and b.i = q.i),
e as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as opens from g),
k as (select r, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, coalesce(string_agg(x, '' order by i) filter (where not gone), '') as kept from e group by r)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join k on k.r = d.r
"""
