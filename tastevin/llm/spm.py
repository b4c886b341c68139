"""SentencePiece encoding and decoding in batches of numpy.

A text is split where a blank follows another character; no piece reaches across such a place (blanks stand in pieces only
at the front, or alone), so these units are encoded apart, each distinct one once in a chunk. Units of equal length in
characters advance together as rows of one matrix; 64-bit hashes of their substrings probe the sorted keys of the pieces.

`viterbi` goes over the ends of a unit; for each end, vectorised maxima over the starts store backpointers. For unigram
models they are maxima of the sum of scores.

A BPE model's ids are by definition those of its merges. These are found by the same search, with a condition in the place
of the sum: merging the text of two tokens gives these two again if and only if they can stand side by side, and a row of tokens is
the merged form of its text if and only if each two neighbours can (a merge across a border sees only the two tokens beside
it until it happens). So of all pieces that end at a place just one can follow the token that ends where it starts, and the
maximum is over what can. Whether two pieces can stand side by side is found by merging the text of the two, once for each
pair, and kept in a bounded table of the worker. The method follows the model's type. Characters that no piece covers become byte pieces if the model has them, else unknown.

Decoding concatenates the pieces' bytes and takes off the blank that encoding put in front.

Edge cases: null and empty texts have no tokens; U+2581 counts as a blank, as in the library (so its round trip isn't exact);
units of more than LONG characters are merged one by one; null or repeated doc_id are rows like any other; an empty
table gives an empty result; carried columns with names of the outputs give way to them; null token_ids decode to the empty
text. Whatever the normaliser, it must be the identity with a blank in front.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, table, text_or_empty
from .textbatch import chunks, mix, prefix_sums, span_hashes

MODEL = "piece_bpe_32k.model"
LONG = 96
CHUNK = 1 << 20
#: Characters of units that are worked on at once; each takes some ten numbers for every start of a piece.
CELLS = 1 << 17
_BLANK = "▁"
_NONE = -np.inf


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces:
    """The pieces of a model: sorted hash keys, scores, ids, bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        model = proto.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError(f"{path}: only models without normalisation and with a blank in front are supported")
        self.unigram = model.trainer_spec.model_type == 1
        self.n = SentencePieceProcessor(model_proto=blob).get_piece_size()
        self.unknown, self.byte = 0, np.full(256, -1)
        spelled, ids, scores = [], [], []
        raw = []
        for i, p in enumerate(model.pieces):
            text = p.piece.replace(_BLANK, " ").encode()
            if p.type == 2:
                self.unknown, text = i, b" \xe2\x81\x87 "
            elif p.type == 3:
                text = b""
            elif p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                spelled.append(text)
                ids.append(i)
                scores.append(p.score)
            raw.append(text)
        self.lengths = np.array([len(x) for x in raw])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        h = span_hashes(prefix_sums(np.frombuffer(b"".join(spelled), np.uint8)), at[:-1], at[1:])
        order = np.argsort(h)
        self.keys, self.ids, self.scores = h[order], np.array(ids)[order], np.array(scores)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.longest = max(len(x.decode()) for x in spelled)
        self.penalty = min(scores) - 10.0  # of a character that no piece covers, as the library's unigram search has it
        self.pairs, self.spelled = Pairs(), dict(zip(spelled, scores, strict=True))
        # place of the key of each slot, -1 without one; where several share a slot, binary search finds theirs
        self.slots, at = np.full(1 << 20, -1, np.int32), (self.keys >> np.uint64(44)).astype(np.int64)
        self.slots[at] = np.arange(len(at))
        self.crowded = np.bincount(at, minlength=1 << 20) > 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in keys, -1 for what is no piece."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        out = self.slots[slot]
        some = np.flatnonzero(out >= 0)
        found = out[some]
        many = np.flatnonzero(self.crowded[slot[some]])
        found[many] = np.minimum(np.searchsorted(self.keys, h[some[many]]), len(self.keys) - 1)
        out[some] = np.where(self.keys[found] == h[some], found, -1)
        return out

    def score(self, h: np.ndarray) -> np.ndarray:
        k = self.find(h)
        return np.where(k >= 0, self.scores[k], _NONE)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def merge_long(p: Pieces, sums: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Merged form of one long unit, with a heap of pairs: n log n steps. cuts: its characters' places."""
    n = len(cuts) - 1
    before, after, end, alive = list(range(-1, n - 1)), [*range(1, n), -1], cuts[1:].tolist(), [True] * n
    start = cuts[:-1].tolist()
    first = p.score(span_hashes(sums, cuts[:-2], cuts[2:]))
    heap = [(-s, i, i + 1, end[i + 1]) for i, s in enumerate(first.tolist()) if s > _NONE]
    heapq.heapify(heap)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] == e):
            continue
        alive[j], end[i], after[i] = False, e, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0:
                s = float(p.score(span_hashes(sums, np.array([start[a]]), np.array([end[b]])))[0])
                if s > _NONE:
                    heapq.heappush(heap, (-s, a, b, end[b]))
    return np.array([*(start[i] for i in range(n) if alive[i]), cuts[-1]])


class Pairs:
    """Which pieces can stand side by side, as far as asked: two tables of slots, bounded; a pair whose slots are taken pushes
    out the later one and is found again when it is asked for."""

    SLOTS = 19

    def __init__(self):
        self.tables = np.zeros((2, 1 << self.SLOTS), np.uint64)

    def _slots(self, keys: np.ndarray):
        return (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64((1 << self.SLOTS) - 1)).astype(np.int64)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """1 or 0, and -1 for pairs not asked for yet. A key's last bit makes room for the answer."""
        out, one = np.full(len(keys), -1, np.int8), np.uint64(1)
        rest = slice(None)
        for table, slot in zip(self.tables, self._slots(keys), strict=True):
            held = table[slot[rest]]
            hit = (held | one) == (keys[rest] | one)
            out[rest] = np.where(hit, (held & one).astype(np.int8), -1)
            rest = np.flatnonzero(out < 0)
        return out

    def add(self, keys: np.ndarray, can: np.ndarray) -> None:
        value = (keys & ~np.uint64(1)) | can.astype(np.uint64)
        first, second = self._slots(keys)
        free = self.tables[0][first] == 0
        self.tables[0][first[free]] = value[free]
        late = self.tables[0][first] != value
        self.tables[1][second[late]] = value[late]


def stays(p: Pieces, raw: bytes, ends: list[int], mid: int) -> bool:
    """Whether merging a text of characters that begin and end at the places gives two symbols with the border mid (one symbol,
    if mid is its start)."""
    ends = list(ends)
    find, first = p.spelled.get, ends[0]
    while True:
        best, at = _NONE, -1
        for k in range(len(ends) - 2):
            score = find(raw[ends[k] : ends[k + 2]], _NONE)
            if score > best:
                best, at = score, k
        if at < 0:
            return len(ends) == (3 if mid > first else 2)
        if ends[at + 1] == mid:
            return False
        del ends[at + 1]


def side_by_side(p: Pieces, raw: bytes, sums: np.ndarray, cuts: np.ndarray, row: np.ndarray, left: np.ndarray, mid: np.ndarray, end: int) -> np.ndarray:
    """Whether the piece from place mid to place end of each row can follow that from left to mid; without one (mid 0), whether it
    is its own merged form."""
    a, b, c = cuts[row, left], cuts[row, mid], cuts[row, end]
    h = span_hashes(sums, b, c)
    key = mix(np.where(mid > 0, span_hashes(sums, a, b), np.uint64(0)) * np.uint64(0xD6E8FEB86659FD93) + h)
    can = p.pairs.known(key)
    new = np.flatnonzero(can < 0)
    if len(new):
        # few and short once a worker is warm, so one by one
        names, one, code = np.unique(key[new], return_index=True, return_inverse=True)
        one = new[one]
        found = np.array([stays(p, raw, cuts[r, i : end + 1].tolist(), m) for r, i, m in zip(row[one].tolist(), left[one].tolist(), b[one].tolist(), strict=True)])
        p.pairs.add(names, found)
        can[new] = found[code]
    return can > 0


def viterbi(p: Pieces, sums: np.ndarray, cuts: np.ndarray, scores: bool = True, raw: bytes = b"") -> list[tuple[np.ndarray, np.ndarray]]:
    """cuts: a row of character places for each unit of one length. The best segmentations (of the greatest sum of scores, or else of pieces that can stand side by
    side), grouped by their number of pieces, and so in matrices again."""
    n, m = cuts.shape
    best, back = np.full((n, m), _NONE), np.zeros((n, m), np.int64)
    best[:, 0] = 0.0
    for end in range(1, m):
        low = max(0, end - p.longest)
        at = p.find(span_hashes(sums, cuts[:, low:end].ravel(), np.repeat(cuts[:, end], end - low)))
        if scores:
            score = np.where(at >= 0, p.scores[at], _NONE).reshape(n, end - low)
            score[:, -1] = np.where(score[:, -1] > _NONE, score[:, -1], p.penalty)
            total = best[:, low:end] + score
        else:
            there = (at >= 0).reshape(n, end - low)
            there[:, -1] = True  # any character alone
            row, k = np.nonzero(there)
            can = side_by_side(p, raw, sums, cuts, row, back[row, k + low], k + low, end)
            total = np.full((n, end - low), _NONE)
            total[row[can], k[can]] = 0.0
        k = total.argmax(1)
        best[:, end], back[:, end] = total[np.arange(n), k], k + low
    if not np.isfinite(best[:, -1]).all():
        raise ValueError("a unit has no segmentation")
    used = np.zeros((n, m), bool)
    at, rows = np.full(n, m - 1), np.arange(n)
    while len(rows):
        used[rows, at[rows]] = True
        rows = rows[at[rows] > 0]
        at[rows] = back[rows, at[rows]]
    size = used.sum(1)
    return [(r, cuts[r][used[r]].reshape(len(r), s)) for s in np.unique(size) for r in [np.flatnonzero(size == s)]]


def units(data: np.ndarray, at: np.ndarray):
    """Texts with a blank in front of each that isn't empty; starts and ends of the units, number of the text of each."""
    raw = data.tobytes()
    if _BLANK.encode() in raw:
        texts = [raw[a:b].replace(_BLANK.encode(), b" ") for a, b in zip(at[:-1], at[1:], strict=True)]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    some = np.diff(at) > 0
    data = np.insert(data, at[:-1][some], 32)
    at = at + np.concatenate([[0], np.cumsum(some)])
    blank = data == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[at[:-1][some]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))
    return data, at, start, end, np.searchsorted(at, start, "right") - 1


def segment(p: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all the units one after the other, and how many each has."""
    sums, raw = prefix_sums(data), data.tobytes()
    h = span_hashes(sums, start, end)
    _, sample, code = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[sample], end[sample]
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    low, high = np.searchsorted(chars, s), np.searchsorted(chars, e)
    length = high - low
    edges = np.append(chars, len(data))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        for k in range(0, len(rows), max(1, CELLS // (n + 1))):
            part = rows[k : k + max(1, CELLS // (n + 1))]
            cuts = edges[low[part][:, None] + np.arange(n + 1)]
            if n > LONG and not p.unigram:
                done = [(np.array([i]), merge_long(p, sums, c)[None]) for i, c in enumerate(cuts)]
            else:
                done = viterbi(p, sums, cuts, p.unigram, raw)
            found += [(part[r], c) for r, c in done]
    # spans of all distinct units in order of the units
    sizes = np.zeros(len(s), np.int64)
    for r, c in found:
        sizes[r] = c.shape[1] - 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    a, b = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    for r, c in found:
        to = first[r][:, None] + np.arange(c.shape[1] - 1)
        a[to], b[to] = c[:, :-1], c[:, 1:]
    k = p.find(span_hashes(sums, a, b))
    ids = np.where(k >= 0, p.ids[k], p.unknown)
    if (p.byte >= 0).all() and (k < 0).any():  # byte pieces for what no piece covers
        wide = np.where(k < 0, b - a, 1)
        place = np.repeat(np.arange(len(ids)), wide)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(wide) - wide, wide)
        spelled = p.byte[data[a[place] + np.where(k[place] < 0, inner, 0)]]
        ids = np.where(k[place] < 0, spelled, ids[place])
        first = np.concatenate([[0], np.cumsum(wide)])[first]
    sizes = np.diff(first)
    count = sizes[code]
    pick = np.repeat(first[code] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return ids[pick], count


def encode(p: Pieces, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts one after the other, and n + 1 offsets."""
    spelled, _, start, end, owner = units(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ids, count = segment(p, spelled, start, end)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, count, len(at) - 1).astype(np.int64))])


def decode(p: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and n + 1 offsets."""
    n = p.lengths[ids]
    pick = np.repeat(p.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    data, ends = p.bytes[pick], np.concatenate([[0], np.cumsum(n)])[at]
    front = ends[:-1][np.diff(ends) > 0]
    front = front[data[front] == 32]
    keep = np.ones(len(data), bool)
    keep[front] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def encoded(docs: DataFrame, path: str, *carry: str) -> DataFrame:
    """carry, n_tokens, token_ids and exact (the ids decode to the text's bytes) for every row of docs."""
    carried = Carried(docs, carry, ["n_tokens", "token_ids", "exact"])

    def run(batches):
        p = pieces(path)
        for batch, data, at in chunks(batches, limit=CHUNK):
            ids, ends = encode(p, data, at)
            back, back_at = decode(p, ids, ends)
            exact = np.diff(back_at) == np.diff(at)
            if exact.all():
                wrong = np.flatnonzero(back != data)
                exact[np.searchsorted(at, wrong, "right") - 1] = False
            else:
                for k in np.flatnonzero(exact):
                    exact[k] = (back[back_at[k] : back_at[k + 1]] == data[at[k] : at[k + 1]]).all()
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch({**carried.of(batch), "n_tokens": np.diff(ends), "token_ids": tokens, "exact": exact})

    schema = ", ".join([*carried.schema, "n_tokens long, token_ids array<int>, exact boolean"])
    return docs.select(*carried.columns, text_or_empty().alias("text")).mapInArrow(run, schema).select(*carried.back, "n_tokens", "token_ids", "exact")


def decoded(rows: DataFrame, path: str, *carry: str) -> DataFrame:
    """carry and text for every row of rows (token_ids)."""
    carried = Carried(rows, carry, ["text"])

    def run(batches):
        p = pieces(path)
        for batch in batches:
            column = batch.column("token_ids")
            ids, ends = np.array(column.flatten(), np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
            data, at = decode(p, ids, ends)
            raw = data.tobytes()
            yield pa.record_batch({**carried.of(batch), "text": pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())})

    ids = F.coalesce(F.col("token_ids").cast("array<int>"), F.array().cast("array<int>")).alias("token_ids")
    return rows.select(*carried.columns, ids).mapInArrow(run, ", ".join([*carried.schema, "text string"])).select(*carried.back, "text")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, model_path(), "doc_id")
