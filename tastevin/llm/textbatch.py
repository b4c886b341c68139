"""Texts as flat byte arrays for numpy: Arrow batches cut into chunks of bounded bytes, words as spans, span hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C55)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: list[np.ndarray] = []


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK, rows: int = 65536) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most limit bytes of text and so many rows (one row at least), with their bytes and offsets."""
    for batch in batches:
        data, at = utf8(batch.column(text))
        k = 0
        while k < batch.num_rows:
            end = min(max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1), k + rows, batch.num_rows)
            yield batch.slice(k, end - k), data[at[k] : at[end]], at[k : end + 1] - at[k]
            k = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, r, np.uint64))]) for r in (_R, _R_INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), independent of place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each text: start, end, number of the text."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, "right") - 1


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without ASCII white space."""
    return spans(~_SPACE[data], at)


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and bytes of other characters."""
    return spans(_LETTER[data], at)


def per_text(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, values, minlength=n)[:n]


def shingles(data: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of `width` words of each text (all words where there are fewer): text, 44-bit hash, count; sorted by these."""
    start, end, owner = words(data, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = span_hashes(prefix_sums(data), start, end)
    n = np.bincount(owner, minlength=len(at) - 1)
    total = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width if len(total) else 0):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(total)]
    whole = owner[: len(total)] == owner[width - 1 :] if len(total) else np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(n)])
    few = np.flatnonzero((n > 0) & (n < width))
    short = np.zeros(len(few), np.uint64)
    for k in range(width - 1):
        more = n[few] > k
        short[more] = short[more] * np.uint64(0xD6E8FEB86659FD93) + h[first[few[more]] + k]
    of = np.concatenate([owner[: len(total)][whole], few]).astype(np.uint64)
    key = np.sort((of << np.uint64(44)) | (mix(np.concatenate([total[whole], short])) >> np.uint64(20)))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[edge]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), np.diff(np.append(edge, len(whole) and int(whole.sum()) + len(few) or len(few)))


def complete(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal keys, small ones together until there are `rows`, from batches that are sorted by the keys."""
    waiting: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate([[0] if last is not None and last != tuple(c[0] for c in columns) else [], np.flatnonzero(change) + 1]).astype(np.int64)
        at = 0
        for cut in cuts.tolist():
            if size + cut - at >= rows:
                if cut > at:
                    waiting.append(batch.slice(at, cut - at))
                yield pa.Table.from_batches(waiting)
                waiting, size, at = [], 0, cut
        waiting.append(batch.slice(at))
        size += batch.num_rows - at
        last = tuple(c[-1] for c in columns)
    if waiting:
        yield pa.Table.from_batches(waiting)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)
