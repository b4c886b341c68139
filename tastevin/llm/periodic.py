"""Periodic runs of words: stretches in which words a fixed distance apart are the same, found by counting lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least LEAST words and
EXPONENT periods long, that no neighbouring word extends. It shows as an island of matches at lag q: places i .. with
word[i] = word[i + q], as many as the run is longer than q. So a lag with fewer matches in the whole text than the
shortest island of its own can hold no run, and only the others are scanned.

Matches of all lags up to n / EXPONENT are counted at once. A word that is frequent in its text (heavy) has its lags counted
by the exact autocorrelation of its places, a Fourier transform for each and one back for their sum; the places of all
others (light) are paired, each with the ones after it. A word is heavy where its pairs would cost more than the transform,
so a text of n words takes about n ** 1.5 steps, whatever its words.

A scan looks at every k-th place first, k an eighth of the shortest island, and whole stretches only around eight matches in
a row; all lags together so take about n log n steps besides what is found. Lags go upwards. A stretch found before has a
smaller period and is left out; where the runs of one smaller period that divides the lag account for so many of its matches
that the rest couldn't hold an island, the lag isn't scanned.

Words are numbered by an exact dictionary of the texts at hand, hashes decide nothing. Rows are worked on where they are, in
chunks of bounded bytes; a longer text is a chunk of its own and takes some 100 bytes a word.

Edge cases: null, empty and blank texts have no words and no runs, their collapsed text is empty; repeated rows and ids get a
result each; an empty table gives an empty result; further columns go through, except those named runs or collapsed, whose place
the operator's take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Carried, crc32_sql, table, text_or_empty
from .textbatch import chunks, spans

LEAST = 24
EXPONENT = 3
#: Pairs that are worth one step of a transform of n log n steps: where the two ways cost the same, measured.
WORTH = 2.0
#: Of the shortest island, the part by which a first look steps.
LOOKS = 8
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first[k] .. first[k] + size[k] - 1 of all k, and the offsets of each k's."""
    at = np.concatenate([[0], np.cumsum(size)])
    return np.arange(at[-1]) - np.repeat(at[:-1] - first, size), at


class Lags:
    """Numbers of matches of all texts of a chunk at all lags of 1 to n // exponent. code: the words' numbers; at: offsets."""

    def __init__(self, code: np.ndarray, at: np.ndarray, exponent: int):
        self.code, self.at = code, at
        self.n = np.diff(at)
        self.most = self.n // exponent
        self.slot = np.concatenate([[0], np.cumsum(self.most + 1)])
        self.count = np.zeros(self.slot[-1], np.int64)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(code)) - at[owner]
        key = owner * (int(code.max(initial=0)) + 1) + code
        order = np.argsort(key, kind="stable")
        key, owner, place = key[order], owner[order], place[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        heavy = size > np.sqrt(WORTH * self.n[owner[edge]] * np.log2(self.n[owner[edge]] + 2)) + 16
        self._light(np.flatnonzero(np.repeat(~heavy & (size > 1), size)), key, owner, place)
        for text in np.unique(owner[edge[heavy]]).tolist():
            mine = heavy & (owner[edge] == text)
            self._heavy(text, [place[a : a + s] for a, s in zip(edge[mine].tolist(), size[mine].tolist(), strict=True)])

    def _light(self, now, key, owner, place) -> None:
        """Each place with the first, second, ... place of its word after it, until a text's greatest lag is passed."""
        slot, limit, found, size, step = self.slot[owner], self.most[owner], [], 0, 0
        while len(now):
            step += 1
            now = now[now + step < len(key)]
            lag = place[now + step] - place[now]
            near = (key[now + step] == key[now]) & (lag <= limit[now])
            now, lag = now[near], lag[near]
            found.append(slot[now] + lag)
            size += len(now)
            if size > len(self.count) or not len(now):
                self.count += np.bincount(np.concatenate(found), minlength=len(self.count))
                found, size = [], 0

    def _heavy(self, text: int, places: list[np.ndarray]) -> None:
        n, most = int(self.n[text]), int(self.most[text])
        size = 1 << (n + most).bit_length()  # no lag that counts wraps around
        power = np.zeros(size // 2 + 1)
        for p in places:
            here = np.zeros(size)
            here[p] = 1
            spectrum = np.fft.rfft(here)
            power += spectrum.real**2 + spectrum.imag**2
        self.count[self.slot[text] : self.slot[text] + most + 1] += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)

    def enough(self, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """(lag, text), by lag, of lags with the matches of their shortest island."""
        text = np.repeat(np.arange(len(self.n)), self.most + 1)
        lag = np.arange(len(self.count)) - self.slot[text]
        good = np.flatnonzero((lag > 0) & (self.count >= shortest(lag, least, exponent)))
        good = good[np.lexsort((text[good], lag[good]))]
        return lag[good], text[good]

    def islands(self, lag: int, texts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, start and length of the islands of `need` or more matches at a lag, of some texts."""
        first, size, step = self.at[texts], self.n[texts] - lag, max(need // LOOKS, 1)
        looks = -(-size // step)
        look, at = _ranges(np.zeros(len(texts), np.int64), looks)
        place = np.repeat(first, looks) + look * step
        a, b, of = spans(self.code[place] == self.code[place + lag], at)
        row = b - a >= need // step
        a, b, of = a[row] - at[of[row]], b[row] - at[of[row]], of[row]
        low, high = np.maximum((a - 1) * step + 1, 0), np.minimum(b * step, size[of])
        place, at = _ranges(first[of] + low, high - low)
        a, b, stretch = spans(self.code[place] == self.code[place + lag], at)
        long = b - a >= need
        a, b, stretch = a[long], b[long], stretch[long]
        return texts[of[stretch]], low[stretch] + a - at[stretch], b - a


def shortest(lag, least: int, exponent: int):
    """Matches that a run of this period has at least."""
    return np.maximum(least - lag, (exponent - 1) * lag)


def runs_of(code: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start, then period."""
    lags = Lags(code, at, exponent)
    every, texts = lags.enough(least, exponent)
    found: dict[int, dict[tuple[int, int], int]] = {}
    edge = np.append(np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])), len(every)) if len(every) else np.zeros(1, np.int64)
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        lag, here = int(every[i]), texts[i:j]
        need = int(shortest(lag, least, exponent))
        if found:
            open_ = [t not in found or lags.count[lags.slot[t] + lag] - _explained(found[t], lag) >= need for t in here.tolist()]
            here = here[np.array(open_, bool)]
        if len(here):
            for t, start, size in zip(*(x.tolist() for x in lags.islands(lag, here, need)), strict=True):
                found.setdefault(t, {}).setdefault((start, size + lag), lag)
    return [sorted(((s, n, q) for (s, n), q in found.get(t, {}).items()), key=lambda r: (r[0], r[2])) for t in range(len(at) - 1)]


def _explained(runs: dict[tuple[int, int], int], lag: int) -> int:
    """Matches at a lag that are inside runs of one smaller period that divides it, of the period with most. Islands of such runs
    are islands of the lag, those of one period don't overlap, and none is a run of its own."""
    by: dict[int, int] = {}
    for (_, length), period in runs.items():
        if lag % period == 0 and length > lag:
            by[period] = by.get(period, 0) + length - lag
    return max(by.values(), default=0)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and offsets by text."""
    split = pc.ascii_split_whitespace(texts)
    at, words = np.asarray(split.offsets).astype(np.int64), split.values
    real = np.asarray(pc.greater(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[at]


def _found(carried: Carried, least: int, exponent: int):
    def each(batches):
        for batch, _, _ in chunks(batches, "periodic_text"):
            words, at = _words(batch.column("periodic_text").cast(pa.string()).fill_null(""))
            code = np.asarray(words.dictionary_encode().indices).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            runs = runs_of(code, at, least, exponent)
            kept = np.zeros(len(code) + 1, np.int64)
            for t, mine in enumerate(runs):
                for start, length, period in mine:
                    kept[at[t] + start + period] += 1
                    kept[at[t] + start + length] -= 1
            kept = np.cumsum(kept)[:-1] == 0
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[at], pa.int32()), words.filter(pa.array(kept, pa.bool_())))
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in runs]
            yield pa.record_batch(carried.of(batch) | {"runs": pa.array(rows, pa.list_(_RUN)), "collapsed": pc.binary_join(left, " ")})

    return each


def periodic_runs(docs: DataFrame, column: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The rows of docs with runs (their start, length and period in words, by start, then period) and collapsed: the text's words,
    one space between, without those that a run holds after its first period."""
    carried = Carried(docs, docs.columns, ["runs", "collapsed"])
    rows = docs.select(*carried.columns, text_or_empty(column).alias("periodic_text"))
    schema = ", ".join([*carried.schema, "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    return rows.mapInArrow(_found(carried, least, exponent), schema).select(*carried.back, "runs", "collapsed")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; ties go to the smallest start, then period; null without a run."""
    better = lambda m, r: F.when(m.isNull() | (r.length * m.period > m.length * r.period), r).otherwise(m)
    return F.reduce(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document's words repeat from a place on. A null doc_id counts as ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    sized = words.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    dealt = sized.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = "array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)), ' ')"
    return dealt.select("doc_id", F.expr(f"if(a is null, text, {again})").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("r", strongest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), F.col("r.length").alias("length"), F.col("r.period").alias("period"),
        F.expr("1000 * r.length div r.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Lags come from runs of 16 words with equal sums of hashes, as every run has that many matches at least.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, {crc32_sql("coalesce(doc_id::varchar, '')")} as h from documents),
e as (select *, len(w) as n, h // 10 as g from d), f as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from e),
x as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end]) end as w from f),
t as (select r, unnest(range(n)) as i, unnest(w) as word from x),
y as (select r, i, sum(hash(word) % 1000000007) over (partition by r order by i rows between current row and 15 following) as s from t),
c as (select distinct a.r, b.i - a.i as q from y a join y b on a.r = b.r and a.s = b.s and a.i < b.i),
o as (select c.r, c.q, unnest(list_filter(range(n - c.q), lambda i: w[i + 1] = w[i + 1 + c.q])) as i from c join x on x.r = c.r where 3 * c.q <= n),
m as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from o),
s as (select r, q, min(i) as start, count(*) + q as length from m group by r, q, island having count(*) + q >= greatest(24, 3 * q)),
u as (select r, start, length, min(q) as period from s group by r, start, length),
k as (select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as line from u group by r),
b as (select *, row_number() over (partition by r order by length::double / period desc, start, period) as place from u),
l as (select r, string_agg(word, ' ' order by i) as words from t where not exists (select 1 from u where u.r = t.r and t.i >= u.start + u.period and t.i < u.start + u.length) group by r)
select x.doc_id, coalesce(k.n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(k.line, '')) as runs_sha256, sha256(coalesce(l.words, '')) as collapsed_sha256
from x left join k using (r) left join b on b.r = x.r and b.place = 1 left join l on l.r = x.r
"""
