"""Conversation structure repair: the cheapest edits after which roles alternate and no turn is empty or repeated.

Edits of a turn are Keep (0), Rerole to user or assistant (3) and Delete (4, the only one for a blank or repeated turn); an
empty turn may be Inserted anywhere (3); a truncated turn that stays costs 3 more. Roles have to read (s?(ua)+)?.

Cost layers, in the manner of Wu and Manber's approximate matching: between each two turns a word of LAYERS bitsets says which
states of the grammar (nothing yet, after s, after u, after a) can be finished at a cost of so much more than the cheapest; bit
4 * layer + state. The word before a turn is made from that after it by shifts (each cost a number of layers) and by
masks (which states an edit leads from), for all layers and states at once. From any state any other's rest can be finished
for at most 13 more, so 16 layers hold all and a word is 64 bits whatever the length. The first layer that accepts at the
start is the cost. The trace goes forwards from there and takes the least letter whose bit is set in the layer that the
edit's cost leaves; as the next state depends on the letter alone, that is the least audit. Few different words occur, so a
step is looked up once it is known.

Rows are numbered in their conversation by a window, which spills; the search sees a conversation's numbers and a byte a turn,
texts go by its side and meet the edits again by number. A conversation is searched and hashed in order, by one task, at some
30 bytes a turn; the hash is read from a sorted stream.

Order: by turn (nulls first), then role, then text. Edge cases: a null role or text counts as one space, so such a text is
blank; rows of null conv_id are one conversation; equal rows of one turn are repetitions of the first; an empty table gives empty
results; further columns go through with their rows and are null in inserted ones, except those named place or edit, whose
place the operator's take.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Carried, Scratch, crc32_sql, stored, table
from .textbatch import complete

RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LAYERS = 16
#: Initials of roles that the grammar knows; faults in the order in which they count.
INITIALS, FAULTS = "sua", ("fine", "truncated", "blank", "duplicate")
_START, _S, _U, _A = range(4)
#: A bit in every layer, with some more above a word's layers, where every state is in.
_ONES = int("1" * (LAYERS + 8), 16)
_ABOVE = ((1 << 32) - 1) << 4 * LAYERS
#: State that a user or assistant turn leads to from each state, and its role; states from which a kept initial is right, and to where.
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}
_ROLE = {_U: "user", _A: "assistant"}
_KEPT = {"s": ((_START,), _S), "u": ((_START, _S, _A), _U), "a": ((_U,), _A)}
_KEY = ["conv_null", "conv_key"]


def _led(word: int, to: int, states) -> int:
    """States from which an edit leads to `to`, in every layer that has `to`."""
    return (word >> to & _ONES) * sum(1 << s for s in states)


def _any_role(word: int) -> int:
    return _led(word, _U, (_START, _S, _A)) | _led(word, _A, (_U,))


def _inserted(word: int) -> int:
    """With what insertions before it can reach."""
    while True:
        more = (word | _any_role(word) << 4 * INSERT) & ((1 << 4 * (LAYERS + 8)) - 1)
        if more == word:
            return word
        word = more


def _first(word: int, state: int) -> int:
    """The first layer that has a state."""
    found = word >> state & _ONES
    return ((found & -found).bit_length() - 1) // 4


class Repair:
    """Words by number, and the steps between them that were needed so far. A turn's class is 4 * fault + initial (3: another)."""

    def __init__(self):
        self.words: list[int] = []
        self.number: dict[int, int] = {}
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        self.forth: dict[tuple[int, int, int], tuple[str, int]] = {}
        end = _led(1, 0, (_START, _A))  # layer 0
        self.end = self._numbered(self._filled(_inserted(end)))

    def _filled(self, word: int) -> int:
        """What a layer has the next ones have too."""
        for k in range(1, LAYERS):
            word |= (word >> 4 * (k - 1) & 15) << 4 * k
        return word & ((1 << 4 * LAYERS) - 1)

    def _numbered(self, word: int) -> int:
        if word not in self.number:
            self.number[word] = len(self.words)
            self.words.append(word)
        return self.number[word]

    def _step(self, after: int, kind: int) -> tuple[int, int]:
        word, fault, initial = self.words[after] | _ABOVE, kind // 4, kind % 4
        out = word << 4 * DELETE
        if fault < 2:
            stays = _any_role(word) << 4 * RE_ROLE
            if initial < 3:
                states, to = _KEPT[INITIALS[initial]]
                stays |= _led(word, to, states)
            out |= stays << 4 * TRUNCATED * fault
        out = _inserted(out)
        base = ((out & -out).bit_length() - 1) // 4
        return self._numbered(self._filled(out >> 4 * base)), base

    def _choice(self, after: int, kind: int, state: int) -> tuple[str, int]:
        """Letters up to and with the turn's own, and the state after it."""
        before, base = self.back[after, kind]
        rest, fault, initial = self.words[after], kind // 4, kind % 4
        cost, letters = base + _first(self.words[before], state), ""
        while True:
            left = lambda to, paid: cost - paid == _first(rest, to)  # noqa: B023, E731
            if left(state, DELETE):
                return letters + "D", state
            if cost - INSERT == base + _first(self.words[before], _NEXT[state]):
                letters, state, cost = letters + "I", _NEXT[state], cost - INSERT
                continue
            extra = TRUNCATED * fault
            if initial < 3 and state in _KEPT[INITIALS[initial]][0] and left(_KEPT[INITIALS[initial]][1], extra):
                return letters + "K", _KEPT[INITIALS[initial]][1]
            return letters + "R", _NEXT[state]

    def search(self, kinds: bytes) -> tuple[int, list[str], list[int]]:
        """Cost, letters for each turn and behind the last, and the state before each of these."""
        words, cost, now = array("H", [self.end]), 0, self.end
        back, forth = self.back, self.forth
        for kind in reversed(kinds):
            step = back.get((now, kind))
            if step is None:
                step = back[now, kind] = self._step(now, kind)
            now = step[0]
            cost += step[1]
            words.append(now)
        cost += _first(self.words[now], _START)
        letters, states, state = [], [], _START
        for i, kind in enumerate(kinds):
            key = (words[len(kinds) - 1 - i], kind, state)
            step = forth.get(key)
            if step is None:
                step = forth[key] = self._choice(*key)
            states.append(state)
            letters.append(step[0])
            state = step[1]
        states.append(state)
        letters.append("I" * (_first(self.words[self.end], state) // INSERT))
        return cost, letters, states


def _edits(conv: Carried, schema: pa.Schema):
    """Each turn's letters, new role and the roles inserted before it; behind the last turn a row with the conversation's figures."""

    def each(batches):
        repair = Repair()
        for rows in complete(batches, _KEY, 1 << 16):
            rows = rows.combine_chunks()
            keys = [np.asarray(rows.column(c)) for c in _KEY]
            edge = np.flatnonzero(np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]))
            kinds, out = rows.column("kind").to_numpy().astype(np.uint8), {c: [] for c in ("k", "letters", "new_role", "before", "figures")}
            take = []
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(kinds)], strict=True):
                mine = kinds[a:b]
                cost, letters, states = repair.search(mine.tobytes())
                first = mine % 4
                legal = sum((first[:-1] == INITIALS.index(x)) & (first[1:] == INITIALS.index(y)) for x, y in ("su", "ua", "au"))
                counts = np.bincount(mine // 4, minlength=4)
                take += [*range(a, b), b - 1]
                out["k"] += range(1, b - a + 2)
                out["letters"] += letters
                for word, state in zip(letters, states, strict=True):
                    roles = []
                    for _ in range(word.count("I")):
                        state = _NEXT[state]
                        roles.append(_ROLE[state])
                    out["before"].append(roles)
                    out["new_role"].append(_ROLE[_NEXT[state]] if word[-1:] == "R" else None)
                out["figures"] += [None] * (b - a) + [{"blank": int(counts[2]), "duplicate": int(counts[3]), "truncated": int(counts[1]), "illegal": int((b - a - 1) - legal.sum()) if b - a > 1 else 0, "cost": cost, "audit": "".join(letters)}]
            same = rows.select([*_KEY, *conv.all]).take(pa.array(take, pa.int64())).combine_chunks()
            yield from pa.table({c: same.column(c) for c in same.column_names} | {c: pa.array(v, schema.field(c).type) for c, v in out.items()}).to_batches()

    return each


def _kind() -> Column:
    tail = F.rtrim(F.col("text"), F.lit("\t\n\x0b\f\r "))
    fault = F.when(tail == "", 2).when(F.col("copy") > 1, 3).when(~F.substring(tail, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when(F.left("role", F.lit(1)) == "s", 0).when(F.left("role", F.lit(1)) == "u", 1).when(F.left("role", F.lit(1)) == "a", 2).otherwise(3)
    return (4 * fault + initial).cast("int")


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, reports), tables that stay in the shared folder, of conv_id, turn, role, text.

    rows: the columns of conversations with the turns that stay or are inserted (of null turn and empty text), place (the
    order in the conversation) and edit (K, R or I). reports: a row for each conversation with conv_id, gaps (turn numbers
    missing between the least and the greatest), blank, duplicate, truncated, illegal (neighbours whose roles can't stand so),
    cost and audit."""
    own = ["conv_id", "turn", "role", "text"]
    more = Carried(conversations, [c for c in conversations.columns if c.lower() not in own], ["place", "edit"])
    conv = Carried(conversations, ["conv_id"])
    conv.all, conv.columns, conv.schema = ["conv"], [F.col("conv_id").alias("conv")], [conv.schema[0].replace("carried_0", "conv", 1)]
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = [F.col("conv_id").isNull().alias(_KEY[0]), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias(_KEY[1])]
    with Scratch() as s:
        rows = conversations.select(*key, *conv.columns, F.col("turn").alias("turn"), plain("role"), plain("text"), *more.columns)
        order = W.partitionBy(*_KEY).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
        again = W.partitionBy(*_KEY, "role", "sha").orderBy("k")
        placed = rows.withColumn("k", F.row_number().over(order)).withColumn("sha", F.sha2("text", 256)).withColumn("copy", F.row_number().over(again))
        turns = s.stored(placed.withColumn("kind", _kind()).drop("sha", "copy"), "talk-turns")
        columns = "k int, letters string, new_role string, before array<string>, figures struct<blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"
        figures = pa.struct([(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
        arrow = pa.schema([("k", pa.int32()), ("letters", pa.string()), ("new_role", pa.string()), ("before", pa.list_(pa.string())), ("figures", figures)])
        dealt = turns.select(*_KEY, *conv.all, "k", "kind").repartition(*_KEY).sortWithinPartitions(*_KEY, "k").drop("k")
        edits = s.stored(dealt.mapInArrow(_edits(conv, arrow), f"conv_null boolean, conv_key string, {conv.schema[0]}, {columns}"), "talk-edits")

        span = turns.groupBy(*_KEY).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        told = edits.where("figures is not null").join(span.hint("merge"), _KEY)
        reports = stored(told.select(F.col("conv").alias("conv_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "figures.*"), "talk-reports")

        real = turns.select(*_KEY, "k", "turn", "role", "text", *more.all)
        both = edits.join(real.hint("merge"), [*_KEY, "k"], "left")
        new = F.transform("before", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        kept = F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"), F.right("letters", F.lit(1)).alias("edit"))
        all_ = F.concat(new, F.when(F.right("letters", F.lit(1)).isin("K", "R"), F.array(kept)).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>")))
        lines = both.select("conv", "k", "turn", *more.all, F.posexplode(all_).alias("pos", "line"))
        old = F.col("line.edit") != "I"
        out = lines.select(
            F.col("conv").alias("conv_id"), F.when(old, F.col("turn")).alias("turn"), "line.role", "line.text", *(F.when(old, F.col(c)).alias(c) for c in more.all),
            F.struct("k", "pos").alias("place"), "line.edit",
        )
        return stored(out.select(*own, *more.back, "place", "edit"), "talk-rows"), reports


def _hashed(schema: pa.Schema):
    def each(batches):
        now, sha, conv = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KEY, "conv", "line")]
            for null, key, value, line in zip(*columns, strict=True):
                if (null, key) != now:
                    if now is not None:
                        yield pa.record_batch([pa.array([conv], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)
                    now, conv, sha = (null, key), value, hashlib.sha256(line)
                else:
                    sha.update(b"\n")
                    sha.update(line)
        if now is not None:
            yield pa.record_batch([pa.array([conv], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)

    return each


def fingerprints(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's rows, role:text, a line feed between. rows: conv_id, role, text, place."""
    key = [F.col("conv_id").isNull().alias(_KEY[0]), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias(_KEY[1])]
    kind = rows.schema["conv_id"].dataType
    lines = rows.select(*key, F.col("conv_id").alias("conv"), "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    dealt = lines.repartition(*_KEY).sortWithinPartitions(*_KEY, "place").drop("place")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("sha", pa.string())])
    return dealt.mapInArrow(_hashed(schema), f"conv_id {kind.simpleString()}, sha string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by a checksum of conv_id and turn; nulls become a space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    times = F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int")
    return conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("again")).drop("again")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows, reports = repaired(damaged(conversations))
    every = conversations.select("conv_id").distinct()
    same = lambda other: every["conv_id"].eqNullSafe(other["conv_id"])
    shas = fingerprints(rows)
    # small in their files, not in memory: no table here has a bound
    found = every.join(reports.hint("merge"), same(reports), "left").join(shas.hint("merge"), same(shas), "left")
    none = lambda c: F.coalesce(reports[c], F.lit(0)).cast("long").alias(c)
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(every["conv_id"], *map(none, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def _moves() -> str:
    """VALUES of (state, letters, initial, next state, cost, lines inserted, new role), with up to two insertions before the turn."""
    out = []
    for state in range(4):
        for inserts in range(3):
            now, lines = state, []
            for _ in range(inserts):
                now = _NEXT[now]
                lines.append(f"'{_ROLE[now]}:'")
            for letter, initial, to, cost, role in [
                *(("K", f"'{i}'", end, 0, "null") for i, (states, end) in _KEPT.items() if now in states), ("R", "null", _NEXT[now], RE_ROLE, f"'{_ROLE[_NEXT[now]]}'"), ("D", "null", now, DELETE, "null"),
            ]:
                out.append(f"({state}, '{'I' * inserts + letter}', {initial}, {to}, {cost + INSERT * inserts}, [{', '.join(lines)}]::varchar[], {role})")
    return ", ".join(out)


#: From the last turn backwards, the cheapest and least rest of every state.
SQL = rf"""
with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
h as (select *, {crc32_sql("name")} % 20 as h from d),
e as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case h when 0 then []::int[] when 3 then [1, 2] else [1] end) as again from h),
n as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from e),
f as (select *, row_number() over (partition by conv_id, role, text order by k) as copy, left(role, 1) as initial, lead(left(role, 1)) over (partition by conv_id order by k) as next from n),
t as (select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when copy > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'fine' end as fault from f),
m(state, letters, initial, next, cost, lines, role) as (values {_moves()}),
r(conv_id, k, state, cost, audit, lines) as (
    select conv_id, max(k), state, cost, audit, lines from t, (values (0, 0, '', []::varchar[]), (3, 0, '', []::varchar[]), (2, 3, 'I', ['assistant:']), (1, 6, 'II', ['user:', 'assistant:'])) v(state, cost, audit, lines) group by all
    union all
    select conv_id, k, state, best.cost, best.audit, best.lines from (
        select r.conv_id, r.k - 1 as k, m.state, min({{'cost': r.cost + m.cost + case when t.fault = 'truncated' and not m.letters like '%D' then 3 else 0 end, 'audit': m.letters || r.audit,
            'lines': list_concat(m.lines, case right(m.letters, 1) when 'D' then []::varchar[] when 'K' then [t.role || ':' || t.text] else [m.role || ':' || t.text] end, r.lines)}}) as best
        from r join t on t.conv_id is not distinct from r.conv_id and t.k = r.k join m on m.next = r.state and (m.initial is null or m.initial = t.initial) and (m.letters like '%D' or t.fault in ('fine', 'truncated'))
        group by r.conv_id, r.k, m.state)),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (next is not null and initial || next not in ('su', 'ua', 'au')) as illegal from t group by conv_id),
c as (select distinct conv_id from conversations)
select c.conv_id, coalesce(g.gaps, 0) as gaps, coalesce(g.blank, 0) as blank, coalesce(g.duplicate, 0) as duplicate, coalesce(g.truncated, 0) as truncated, coalesce(g.illegal, 0) as illegal, coalesce(r.cost, 0) as cost, coalesce(r.audit, '') as audit, sha256(coalesce(array_to_string(r.lines, chr(10)), '')) as repaired_sha256
from c left join g on g.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id and r.k = 0 and r.state = 0
"""
