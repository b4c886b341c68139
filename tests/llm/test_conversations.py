"""Repairs against a search of all edits, from the definitions."""

import hashlib
import random
import re
import zlib
from functools import cache

from tastevin.llm import conversations

WORDS = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        found = WORDS.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying all edits at each turn."""
    kinds = faults(rows)

    @cache
    def best(i, state, inserts):
        options = []
        if inserts < 3:
            new = NEXT[state]
            cost, audit, lines = best(i, new, inserts + 1) if i < len(rows) or inserts < 2 else (10**9, "", ())
            options.append((cost + 3, "I" + audit, ("user:" if new == "u" else "assistant:", *lines)))
        if i == len(rows):
            return min(options + ([(0, "", ())] if state in ("", "a") else []))
        role, text = rows[i]
        cost, audit, lines = best(i + 1, state, 0)
        options.append((cost + 4, "D" + audit, lines))
        if kinds[i] in ("fine", "truncated"):
            extra, new = 3 * (kinds[i] == "truncated"), NEXT[state]
            cost, audit, lines = best(i + 1, new, 0)
            options.append((cost + 3 + extra, "R" + audit, (("user:" if new == "u" else "assistant:") + text, *lines)))
            if role[:1] in ("s", "u", "a") and (role[:1] == "s" and state == "" or role[:1] == NEXT[state]):
                cost, audit, lines = best(i + 1, role[:1], 0)
                options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
        return min(options)

    return best(0, "", 0)


def report(rows):
    """rows: (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    kinds = faults([(r, x) for _, r, x in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest([(r, x) for _, r, x in rows])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def samples():
    rng = random.Random(6)
    out = [[]]
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "] if rng.random() < 0.4 else ["user", "assistant"]), rng.choice(["", " \t", "Yes.", "No", "why?", f"t{rng.randint(0, 99)}!", f"t{rng.randint(0, 99)}"])) for _ in range(rng.randint(0, 12))]
        out.append(rows)
    return out


def test_search_equals_all_edits():
    repair = conversations.Repair()
    for rows in samples():
        kinds = bytes(4 * conversations.FAULTS.index(f) + ("sua".index(r[0]) if r[:1] in ("s", "u", "a") else 3) for (r, _), f in zip(rows, faults(rows), strict=True))
        cost, letters, _ = repair.search(kinds)
        assert (cost, "".join(letters)) == cheapest(rows)[:2], rows
    # the automaton is small, and all words have all states in their last layers
    assert len(repair.words) < 200
    assert all(w >> 4 * 13 == 0xFFF for w in repair.words)


def test_all_words_hold_all_states():
    repair = conversations.Repair()
    done = 0
    while done < len(repair.words):
        for kind in range(16):
            repair._step(done, kind)
        done += 1
    assert done < 500 and all(w >> 4 * 13 == 0xFFF for w in repair.words)


def test_long_conversation():
    repair = conversations.Repair()
    rng = random.Random(1)
    kinds = bytes(rng.randrange(16) for _ in range(400_000))
    cost, letters, _ = repair.search(kinds)
    assert cost > 0 and len(letters) == 400_001


def test_rows_and_reports(spark):
    rows = [
        (1, 0, "system", "Be kind.", "p"), (1, 1, "user", "Hi there.", "p"), (1, 2, "user", "Hi there.", "p"), (1, 4, "assistant", "Hello", None), (1, None, "user", "First?", "p"),
        (None, 0, "user", "Null id.", "q"), (None, 0, "user", "Null id.", "q"), (None, 1, None, None, "q"), (2, None, "assistant", None, "q"), (3, 5, "assistant", "Only.", "q"), (4, 0, "tool", "x" * 100_000 + ".", "q"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got, reports = conversations.repaired(frame)
    assert got.columns == ["conv_id", "turn", "role", "text", "place", "edit"]
    by = {r["conv_id"]: tuple(r)[1:] for r in reports.collect()}
    lines = {}
    for r in sorted(got.collect(), key=lambda r: tuple(r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv in (None, 1, 2, 3, 4):
        mine = order([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, _ in rows if c == conv])
        assert by[conv] == report(mine)[:7], conv
        assert "\n".join(lines.get(conv, [])) == "\n".join(cheapest([(r, x) for _, r, x in mine])[2])
    more = frame.select("conv_id", "turn", "role", "text", frame["place"].alias("conv"), frame["place"].alias("kind"))
    again, _ = conversations.repaired(more)
    assert {(r["edit"] == "I", r["conv"] is None) for r in again.where("conv_id is null or conv_id = 3").collect()} <= {(True, True), (False, False)}
    rows_, reports_ = conversations.repaired(frame.limit(0))
    assert rows_.collect() == [] and reports_.collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", None]), rng.choice([None, "", "Done.", "One. Two! Three?", f"text {rng.random()}."])))
    rows += rows[:7]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h:
                text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
                mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        want.append((conv, *report(order(mine))))
    got = [tuple(r) for r in conversations.op13_conversation_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert conversations.op13_conversation_repair(spark, str(tmp_path)).collect() == []
