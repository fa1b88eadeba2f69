import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonelake.llm import conversations as cv

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Cost, edits and left turns of rows ``(role, text, must go, cut)`` by trying everything."""

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        if inserts < 3:
            role, after = ("assistant", 3) if state == 2 else ("user", 2)
            cost, edits, kept = best(i, after, inserts + 1)
            ways.append((cost + 2, "I" + edits, ((role, ""), *kept)))
        if i < len(rows):
            role, text, must, cut = rows[i]
            cost, edits, kept = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + edits, kept))
            if not must:
                new, after = ("assistant", 3) if state == 2 else ("user", 2)
                cost, edits, kept = best(i + 1, after, 0)
                ways.append((cost + 2 + cut, "R" + edits, ((new, text), *kept)))
                to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(role[:1])
                if to:
                    cost, edits, kept = best(i + 1, to, 0)
                    ways.append((cost + cut, "K" + edits, ((role, text), *kept)))
        return min(ways, default=(10**9, "", ()))

    return best(0, 0, 0)


def brute_report(rows, ids):
    out = []
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2]))
        own = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
        seen, blank, dup, cut, cards = set(), 0, 0, 0, []
        for _, _, role, text in own:
            solid = SOLID.findall(text)
            is_blank, is_dup = not solid, (role, text) in seen
            is_cut = bool(solid) and not is_dup and solid[-1] not in ".!?"
            blank, dup, cut = blank + is_blank, dup + (is_dup and not is_blank), cut + is_cut
            seen.add((role, text))
            cards.append((role, text, is_blank or is_dup, int(is_cut)))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[:1] for _, _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        cost, audit, kept = cheapest(tuple(cards))
        left = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = lambda x: " " if x is None else x
        code = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (conv, turn, "user" if code == 4 else role, text)
        out += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


KINDS = st.lists(st.integers(0, cv.KINDS - 1), min_size=1, max_size=7)


def card(kind):
    initial = [*"sua", "x"][(kind - 1) // 2] if kind else "u"
    return initial, "t", kind == 0, (kind - 1) % 2 if kind else 0


@settings(max_examples=400, deadline=None)
@given(KINDS)
def test_crossings_are_the_least_way(kinds):
    items = [cv.ROW_STEPS[k] for k in kinds]
    states = cv.crossings(items, 0, cv.END_COST)
    cost, edits, begin = cv.END_COST[states[-1]], "", 0
    for kind, end in zip(kinds, states, strict=True):
        paid, way = cv.ROW_EDITS[kind][begin, end]
        cost, edits, begin = cost + paid, edits + way, end
    assert (cost, edits + cv.CLOSING[begin]) == cheapest(tuple(map(card, kinds)))[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(KINDS, min_size=1, max_size=4))
def test_spans_give_what_rows_give(parts):
    rows = [k for part in parts for k in part]
    whole = cv.crossings([cv.ROW_STEPS[k] for k in rows], 0, cv.END_COST)
    ends = cv.crossings([cv.span_steps(part) for part in parts], 0, cv.END_COST)
    states, begin = [], 0
    for part, end in zip(parts, ends, strict=True):
        states += cv.crossings([cv.ROW_STEPS[k] for k in part], begin, cv.only(end))
        begin = end
    assert states == whole


def rows_of(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def test_whole_small_table(spark, sf):
    from tonelake.llm.queries import op12_conversations

    rows = rows_of(spark, sf)
    assert collected(op12_conversations(spark, sf)) == brute_report(brute_damage(rows), {r[0] for r in rows})


@pytest.mark.parametrize("segment", [4096, 3])
def test_odd_rows(spark, monkeypatch, segment):
    monkeypatch.setattr(cv, "SEGMENT", segment)
    talk = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(60)]
    rows = talk[:20] + talk[23:40] + talk[45:] + [
        (2, None, "system", "Be brief."), (2, 5, "system", "Be long!"), (2, 9, "user", "\t \n"),
        (2, 9, None, None), (2, 9, "", "no stop"), (3, None, None, None), (4, 1, "assistant", "Hm?"),
        (None, 1, "user", "No id."), (None, 2, "user", "No id."), (None, 3, "usher", "Long. " * 5000),
        (5, 1, "user", "Same."), (5, 1, "user", "Same."), (5, 1, "user", "Same."), (6, 7, "user", "Ünï  "),
        (7, -(2**62), "user", "a."), (7, 2**62, "user", "b."), (8, 1, "System", "x."), (8, 2, "a", "\x0b."),
    ]
    schema = SCHEMA + ", kind int, pos string, seg double"
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], schema).repartition(4)
    ids = {r[0] for r in rows}
    assert collected(cv.conversation_report(df, df)) == brute_report(rows, ids)
    assert collected(cv.conversation_report(df, cv.damage_turns(df))) == brute_report(brute_damage(rows), ids)
    assert cv.conversation_report(df.limit(0), df.limit(0)).count() == 0
    gone = cv.conversation_report(df.limit(1), df.limit(0)).collect()[0]
    assert (gone["cost"], gone["audit"], gone["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hello"), (1, 2, "user", "Still there?"), (1, 3, "user", "Still there?"), (1, 4, "x", "Yes.")]
    turns = cv.repair_conversations(spark.createDataFrame(rows, SCHEMA)).turns
    got = [(r["edit"], r["role"], r["text"]) for r in turns.orderBy("pos", "sub").collect()]
    assert got == [("D", "user", None), ("K", "user", "Still there?"), ("D", "user", None), ("R", "assistant", "Yes.")]
