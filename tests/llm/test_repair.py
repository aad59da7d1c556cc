"""Conversation repair against a search over all edits, and edge cases."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from itertools import product

from labelloom.llm import repair_dawg

TALK = "conv_id long, turn long, role string, text string, pos int, audit string, conv string"
LEGAL = re.compile(r"(s?(ua)+)?")
CAN_GROW = re.compile(r"s?(ua)*u?")


def search(turns):
    """(cost, audit, repaired) by trying edits in order of cost, then audit; turns are (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in made)
        if at == len(turns) and LEGAL.fullmatch(roles):
            return cost, audit, made
        if not CAN_GROW.fullmatch(roles) or (audit, at, made) in seen:
            continue
        seen.add((audit, at, made))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, made + ((role, ""),)))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, made + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, made + ((new, text),)))
    raise AssertionError("no repair")


def symbol(role, fault):
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter


def expected(rows, ids):
    """conv_id -> report, from (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in ids:
        turns = sorted(talks[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faulty, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit, made = search(faulty)
        pairs = zip(turns, turns[1:])
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
                     *(sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")),
                     sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in pairs), cost, audit, len(made),
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def reported(plan):
    return {r.conv_id: tuple(r)[1:] for r in repair_dawg.repair_report(plan).collect()}


def test_automaton_equals_search():
    """All signatures of up to three turns, and longer ones, in order from their ends as Spark gives them."""
    draw, letters = random.Random(1), "suaxSUAX-"
    some = {""} | {"".join(p) for n in (1, 2, 3) for p in product(letters, repeat=n)}
    some |= {"".join(draw.choice(letters) for _ in range(draw.randrange(4, 7))) for _ in range(300)}
    automaton = repair_dawg.Automaton()
    for backward in sorted(s[::-1] for s in some):
        turns = [(c.lower(), "", "blank" if c == "-" else "truncated" if c.isupper() else "") for c in reversed(backward)]
        assert automaton.audit(backward) == search(turns)[:2], backward


def test_nodes_are_shared(monkeypatch):
    """A thousand conversations with one end: its nodes are worked out once."""
    made = []
    work = repair_dawg.node
    monkeypatch.setattr(repair_dawg, "node", lambda symbol, rest: made.append(symbol) or work(symbol, rest))
    automaton, end = repair_dawg.Automaton(), "au" * 500
    for i in range(1000):
        automaton.audit(end + format(i, "010b").replace("0", "s").replace("1", "x"))
    assert len(made) < 1000 + 2 * 1024


EDGE = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."),
    (2, 0, None, None), (2, 1, "", "No role."), (2, 3, "user", "cut"), (2, 3, "user", "cut"), (2, 3, "tool", "x. "),
    (3, None, "user", "First?"), (3, None, "assistant", "Second."), (3, None, "assistant", "Second."),
    (4, 5, "user", " \t\x0b"), (4, 9, "assistant", ""), (None, 0, "user", "Whose?"), (None, 1, "assistant", "Mine"),
    (5, -2, "assistant", "A."), (5, 2, "system", "S."), (5, 7, "user2", "Q?"), (5, 7, "élan", "E."),
    (6, 0, "user", "line\nline. \r\n"), (6, 1, "assistant", "long. " * 200_000),
]


def test_edge_cases_and_clashing_names(spark):
    rows = [(*r, 1, "x", "y") for r in EDGE]
    plan = repair_dawg.plan_repair(spark.createDataFrame(rows, TALK), spark.createDataFrame([(1,), (99,)], "conv_id long"))
    assert reported(plan) == expected(EDGE, {r[0] for r in EDGE} | {99})
    turns = sorted((r.position, r.edit, r.role, r.text) for r in repair_dawg.repaired_turns(plan).where("conv_id = 2").collect())
    assert "".join(r[:1] for _, _, r, _ in turns) in ("ua", "uaua") and turns[0][0] == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], TALK)
    assert reported(repair_dawg.plan_repair(empty, empty.select("conv_id"))) == {}
    ids = spark.createDataFrame([("a",), (None,)], "id string")
    nothing = (0, 0, 0, 0, 0, 0, "", 0, hashlib.sha256(b"").hexdigest())
    strings = empty.withColumn("conv_id", empty.conv_id.cast("string"))
    assert reported(repair_dawg.plan_repair(strings, ids)) == {"a": nothing, None: nothing}


def test_damage(spark):
    rows = [(c, t, "assistant", f"Is it {c}? {t}.") for c in (1, 2, None) for t in [*range(40), None]]
    out = defaultdict(list)
    for r in repair_dawg.damage(spark.createDataFrame([(*r, 1, "", "") for r in rows], TALK)).collect():
        out[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        kept = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        assert out[c, t] == ([] if kind == 0 else [kept] * (2 if kind == 3 else 1))


def test_a_hot_conversation(spark):
    """Thousands of turns in one conversation, and one signature that most conversations have."""
    rows = [(0, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(6001)]
    rows += [(c, t, ("user", "assistant")[t], f"{c} {t}.") for c in range(1, 400) for t in range(2)]
    plan = repair_dawg.plan_repair(spark.createDataFrame([(*r, 1, "", "") for r in rows], TALK))
    got = reported(plan)
    assert got[0][4:8] == (0, 2, "K" * 6001 + "I", 6002)
    assert all(got[c][5:8] == (0, "KK", 2) for c in range(1, 400))
