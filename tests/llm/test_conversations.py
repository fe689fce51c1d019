"""Conversation repair against every edit sequence up to a cost, written plainly."""

import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lectern.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, alive string, at int, fault string"
BLANK = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(heads):
    return heads in ("",) or (heads.removeprefix("s") and heads.removeprefix("s") == "ua" * (len(heads.removeprefix("s")) // 2))


def plain_repair(rows):
    """(cost, audit, text) by trying all edits in order of cost (uniform cost search over whole edit sequences)."""
    faults = plain_faults(rows)
    frontier = {(0, "", "", ()): 0}  # (cost, audit, heads, lines) -> rows read
    best = None
    while frontier:
        path = min(frontier)
        if best and path[0] > best[0]:
            break
        at = frontier.pop(path)
        cost, audit, heads, lines = path
        if at == len(rows) and legal(heads) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(lines)
        moves = [(3, "I", r, "", 0) for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            moves.append((4, "D", None, None, 1))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] == "truncated" else 0
                moves += [(more, "K", role, text, 1)] + [(3 + more, "R", r, text, 1) for r in ("user", "assistant")]
        for more, letter, role, text, read in moves:
            h = heads if role is None else heads + (role[:1] or "?")
            rest = h.removeprefix("s")
            if rest == ("ua" * len(rest))[: len(rest)]:
                frontier[cost + more, audit + letter, h, lines if role is None else (*lines, f"{role}:{text}")] = at + read
    return best


def plain_counts(rows, turns):
    known = [t for t in turns if t is not None]
    faults = plain_faults(rows)
    pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))


def small(seed=1, convs=60):
    rnd = random.Random(seed)
    out = []
    for c in range(convs):
        for _ in range(rnd.randint(1, 4)):
            turn = rnd.choice([None, 0, 1, 2, 3, 7])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "unknown", ""])
            text = rnd.choice([None, "", " \t", "Ja.", "Nein!", "so", "é?", "ends.\n ", "x\x1c"])
            out.append((c if c else None, turn, role, text, "a", 1, "b"))
    return out


def plain_damage(rows):
    said = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in said(text) if x not in ".!?") if kind == 2 else said(text)
        out += [(conv, turn, "user" if kind == 4 else said(role), text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


@pytest.mark.parametrize("block", [1, 2, 64])
def test_repair_is_the_cheapest_and_least(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    data = small()
    got = conversations.repair(conversations.damage(spark.createDataFrame(data, SCHEMA)), alive=F.col("alive")).collect()
    assert len(got) == len({r[0] for r in data})
    damaged = {}
    for r in plain_damage(data):
        damaged.setdefault(r[0], []).append(r)
    for r in got:
        rows = order(damaged.get(r.conv_id, []))
        turns, said = [x[1] for x in rows], [x[2:] for x in rows]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == plain_counts(said, turns)
        assert (r.cost, r.audit, r.repaired) == plain_repair(said), said


def test_undamaged_general_interface(spark):
    rows = [(5, 2, "assistant", "Yes."), (5, 1, "user", "Why?"), (6, 1, "assistant", "Alone."), (7, None, "tool", "cut")]
    df = spark.createDataFrame(rows, "c long, n int, who string, said string")
    got = {r.conv_id: r for r in conversations.repair(df, "c", "n", "who", "said").collect()}
    assert (got[5].cost, got[5].audit, got[5].repaired) == (0, "KK", "user:Why?\nassistant:Yes.")
    assert (got[6].cost, got[6].audit, got[6].repaired) == (3, "IK", "user:\nassistant:Alone.")
    assert (got[7].cost, got[7].audit, got[7].repaired, got[7].truncated, got[7].gaps) == (4, "D", "", 1, 0)


def test_long_conversation_and_extreme_turns(spark):
    n = 20_000
    rows = [(1, i, "user" if i % 3 else "assistant", f"Said {i}.") for i in range(n)] + [(2, -(1 << 63), "user", "a."), (2, (1 << 63) - 1, "assistant", "b.")]
    got = {r.conv_id: r for r in conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].gaps == (1 << 63) - 1 and got[2].audit == "KK"
    audit = got[1].audit
    assert len([x for x in audit if x != "I"]) == n
    lines = [[role, [t for _, t in g]] for role, g in groupby([x.split(":", 1) for x in got[1].repaired.split("\n")], lambda x: x[0])]
    assert lines[0][0] == "user" and lines[-1][0] == "assistant" and all(len(x[1]) == 1 for x in lines)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(empty), alive=F.col("alive")).count() == 0
