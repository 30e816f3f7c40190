from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from mailsift.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, audit string, pos string, block string"


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        here = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if fault == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(r, key=order) for c, r in out.items()}


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        words = text.strip(" \t\n\v\f\r")
        if not words:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def plain(rows):
    """All reachable (state, cost, edits, lines) row by row; the least edits of the cheapest."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best.items()):
                new = follow[state]
                option = (cost + 3, edits + "I", lines + (f"{full[new]}:",))
                if new not in best or option < best[new]:
                    best[new] = option
        return best

    best = inserted({"": (0, "", ())})
    found = faults(rows)
    for (_, role, text), fault in zip(rows, found):
        new = {}

        def offer(state, cost, edits, lines, new=new):
            if state not in new or (cost, edits, lines) < new[state]:
                new[state] = (cost, edits, lines)

        for state, (cost, edits, lines) in best.items():
            offer(state, cost + 4, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] == follow[state] or (state == "" and role[:1] == "s"):
                offer(role[:1], cost + more, edits + "K", (*lines, f"{role}:{text}"))
            offer(follow[state], cost + 3 + more, edits + "R", (*lines, f"{full[follow[state]]}:{text}"))
        best = inserted(new)
    cost, edits, lines = min(best[s] for s in ("", "a") if s in best)
    initials = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(df, rows, **sizes):
    result = dialogue.repair(df, **sizes)
    assert result.columns == NAMES
    got = sorted((tuple(r) for r in result.collect()), key=repr)
    assert got == sorted(((c, *plain(r)) for c, r in damage(rows).items()), key=repr)


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    check(df, rows)


def test_long_conversations_in_blocks(talks):
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "assistant", "user"]
    rows = [(c, t * 2, roles[(t * t + c) % 8], f"row {t % 37}{'.' if t % 5 else ''}") for c in (1, 2, 3) for t in range(60 * c)]
    check(talks(rows), rows, block=4, fan=3)
    check(talks(rows), rows)


def test_odd_rows(talks):
    rows = [
        (1, None, "user", None),
        (1, 0, None, "Hello."),
        (1, 1, "user", "Hello."),
        (1, 1, "user", "Hello."),
        (1, 1, "assistant", "Hi!"),
        (None, 3, "assistant", "No id."),
        (None, None, "user", "No id, no turn"),
        (2, 5, "", ""),
        (3, None, "system", " \t\x0b "),
        (4, 7, "user", "Very long. " * 50_000),
        (4, 8, "äther", "Ends with a space. "),
        *((5, t, "user", "Same text.") for t in range(40)),
    ]
    check(talks(rows), rows)
    check(talks(rows), rows, block=3, fan=2)
    assert dialogue.repair(talks([])).collect() == []


def test_lost_conversation_is_returned(talks):
    lost = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = dialogue.repair(talks([(lost, 0, "user", "Gone.")])).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_walk_equals_all_edits():
    for codes in itertools.product([0, 1, 2, 3, 6, 10, 11], repeat=4):
        edits, state, _ = dialogue.walk(list(codes), dialogue.END, dialogue.NONE, True)
        cost = dialogue._back(list(codes), dialogue.END)[dialogue.NONE]
        price = {"D": 4, "I": 3, "R": 3, "K": 0}
        rows = iter(codes)
        total = 0
        for e in edits:
            code = 0 if e == "I" else next(rows)
            total += price[e] + (3 if e in "KR" and code & dialogue.CUT_OFF else 0)
        assert total == cost and state in (dialogue.NONE, dialogue.ASSISTANT)


def test_schema(talks):
    assert dialogue.repair(talks([(1, 0, "user", "x")])).schema["cost"].dataType == T.LongType()
