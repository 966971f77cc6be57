"""Repairs against a search through all edits, over pieces of any length."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from spotweave.llm import turn_repair
from spotweave.llm.turn_repair import AFTER_A, AFTER_S, AFTER_U, START

TURN = {"u": AFTER_U, "a": AFTER_A}
FITS = {START: "su", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}


def least_by_force(rows, entry=START, ends=(START, AFTER_A)):
    """The least (cost, audit), from the last row backwards."""

    @cache
    def rest(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in ends else []
        new = [(c, TURN[c]) for c in FITS[q] if c in TURN]
        if inserted < 3:
            found += [(cost + 3, "I" + a) for _, t in new for cost, a in rest(i, t, inserted + 1)]
        if i < len(rows):
            c, fault = rows[i]
            found += [(cost + 4, "D" + a) for cost, a in rest(i + 1, q, 0)]
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                if c and c in FITS[q]:
                    found += [(cost + more, "K" + a) for cost, a in rest(i + 1, AFTER_S if c == "s" else TURN[c], 0)]
                found += [(cost + 3 + more, "R" + a) for _, t in new for cost, a in rest(i + 1, t, 0)]
        return [min(found)] if found else []

    for i in range(len(rows), -1, -1):  # so that no call goes deep
        for q in range(4):
            rest(i, q, 0)
    return (rest(0, entry, 0) or [None])[0]


def some_rows(rng, n):
    return [(rng.choice("suauauauo "), rng.choice(["", "", "", "t", "b", "d"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_search_from_both_ends(seed):
    rng = random.Random(seed)
    for n in [*range(7)] * 12 + [25]:
        rows = some_rows(rng, n)
        assert turn_repair.least_edits(rows) == least_by_force(rows)
        for p in range(4):
            for q in range(4):
                assert turn_repair.least_edits(rows, p, (q,)) == least_by_force(rows, p, (q,))


def test_pieces_multiply_to_the_whole():
    rng = random.Random(9)
    for n in (1, 5, 40):
        rows = some_rows(rng, n)
        for size in (1, 3, 7):
            ways = turn_repair.product([turn_repair.ways_through(rows[k : k + size]) for k in range(0, n, size)])
            assert min(v for (p, q), v in ways.items() if p == START and q in (START, AFTER_A)) == least_by_force(rows)


def by_force(turns):
    """The result rows for turns after damage (with ``gone``)."""
    out = []
    for conv in {t[0] for t in turns}:
        own = sorted([t for t in turns if t[0] == conv and not t[4]], key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        faults, seen = [], set()
        for _, _, role, text, _ in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        firsts = [t[2][:1] for t in own]
        cost, audit = least_by_force([*zip(firsts, faults, strict=True)])
        lines, state, at = [], START, 0
        for letter in audit:
            if letter == "I":
                state = TURN[next(c for c in FITS[state] if c in TURN)]
                lines.append(("user:", "assistant:")[state == AFTER_A])
                continue
            _, _, role, text, _ = own[at]
            at += 1
            if letter == "K":
                state = AFTER_S if role[0] == "s" else TURN[role[0]]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = TURN[next(c for c in FITS[state] if c in TURN)]
                lines.append(f"{('user', 'assistant')[state == AFTER_A]}:{text}")
        numbers = {t[1] for t in own if t[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts[:-1], firsts[1:], strict=True))
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def damaged_by_force(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text, fate == 0)] * (2 if fate == 3 else 1)
    return out


def test_odd_conversations(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool"]
    texts = ["A full text.", "cut off", "Really?", " \n\t", "", None, "é!\n", "dots... ", "A full text."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in (None, 1, 2, 5, None)]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 7 else "same.") for t in range(1500)]  # several pieces
    rows += [(101, 0, "user", "word " * 200_000 + "."), (101, 1, "assistant", "ok."), (101, 1, "assistant", "ok."), (102, None, None, None)]
    clash = "conv_id long, turn long, role string, text string, gone string, key string, audit long, _at long"
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], clash).repartition(5)
    made = turn_repair.damaged(df)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, damaged_by_force(rows)))
    got = turn_repair.repair(made, gone=F.col("gone")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, by_force(damaged_by_force(rows))))
    assert turn_repair.repair(df.limit(0)).collect() == []


def test_plain_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Hello."), (3, 4, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in turn_repair.repair(df).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK"), 3: (4, "D")}
