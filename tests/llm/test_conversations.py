"""Repair of conversations against dynamic programming over whole audits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from spanloom.llm import conversations
from spanloom.llm.conversations import damaged, repair_conversations, repaired_damage
from spanloom.llm.queries import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CLASHING = ["id", "sha", "fault", "chunk", "at", "first", "shape", "before", "after", "size", "edit", "case"]
WHITE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA)
    for k, name in enumerate(CLASHING):
        made = made.withColumn(name, made["turn"] + k)
    return made.repartition(3)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def outputs(rows, length):
    """All roles a repaired conversation of so many rows may have."""
    if length == 0:
        return [""]
    return [("s" * (length % 2)) + "ua" * (length // 2)] if length % 2 == 0 or length > 2 else []


def by_trying(rows):
    """Cheapest audit by trying all of them, for a few rows."""
    found = []
    marks = faults(rows)
    for inserted in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            audit = "".join("I" * k + e for k, e in zip(inserted, letters)) + "I" * inserted[-1]
            if any(e != "D" and m in ("blank", "duplicate") for e, m in zip(letters, marks)):
                continue
            for roles in outputs(rows, sum(c != "D" for c in audit)):
                cost, out, row, ok, left = 0, [], iter(zip(rows, marks)), True, iter(roles)
                for c in audit:
                    if c == "I":
                        role = next(left)
                        ok, cost = ok and role != "s", cost + 3
                        out.append({"u": "user:", "a": "assistant:", "s": ""}[role])
                        continue
                    (_, role, text), mark = next(row)
                    if c == "D":
                        cost += 4
                        continue
                    want = next(left)
                    cost += 3 if mark == "truncated" else 0
                    if c == "K":
                        ok = ok and role[:1] == want
                        out.append(f"{role}:{text}")
                    else:
                        ok, cost = ok and want != "s", cost + 3
                        out.append(f"{'user' if want == 'u' else 'assistant'}:{text}")
                if ok:
                    found.append((cost, audit, "\n".join(out)))
    return min(found)


def by_rows(rows):
    """Cheapest audit row by row, whole audits and repaired rows carried along."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "", ())}

    def inserted(best):
        for _ in range(3):
            more = dict(best)
            for p, (cost, audit, out) in best.items():
                q = after[p]
                way = (cost + 3, audit + "I", (*out, ("user:", "assistant:")[q == 3]))
                more[q] = min(more.get(q, way), way)
            best = more
        return best

    for (_, role, text), mark in zip(rows, faults(rows)):
        new = {}
        for p, (cost, audit, out) in inserted(best).items():
            ways = [(p, (cost + 4, audit + "D", out))]
            if mark not in ("blank", "duplicate"):
                cost += 3 if mark == "truncated" else 0
                q = after[p]
                if role[:1] == "s" and p == 0:
                    ways.append((1, (cost, audit + "K", (*out, f"{role}:{text}"))))
                if role[:1] == " ua"[q - 1]:
                    ways.append((q, (cost, audit + "K", (*out, f"{role}:{text}"))))
                ways.append((q, (cost + 3, audit + "R", (*out, f"{('user', 'assistant')[q == 3]}:{text}"))))
            for q, way in ways:
                new[q] = min(new.get(q, way), way)
        best = new
    cost, audit, out = min(v for p, v in inserted(best).items() if p in (0, 3))
    return cost, audit, "\n".join(out)


def expected(rows, cheapest=by_rows):
    """Totals, audit and hash of one conversation, its rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marks, initials = faults(rows), [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, text = cheapest(rows)
    return (gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "U", " "]
    texts = ["Hi.", "Yes!", "what", "", " \n", "Well?\n ", "é 😀", "no end,", "ok. "]
    return [(rng.choice([None, *range(n + 3)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", str(rng.randrange(3)) + "."])) for _ in range(n)]


def test_brute_forces_agree():
    rng = random.Random(4)
    for _ in range(150):
        rows = in_order(random_rows(rng, rng.randrange(4)))
        assert by_trying(rows) == by_rows(rows)


@pytest.mark.parametrize("chunk_rows", [1, 3, 4096])
def test_repair(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    data = {k: random_rows(rng, rng.randrange(1, 14)) for k in range(120)}
    data[500] = [(k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(300)]
    data[501] = random_rows(rng, 400)
    data[None] = random_rows(rng, 9)
    rows = [(k, *r) for k, rs in data.items() for r in rs]
    repair = repair_conversations(frame(spark, rows), chunk_rows=chunk_rows)
    totals = {r["conv_id"]: tuple(r)[1:] for r in repair.totals.collect()}
    digests = {r["conv_id"]: tuple(r)[1:] for r in repair.digests().collect()}
    assert totals.keys() == digests.keys() == data.keys()
    for k, rs in data.items():
        assert (*totals[k], *digests[k]) == expected(in_order(rs)), k
    out = defaultdict(str)
    for r in repair.rows.orderBy("chunk", "at", "step").collect():
        out[r["conv_id"]] += r["role"][:1]
    assert all(re.fullmatch("s?(ua)+", o) for o in out.values())


def planted(rows):
    """The damage of the contract, row by row."""
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        by[conv_id]
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            by[conv_id] += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return by


def test_damage_and_repair(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(9)]), rng.choice([None, "system", "user", "assistant"]), rng.choice([None, "", "A.", "b c", "d?\n"])) for _ in range(300)]
    rows += [(900, 5, "user", "only row"), (901, 0, "user", "x" * 100_000), (901, 1, "assistant", "y." * 200_000)]
    rows += [next((k, 0, "user", "dropped") for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)]
    got = {r[0]: tuple(r)[1:] for r in repaired_damage(frame(spark, rows)).collect()}
    want = {k: expected(in_order(rs)) for k, rs in planted(rows).items()}
    assert got == want
    assert any(not rs for rs in planted(rows).values())
    assert repaired_damage(frame(spark, [])).count() == 0
    assert damaged(frame(spark, rows)).columns == ["conv_id", "turn", "role", "text"]


def test_crossings_hold_no_table(monkeypatch):
    """One long chunk is solved with vectors of four states only, and as well as row by row."""
    rng = random.Random(2)
    rows = in_order(random_rows(rng, 700))
    code = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    steps = [conversations.row_step(r[1][:1] if r[1][:1] in "sua" else "", code[m]) for r, m in zip(rows, faults(rows))]
    front = conversations.only(0)
    for s in steps:
        front = conversations._forward(front, s)
    states = conversations.crossings(steps, 0, conversations.final_state(front), rows=True)
    audit = "".join(s[p][q][1] for s, p, q in zip(steps, states, states[1:])) + "I" * conversations.TRAILING[states[-1]]
    assert audit == by_rows(rows)[1]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in op12_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: expected(in_order(rs)) for k, rs in planted(map(tuple, rows)).items()}
