from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from changelore.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def shapes(rows: list[tuple]) -> list[tuple]:
    """(role, text, fault) in order."""
    seen, out = set(), []
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        shown = text.strip(SPACE)
        fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((role, text, fault, turn))
    return out


def spelled_out(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """Every string of edits and every choice of roles: the cheapest, then least audit, and its rows."""
    best = None
    for extra in range(5):
        for edits in itertools.product("DIKR", repeat=len(rows) + extra):
            if sum(e != "I" for e in edits) != len(rows):
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(e in "IR" for e in edits)):
                chosen, left, cost, out, fits = iter(roles), iter(rows), 0, [], True
                for e in edits:
                    if e == "I":
                        cost += 5
                        out.append((next(chosen), ""))
                        continue
                    role, text, fault, _ = next(left)
                    if e == "D":
                        cost += 2
                        continue
                    fits &= fault not in (1, 2)
                    cost += (e == "R") + 5 * (fault == 3)
                    out.append((role if e == "K" else next(chosen), text))
                if fits and GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)) and all(r for r, _ in out):
                    found = (cost, "".join(edits), [f"{r}:{t}" for r, t in out])
                    best = found if best is None else min(best, found)
    return best


def by_states(rows: list[tuple]) -> tuple[int, str, list[str]]:
    """The same by the best (cost, audit) of each prefix, with whole strings."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    front = {"": (0, "", ())}

    def with_inserts(front):
        for _ in range(2):
            for state, (cost, audit, out) in list(front.items()):
                to = follows[state]
                new = (cost + 5, audit + "I", (*out, f"{name[to]}:"))
                front[to] = min(front.get(to, new), new)
        return front

    for role, text, fault, _ in rows:
        after = {}
        for state, (cost, audit, out) in with_inserts(dict(front)).items():
            to = follows[state]
            options = [(state, (cost + 2, audit + "D", out))]
            if fault in (0, 3):
                dear = cost + 5 * (fault == 3)
                options.append((to, (dear + 1, audit + "R", (*out, f"{name[to]}:{text}"))))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    options.append((role[:1], (dear, audit + "K", (*out, f"{role}:{text}"))))
            for to, new in options:
                after[to] = min(after.get(to, new), new)
        front = after
    best = min(v for s, v in with_inserts(dict(front)).items() if s in ("", "a"))
    return best[0], best[1], list(best[2])


def expected(rows: list[tuple], solve) -> tuple:
    found = shapes([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows])
    cost, audit, out = solve(found)
    initials = [r[:1] for r, _, _, _ in found]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [t for *_, t in found if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [sum(f == k for _, _, f, _ in found) for k in (1, 2, 3)]
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(rng: random.Random, key, n: int) -> list[tuple]:
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "", None, "ünknown"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", None, "end. ", "ok. ", "x.", "y."]
    return [(key, rng.choice([None, i, i, i + 1, 2 * i]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_short_conversations_against_every_audit(table_of):
    rng = random.Random(7)
    rows = {k: random_rows(rng, k, rng.randint(1, 3)) for k in range(40)}
    got = C.repair(table_of([r for v in rows.values() for r in v], SCHEMA)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {k: expected(v, spelled_out) for k, v in rows.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_of_any_size(table_of, seed):
    rng = random.Random(seed)
    sizes = [1, 2, 5, 9, 30, 200, 700] * 6
    rows = {k: random_rows(rng, k, n) for k, n in enumerate(sizes)}
    rows[None] = random_rows(rng, None, 6)
    table = table_of([r for v in rows.values() for r in v], SCHEMA).withColumn("conv", F.lit(1)).withColumn("audit", F.lit("x"))
    got = C.repair(table).collect()
    assert len(got) == len(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {k: expected(v, by_states) for k, v in rows.items()}


def test_a_conversation_that_holds_most_rows(table_of):
    rng = random.Random(3)
    role = ["user", "assistant"]
    hot = [(5, i, role[i % 2] if rng.random() < 0.9 else rng.choice(["user", "assistant", "system"]), f"turn {i}" + rng.choice([".", ".", "?", ""])) for i in range(7000)]
    hot += [(5, None, "user", "again.")] * 30
    others = {k: random_rows(rng, k, 4) for k in range(6, 40)}
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(table_of(hot + [r for v in others.values() for r in v], SCHEMA)).collect()}
    assert got[5] == expected(hot, by_states)
    assert all(got[k] == expected(v, by_states) for k, v in others.items())


def test_blocks_chain_to_the_whole(spark):
    rng = random.Random(11)
    for _ in range(40):
        rows = shapes([(1, t, r or " ", x or " ") for _, t, r, x in random_rows(rng, 1, rng.randint(1, 60))])
        front = {C.START: (0, C.Prefix())}
        at = 0
        while at < len(rows):
            block = C.Block()
            for role, text, fault, turn in rows[at : at + rng.randint(1, 9)]:
                block.add(role, text, turn, fault)
            at += len(block.shapes)
            front = C.chain(front, block.table())
        cost, prefix = C.ending(front)
        assert (cost, prefix.text()) == by_states(rows)[:2]


def test_equal_hashes_of_different_prefixes_are_verified():
    same = C.Prefix(C.Prefix(), "K")
    x, y = C.Prefix(C.Prefix(same, "D"), "K"), C.Prefix(C.Prefix(same, "K"), "K")
    assert C.first_pieces_apart(x, y) == ("D", "K")
    x.up[0].hash = y.up[0].hash  # a planted collision one row back
    assert C.first_pieces_apart(x, y) == ("D", "K")


def test_long_texts_and_rows_without_conversation(table_of):
    text = "word " * 40_000 + "end."
    rows = [(1, 0, "user", text), (1, 1, "assistant", "Fine."), (2, 0, "user", text), (2, 0, "user", text)]
    table = table_of(rows, SCHEMA).withColumn("on", F.col("conv_id") == 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(table, present="on").collect()}
    assert got[1] == expected(rows[:2], by_states)
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(table.where("conv_id > 2")).count() == 0


def test_damage_follows_the_checksum(table_of):
    rows = [(c, t, "assistant", f"A. b! {c}?") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = C.damaged(table_of(rows, SCHEMA)).collect()
    found: dict = {}
    for r in got:
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["present"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = (
            "user" if kind == 4 else role,
            "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text,
            kind != 0,
        )
        assert found[c, t] == [want] * (2 if kind == 3 else 1)
