import hashlib
import random
import re
from itertools import product
from zlib import crc32

import pytest

from cueline.llm import repair

SPACE = " \t\n\x0b\x0c\r"
KIND = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        ink = [c for c in text if c not in SPACE]
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by plain search over all prefixes: the least (cost, audit) of every (row, initials' shape)."""
    found = faults(rows)
    best = {(0, ""): (0, "", [])}
    shapes = lambda s: re.fullmatch(r"s?(ua)*u?", s)
    short = lambda s: s if len(s) < 3 else ("ua" if s.endswith("a") else "uau")
    done = None
    for i in range(len(rows) + 1):
        for _ in range(3):  # two insertions lead back
            for (k, shape), (cost, audit, made) in list(best.items()):
                if k == i:
                    for role in ("user", "assistant"):
                        if shapes(shape + role[0]):
                            key, new = (i, short(shape + role[0])), (cost + 3, audit + "I", [*made, (role, "")])
                            if key not in best or new[:2] < best[key][:2]:
                                best[key] = new
        if i == len(rows):
            done = min(v[:2] + (v[2],) for (k, shape), v in best.items() if k == i and (shape == "" or shape.endswith("a")))
            break
        role, text = rows[i]
        for (k, shape), (cost, audit, made) in list(best.items()):
            if k != i:
                continue
            moves = [(4, "D", None)]
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] else 0
                moves += [(more, "K", role), *((more + 3, "R", x) for x in ("user", "assistant"))]
            for price, letter, who in moves:
                if who is not None and not (who and shapes(shape + who[0])):
                    continue
                key = (i + 1, short(shape + who[0]) if who is not None else shape)
                new = (cost + price, audit + letter, made + ([(who, text)] if who is not None else []))
                if key not in best or new[:2] < best[key][:2]:
                    best[key] = new
    return done


def brute(rows):
    """The whole row of a conversation from its (turn, role, text)."""
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    lines = [(r, t) for _, r, t in own]
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = faults(lines)
    bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
    cost, audit, made = cheapest(lines)
    return (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def test_every_short_conversation():
    """All sequences of up to five rows: cost and audit are those of a plain search."""
    kinds = [("system", "S{}."), ("user", "u{}."), ("assistant", "a{}"), ("user", " "), ("tool", "t{}.")]
    for n in range(6):
        for picks in product(kinds, repeat=n):
            rows = [(r, t.format(i)) for i, (r, t) in enumerate(picks)]
            roles, texts = [r for r, _ in rows], [t for _, t in rows]
            codes, _ = repair.read_codes(roles, texts)
            dist = repair.distances(codes, [0, repair.FAR, repair.FAR, 0])
            audit, _ = repair.walk(codes, dist, 0, True)
            lines = repair.edited(roles, texts, audit)
            assert (dist[0], audit, [(x["role"], x["text"]) for x in lines]) == cheapest(rows), rows


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(25), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No", " \n", "", None, "what?", f"{turn}!", "a ", "x. \t", "long " * 300])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 2]), role, text))
    return rows


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_repair_is_that_of_a_plain_search(spark, size):
    rows = conversations(size)
    found = repair.digests(repair.repair(spark, spark.createDataFrame(rows, KIND).repartition(4), rows=size))
    found = {r[0]: tuple(r)[1:] for r in found.collect()}
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert found == {conv: brute(own) for conv, own in held.items()}


def test_a_long_conversation_is_many_pieces(spark):
    rows = [(1, i, ("user", "assistant")[i % 7 % 2], f"text {i % 50}." if i % 11 else "cut") for i in range(3000)]
    repaired = repair.repair(spark, spark.createDataFrame(rows, KIND), rows=64)
    assert repaired.where("open").count() >= 3000 // 64 and repaired.agg({"part": "max"}).first()[0] >= 0
    assert tuple(repair.digests(repaired).first())[1:] == brute([r[1:] for r in rows])


def test_damage_and_whole_result(spark):
    rows = [(c, t, ("system", "user", "assistant")[0 if t == 0 else 1 + (t + 1) % 2], f"Text {c} {t}. More!") for c in range(60) for t in range(c % 9)]
    rows += [(None, 1, "user", "x."), (None, None, None, None), *((-k, 0, "user", "one.") for k in range(100, 140))]
    held = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        fate = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        held[c] += [(t, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{KIND}, audit string, part int").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(spark, frame).collect()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert none in found.values()
    assert found == {c: brute(own) if own else none for c, own in held.items()}
    assert repair.repair_damaged(spark, spark.createDataFrame([], KIND)).count() == 0
