"""Cheapest repair of a conversation's structure, with the audit of its edits.

A conversation's rows and the states of the order ``(s?(ua)+)?`` of role initials span a graph with small integer costs.
Distances to the end come from a bucket queue; the audit walks tight arcs from the start, the least letter first.

Conversations are cut into pieces of bounded size, wherever Spark's ranges and that bound cut them. A conversation in one
piece is repaired at once. For others, a piece is a 4 x 4 matrix of distances between its ends: matrices combine from the
last piece on and give each piece the distances behind it; each piece walks from every state; walks combine from
the first piece on. Only matrices and end states of a conversation meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cueline.llm.scratch import Scratch

#: The white space of texts, and costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: A piece has at most so many rows, and so many characters beyond one row.
PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000

FAR = 1 << 60
FINE, DROP, CUT = 0, 1, 2
#: State behind a user row and behind an assistant row; -1: not in order. States: 0 nothing, 1 s, 2 ..u, 3 ..ua.
_USER, _ASSISTANT, _SYSTEM = (2, 2, -1, 2), (-1, -1, 3, -1), (1, -1, -1, -1)
_ON = {0: _SYSTEM, 1: _USER, 2: _ASSISTANT, 3: (-1, -1, -1, -1)}
#: What an insertion or a new role leads to from each state.
_ADDED = (2, 2, 3, 2)
_BACK = {t: [s for s in range(4) if _ADDED[s] == t] for t in range(4)}

_LINES = "array<struct<role:string,text:string>>"
PIECE = "conv_id long, part int, k int, open boolean, low long, high long, turns long, roles array<string>, texts array<string>"
REPAIRED = f"conv_id long, part int, k int, open boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines {_LINES}"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "part int, k int, codes binary, blank long, duplicate long, truncated long, illegal long, first string, last string, paths array<long>"


def read_codes(roles: list[str], texts: list[str], fresh: set[int] | None = None) -> tuple[bytes, list[int]]:
    """A byte for each row (role initial, and whether it must go or is truncated), and the numbers of blank, duplicate and truncated rows.

    ``fresh`` has the places of rows whose role and text weren't seen before; without it the rows themselves show that.
    """
    codes, counts, seen = bytearray(), [0, 0, 0], set()
    for i, (role, text) in enumerate(zip(roles, texts)):
        stripped = text.strip(BLANKS)
        old = (role, text) in seen if fresh is None else i not in fresh
        if fresh is None:
            seen.add((role, text))
        fault = 0 if not stripped else 1 if old else 2 if stripped[-1] not in ".!?" else 3
        if fault < 3:
            counts[fault] += 1
        codes.append("sua".find(role[:1]) % 4 * 3 + (DROP, DROP, CUT, FINE)[fault] if role else 9 + (DROP, DROP, CUT, FINE)[fault])
    return bytes(codes), counts


def distances(codes: bytes, end: list[int]) -> list[int]:
    """Least cost from each node (row * 4 + state) to the end, where each state has the cost ``end``: Dial's bucket queue."""
    n = len(codes)
    out = [FAR] * (4 * (n + 1))
    ends = [x for x in end if x < FAR]
    at = min(ends)
    width = max(ends) - at + REROLE + TRUNCATED + 1
    buckets: list[list[int]] = [[] for _ in range(width)]
    left = 0

    def reach(node: int, cost: int) -> None:
        nonlocal left
        if cost < out[node]:
            out[node] = cost
            buckets[cost % width].append(node)
            left += 1

    for s, cost in enumerate(end):
        if cost < FAR:
            reach(4 * n + s, cost)
    while left:
        bucket = buckets[at % width]
        while bucket:
            node = bucket.pop()
            left -= 1
            if out[node] != at:
                continue
            row, t = divmod(node, 4)
            for s in _BACK[t]:
                reach(node - t + s, at + INSERT)
            if not row:
                continue
            who, fault = divmod(codes[row - 1], 3)
            before = node - t - 4
            reach(before + t, at + DELETE)
            if fault != DROP:
                more = at + (TRUNCATED if fault == CUT else 0)
                for s in range(4):
                    if _ON[who][s] == t:
                        reach(before + s, more)
                for s in _BACK[t]:
                    reach(before + s, more + REROLE)
        at += 1
    return out


def walk(codes: bytes, found: list[int], state: int, last: bool) -> tuple[str, int]:
    """(letters of the edits, state behind them) along tight arcs from ``state``; only the last piece goes on behind its rows."""
    out, row, n = [], 0, len(codes)
    while row < n or (last and found[4 * n + state]):
        here = found[4 * row + state]
        if row < n and here == found[4 * row + 4 + state] + DELETE:
            out.append("D")
            row += 1
            continue
        if here == found[4 * row + _ADDED[state]] + INSERT:
            out.append("I")
            state = _ADDED[state]
            continue
        who, fault = divmod(codes[row], 3)
        kept = _ON[who][state]
        if fault != DROP and kept >= 0 and here == found[4 * row + 4 + kept] + (TRUNCATED if fault == CUT else 0):
            out.append("K")
            state = kept
        else:
            out.append("R")
            state = _ADDED[state]
        row += 1
    return "".join(out), state


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> list[dict]:
    """The rows that the edits of ``audit`` make, from ``state`` on."""
    out, row = [], 0
    for edit in audit:
        name = "assistant" if state == 2 else "user"
        if edit == "I":
            out.append({"role": name, "text": ""})
        elif edit == "R":
            out.append({"role": name, "text": texts[row]})
        elif edit == "K":
            out.append({"role": roles[row], "text": texts[row]})
        if edit == "K":
            state = _ON["sua".find(roles[row][:1]) % 4][state]
        elif edit != "D":
            state = _ADDED[state]
        row += edit != "I"
    return out


def illegal(initials: list[str]) -> int:
    """Neighbours that are not su, ua or au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _made(df: DataFrame, rows, ddl: str, size) -> DataFrame:
    """What ``rows`` makes of the batches of ``df``, sent on whenever what it holds passes a bound."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [], 0
        for row in rows(batches):
            own.append(row)
            held += size(row)
            if held > PIECE_CHARS or len(own) >= PIECE_ROWS:
                yield _batch(own, schema)
                own, held = [], 0
        if own:
            yield _batch(own, schema)

    return df.mapInArrow(run, ddl)


def cut(turns: DataFrame, rows: int = PIECE_ROWS, chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces of conversations (PIECE) in the order of (part, k); one is open if its conversation may have others.

    Rows are dealt to ranges of (conv_id, turn, role, head of the text), so a long conversation spreads over tasks, and
    sorted by the whole text. A task holds one piece. Nulls in role and text are one space; null conv_ids are one conversation.
    """

    def piece(conv, part, k, open_, own):
        known = [t for t, _, _ in own if t is not None]
        low, high = (known[0], known[-1]) if known else (None, None)
        return (conv, part, k, open_, low, high, len(set(known)), [r for _, r, _ in own], [x for _, _, x in own])

    def pieces(batches):
        part, k, own, held, conv = TaskContext.get().partitionId(), 0, [], 0, None
        first, several = True, False
        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own and (c != conv or len(own) >= rows or held >= chars):
                    several = several or c == conv
                    yield piece(conv, part, k, first or several, own)
                    k += 1
                    if c != conv:
                        first, several = False, False
                    own, held = [], 0
                conv = c
                own.append((turn, role, text))
                held += len(text)
        if own:
            yield piece(conv, part, k, True, own)

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    dealt = known.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return _made(dealt, pieces, PIECE, lambda r: sum(map(len, r[-1])))


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)


def _repair_whole(pieces: DataFrame) -> DataFrame:
    """Repaired conversations (REPAIRED) of pieces that are whole ones."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                roles, texts = r["roles"], r["texts"]
                codes, counts = read_codes(roles, texts)
                found = distances(codes, [0, FAR, FAR, 0])
                audit, _ = walk(codes, found, 0, True)
                lines = edited(roles, texts, audit)
                yield (r["conv_id"], r["part"], r["k"], False, _gaps(r["low"], r["high"], r["turns"]), *counts, illegal([x[:1] for x in roles]), found[0], audit, lines)

    return _made(pieces, rows, REPAIRED, lambda r: sum(len(x["text"]) for x in r[-1]))


def _summaries(pieces: DataFrame) -> DataFrame:
    """Codes, counts and distances between the ends (16, from state to state) of pieces of longer conversations."""
    role_text = F.col("x")
    rows = pieces.select("conv_id", "part", "k", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    mark = F.sha2(F.concat(F.length(role_text["roles"]).cast("string"), F.lit(":"), role_text["roles"], role_text["texts"]), 256)
    seen = rows.groupBy("conv_id", mark.alias("mark")).agg(F.min(F.struct("part", "k", "i")).alias("at"))
    fresh = seen.select("at.*").groupBy("part", "k").agg(F.collect_list("i").alias("fresh"))
    known = pieces.select("part", "k", "roles", "texts").join(fresh, ["part", "k"], "left")

    def summed(batches):
        for batch in batches:
            for r in batch.to_pylist():
                roles = r["roles"]
                codes, counts = read_codes(roles, r["texts"], set(r["fresh"] or ()))
                columns = [distances(codes, [0 if s == t else FAR for s in range(4)])[:4] for t in range(4)]
                paths = [columns[t][s] for s in range(4) for t in range(4)]
                yield (r["part"], r["k"], codes, *counts, illegal([x[:1] for x in roles]), roles[0][:1], roles[-1][:1], paths)

    return _made(known, summed, SUMMARY, lambda r: len(r[2]))


def _behind(pieces: pd.DataFrame) -> pd.DataFrame:
    """The distances behind each piece of a conversation, and what its pieces have together: gaps and illegal neighbours."""
    own = pieces.sort_values(["part", "k"]).reset_index(drop=True)
    end, ends = [0, FAR, FAR, 0], []
    for paths in reversed(own["paths"].tolist()):
        ends.append(end)
        end = [min(FAR, *(paths[4 * s + t] + end[t] for t in range(4))) for s in range(4)]
    known = own.dropna(subset=["low"])
    again = int((known["low"].iloc[1:].to_numpy() == known["high"].iloc[:-1].to_numpy()).sum())
    low, high = (int(known["low"].iloc[0]), int(known["high"].iloc[-1])) if len(known) else (None, None)
    gaps = _gaps(low, high, int(own["turns"].sum()) - again)
    borders = [illegal([a, b]) for a, b in zip(own["last"], own["first"].iloc[1:])]
    first = own.index == 0
    return pd.DataFrame({
        "part": own["part"], "k": own["k"], "end": ends[::-1], "closes": own.index == len(own) - 1,
        "gaps": [gaps if x else 0 for x in first], "cost": [end[0] if x else 0 for x in first], "border": [0, *borders],
    })


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state in which the walk enters each piece of a conversation."""
    own = pieces.sort_values(["part", "k"])
    state, states = 0, []
    for leaves in own["leaves"]:
        states.append(state)
        state = int(leaves[state])
    return pd.DataFrame({"part": own["part"], "k": own["k"], "entry": states})


def _repair_cut(scratch: Scratch, pieces: DataFrame) -> DataFrame:
    """Repaired pieces (REPAIRED) of conversations that are cut: counts of a conversation are the sums over its pieces."""
    coded = scratch.save(_summaries(pieces), "coded")
    spans = pieces.select("conv_id", "part", "k", "low", "high", "turns")
    light = spans.join(coded.select("part", "k", "first", "last", "paths"), ["part", "k"])
    behind = light.groupBy("conv_id").applyInPandas(_behind, "part int, k int, end array<long>, closes boolean, gaps long, cost long, border long")

    def walked(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = distances(r["codes"], r["end"])
                walks = [walk(r["codes"], found, s, r["closes"]) if found[s] < FAR else ("", 0) for s in range(4)]
                counts = (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"] + r["border"], r["cost"])
                yield (r["part"], r["k"], *counts, [a for a, _ in walks], [s for _, s in walks])

    kind = "part int, k int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audits array<string>, leaves array<int>"
    walks = scratch.save(_made(coded.join(behind, ["part", "k"]), walked, kind, lambda r: sum(map(len, r[-2]))), "walks")
    entries = walks.select("part", "k", "leaves").join(pieces.select("conv_id", "part", "k"), ["part", "k"]).groupBy("conv_id").applyInPandas(_entries, "part int, k int, entry int")
    chosen = walks.join(entries, ["part", "k"]).select("part", "k", *_COUNTS, "entry", F.get("audits", F.col("entry")).alias("audit"))

    def made(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lines = edited(r["roles"], r["texts"], r["audit"], r["entry"])
                yield (r["conv_id"], r["part"], r["k"], True, *(r[c] for c in _COUNTS), r["audit"], lines)

    texts = pieces.select("conv_id", "part", "k", "roles", "texts").join(chosen, ["part", "k"])
    return _made(texts, made, REPAIRED, lambda r: sum(len(x["text"]) for x in r[-1]))


def repair(spark: SparkSession, turns: DataFrame, rows: int = PIECE_ROWS, chars: int = PIECE_CHARS) -> DataFrame:
    """Repaired pieces (REPAIRED) of all conversations of ``turns`` (conv_id, turn, role, text): counts, cost, audit, and the repaired lines.

    Rows are taken by turn (null first), role and text. Nulls in role and text are one space; rows without conv_id are one
    conversation; repeated rows are duplicates; other columns aren't read. No rows: no pieces. A conversation that isn't open
    has one row; of others, pieces follow each other by (part, k), and counts and costs are to be summed.
    """
    scratch = Scratch(spark, "repair")
    pieces = scratch.save(cut(turns, rows, chars), "pieces")
    whole = _repair_whole(pieces.where("not open"))
    return whole.unionByName(_repair_cut(scratch, pieces.where("open")))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit and repaired_sha256 of every conversation, folded over its pieces in order.

    A digest needs its text in order, so pieces of one conversation pass through one task, which holds one of them and the audit.
    """
    kind = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def fold(batches):
        conv, sums, audits, digest, some = None, None, [], None, False
        close = lambda: (conv, *sums, "".join(audits), digest.hexdigest())
        for batch in batches:
            for r in batch.to_pylist():
                if sums is None or r["conv_id"] != conv or not r["open"]:
                    if sums is not None:
                        yield close()
                    conv, sums, audits, digest, some = r["conv_id"], [0] * len(_COUNTS), [], hashlib.sha256(), False
                sums = [a + r[c] for a, c in zip(sums, _COUNTS)]
                audits.append(r["audit"])
                for x in r["lines"]:
                    digest.update(f"{chr(10) if some else ''}{x['role']}:{x['text']}".encode())
                    some = True
        if sums is not None:
            yield close()

    run = lambda df: _made(df, fold, kind, lambda r: len(r[-2]))
    long = repaired.where("open").repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return run(repaired.where("not open")).unionByName(run(long))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with rows dropped, emptied, stripped of stops, repeated or given to the user, by a checksum of conversation and turn. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fate == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return turns.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def repair_damaged(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Damage ``turns``, repair what is left, and return a row for every conversation there was, also where no rows are left."""
    scratch = Scratch(spark, "repaired")
    repaired = scratch.save(repair(spark, damaged(turns)), "pieces")
    found = digests(repaired).withColumnRenamed("conv_id", "_own")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = every.join(found, F.col("conv_id").eqNullSafe(F.col("_own")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
