"""Byte-level BPE by merge ranks: piece boundaries by a scan of transition functions, merges cached by piece, offsets kept.

The split that precedes the merges is a small automaton over classes of code points. A code point is a function from
states to states, and composing functions is associative, so the states before all code points of many texts come
from a scan over blocks: compose within each block, scan the blocks' functions, run each block from its entry state.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm.scratch import Scratch
from cueline.llm.texts import edge_checks, mix, power_tables
from cueline.llm.tokens import in_slices, vocabulary

# Classes of code points: white space, numbers, letters that can stand in a short form behind an apostrophe, and others.
SPACE, WHITE, NUMBER, OTHER, APOSTROPHE, STMD, LL, RV, EE, LETTER, END = range(11)
# What the match that a code point goes on has so far. QUOTE: an apostrophe that began it; QUOTE_L and QUOTE_RV: one and
# the first of two letters; SHORT: a whole short form; ONE_*: one white code point; MORE_*: several, named by the last.
START, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_L, QUOTE_RV, SHORT, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(12)
STATES = 12
#: Flags of a step: a match begins at this code point, and one begins at the code point before it.
HERE, BEFORE = 1, 2
_ROWS = 64
#: Longer pieces are merged alone and not remembered.
LONG = 64
_ENCODED = "doc_id long, ids array<int>, starts array<int>"


def _fresh(c: int) -> int:
    """The state behind the first code point of a match."""
    if c >= STMD and c != END:
        return LETTERS
    return {SPACE: ONE_SPACE, WHITE: ONE_WHITE, NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: QUOTE, END: START}[c]


def _joined(c: int) -> int:
    """The state behind a space and one more code point of the same match."""
    return OTHERS if c == APOSTROPHE else _fresh(c)


def step(state: int, c: int) -> tuple[int, int]:
    """(next state, flags) of a code point of class ``c``: the split of byte-level vocabularies, one code point at a time."""
    letter, white, kind = STMD <= c < END, c in (SPACE, WHITE), _fresh(c)
    if state == QUOTE:
        if letter:
            return {STMD: (SHORT, 0), LL: (QUOTE_L, 0), RV: (QUOTE_RV, 0)}.get(c, (LETTERS, HERE))
        return (OTHERS, 0) if c in (OTHER, APOSTROPHE) else (kind, HERE)
    if state in (QUOTE_L, QUOTE_RV):
        if c == (LL if state == QUOTE_L else EE):
            return SHORT, 0
        return (LETTERS, BEFORE) if letter else (kind, BEFORE | HERE)
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        if white:
            return (MORE_SPACE if c == SPACE else MORE_WHITE), 0
        if c == END or state == ONE_WHITE:
            return kind, HERE
        if state == MORE_WHITE:
            return kind, BEFORE | HERE
        return _joined(c), (BEFORE if state == MORE_SPACE else 0)
    goes_on = (state == LETTERS and letter) or (state == NUMBERS and c == NUMBER) or (state == OTHERS and c in (OTHER, APOSTROPHE))
    return (state, 0) if goes_on else (kind, HERE)


_steps = [step(s, c) for c in range(END + 1) for s in range(STATES)]
NEXT = np.array([x for x, _ in _steps], np.uint8)
FLAGS = np.array([x for _, x in _steps], np.uint8)


def states_before(classes: np.ndarray) -> np.ndarray:
    """The automaton's state before each code point, from START, by a blocked scan of transition functions."""
    n = len(classes)
    rows = -(-n // _ROWS)
    padded = np.full(rows * _ROWS, END, np.uint8)
    padded[:n] = classes
    turned = np.ascontiguousarray(padded.reshape(rows, _ROWS).T).astype(np.int16) * STATES
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in turned:
        whole = NEXT[column[:, None] + whole]
    reach = 1
    while reach < rows:  # whole[i] becomes the function of all blocks up to i
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.concatenate((np.zeros(1, np.uint8), whole[:-1, START]))
    out = np.empty((_ROWS, rows), np.uint8)
    for k, column in enumerate(turned):
        out[k] = state
        state = NEXT[column + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def match_starts(classes: np.ndarray) -> np.ndarray:
    """Places where a match begins; each END is a place of its own."""
    flags = FLAGS[classes.astype(np.int16) * STATES + states_before(classes)]
    begins = (flags & HERE) > 0
    begins[:-1] |= (flags[1:] & BEFORE) > 0
    return np.flatnonzero(begins)


def class_table() -> np.ndarray:
    """The class of each code point. Letters, numbers and white space are what the tokenizer's own library takes for them."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, OTHER, np.uint8)
    for sign, kind in ((r"\s", WHITE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        own = tiktoken.Encoding("classes", pat_str=sign, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(own.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    for signs, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("l", LL), ("rv", RV), ("e", EE)):
        table[[ord(x) for x in signs]] = kind
    return table


class RankEncoder:
    """Ids and byte offsets of whole texts, with a memo of pieces.

    A piece is known by a 64-bit hash and, as a check, its ends and length. At most ``remember`` pieces are kept, in arrays
    of a fixed size each; forgetting only costs time. New pieces are merged together, one merge a round in each.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.remember = remember
        self.classes = class_table()
        self.none = max(self.ranks.values()) + 1
        parts = {rank: part for part, rank in self.ranks.items()}
        spelt = [parts.get(i, b"") for i in range(self.none)]
        self.lengths = np.fromiter(map(len, spelt), np.int64, self.none)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        find = self.ranks.get
        pairs = [(x * self.none + y, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (x := find(t[:i])) is not None and (y := find(t[i:])) is not None]
        keys, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pairs, self.merges = keys[order], ranks[order]
        # Tokens that their own bytes don't merge to are looked up whole.
        made, counts = self._merged(self.letters, self.begins, self.begins + self.lengths)
        ends = np.cumsum(counts)
        self.whole = {t for i, t in enumerate(spelt) if t and (counts[i] != 1 or made[ends[i] - 1] != i)}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.places, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; ``none`` where it has none."""
        keys = left * self.none + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.merges[at], self.none)

    def _merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each): each round merges the leftmost of a piece's pairs of least rank."""
        sizes = ends - starts
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids = self.single[data[np.repeat(starts - (upto - sizes), sizes) + np.arange(total)]]
        rank = np.full(total, self.none)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self._rank(ids[same], ids[same + 1])
        done = [(owner[:0], ids[:0])]
        while len(ids):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            widths = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == self.none, widths)
            if over.any():
                done.append((owner[over], ids[over]))
                owner, ids, rank = owner[~over], ids[~over], rank[~over]
                widths, least = widths[least < self.none], least[least < self.none]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, widths))
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            owner, ids, rank = owner[keep], ids[keep], rank[keep]
            at = at - np.arange(len(at))
            rank[at] = self.none
            touched = np.union1d(at, at - 1)
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self._rank(ids[touched], ids[touched + 1])
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(sizes))

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and the number of each; tokens that don't come of merges are taken whole."""
        ids, counts = self._merged(data, starts, ends)
        if not self.whole:
            return ids, counts
        own = [bytes(data[a:b]) for a, b in zip(starts, ends)]
        cuts = np.split(ids, np.cumsum(counts)[:-1])
        lists = [np.array([self.ranks[x]], np.uint32) if x in self.whole else y for x, y in zip(own, cuts)]
        return np.concatenate([ids[:0], *lists]), np.array([len(x) for x in lists], np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length, in time n log n: a heap of its pairs by rank and place."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, middle, end = heapq.heappop(pairs)
            if ends[i] != middle or middle >= n or ends[middle] != end:
                continue  # one of the two was merged meanwhile
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(pairs, (r, i, end, ends[end]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(pairs, (r, j, i, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's entry of each piece of ``data``; new ones are merged and entered."""
        up, down = power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys, first, entry = np.unique(keys, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        checks = edge_checks(data, a, b)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == keys) & (self.checks[near] == checks)
        if not known.all():
            new = np.flatnonzero(~known)
            ids, counts = self._pieces(data, a[new], b[new])
            places = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate((self.pool, ids))
            where = at[new]
            self.keys, self.checks = np.insert(self.keys, where, keys[new]), np.insert(self.checks, where, checks[new])
            self.places, self.counts = np.insert(self.places, where, places), np.insert(self.counts, where, counts)
            at = at + np.cumsum(~known) - ~known  # entries before it
        return at[entry]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, byte offset of each token in its text's UTF-8) of each text; None counts as empty."""
        blobs = [(t or "").encode() for t in texts]
        if not any(blobs):
            return [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * len(texts)
        raw = b"\n".join(blobs)
        points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        places = np.cumsum(widths) - widths
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        begins = np.cumsum(sizes + 1) - sizes - 1
        classes = self.classes[points]
        between = np.searchsorted(places, begins[1:] - 1)
        classes[between] = END
        at = match_starts(classes)
        starts = places[at]
        ends = np.append(starts[1:], len(raw))
        own = classes[at] != END
        starts, ends = starts[own], ends[own]
        data = np.frombuffer(raw, np.uint8)
        long = np.flatnonzero(ends - starts > LONG)
        entry = self._find(data, starts, np.where(ends - starts > LONG, starts, ends))
        where, counts, pool = self.places[entry].astype(np.int64), self.counts[entry].astype(np.int64), self.pool
        if len(long):
            made = [np.array(self.merged(raw[x:y]), np.uint32) for x, y in zip(starts[long].tolist(), ends[long].tolist())]
            counts[long] = [len(x) for x in made]
            where[long] = len(pool) + np.cumsum(counts[long]) - counts[long]
            pool = np.concatenate((pool, *made))
        upto = np.cumsum(counts)
        ids = pool[np.repeat(where - (upto - counts), counts) + np.arange(upto[-1])]
        first = np.append(0, upto)[np.searchsorted(starts, np.append(begins, len(raw) + 1))]
        spans = self.lengths[ids]
        offsets = np.cumsum(spans) - spans
        tokens = np.cumsum(sizes) - sizes  # of the text in the tokens' bytes, which have nothing between texts
        if len(self.keys) > self.remember:
            self._forget()
        return [(ids[x:y], offsets[x:y] - t) for x, y, t in zip(first[:-1].tolist(), first[1:].tolist(), tokens.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``."""
        ids = np.asarray(ids, np.int64)
        spans = self.lengths[ids]
        upto = np.cumsum(spans)
        if not len(ids):
            return b""
        return self.letters[np.repeat(self.begins[ids] - (upto - spans), spans) + np.arange(upto[-1])].tobytes()


_encoders: dict[str, RankEncoder] = {}


def rank_encoder(path: str) -> RankEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = RankEncoder(path)
    return _encoders[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    upto = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts of every row of ``docs`` (doc_id, text): token ids and the byte offset of each in the text's UTF-8.

    Null and empty texts have empty lists; repeated and null doc_ids are rows like others; other columns aren't read.
    No rows give no rows. A task holds slices of 2 million characters, or one text where it is longer.
    """
    Scratch(docs.sparkSession, "bpe")  # bounds what a worker gets at a time
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches):
        own = rank_encoder(path)
        for batch in batches:
            at = 0
            for texts in in_slices(batch.column(1)):
                found = own.encode(texts)
                columns = [batch.column(0).slice(at, len(texts)), _lists([x for x, _ in found]), _lists([x for _, x in found])]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, path: str | None = None, first: int = 0, n: int | None = None) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids, or only the ``n`` from the byte ``first`` on.

    For a range, the kept offsets show which tokens have bytes in it, and only those are decoded.
    """
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    names = ["doc_id", "ids", "starts", "decoded"]

    def run(batches):
        own = rank_encoder(path)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, starts = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                a, b = 0, len(ids)
                if n is not None or first:
                    a = max(int(np.searchsorted(starts, first, "right")) - 1, 0)
                    b = len(ids) if n is None else int(np.searchsorted(starts, first + n))
                data = own.decode(ids[a:b])
                skip = first - int(starts[a]) if b > a else 0
                data = data[skip:] if n is None else data[skip : skip + n]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), pa.array([data], pa.binary())], names=names)

    return encoded.select("doc_id", "ids", "starts").mapInArrow(run, f"{_ENCODED}, decoded binary")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: each text is encoded, and its ids are decoded again."""
    both = decode(encode(docs, path), path)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
