"""Token ids of the public tokenizers, with a memo of the pieces that texts share."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from cueline.llm.texts import SPACES, mix, power_tables

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: How the byte-level vocabulary splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: How byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 on. Line ends are left out.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN) if b != 10}

#: White space beyond the six ASCII bytes: texts that have some are encoded in one go.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Longer parts are not remembered.
_LONG = 64


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file; nothing of it is copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts as the tokenizer does, computing each distinct part once while it is remembered.

    Texts are cut at spaces between two non-space characters. No piece of the byte-level split
    crosses such a place, so the ids of a text are those of its parts in order. Cutting, looking up and putting
    together are array operations over many texts; only new parts go through Python. Parts are known by a 64-bit hash
    and, as a check, 64 bits of their ends and length. At most ``remember`` parts are kept, in arrays of a fixed size
    each; forgetting only costs time. With ``special`` false, strings of special tokens in a text are ordinary
    text; else a text that has one is encoded in one go.
    """

    def __init__(self, path: str, remember: int = 2_000_000, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # what recurs is remembered here
        self.split = regex.compile(SPLIT).findall
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.places, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the split; one of letters goes to the tokenizer's model at once."""
        letters = piece[1:] if piece[:1] == " " else piece
        if not letters.isalpha():
            return self._whole(piece)
        if letters.isascii():
            spelt = "\u0120" + letters if letters is not piece else piece
        else:
            spelt = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [x.id for x in self.model.tokenize(spelt)]).tobytes()

    def _known(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > 300_000:
                self.pieces.clear()
            ids = self.pieces[piece] = self._piece(piece)
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a part, put together from known pieces where letters, a stop or a lone line end show them at once."""
        made, at, end = [], 0, part.find("\n")
        while end > at and (part[end - 1].isalpha() or part[end - 1] in ".,") and part[end + 1 : end + 2].isalpha():
            made += [self._line(part[at:end]), self._known("\n")]
            at, end = end + 1, part.find("\n", end + 1)
        return b"".join([*made, self._line(part[at:])])

    def _line(self, part: str) -> bytes:
        word = part[1:] if part[:1] == " " else part
        if word.isalpha():
            return self._known(part)
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self._known(part[:-1]) + self._known(part[-1])
        return b"".join([self._known(x) for x in self.split(part)])

    def _find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each part of ``data``; new ones are encoded and entered."""
        up, down = power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys, first, entry = np.unique(keys, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        padded = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
        wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
        ahead = np.minimum(b - a, 8).astype(np.uint64) * np.uint64(8)
        head = wide[a + 8].copy().view("<u8").ravel()
        head = np.where(ahead < 64, head & ~(~np.uint64(0) << np.minimum(ahead, np.uint64(63))), head)
        tail = wide[np.maximum(b, a)].copy().view(">u8").ravel()
        tail = np.where(ahead < 64, tail & ~(~np.uint64(0) << np.minimum(ahead, np.uint64(63))), tail)
        checks = mix(head) + mix(tail + np.uint64(0x51)) + (b - a).astype(np.uint64)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == keys) & (self.checks[near] == checks)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            made = [self._part(raw[x:y].decode()) for x, y in zip(a[new].tolist(), b[new].tolist())]
            sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
            places = len(self.pool) + np.cumsum(sizes) - sizes
            self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(made), "<u4")))
            where = at[new]
            self.keys = np.insert(self.keys, where, keys[new])
            self.checks = np.insert(self.checks, where, checks[new])
            self.places = np.insert(self.places, where, places)
            self.counts = np.insert(self.counts, where, sizes)
            at = at + np.cumsum(~known) - ~known  # entries before it
        return at[entry]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; None counts as empty."""
        out: list[bytes | None] = [None] * len(texts)
        rows, blobs = [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif _OTHER_SPACE.search(text) or (self.marks and any(m in text for m in self.marks)):
                out[i] = self._whole(text)
            else:
                rows.append(i)
                blobs.append(text.encode())
        if not rows:
            return out
        data = np.frombuffer(b"\n".join(blobs), np.uint8)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        begins = np.cumsum(sizes + 1) - sizes - 1
        ink = ~SPACES[data]
        cuts = np.flatnonzero((data[1:-1] == 32) & ink[:-2] & ink[2:]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        starts = np.sort(np.concatenate((begins, cuts)))
        firsts = np.searchsorted(starts, begins)
        ends = np.append(starts[1:], len(data))
        ends[firsts[1:] - 1] -= 1  # what stands between two texts
        long = np.flatnonzero(ends - starts > _LONG)
        entry = self._find(data, starts, np.where(ends - starts > _LONG, starts, ends))
        places, counts = self.places[entry].astype(np.int64), self.counts[entry].astype(np.int64)
        if len(long):
            raw = data.tobytes()
            made = [self._part(raw[x:y].decode()) for x, y in zip(starts[long].tolist(), ends[long].tolist())]
            counts[long] = np.fromiter(map(len, made), np.int64, len(made)) // 4
            places[long] = len(self.pool) + np.cumsum(counts[long]) - counts[long]
            pool = np.concatenate((self.pool, np.frombuffer(b"".join(made), "<u4")))
        else:
            pool = self.pool
        upto = np.cumsum(counts)
        ids = pool[np.repeat(places - (upto - counts), counts) + np.arange(upto[-1])]
        bounds = np.append((upto - counts)[firsts], upto[-1])
        for i, x, y in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[i] = ids[x:y].tobytes()
        if len(self.keys) > self.remember:
            self._forget()
        return out


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, special: bool = True) -> PieceEncoder:
    """The encoder of this Python worker; its memo lasts from task to task."""
    key = (path, special)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, special=special)
    return _encoders[key]


def in_slices(column, rows: int = 400, chars: int = 2_000_000):
    """Texts of an Arrow string column in slices that hold a bounded number of characters beyond one text."""
    own, size = [], 0
    for value in column:
        text = value.as_py() or ""
        own.append(text)
        size += len(text)
        if len(own) >= rows or size >= chars:
            yield own
            own, size = [], 0
    if own:
        yield own
