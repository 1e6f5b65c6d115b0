"""Words and word shingles of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: The ASCII bytes that separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

WORDS = 5
HASH_BITS = 48

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        up = np.full(size, _BASE, _U)
        down = np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def edge_checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the first and last eight bytes of spans, and their length: a check beside a hash of all bytes."""
    padded = np.concatenate((np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    bits = np.minimum(ends - starts, 8).astype(_U) * _U(8)
    keep = np.where(bits < 64, ~(~_U(0) << np.minimum(bits, _U(63))), ~_U(0))
    head, tail = (wide[at].copy().view(order).ravel() & keep for at, order in ((starts + 8, "<u8"), (ends, ">u8")))
    return mix(head) + mix(tail + _U(0x51)) + (ends - starts).astype(_U)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no ASCII white space."""
    space = np.ones(len(data) + 2, np.int8)
    space[1:-1] = SPACES[data]
    edges = np.flatnonzero(np.diff(space))
    return edges[::2], edges[1::2]


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``blobs`` in order, and the number of words before each blob (one more entry)."""
    data = np.frombuffer(b" ".join(blobs), np.uint8)
    starts, ends = word_spans(data)
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    return hashes, np.searchsorted(starts, begins)


def shingle_hashes(blobs: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all runs of ``words`` words, and the blob of each; a shorter text is one shingle of all its words."""
    hashes, before = word_hashes(blobs)
    counts = np.diff(before)
    total = np.zeros(len(hashes), _U)
    for k in range(min(words, len(hashes))):
        total[: len(hashes) - k] += mix(hashes[k:] + _U(k + 1))
    owner = np.repeat(np.arange(len(blobs)), counts)
    place = np.arange(len(hashes)) - before[owner]
    full = place + words <= counts[owner]
    out, own = total[full], owner[full]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.array(
            [mix(hashes[before[i] : before[i + 1]] + np.arange(1, counts[i] + 1, dtype=_U)).sum(dtype=_U) for i in short], _U
        )
        out, own = np.concatenate((out, extra)), np.concatenate((own, short))
    return mix(out) >> _U(64 - HASH_BITS), own


def multisets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) in order: hashes, their counts, and the first place of each owner (``n`` + 1 entries)."""
    keys = (owner.astype(_U) << _U(HASH_BITS)) | hashes
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    begins = np.searchsorted(keys, np.arange(n + 1, dtype=_U) << _U(HASH_BITS))
    return keys & _U((1 << HASH_BITS) - 1), counts, begins


def slices(values, rows: int = 400, size: int = 1_500_000):
    """Lists of UTF-8 texts (None: empty) of bounded length in all, beyond one text."""
    own, held = [], 0
    for value in values:
        blob = value.as_buffer().to_pybytes() if value.is_valid else b""
        own.append(blob)
        held += len(blob)
        if len(own) >= rows or held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own
