"""Prediction by partial matching over bytes, trained and applied on Spark.

The trie of byte contexts is kept as counts of (context, byte) runs of ``order`` + 1 bytes, one
long each; all shorter contexts are its marginals. A text stands between ``order`` bytes 0xFF
(never in UTF-8) and one 0xFF, which is the predicted end.

A byte is coded in its longest context of the training texts. There a byte seen n of N times gets
(n - 1/2) / N and the escape takes q / 2N for q distinct bytes (escape method D). After an escape
all bytes of that context are excluded from the counts of the next shorter one, down to a uniform
choice among what is left of the 256 values. Code lengths hence sum to one over all bytes.

The work goes in steps that each write a table:

1. texts are packed into chunks, which are dealt into blocks of about ``block_bytes``;
2. each block lists its distinct runs and words with their counts, in one packet for each bucket (a
   hash of the run or word, so that buckets are even however often a run occurs);
3. buckets add up the packets of all blocks;
4. runs go to shards by the last three bytes of their context, where all longer contexts are complete; a
   shard gives runs their code lengths. What three bytes share with other shards, the counts of byte triples, is broadcast: its size is
   bounded by the alphabet, not by the corpus;
5. buckets answer each packet of a block with code lengths and total counts in the same order;
6. each block is scored with its answers in one stream.

Packets are arrays of numbers, stored as compressed byte planes, so no run or word is a row of its own.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.scratch import Scratch

_U = np.uint64
WINDOW = 1 << 19
#: Bytes of text in a chunk, beyond one text.
CHUNK = 1 << 20
#: Blocks whose packets a bucket adds up.
BLOCKS_A_BUCKET = 4

#: kind 0: runs, 1: words, 2: sums of the bucket, 3: byte triples, 4: texts. ``part`` is a block, shard or triple.
PACKET = "kind int, bucket int, part int, n long, keys binary, values binary"
RUNS, WORDS, SUMS, TRIPLES, TEXTS = range(5)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 1):
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind=_U) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their compressed differences."""
    return pack(np.diff(x, prepend=_U(0)))


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n), dtype=_U)


def pack_words(words: list[bytes]) -> bytes:
    """Words (without white space) as compressed lines; their number and length in front."""
    joined = b"\n".join(words)
    return len(joined).to_bytes(8, "little") + pa.compress(joined, "zstd", asbytes=True)


def unpack_words(blob: bytes) -> list[bytes]:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd").to_pybytes().split(b"\n")


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "part": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "values": pa.binary()}
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _grouped(batches, key: int):
    """(key, rows) of packets sorted by their column ``key``; rows is an iterator that must be used up or left before the next."""
    from itertools import groupby

    def rows():
        for batch in batches:
            columns = [batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(6)]
            for i in range(batch.num_rows):
                yield (*(c[i] for c in columns[:4]), *(c[i].as_buffer().to_pybytes() if c[i].is_valid else b"" for c in columns[4:]))

    return groupby(rows(), key=lambda r: r[key])


def _join(blobs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with separators; for each blob its first predicted place and the place after its end."""
    gap = b"\xff" * order
    data = np.frombuffer(gap + gap.join(blobs) + gap, np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    starts = order + np.concatenate(([0], np.cumsum(sizes + order)[:-1]))
    return data, starts, starts + sizes + 1


def _windows(data: np.ndarray, order: int):
    """(first place, runs) of windows over all places from ``order`` on: each run ends with the place's byte."""
    for a in range(order, len(data), WINDOW):
        b = min(len(data), a + WINDOW)
        runs = np.zeros(b - a, _U)
        for k in range(order, -1, -1):
            runs = (runs << _U(8)) | data[a - k : b - k]
        yield a, runs


def _predicted(a: int, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the places of a window that belong to a text or its end."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.clip(starts - a, 0, n), 1)
    np.add.at(step, np.clip(ends - a, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def _first_of(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values.sort()
    first = _first_of(values)
    return values[first], np.diff(np.concatenate((first, [len(values)])))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    values = np.concatenate([x for x, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = _first_of(values)
    return values[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


class _Sum:
    """Counts of runs, merged when as many have come as there are already."""

    def __init__(self):
        self.parts, self.size, self.limit = [], 0, 1 << 22

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((values, counts))
        self.size += len(values)
        if self.size > self.limit:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])
            self.limit = max(1 << 22, 2 * self.size)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _merged(self.parts)


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, size, train, payload: rows (doc_id, text, held_out) as compressed Arrow streams of about ``CHUNK`` bytes."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            sizes = np.fromiter((len(x.as_buffer()) for x in batch.column(1)), np.int64, batch.num_rows)
            held = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            upto, a = np.cumsum(sizes), 0
            while a < batch.num_rows:
                before = upto[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(upto, before + CHUNK, side="right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([(part << 32) + k], pa.int64()), "size": pa.array([int(upto[b - 1] - before)], pa.int64()),
                        "train": pa.array([int((~held[a:b]).sum())], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                    }
                )
                a, k = b, k + 1

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "chunk long, size long, train long, payload binary")


def _texts(payload: bytes) -> tuple[pa.Table, list[bytes]]:
    table = pa.ipc.open_stream(payload).read_all()
    return table, [x.as_buffer().to_pybytes() for x in table.column("text")]


def _slices(blobs: list[bytes], size: int = 1_500_000):
    """Ranges of ``blobs`` of bounded length beyond one text."""
    a, held = 0, 0
    for b, blob in enumerate(blobs):
        if b > a and held >= size:
            yield a, b
            a, held = b, 0
        held += len(blob)
    if blobs:
        yield a, len(blobs)


def _statistics(dealt: DataFrame, order: int, buckets: int) -> DataFrame:
    """Packets of each block: its distinct runs and words with their counts in its training texts."""

    def run(batches):
        for block, rows in _grouped(batches, 2):
            sums, words = _Sum(), {}
            get = words.get
            for row in rows:
                table, blobs = _texts(row[4])
                held = np.asarray(table.column("held_out").to_numpy(zero_copy_only=False), bool)
                for train in (True, False):
                    own = [blobs[i] for i in np.flatnonzero(held != train)]
                    for a, b in _slices(own):
                        data, starts, ends = _join(own[a:b], order)
                        for at, runs in _windows(data, order):
                            values, counts = _counted(runs[_predicted(at, len(runs), starts, ends)])
                            sums.add(values, counts if train else np.zeros(len(counts), np.int64))
                        for blob in own[a:b]:
                            for w in blob.lower().split():
                                words[w] = get(w, 0) + train
            runs, counts = sums.total()
            bucket = _bucket(runs, buckets)
            named: list[list[bytes]] = [[] for _ in range(buckets)]
            for w in words:
                named[crc32(w) % buckets].append(w)
            for k in range(buckets):
                own = np.flatnonzero(bucket == k)
                out = []
                if len(own):
                    out.append((RUNS, k, block, len(own), pack_sorted(runs[own]), pack(counts[own])))
                if named[k]:
                    some = sorted(named[k])
                    out.append((WORDS, k, block, len(some), pack_words(some), pack(np.array([words[w] for w in some], np.int64))))
                if out:
                    yield _packets(out)

    return dealt.mapInArrow(run, PACKET)


def _bucket(runs: np.ndarray, buckets: int) -> np.ndarray:
    return (((runs * _U(0x9E3779B97F4A7C15)) >> _U(40)) % _U(buckets)).astype(np.int64)


def _shard(runs: np.ndarray, shards: int) -> np.ndarray:
    return ((((runs >> _U(8)) & _U(0xFFFFFF)) * _U(0x9E3779B97F4A7C15) >> _U(40)) % _U(shards)).astype(np.int64)


def _totals(statistics: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Packets of each bucket over all blocks: runs by shard, words, the sums of tokens and of seen words, and byte triples."""

    def run(batches):
        for bucket, rows in _grouped(batches, 1):
            sums, words = _Sum(), {}
            get = words.get
            for kind, _, _, n, keys, values in rows:
                if kind == RUNS:
                    sums.add(unpack_sorted(keys, n), unpack(values, n, np.int64))
                else:
                    for w, c in zip(unpack_words(keys), unpack(values, n, np.int64).tolist()):
                        words[w] = get(w, 0) + c
            runs, counts = sums.total()
            shard = _shard(runs, shards)
            for k in np.unique(shard).tolist():
                own = np.flatnonzero(shard == k)
                yield _packets([(RUNS, bucket, k, len(own), pack_sorted(runs[own]), pack(counts[own]))])
            seen = np.flatnonzero(counts)
            triples, n = _merged([(runs[seen] & _U(0xFFFFFF), counts[seen])])
            for i in range(0, len(triples), 50_000):
                x = triples[i : i + 50_000]
                nulls = pa.nulls(len(x), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), TRIPLES, np.int32)), pa.array(np.full(len(x), bucket, np.int32)), pa.array(x.astype(np.int32)), pa.array(n[i : i + 50_000]), nulls, nulls],
                    names=["kind", "bucket", "part", "n", "keys", "values"],
                )
            some = sorted(words)
            totals = np.array([words[w] for w in some], np.int64)
            # part 0: tokens, part 1: distinct words of training texts.
            out = [(SUMS, bucket, 0, int(totals.sum()), b"", b""), (SUMS, bucket, 1, int((totals > 0).sum()), b"", b"")]
            if some:
                out.append((WORDS, bucket, 0, len(some), pack_words(some), pack(totals)))
            yield _packets(out)

    return statistics.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, PACKET)


def _dense(contexts: np.ndarray, begins: np.ndarray, symbols: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """256 counts for each wanted context (zeros if it was never seen)."""
    out = np.zeros((len(wanted), 256))
    if len(contexts):
        at = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
        known = np.flatnonzero(contexts[at] == wanted)
        lo, n = begins[at[known]], begins[at[known] + 1] - begins[at[known]]
        rows = np.repeat(known, n)
        cells = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out[rows, symbols[cells]] = counts[cells]
    return out


def _level(runs: np.ndarray, counts: np.ndarray, size: int):
    """Contexts of ``size`` bytes with the counts of the bytes after them."""
    keep = _U((1 << (8 * (size + 1))) - 1)
    values, counts = _merged([(runs & keep, counts)])
    above = values >> _U(8)
    first = _first_of(above)
    return above[first], np.concatenate((first, [len(values)])), (values & _U(255)).astype(np.int64), counts


def code_lengths(runs: np.ndarray, counts: np.ndarray, order: int, triples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the last byte of each run.

    ``runs`` (sorted, distinct) must hold all training runs that share the last three bytes of their context
    with one of them; ``triples`` are all byte triples of the training texts with their counts.
    """
    seen = counts > 0
    levels = {k: _level(*triples, k) for k in range(3)}
    levels |= {k: _level(runs[seen], counts[seen], k) for k in range(min(3, order), order + 1)}
    out = np.zeros(len(runs))
    contexts, begins, _, n = levels[order]
    above = runs[seen] >> _U(8)
    if len(above):
        totals = np.add.reduceat(n, begins[:-1])
        out[seen] = np.log10((counts[seen] - 0.5) / totals[np.searchsorted(contexts, above)])
    novel = np.flatnonzero(~seen)
    for i in range(0, len(novel), 2048):
        at = novel[i : i + 2048]
        symbol = (runs[at] & _U(255)).astype(np.int64)
        left, excluded = np.ones(len(at)), np.zeros((len(at), 256), bool)
        done, row = np.zeros(len(at), bool), np.arange(len(at))
        for k in range(order, -1, -1):
            wanted = (runs[at] >> _U(8)) & _U((1 << (8 * k)) - 1)
            table = _dense(*levels[k], wanted)
            table[excluded] = 0
            total, kinds = table.sum(1), (table > 0).sum(1)
            mine = table[row, symbol]
            hit = ~done & (mine > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at[hit]] = np.log10(left[hit] * (mine[hit] - 0.5) / total[hit])
                left = np.where(total > 0, left * kinds / (2 * total), left)
            done |= hit
            excluded |= table > 0
        rest = ~done
        out[at[rest]] = np.log10(left[rest] / (256 - excluded[rest].sum(1)))
    return out


def _codes(totals: DataFrame, order: int, shards: int, triples) -> DataFrame:
    """Packets of runs and code lengths, for the bucket that each run came from."""

    def run(batches):
        for shard, rows in _grouped(batches, 2):
            own = [(bucket, unpack_sorted(keys, n), unpack(values, n, np.int64)) for _, bucket, _, n, keys, values in rows]
            runs, counts = (np.concatenate([x[k] for x in own]) for k in (1, 2))
            at = np.argsort(runs)
            codes = np.zeros(len(runs))
            codes[at] = code_lengths(runs[at], counts[at], order, triples.value)
            a = 0
            for bucket, part, _ in own:
                b = a + len(part)
                yield _packets([(RUNS, bucket, shard, b - a, pack_sorted(part), pack(codes[a:b]))])
                a = b

    sharded = totals.where(F.col("kind") == RUNS).repartitionById(shards, F.col("part")).sortWithinPartitions("part", "bucket")
    return sharded.mapInArrow(run, PACKET)


def _answers(codes: DataFrame, totals: DataFrame, statistics: DataFrame, buckets: int) -> DataFrame:
    """The packets of ``statistics`` with code lengths and total counts for their values."""

    def run(batches):
        for bucket, rows in _grouped(batches, 1):
            learnt, words, table = [], {}, None
            for kind, _, part, n, keys, values in rows:
                if kind >= 10:  # what the bucket knows comes first
                    if kind == 10 + RUNS:
                        learnt.append((unpack_sorted(keys, n), unpack(values, n, float)))
                    else:
                        words = dict(zip(unpack_words(keys), unpack(values, n, np.int64).tolist()))
                    continue
                if kind == RUNS:
                    if table is None:
                        table, known = (np.concatenate([x[k] for x in learnt]) for k in (0, 1))
                        at = np.argsort(table)
                        table, known = table[at], known[at]
                    found = known[np.searchsorted(table, unpack_sorted(keys, n))]
                else:
                    found = np.array([words[w] for w in unpack_words(keys)], np.int64)
                yield _packets([(kind, bucket, part, n, keys, pack(found))])

    known = codes.unionByName(totals.where(F.col("kind") == WORDS)).withColumn("kind", F.col("kind") + 10)
    both = known.unionByName(statistics).repartitionById(buckets, F.col("bucket"))
    return both.sortWithinPartitions("bucket", F.col("kind").desc(), "part").mapInArrow(run, PACKET)


class _Scorer:
    """What one block needs to know."""

    def __init__(self, order: int, scale: float):
        self.order, self.scale = order, scale
        self.runs, self.values, self.words, self.counts, self.slots = [], [], {}, [], None

    def learn(self, kind: int, n: int, keys: bytes, values: bytes) -> None:
        if kind == RUNS:
            self.runs.append(unpack_sorted(keys, n))
            self.values.append(unpack(values, n, float))
        else:
            self.words.update(zip(unpack_words(keys), range(len(self.words), len(self.words) + n)))
            self.counts.append(unpack(values, n, np.int64))

    def _ready(self) -> None:
        runs = np.concatenate(self.runs)
        at = np.argsort(runs)
        self.table, self.codes = runs[at], np.concatenate(self.values)[at]
        self.bits = _U(64 - min(24, max(12, int(len(runs)).bit_length() + 3)))
        self.slots = np.zeros(1 << int(_U(64) - self.bits), np.int32)
        self.slots[self._slot(self.table)] = np.arange(len(self.table), dtype=np.int32)
        self.runs = self.values = None
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        self.known, self.base = counts > 0, np.log10(counts + 0.5) - self.scale

    def _slot(self, runs: np.ndarray) -> np.ndarray:
        return (runs * _U(0x9E3779B97F4A7C15)) >> self.bits

    def _lookup(self, runs: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(runs)]
        missed = np.flatnonzero(self.table[at] != runs)
        at[missed] = np.searchsorted(self.table, runs[missed])
        return self.codes[at]

    def score(self, blobs: list[bytes]):
        """Numbers of words and known words, word scores and code lengths, without the end token of the word model."""
        if self.slots is None:
            self._ready()
        data, starts, ends = _join(blobs, self.order)
        scores = np.zeros(len(blobs))
        for a, runs in _windows(data, self.order):
            flags = _predicted(a, len(runs), starts, ends)
            values = np.zeros(len(runs))
            values[flags] = self._lookup(runs[flags])
            lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, a + len(runs))
            if hi > lo:
                scores[lo:hi] += np.add.reduceat(values, np.maximum(starts[lo:hi] - a, 0))
        n_words, n_known, base = (np.zeros(len(blobs), kind) for kind in (np.int64, np.int64, float))
        for i, blob in enumerate(blobs):
            found = blob.lower().split()
            at = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            n_words[i], n_known[i], base[i] = len(found), self.known[at].sum(), self.base[at].sum()
        return n_words, n_known, base, scores


def _score(rows: DataFrame, order: int, total: int, scale: float, n_docs: int) -> DataFrame:
    end = math.log10(n_docs + 0.5) - scale

    def run(batches):
        for _, packets in _grouped(batches, 2):
            own = _Scorer(order, scale)
            for kind, _, _, n, keys, values in packets:
                if kind != TEXTS:
                    own.learn(kind, n, keys, values)
                    continue
                table, blobs = _texts(keys)
                table = table.combine_chunks()
                for a, b in _slices(blobs):
                    n_words, n_known, base, scores = own.score(blobs[a:b])
                    part = table.slice(a, b - a).to_batches()[0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0), part.column(2), pa.array(n_words + 1), pa.array(n_known + (n_docs > 0)),
                            pa.array(np.full(b - a, total)), pa.array(base + end), pa.array(scores),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def score_documents(spark: SparkSession, docs: DataFrame, order: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, held_out) with its code length under the model of those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (a smoothed word count model, with which to
    compare) and score (log10 probability of the text and its end). Null texts are empty: only their end is scored.
    A null id is kept. Repeated rows count and are scored as often as they occur. Without training texts each byte
    gets 1/256. An empty table gives no rows. Other columns are not read. ``order`` may be 2 to 6.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    scratch = Scratch(spark, "ppm")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    chunks = scratch.save(_chunks(own), "texts")
    size, n_docs = chunks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    blocks = max(8, -(-size // block_bytes))
    buckets = max(8, -(-blocks // BLOCKS_A_BUCKET))
    shards = min(buckets, 1 << 12)
    block = F.pmod(F.xxhash64("chunk"), F.lit(blocks)).cast("int").alias("part")
    none = lambda name: F.lit(None).cast("binary").alias(name)
    texts = chunks.select(F.lit(TEXTS).alias("kind"), F.lit(0).alias("bucket"), block, F.lit(0).cast("long").alias("n"), F.col("payload").alias("keys"), none("values"))

    dealt = texts.repartitionById(blocks, F.col("part")).sortWithinPartitions("part")
    statistics = scratch.save(_statistics(dealt, order, buckets), "statistics")
    totals = scratch.save(_totals(statistics, buckets, shards), "totals")
    sums = {r["part"]: r["n"] for r in totals.where(F.col("kind") == SUMS).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    # At most 2**24 triples, whatever the input.
    found = totals.where(F.col("kind") == TRIPLES).groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    at = np.argsort(found.column("part").to_numpy())
    triples = spark.sparkContext.broadcast((found.column("part").to_numpy()[at].astype(_U), found.column("n").to_numpy()[at]))
    codes = scratch.save(_codes(totals, order, shards, triples), "codes")
    answers = _answers(codes, totals, statistics, buckets)

    total = sums.get(0, 0) + n_docs
    scale = math.log10(total + 0.5 * (sums.get(1, 0) + (n_docs > 0) + 1))
    rows = answers.unionByName(texts).repartitionById(blocks, F.col("part")).sortWithinPartitions("part", "kind", "bucket")
    return _score(rows, order, total, scale, n_docs)
