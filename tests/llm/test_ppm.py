import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from cueline.llm.ppm import held_out, score_documents

A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))


def by_hand(rows, order):
    tries = [defaultdict(Counter) for _ in range(order + 1)]
    train = [t for i, t in rows if i is None or crc32(str(i).encode()) % 5 != 1]
    for t in train:
        data = b"\xff" * order + (t or "").encode() + b"\xff"
        for p in range(order, len(data)):
            for k in range(order + 1):
                tries[k][data[p - k : p]][data[p]] += 1
    words = Counter(w for t in train for w in tokens(t))
    ends, n = len(train), sum(words.values()) + len(train)
    scale = n + 0.5 * (len(words) + (ends > 0) + 1)

    def code(context, byte):
        left, excluded = 1.0, set()
        for k in range(order, -1, -1):
            found = {b: c for b, c in tries[k][context[order - k :]].items() if b not in excluded}
            total = sum(found.values())
            if byte in found:
                return math.log10(left * (found[byte] - 0.5) / total)
            if total:
                left *= len(found) / (2 * total)
            excluded |= set(found)
        return math.log10(left / (256 - len(excluded)))

    out = []
    for i, t in rows:
        data = b"\xff" * order + (t or "").encode() + b"\xff"
        score = sum(code(data[p - order : p], data[p]) for p in range(order, len(data)))
        own = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / scale) for w in own) + math.log10((ends + 0.5) / scale)
        known = sum(words[w] > 0 for w in own) + (ends > 0)
        held = i is not None and crc32(str(i).encode()) % 5 == 1
        out.append((i, held, len(own) + 1, known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def run(spark, rows, order=4):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held_out string")
    docs = docs.withColumn("held_out", held_out())
    found = score_documents(spark, docs, order=order, block_bytes=2000).collect()
    return sorted([(*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in found], key=str)


def close(found, expected):
    assert [r[:6] for r in found] == [r[:6] for r in expected]
    assert [r[6] for r in found] == pytest.approx([r[6] for r in expected], rel=1e-6)


def test_scores_equal_a_trie_by_hand(spark):
    rng = random.Random(3)
    parts = ["the ", "An", "on ", "é", "\t", "ing ", "x", "\x1c", "z\n", "Ü "]
    rows = [(i, "".join(rng.choice(parts[: 4 + i % 7]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(101, None), (102, ""), (None, "the on ing"), (7, rows[7][1]), (200, "never seen QJ€ " * 30)]
    close(run(spark, rows), by_hand(rows, 4))
    for order in (2, 3, 5):
        close(run(spark, rows, order), by_hand(rows, order))


def test_no_training_text_and_no_rows(spark):
    held = next(i for i in range(100) if crc32(str(i).encode()) % 5 == 1)
    close(run(spark, [(held, "ab")]), by_hand([(held, "ab")], 4))
    assert run(spark, []) == []


def test_texts_beyond_a_window_are_summed_whole(spark, monkeypatch):
    rows = [(i, ("abc de" * (i + 1))) for i in range(12)]
    import cueline.llm.ppm as ppm

    data, starts, ends = ppm._join([t.encode() for _, t in rows], 4)
    whole = [len(t) + 1 for _, t in rows]
    monkeypatch.setattr(ppm, "WINDOW", 7)
    got = [0] * len(rows)
    for a, runs in ppm._windows(data, 4):
        flags = ppm._predicted(a, len(runs), starts, ends)
        for p in range(a, a + len(runs)):
            if flags[p - a]:
                got[next(i for i in range(len(rows)) if starts[i] <= p < ends[i])] += 1
    assert got == whole
