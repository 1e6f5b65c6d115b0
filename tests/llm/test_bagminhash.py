import random
from collections import Counter, defaultdict

import numpy as np

from cueline.llm.bagminhash import near_duplicates, signatures
from cueline.llm.texts import multisets, shingle_hashes


def bag(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_hand(rows):
    """Groups of rows by weighted Jaccard of 0.8 or more, or equal text: lists of places in ``rows``."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (rows[i][1] or "") == (rows[j][1] or "") or (low and low >= 0.8 * high):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return list(groups.values())


def expected(rows):
    """(doc_id, class_id, kept) of all rows; of rows with equal id and text any one may be the kept one."""
    out = []
    for group in by_hand(rows):
        ids = [rows[i][0] for i in group]
        least = min((i for i in ids if i is not None), default=None)
        kept = ids.index(least)
        out += [(i, least, k == kept) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def family(rng, n, copies, edits):
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(n)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


def test_large_buckets_without_an_original(spark, monkeypatch):
    import cueline.llm.bagminhash as own

    monkeypatch.setattr(own, "LARGE", 6)
    rng = random.Random(8)
    texts = family(rng, 100, 60, 6)[1:] + family(rng, 80, 60, 3)[1:] + family(rng, 60, 10, 1)
    rows = list(enumerate(texts))
    found = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_a_hub_dealt_to_many_parts(spark, monkeypatch):
    import cueline.llm.bagminhash as own

    rng = random.Random(11)
    texts = family(rng, 120, 80, 5) + family(rng, 70, 3, 2)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(0, b) for b in range(1, 81)] + [(81, 82), (81, 83)], "a long, b long")
    nodes = spark.createDataFrame([(i, t) for i, t in rows], "node long, text string")
    found = []
    for spread in (1000, 3):
        monkeypatch.setattr(own, "SPREAD", spread)
        found.append(sorted(map(tuple, own._verified(pairs, nodes, 0.8, 5).collect())))
        assert sorted(map(tuple, near_duplicates(spark, docs).collect()), key=str) == expected(rows)
    assert found[0] == found[1] and len(found[0]) == 82


def test_many_pairs_as_matrices():
    rng = random.Random(9)
    texts = [x * rng.choice([1, 2]) for x in family(rng, 40, 50, 12)]
    hashes, counts, begins = multisets(*shingle_hashes([x.encode() for x in texts]), len(texts))
    sets = [(hashes[a:b], counts[a:b]) for a, b in zip(begins, begins[1:])]
    x, y = np.triu_indices(len(sets), 1)
    from cueline.llm.bagminhash import _overlap, _overlaps

    assert np.allclose(_overlaps(sets, x, y), [_overlap(sets[i], sets[j]) for i, j in zip(x, y)], atol=1e-6)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "a b", "a b", "a  b", "a b c", "x " * 50, "x " * 49, "x " * 30]
    for n, copies, edits in ((300, 20, 12), (120, 12, 4), (60, 30, 3), (30, 10, 2), (9, 6, 1), (500, 25, 45)):
        texts += family(rng, n, copies, edits)
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (5000, "tail " * 7), (5000, "other words that are quite different")]
    rows += [(None, texts[20]), (None, texts[40]), (None, "no id at all here"), (None, "no id at all here")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, node string, row int")
    found = near_duplicates(spark, docs).collect()
    assert sorted(map(tuple, found), key=str) == expected(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.8):
        a = [f"w{i} " * 1 for i in range(400)]
        b = [w if rng.random() < share else f"v{w}" for w in a]
        pair = ["".join(a) * 3, "".join(b) * 2]
        hashes, counts, begins = multisets(*shingle_hashes([x.encode() for x in pair]), 2)
        signed = signatures(hashes, counts, begins, 4000)
        x, y = bag(pair[0]), bag(pair[1])
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs((signed[0] == signed[1]).mean() - true) < 5 * np.sqrt(max(true * (1 - true), 0.01) / 4000)


def test_null_ids_and_no_rows(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (7, text), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(spark, docs).collect()), key=str) == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (None, None, True)], key=str)
    assert near_duplicates(spark, docs.where("false")).count() == 0


def test_a_very_long_text_and_its_copy(spark):
    text = " ".join(f"w{i * i % 9973}" for i in range(200_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 3])]
    found = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_signatures_do_not_depend_on_the_slice():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(n)) * rng.choice([1, 3]) for n in [5, 16, 34, 64, 104] * 500]
    texts[:5] = [" ".join(f"v{i % m}" for i in range(n)) for n, m in ((5, 9), (16, 7), (34, 34), (64, 20), (104, 104))]
    blobs = [x.encode() for x in texts]
    whole = signatures(*multisets(*shingle_hashes(blobs), len(blobs)), 200)
    for part in ([0], [1], [2], [3], [4], range(5), range(40), range(300, 700)):
        own = [blobs[i] for i in part]
        assert np.array_equal(signatures(*multisets(*shingle_hashes(own), len(own)), 200), whole[list(part)])
