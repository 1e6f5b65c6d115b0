import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueline.llm.packing import best_fit, pack, sequences
from cueline.llm.scratch import Scratch
from cueline.llm.tokens import vocabulary


def test_bins_hold_all_items_once_and_are_few(spark):
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 3, rng.randrange(1, 101), rng.randrange(30, 60)]) for _ in range(700)] + [50] * 40 + [100] * 3
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = best_fit(Scratch(spark, "test"), items, 100).collect()
    assert sorted(r["item"] for r in rows) == list(range(len(sizes)))
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["offset"], sizes[r["item"]]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    assert len(bins) <= math.ceil(sum(sizes) / 100) * 1.02 + 1


def test_a_round_gives_the_least_gap_that_holds_an_item(spark):
    items = spark.createDataFrame([(0, 60), (1, 70), (2, 80), (3, 30), (4, 20), (5, 40)], "item long, length long")
    rows = {r["item"]: r["bin"] for r in best_fit(Scratch(spark, "test"), items, 100).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 5: 0}


def test_pieces_are_the_tokenizers_and_lie_gapless(spark):
    rng = random.Random(1)
    texts = ["", None, "one", "a b " * 40, "same", "same"] + [" ".join(rng.choice(["x", "the", "été"]) for _ in range(rng.randrange(300))) for _ in range(25)]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    packed = pack(spark, docs, size=64)
    rows = packed.collect()
    own = Tokenizer.from_file(vocabulary())
    expected = []
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((i if i != 4 else None, piece, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_places in places.values():
        at = 0
        for offset, n in sorted(own_places):
            assert offset == at
            at += n
        assert at <= 64
    named = docs.where(F.col("doc_id").isNotNull())
    built = {r["sequence_id"]: r["ids"] for r in sequences(named, packed.where("doc_id is not null")).collect()}
    assert sum(map(len, built.values())) == sum(r["length"] for r in rows if r["doc_id"] is not None)


def test_no_documents(spark):
    assert pack(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
