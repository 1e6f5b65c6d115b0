import random
import re

import pytest

from cueline.operators import fuzzy

KIND = "film string, id long, text string"


def tokens(text):
    return {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(a, b, least):
    def distinct(rows):
        out = {}
        for film, k, text in rows:
            if text is not None and tokens(text):
                out.setdefault((film, text), []).append(k)
        return out

    found = []
    for (film, x), i in distinct(a).items():
        for (other, y), j in distinct(b).items():
            p, q = tokens(x), tokens(y)
            if film == other and len(p & q) >= least * len(p | q):
                jaccard, ratio = len(p & q) / len(p | q), 1 - levenshtein(x, y) / max(len(x), len(y))
                found.append((film, min(i), min(j), len(i), len(j), round(jaccard, 9), round(ratio, 9), round(max(jaccard, ratio), 9)))
    return sorted(found)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least * 10))
    vocabulary = ["the", "the", "a", "of", "Go", "go", "home", "now", "né", "日本", "x1", "don't", "well"]
    line = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "! "]) for _ in range(rng.randrange(7)))
    a, b = ([(rng.choice("pq"), k, rng.choice([line(), line(), line(), "same line", None])) for k in range(70)] for _ in range(2))
    found = fuzzy.fuzzy_pairs(spark.createDataFrame(a, KIND), spark.createDataFrame([(*r, "x") for r in b], KIND + ", j string"), ["film"], "id", "text", least)
    assert sorted((*r[:5], *(round(v, 9) for v in r[5:])) for r in found.collect()) == brute(a, b, least)


def test_copies_are_one_pair(spark):
    rows = [("p", k, "all of one text") for k in range(300)]
    frame = spark.createDataFrame(rows, KIND)
    assert [tuple(r) for r in fuzzy.fuzzy_pairs(frame, frame, ["film"], "id", "text").collect()] == [("p", 0, 0, 300, 300, 1.0, 1.0, 1.0)]
    empty = spark.createDataFrame([], KIND)
    assert fuzzy.fuzzy_pairs(empty, frame, ["film"], "id", "text").count() == 0


def test_hybrid_scores(spark):
    texts = spark.createDataFrame([("p", 1, 1, 0.9), ("p", 1, 2, 0.5), ("p", 1, 3, 0.5)], "film string, i long, j long, score double")
    vectors = spark.createDataFrame([("p", 1, 1, 1.0), ("p", 1, 2, 0.8), ("p", 2, 2, 0.7)], "film string, i long, j long, value double")
    found = {(r["i"], r["j"]): (r["text_score"], r["cosine"], round(r["score"], 9)) for r in fuzzy.hybrid_pairs(texts, vectors, ["film"]).collect()}
    assert found == {(1, 1): (0.9, 1.0, 0.9), (1, 2): (0.5, 0.8, 0.72), (1, 3): (0.5, None, 0.5), (2, 2): (None, 0.7, 0.63)}
