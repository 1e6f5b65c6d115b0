import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.llm import toxicity


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def sparse(rows):
    terms = np.array([t for r in rows for t in r], np.int64)
    return toxicity.Rows(terms, np.array([w for r in rows for w in r.values()]), np.cumsum([0, *map(len, rows)]))


@pytest.mark.parametrize("full", [1, 8, 30])
def test_block_max_search_is_exact(full):
    rng = random.Random(2)
    rows = [{t: rng.random() for t in rng.sample(range(30), rng.randrange(6))} for _ in range(500)] + [{3: 0.5}] * 20
    index = toxicity.BlockMaxIndex(sparse(rows), 30, block=16, full=full)
    queries = [{t: rng.random() for t in rng.sample(range(30), 3)} for _ in range(40)] + [{}, {3: 1.0}]
    found, cosines = index.search(sparse(queries), 10)
    for q, own, values in zip(queries, found, cosines):
        scores = [round(sum(w * r.get(t, 0) for t, w in q.items()), 10) for r in rows]
        best = sorted((i for i in range(len(rows)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:10]
        assert [i for i in own if i >= 0] == best
        assert np.allclose(values[: len(best)], [scores[i] for i in best]) and not values[len(best) :].any()
    assert index.searched < len(queries) * index.blocks


def by_hand(rows, labels, examples=4000):
    """doc_id -> score from the definition: every text against every example."""
    bag = lambda t: Counter(w[k : k + 4] for w in re.findall(r"[^\W_]+", (t or "").lower()) for k in range(0, len(w), 4))
    texts = dict(rows)
    label = {}
    for i, y in labels:
        if y in (0, 1) and i in texts:
            label[i] = max(y, label.get(i, 0))
    n = len(rows)
    df = Counter(t for _, x in rows for t in bag(x))
    known = {t for i in label for t in bag(texts[i])}

    def vector(t):
        own = {k: c * math.log((n + 1) / (df[k] + 0.5)) for k, c in bag(t).items() if k in known}
        norm = math.sqrt(sum(w * w for w in own.values()))
        return {k: w / norm for k, w in own.items()}

    held = sorted((texts[i] or "", y, i) for i, y in label.items())
    vectors = [vector(t) for t, _, _ in held]
    bare = [y for (_, y, _), v in zip(held, vectors) if not v]
    prior = sum(bare) / len(bare) if bare else 0.0

    def vote(v, leave=None):
        cos = [(round(sum(w * u.get(k, 0) for k, w in v.items()), 10), -j) for j, u in enumerate(vectors) if j != leave]
        best = sorted((c for c in cos if c[0] > 0), reverse=True)[:25]
        total = sum(c**4 for c, _ in best)
        return sum(c**4 * held[-j][1] for c, j in best) / total if total else prior

    votes = sorted((vote(v, j), held[j][1]) for j, v in enumerate(vectors))
    blocks = []
    for x, y in votes:
        blocks.append([x, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a, b = blocks.pop(), blocks.pop()
            blocks.append([p + q for p, q in zip(a, b)])
    xs, ys = [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]
    out = {}
    for i, t in rows:
        v = vector(t)
        share = vote(v)
        out[i] = 0.99 * float(np.interp(share, xs, ys)) + 0.01 * share if v else prior
    return out


def corpus():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.randrange(80)}x" for _ in range(30)]
        if i % 5 == 0:
            words[rng.randrange(30)] = rng.choice(["grumble", "blastfoo", "blastbar"])
        rows.append((i, " ".join(words)))
        if i < 220:
            labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (902, "? !"), (903, "W1x_blastoff"), (904, rows[10][1])]
    return rows, labels + [(900, 0), (5000, 1), (3, None), (4, 1), (7, 3)]


def test_scores_equal_brute_force(spark):
    rows, labels = corpus()
    docs = docs_of(spark, [(*r, "clash", 1) for r in rows], ", score string, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(spark, docs.repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    expected = by_hand(rows, labels)
    assert set(found) == set(expected)
    for i, score in expected.items():
        assert found[i]["score"] == pytest.approx(score, abs=1e-6), i
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.3)
    assert found[10]["score"] == found[904]["score"] and found[900]["score"] == found[901]["score"]
    assert found[0]["evidence"][0]["toxic"] == 1


def test_toxic_texts_are_found(spark):
    rows, labels = corpus()
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(spark, docs_of(spark, rows + [(None, "the Blastfoo")]), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    hits = sum(found[i]["predicted"] == int(i % 5 == 0) for i in range(300))
    assert hits >= 290
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_no_labels_no_rows_and_repeated_ids(spark):
    rows, labels = corpus()
    docs = docs_of(spark, rows)
    none = toxicity.score_toxicity(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("score")).first()[0] == 0
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.score_toxicity(spark, docs.where("false"), own).count() == 0
    twice = docs.unionByName(docs_of(spark, [(0, "another text of the same id"), (1, None)]))
    runs = [sorted(toxicity.score_toxicity(spark, twice.repartition(k), own).select("doc_id", "score").collect(), key=str) for k in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows) + 2


def test_a_very_long_text_is_scored_whole(spark):
    rows, labels = corpus()
    long = " ".join(f"w{i % 80}x" for i in range(200_000)) + " blastfoo" * 40_000
    found = toxicity.score_toxicity(spark, docs_of(spark, [*rows, (7000, long)]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert found.where("doc_id = 7000").first()["predicted"] == 1


def test_terms_cover_words():
    """What stands behind the fourth letter of a word counts, to its end."""
    assert toxicity.bag("Abcdefghij, ab_cdé x") == Counter(["abcd", "efgh", "ij", "ab", "cdé", "x"])
    assert toxicity.bag("wordwordA") != toxicity.bag("wordwordB")
