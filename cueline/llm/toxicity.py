"""Toxicity by nearest labelled examples: exact TF-IDF cosine of whole texts over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.scratch import Scratch

#: The bound of the sample that is learnt from: labelled texts of each class, bytes of a text, and bytes of a class, at most.
EXAMPLES, TEXT_BYTES, CLASS_BYTES = 4000, 1 << 20, 64 << 20
#: Letters of a term: a word is cut into terms of so many from its start to its end, so that the forms of a word meet and nothing is left out.
LETTERS = 4
NEIGHBOURS, SHARPNESS = 25, 4.0
#: Rows of a block, and how many of the most frequent terms have their postings as a full array.
BLOCK, FULL = 256, 640
CUT = 0.3
#: Texts that are scored together.
SLICE = 200

_TERM = re.compile(rf"[^\W_]{{1,{LETTERS}}}")


def bag(text: str | None) -> Counter:
    """How often a text has each term; empty for null."""
    return Counter(_TERM.findall(text.lower())) if text else Counter()


class Rows:
    """Sparse rows: terms and weights of row i stand at ``begins[i]`` to ``begins[i + 1]``."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, begins: np.ndarray):
        self.terms, self.weights, self.begins = terms, weights, begins

    def __len__(self) -> int:
        return len(self.begins) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, term, weight) of all entries of some rows."""
        n = self.begins[rows + 1] - self.begins[rows]
        at = np.repeat(self.begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.terms[at], self.weights[at]


def unit_rows(terms: np.ndarray, counts: np.ndarray, begins: np.ndarray, idf: np.ndarray) -> Rows:
    """Unit vectors of term count times IDF."""
    weights = counts * idf[terms]
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    norms = np.sqrt(np.bincount(owner, weights * weights, len(begins) - 1))
    return Rows(terms, weights / norms[owner], begins)


class _Postings:
    """Entries by key: those of key k stand at ``begins[k]`` to ``begins[k + 1]``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int):
        order = np.argsort(keys, kind="stable")
        self.values, self.weights = values[order], weights[order]
        self.begins = np.searchsorted(keys[order], np.arange(n + 1)).astype(np.int32)

    def add(self, out: np.ndarray, rows: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> None:
        """out[row, value] += weight * posting's weight for all postings of the keys."""
        first = self.begins[keys]
        n = self.begins[keys + 1] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(rows * out.shape[1], n) + self.values[at]
        out += np.bincount(cell, np.repeat(weights, n) * self.weights[at], out.size).reshape(out.shape)


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of rows with the greatest weight of each term in each block.

    Rows that are alike share a block. A search sums the greatest weights of a query's terms to a bound of what a block's
    rows can reach, looks at the block with the highest bound first, and then at those whose bound is not below the least
    of the best ``k`` so far. The result is that of comparing with every row. Queries are taken many at a time, as arrays. The most
    frequent terms have their postings as full arrays, since most rows have them.
    """

    def __init__(self, rows: Rows, n_terms: int, block: int = BLOCK, full: int = FULL):
        self.block, self.n, self.searched = block, len(rows), 0
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(rows.begins))
        common = np.argsort(-np.bincount(rows.terms, minlength=n_terms), kind="stable")[:full]
        self.place = np.full(n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        # Rows whose heaviest frequent term is the same follow each other.
        cell = np.flatnonzero(self.place[rows.terms] >= 0)
        column, weight = self.place[rows.terms[cell]], rows.weights[cell]
        dense = np.zeros((self.n, len(common)), np.float32)
        dense[owner[cell], column] = weight
        self.order = np.lexsort((-dense.max(1, initial=0), dense.argmax(1) if dense.size else np.zeros(self.n)))
        del dense
        rank = np.empty(self.n, np.int32)
        rank[self.order] = np.arange(self.n)
        self.blocks = max(1, -(-self.n // block))
        padded = np.zeros((self.blocks * block, len(common)))
        padded[rank[owner[cell]], column] = weight
        del cell, column, weight
        self.dense = padded.reshape(self.blocks, block, -1)
        self.dense_most = self.dense.max(1)
        cell = np.flatnonzero(self.place[rows.terms] < 0)
        terms, weights, row = rows.terms[cell].astype(np.int32), rows.weights[cell], rank[owner[cell]]
        del cell, owner
        # By block and term: the postings of each block, and each term's greatest weight in each block that has it.
        order = np.lexsort((terms, row // block))
        terms, weights, row = terms[order], weights[order], row[order]
        del order
        bounds = np.searchsorted(row // block, np.arange(self.blocks + 1))
        self.sparse = [_Postings(terms[a:b], row[a:b] % block, weights[a:b], n_terms) for a, b in zip(bounds, bounds[1:])]
        first = np.flatnonzero((np.diff(terms, prepend=-1) != 0) | (np.diff(row // block, prepend=-1) != 0))
        most = np.maximum.reduceat(weights, first) if len(first) else np.zeros(0)
        self.most = _Postings(terms[first], row[first] // block, most, n_terms)

    def search(self, queries: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the rows and cosines of the ``k`` nearest; of equal ones those with the least numbers. Row -1 and cosine 0: none."""
        m = len(queries)
        rows, cosines = np.full((m, k), -1), np.zeros((m, k))
        owner, terms, weights = queries.take(np.arange(m))
        at = self.place[terms]
        full, rare = at >= 0, at < 0
        dense = np.zeros((m, self.dense.shape[2]))
        dense[owner[full], at[full]] = weights[full]
        bounds = dense @ self.dense_most.T
        self.most.add(bounds, owner[rare], terms[rare], weights[rare])
        rest = Rows(terms[rare], weights[rare], np.searchsorted(owner[rare], np.arange(m + 1)))
        lead = bounds.argmax(1)
        for first in (True, False):
            for b in range(self.blocks):
                if first:
                    own = np.flatnonzero((lead == b) & (bounds[:, b] > 0))
                else:
                    own = np.flatnonzero((lead != b) & (bounds[:, b] > 0) & (bounds[:, b] + 1e-9 >= cosines[:, -1]))
                if not len(own):
                    continue
                self.searched += len(own)
                score = dense[own] @ self.dense[b].T
                self.sparse[b].add(score, *rest.take(own))
                score = np.round(score, 10)
                better = (score >= cosines[own, -1:]) & (score > 0)
                hit = better.any(1)
                own, score, better = own[hit], score[hit], better[hit]
                names = np.full(self.block, -1)
                some = self.order[b * self.block : (b + 1) * self.block]
                names[: len(some)] = some
                # The candidates of this block, as many columns as the fullest query has.
                width = min(self.block, max(k, int(better.sum(1).max(initial=0))))
                cut = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < self.block else np.tile(np.arange(self.block), (len(own), 1))
                found = np.concatenate((rows[own], names[cut]), axis=1)
                value = np.concatenate((cosines[own], np.take_along_axis(score, cut, axis=1)), axis=1)
                value[found < 0] = 0
                found[value <= 0] = -1
                best = np.lexsort((np.where(found < 0, self.n, found), -value), axis=1)[:, :k]
                rows[own], cosines[own] = np.take_along_axis(found, best, axis=1), np.take_along_axis(value, best, axis=1)
        return rows, cosines


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares non-decreasing fit of y on x, by pooling neighbours."""
    order = np.argsort(x, kind="stable")
    blocks = []
    for a, b, c in zip(x[order], y[order], w[order]):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    found = np.array(blocks).reshape(-1, 3)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


class Model:
    """Examples and their index. Its size is bounded by that of the sample, whatever the corpus."""

    def __init__(self, names: list, toxic: np.ndarray, number: dict[str, int], idf: np.ndarray, rows: Rows, weight: np.ndarray):
        self.names, self.toxic, self.number, self.idf, self.rows = names, toxic, number, idf, rows
        self._index = None
        bare = np.diff(rows.begins) == 0
        self.prior = float((weight * toxic)[bare].sum() / weight[bare].sum()) if bare.any() else 0.0

    @property
    def index(self) -> BlockMaxIndex:
        """Built where it is first searched: each worker has its own, the driver none."""
        if self._index is None:
            self._index = BlockMaxIndex(self.rows, len(self.number))
        return self._index

    def vectors(self, bags: list) -> Rows:
        """Terms that no example has are left out: they match nothing."""
        find, terms, counts, begins = self.number.get, [], [], [0]
        for own in bags:
            for t, n in own.items():
                k = find(t)
                if k is not None:
                    terms.append(k)
                    counts.append(n)
            begins.append(len(terms))
        return unit_rows(np.array(terms, np.int64), np.array(counts, float), np.array(begins), self.idf)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by a power of the cosine; without any the share among texts without terms."""
        w = cosines**SHARPNESS
        total = w.sum(1)
        share = (w * np.where(found >= 0, self.toxic[found], 0)).sum(1) / np.maximum(total, 1e-300)
        return np.where(total > 0, share, self.prior)

    def left_out(self, own: np.ndarray) -> np.ndarray:
        """What the other examples vote for some of them."""
        owner, terms, weights = self.rows.take(own)
        found, cosines = self.index.search(Rows(terms, weights, np.searchsorted(owner, np.arange(len(own) + 1))), NEIGHBOURS + 1)
        itself = found == own[:, None]
        itself[~itself.any(1), -1] = True
        return self.vote(*(x[~itself].reshape(len(own), NEIGHBOURS) for x in (found, cosines)))

    def score(self, bags: list, knots: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, nearest examples and cosines."""
        rows = self.vectors(bags)
        found, cosines = self.index.search(rows, NEIGHBOURS)
        vote = self.vote(found, cosines)
        score = 0.99 * np.interp(vote, *knots) + 0.01 * vote
        bare = np.diff(rows.begins) == 0
        return np.clip(np.where(bare, self.prior, np.round(score, 9)), 0, 1), found, cosines


def _chosen(scratch: Scratch, docs: DataFrame, labelled: DataFrame, examples: int) -> tuple[DataFrame, list[int]]:
    """The examples (doc_id, toxic, text) and how many labelled documents there are of each class."""
    marked = labelled.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = scratch.save(marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [marked.where(F.col("toxic") == y).orderBy(*order).limit(examples) for y in (0, 1)]
    first = scratch.save(first[0].unionByName(first[1]), "first")
    # At most 2 * examples ids. Of rows that share an id one text stands for it, whatever their order.
    texts = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").withColumn("h", F.xxhash64("text"))
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct("h", "text")).alias("text"))
    texts = texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).where(F.col("size") <= TEXT_BYTES)
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order))
    return scratch.save(texts.withColumn("upto", upto).where(F.col("upto") <= CLASS_BYTES).select("doc_id", "toxic", "text"), "examples"), [count.get(0, 0), count.get(1, 0)]


def fit(spark: SparkSession, scratch: Scratch, docs: DataFrame, labelled: DataFrame, examples: int = EXAMPLES):
    """(broadcast model, knots of its calibration) of ``labelled`` (doc_id, toxic 0 or 1); None without usable labels.

    Document frequencies are those of all ``docs`` (doc_id, text). The examples are those of each class with the least hashes of doc_id, up to
    ``examples`` of them and ``CLASS_BYTES``. All their terms are indexed. Driver and workers hold the examples' vectors and one number a term.
    """
    chosen, counts = _chosen(scratch, docs, labelled, examples)

    def bags(batches):
        for batch in batches:
            own = [bag(x.as_py()) for x in batch.column(2)]
            terms, n = [list(b) for b in own], [list(b.values()) for b in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(terms, pa.list_(pa.string())), pa.array(n, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "n"])

    # Ordered by their texts, not by their ids; at most 2 * examples rows.
    ordered = chosen.orderBy(F.coalesce("text", F.lit("")), "toxic", "doc_id")
    held = ordered.mapInArrow(bags, "doc_id long, toxic int, terms array<string>, n array<int>").toArrow().combine_chunks()
    if not held.num_rows:
        return None
    terms, n = (held.column(k).combine_chunks() for k in ("terms", "n"))
    begins = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy()))).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    number = {t: i for i, t in enumerate(coded.dictionary.to_pylist())}

    def frequencies(batches):
        found, n, find = np.zeros(len(number), np.int64), 0, number.get
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                known = [k for k in map(find, bag(text.as_py())) if k is not None]
                found[known] += 1
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(seen, -1)), "n": pa.array(np.append(found[seen], n))})

    df = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    place, found = (df.column(k).to_numpy() for k in ("term", "n"))  # one number a term
    n_docs, total = int(found[place < 0].sum()), np.zeros(len(number))
    total[place[place >= 0]] = found[place >= 0]
    idf = np.maximum(np.log((n_docs + 1) / (total + 0.5)), 1e-9)
    toxic = held.column("toxic").to_numpy().astype(int)
    share = np.array([counts[y] / max(1, int((toxic == y).sum())) for y in (0, 1)])
    rows = unit_rows(coded.indices.to_numpy().astype(np.int64), n.flatten().to_numpy().astype(float), begins, idf)
    model = Model(held.column("doc_id").to_pylist(), toxic, number, idf, rows, share[toxic])
    shared = spark.sparkContext.broadcast(model)

    def votes(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), SLICE):
                yield pa.RecordBatch.from_pydict({"row": own[a : a + SLICE], "vote": shared.value.left_out(own[a : a + SLICE])})

    del held, terms, n, coded, model
    pa.default_memory_pool().release_unused()
    left = spark.range(0, len(toxic), 1, 16).mapInArrow(votes, "row long, vote double").toArrow()
    order = np.argsort(left.column("row").to_numpy())
    return shared, monotone(left.column("vote").to_numpy()[order], toxic.astype(float), share[toxic])


def score_toxicity(spark: SparkSession, docs: DataFrame, labelled: DataFrame, cut: float = CUT, examples: int = EXAMPLES, keep: tuple = ()) -> DataFrame:
    """doc_id, score, predicted, evidence for each row of ``docs`` (doc_id, text), learning from ``labelled`` (doc_id, toxic).

    A whole text is the vector of its terms' counts times their IDF among all documents; each word is cut into terms of ``LETTERS`` letters. It is compared with the
    labelled examples by the cosine; the nearest vote, weighted by a power of the cosine. Left-out votes of the examples themselves,
    each weighted by how many labelled documents it stands for, calibrate the score. Only the text counts: equal texts have equal
    scores. Texts without any known term, empty and null ones too, get the share of label 1 among such examples. evidence lists the
    nearest examples (doc_id, toxic, cosine; three at most). Null labels and labels of unknown documents are ignored;
    an id with both labels counts as toxic. Without usable labels all scores are 0. No rows give no rows. Other columns are not read, except those
    named in ``keep``, which come back with their row.
    """
    scratch = Scratch(spark, "toxicity")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = fit(spark, scratch, own, labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), examples)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                n = part.num_rows
                if fitted:
                    own = fitted[0].value
                    scores, found, cosines = own.score([bag(x.as_py()) for x in part.column(1)], fitted[1])
                else:
                    scores, found, cosines = np.zeros(n), np.full((n, 3), -1), np.zeros((n, 3))
                evidence = [
                    [{"doc_id": own.names[i], "toxic": int(own.toxic[i]), "cosine": c} for i, c in zip(rows, cos) if i >= 0]
                    for rows, cos in zip(found[:, :3].tolist(), cosines[:, :3].tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(evidence, kind)],
                    names=["doc_id", *keep, "score", "predicted", "evidence"],
                )

    kept = [T.StructField(k, docs.schema[k].dataType) for k in keep]
    fields = [T.StructField("doc_id", T.LongType()), *kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    evidence = T.ArrayType(T.StructType().add("doc_id", T.LongType()).add("toxic", T.IntegerType()).add("cosine", T.DoubleType()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *keep).mapInArrow(
        run, T.StructType([*fields, T.StructField("evidence", evidence)])
    )
