"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import bagminhash, bytebpe, chat, mixing, packing, phrases, ppm, repair, sketch, tokencounts, tokenfiles, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.score_documents(spark, docs.withColumn("held_out", ppm.held_out()))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digests(spark, _table(spark, sf_dir, "documents"))


def formatted_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(spark, table.unionByName(extra))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(spark, _table(spark, sf_dir, "embeddings"))


def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(spark, _table(spark, sf_dir, "documents"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(spark, _table(spark, sf_dir, "documents"))


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = ppm.held_out(parts=4, part=2)
    scored = toxicity.score_toxicity(spark, docs, labels.where(~held).select("doc_id", "toxic"))
    return scored.withColumn("held_out", held)


def rank_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_digests(_table(spark, sf_dir, "documents"))


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, _table(spark, sf_dir, "documents"))


def repaired_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(spark, _table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": lm_scoring,
    "op2_best_fit_packing": packed,
    "op3_entropy_balancing": mixed,
    "op4_token_files": token_files,
    "op5_chat_spans": formatted_chats,
    "op6_near_vectors": near_vectors,
    "op7_token_counts": counted_tokens,
    "op8_scaled_sketch": document_fingerprints,
    "op9_bagminhash": near_texts,
    "op10_toxicity": toxic_scores,
    "op11_byte_bpe": rank_encoded,
    "op12_collocations": collocations,
    "op13_repair": repaired_chats,
    "pipeline": pipeline,
}

_LINKED = (
    "WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), "
    "f AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 "
    "AND len(list_filter(x, lambda c: c <> 0)) > 0), "
    "p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id "
    "WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98), "
    "reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a), "
    "c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a) "
    "SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(v.vec_id = c.component_id, false) AS kept "
    "FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"
)

_PHRASES = (
    "WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p), "
    "n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang), "
    "g AS (SELECT lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m), "
    "f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10), "
    "c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2), "
    "k AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < c.m), "
    "s AS (SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, (1000000::HUGEINT * k.a * k.a // (l.a::HUGEINT * r.a))::BIGINT AS score, "
    "row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY 1000000::HUGEINT * k.a * k.a // (l.a::HUGEINT * r.a), k.k) AS o "
    "FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.lp JOIN f r ON r.lang = k.lang AND r.phrase = k.rp), "
    "d AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS more FROM c WHERE m = 3), "
    "b AS (SELECT lang, phrase, max(more) AS more FROM d GROUP BY ALL), "
    "o AS (SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank "
    "FROM s LEFT JOIN b ON b.lang = s.lang AND b.phrase = s.phrase WHERE s.o = 1 AND (b.more IS NULL OR 100 * b.more < 50 * s.a)) "
    "SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"
)

#: Operators whose whole result DuckDB can state (op6: of distinct vec_ids); the others are tested against brute force.
ORACLES: dict[str, str] = {"op6_near_vectors": _LINKED, "op12_collocations": _PHRASES}
