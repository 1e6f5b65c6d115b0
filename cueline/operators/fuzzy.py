"""Pairs of lines whose words are much the same: an exact set-similarity join, and scores from words, letters and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def _lines(df: DataFrame, on: list[str], id: str, text: str) -> DataFrame:
    """``on``, id (the least of those with the text), n, text, tokens: one row for each distinct text with words."""
    own = df.where(F.col(text).isNotNull()).groupBy(*on, F.col(text).alias("_text")).agg(F.min(id).alias("_id"), F.count("*").alias("_n"))
    return own.withColumn("_tokens", words(F.col("_text"))).where(F.size("_tokens") > 0)


def fuzzy_pairs(a: DataFrame, b: DataFrame, on: list[str], id: str, text: str, least: float = 0.5) -> DataFrame:
    """``on``, i, j, n_i, n_j, jaccard, ratio, score of the pairs of texts of ``a`` and ``b`` whose words overlap by ``least`` or more (Jaccard).

    Equal texts of a side are one: i and j are their least ids, n_i and n_j how many rows have them, so copies don't multiply. ratio is 1 - Levenshtein
    distance / longer length, score the higher of both. Exact: with words ordered by rarity, two sets that overlap by ``least`` share one of
    their first n - ceil(least * n) + 1 words, so only lines that share such a rare word meet. Null texts and texts without words have no pairs.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    left, right = _lines(a, on, id, text), _lines(b, on, id, text)
    exploded = lambda df: df.select(*on, "_id", F.size("_tokens").alias("_size"), F.explode("_tokens").alias("_token"))
    seen = exploded(left).unionByName(exploded(right)).groupBy(*on, "_token").agg(F.count("*").alias("_seen"))

    def rare(df: DataFrame, mine: str, size: str) -> DataFrame:
        """``on``, the id, and each of a line's rarest words that its pairs can't all do without."""
        ranked = exploded(df).join(seen, [*on, "_token"]).groupBy(*on, "_id", "_size").agg(F.array_sort(F.collect_list(F.struct("_seen", "_token"))).alias("_ranked"))
        needed = F.col("_size") - F.ceil(F.col("_size") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
        return ranked.select(*on, F.col("_id").alias(mine), F.col("_size").alias(size), F.explode(F.slice("_ranked", F.lit(1), needed)).alias("r")).select(*on, mine, size, "r._token")

    met = rare(left, "i", "_p").join(rare(right, "j", "_q"), [*on, "_token"])
    met = met.where((F.col("_p") >= F.col("_q") * least - 1e-9) & (F.col("_q") >= F.col("_p") * least - 1e-9)).select(*on, "i", "j").distinct()
    side = lambda df, k: df.select(*on, F.col("_id").alias(k), F.col("_n").alias(f"n_{k}"), F.col("_text").alias(f"_text_{k}"), F.col("_tokens").alias(f"_tokens_{k}"))
    both = met.join(side(left, "i"), [*on, "i"]).join(side(right, "j"), [*on, "j"])
    shared = F.size(F.array_intersect("_tokens_i", "_tokens_j"))
    both = both.withColumn("_shared", shared).withColumn("_all", F.size("_tokens_i") + F.size("_tokens_j") - F.col("_shared"))
    both = both.where(F.col("_shared") >= F.col("_all") * least)
    longest = F.greatest(F.length("_text_i"), F.length("_text_j"))
    scored = both.withColumn("jaccard", F.col("_shared") / F.col("_all")).withColumn("ratio", 1 - F.levenshtein("_text_i", "_text_j") / longest)
    return scored.select(*on, "i", "j", "n_i", "n_j", "jaccard", "ratio", F.greatest("jaccard", "ratio").alias("score"))


def hybrid_pairs(texts: DataFrame, vectors: DataFrame, on: list[str], trust: float = 0.8, weight: float = 0.9) -> DataFrame:
    """``on``, i, j, text_score, cosine, score of pairs that either ``texts`` (score) or ``vectors`` (value) has; the other's score is null.

    A text score of ``trust`` or more counts as it is. Below that a paraphrase may count for more: the higher of it and ``weight`` times the cosine.
    """
    both = texts.select(*on, "i", "j", F.col("score").alias("text_score")).join(vectors.select(*on, "i", "j", F.col("value").alias("cosine")), [*on, "i", "j"], "full")
    score = F.when(F.col("text_score") >= trust, F.col("text_score")).otherwise(F.greatest("text_score", F.col("cosine") * weight))
    return both.select(*on, "i", "j", "text_score", "cosine", score.alias("score"))
