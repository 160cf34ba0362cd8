"""Normalising, fusing, deduplicating and reranking scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import top_k


def min_max(rows: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Adds ``normal``: the score between its group's extremes; 0 where they are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("normal", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0)))


def weighted(lexical: DataFrame, semantic: DataFrame, key: str, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """query_id, key, fused, source, rank of both searches' hits; a missing side counts 0."""
    left = min_max(lexical).select("query_id", key, F.col("normal").alias("l"))
    right = min_max(semantic).select("query_id", key, F.col("normal").alias("s"))
    both = left.join(right, ["query_id", key], "full_outer")
    fused = alpha * F.coalesce("l", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    source = F.when(F.col("l").isNotNull() & F.col("s").isNotNull(), "Mixed").when(F.col("l").isNotNull(), "Lexical").otherwise("Semantic")
    return top_k(both.select("query_id", key, F.round(fused, 9).alias("fused"), source.alias("source")), k, "query_id", "fused", key)


def reciprocal_rank(searches: list[DataFrame], key: str, k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over searches that have query_id, key and rank."""
    rows = searches[0].select("query_id", key, "rank")
    for other in searches[1:]:
        rows = rows.unionByName(other.select("query_id", key, "rank"))
    return top_k(rows.groupBy("query_id", key).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score")), k, "query_id", "score", key)


def distinct_content(rows: DataFrame, order: str, text: str = "text") -> DataFrame:
    """First row, by order, of each trimmed text; blank texts go."""
    kept = rows.where(F.trim(text) != "")
    nth = F.row_number().over(Window.partitionBy(T.content_hash(F.col(text))).orderBy(order))
    return kept.withColumn("nth", nth).where("nth = 1").drop("nth")


def lexical_overlap(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's terms in the text, with a slight pull to short texts."""
    asked, held = F.array_distinct(T.analyzed(query)), F.array_distinct(T.analyzed(text))
    share = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    return share - F.length(text) / (F.length(text) + 1_000_000)


def rerank(candidates: DataFrame, k: int = 5, most_chars: int = 502, scorer=lexical_overlap) -> DataFrame:
    """query_id, key.., original_rank, rerank_score, rank; candidates: query_id, query, doc_id, text, rank.

    Blank queries keep the given order; blank texts go; long texts are cut to what the query leaves of the limit.
    """
    room = F.greatest(F.lit(0), most_chars - F.length("query"))
    text = F.when(F.length("query") + F.length("text") > most_chars, F.left("text", room)).otherwise(F.col("text"))
    blank = F.trim("query") == ""
    rows = candidates.where(blank | (F.trim("text") != "")).withColumnRenamed("rank", "original_rank")
    score = F.when(blank, -F.col("original_rank").cast("double")).otherwise(F.round(scorer(F.col("query"), text), 9))
    return top_k(rows.withColumn("rerank_score", score), k, "query_id", "rerank_score", "original_rank", "doc_id")
