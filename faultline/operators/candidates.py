"""From several queries to one ranking: a tagged candidate pool, deduplication, fusion, reranking and score bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import lexical_overlap, rerank
from .search import once, top_k

#: A search: (query_id, text) to (query_id, key, score, rank).
Search = Callable[[DataFrame], DataFrame]

#: Order and tag of the two engines of a pool.
ENGINES = ("BM25", "FAISS")


def all_queries(processed: DataFrame, most: int = 3) -> DataFrame:
    """query_id, query_no, text of a processed query's texts (query_id, all_queries): the primary one first."""
    rows = processed.select("query_id", F.posexplode(F.slice("all_queries", 1, most)).alias("query_no", "text"))
    return rows.select("query_id", F.col("query_no").cast("long").alias("query_no"), "text")


def candidate_pool(queries: DataFrame, lexical: Search, semantic: Search, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, tag, place: what each engine finds for each query text, in order of text, engine and rank.

    queries: query_id, query_no, text. All texts are asked in one plan for each engine,
    equal ones once. Blank texts find nothing.
    """
    named = queries.where(F.trim("text") != "").withColumn("asked", F.concat_ws("#", F.col("query_id").cast("string"), F.col("query_no").cast("string")))
    ask = named.select(F.col("asked").alias("query_id"), "text")
    parts = []
    for engine_no, (engine, search) in enumerate(zip(ENGINES, (lexical, semantic), strict=True)):
        found = once(ask, search).select(F.col("query_id").alias("asked"), key, "score", "rank")
        parts.append(found.select("*", F.lit(engine).alias("engine"), F.lit(engine_no).alias("engine_no")))
    both = parts[0].unionByName(parts[1]).join(named.select("asked", "query_id", "query_no"), "asked")
    order = Window.partitionBy("query_id").orderBy("query_no", "engine_no", "rank")
    tag = F.concat(F.col("engine"), F.lit("_v"), F.col("query_no").cast("string"))
    return both.select("query_id", key, "score", tag.alias("tag"), F.row_number().over(order).cast("long").alias("place"))


def first_of_text(pool: DataFrame, text: str = "text") -> DataFrame:
    """Of a query's candidates with equal trimmed texts the first by place; blank texts go."""
    nth = F.row_number().over(Window.partitionBy("query_id", T.content_hash(F.col(text))).orderBy("place"))
    return pool.where(F.trim(text) != "").withColumn("nth", nth).where("nth = 1").drop("nth")


def pool_fusion(pool: DataFrame, key: str = "doc_id", k: int = 15, alpha: float = 0.5) -> DataFrame:
    """query_id, key, fused, bm25, faiss, rank of a pool: normalised within query and engine and weighted.

    A key that an engine has found more than once counts with its last place. Where only one engine has found
    anything, its scores rank as they are.
    """
    engine = F.split_part(F.col("tag"), F.lit("_"), F.lit(1))
    last = pool.withColumn("engine", engine).groupBy("query_id", key, "engine").agg(F.max_by("score", "place").alias("score"), F.min("place").alias("place"))
    own = Window.partitionBy("query_id", "engine")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = last.withColumn("normal", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0)))
    of = lambda name, column: F.max(F.when(F.col("engine") == name, F.col(column)))
    rows = scaled.groupBy("query_id", key).agg(of("BM25", "score").alias("bm25"), of("FAISS", "score").alias("faiss"), of("BM25", "normal").alias("b"), of("FAISS", "normal").alias("f"), F.min("place").alias("place"))
    query = Window.partitionBy("query_id")
    both = (F.max(F.col("bm25").isNotNull()).over(query)) & (F.max(F.col("faiss").isNotNull()).over(query))
    fused = F.when(both, alpha * F.coalesce("b", F.lit(0.0)) + (1 - alpha) * F.coalesce("f", F.lit(0.0))).otherwise(F.coalesce("bm25", "faiss"))
    return top_k(rows.select("query_id", key, F.round(fused, 9).alias("fused"), "bm25", "faiss", "place"), k, "query_id", "fused", "place", key)


def final_ranking(pool: DataFrame, queries: DataFrame, k: int = 5, fuse_k: int = 15, fuse_before_dedup: bool = False, scorer=lexical_overlap, key: str = "doc_id") -> DataFrame:
    """query_id, key, original_rank, rank, cross_encoder, fusion, bm25, faiss of the k best candidates of each query.

    pool: query_id, key, text, score, tag, place; queries: query_id, query (the primary text). As required,
    candidates are made distinct before they are fused, so each keeps the score of the engine that found it first;
    ``fuse_before_dedup`` keeps both. Without a scorer (None) the fused order decides.
    """
    texts = pool.groupBy("query_id", key).agg(F.min_by("text", "place").alias("text"))
    if fuse_before_dedup:
        fused = pool_fusion(pool, key, fuse_k * 2).join(texts, ["query_id", key])
        fused = first_of_text(fused.withColumn("place", F.col("rank")))
        fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).where(F.col("rank") <= fuse_k)
    else:
        fused = pool_fusion(first_of_text(pool), key, fuse_k).join(texts, ["query_id", key])
    scores = fused.select("query_id", key, F.col("fused").alias("fusion"), "bm25", "faiss")
    if scorer is None:
        best = fused.where(F.col("rank") <= k).select("query_id", key, F.col("rank").alias("original_rank"), F.lit(None).cast("double").alias("cross_encoder"), "rank")
    else:
        rows = fused.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", F.col(key).alias("doc_id"), "text", "rank")
        best = rerank(rows, k, scorer=scorer).select("query_id", F.col("doc_id").alias(key), "original_rank", F.col("rerank_score").alias("cross_encoder"), "rank")
    return best.join(scores, ["query_id", key])


def all_scores(ranked: DataFrame) -> DataFrame:
    """The ranking with its scores in one struct, null where it was not fused."""
    names = ("cross_encoder", "fusion", "bm25", "faiss")
    return ranked.withColumn("all_scores", F.when(F.col("fusion").isNotNull(), F.struct(*names))).drop(*names[1:])


def pair_scores(pairs: DataFrame, scorer=lexical_overlap) -> DataFrame:
    """The pairs (query, text) with their raw ``score``; 0 where there is none."""
    return pairs.withColumn("score", F.coalesce(scorer(F.col("query"), F.col("text")), F.lit(0.0)))


def speed(seconds: DataFrame) -> DataFrame:
    """One row of runs (seconds, n): mean, least, greatest and deviation of the seconds, and mean items a second."""
    s = F.col("seconds")
    return seconds.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(s), 9).alias("mean"), F.round(F.min(s), 9).alias("least"), F.round(F.max(s), 9).alias("greatest"), F.round(F.stddev_pop(s), 9).alias("deviation"), F.round(F.avg(F.col("n") / s), 9).alias("a_second"))
