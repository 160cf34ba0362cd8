"""Indexes and searches. Every search takes queries as a DataFrame (query_id, text) and answers all in one plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .embedding import embed, embedded, embedded_queries
from .shared import written

K1, B = 1.2, 0.75
BLOCK, PACK = 4096, 4096  # vectors and queries that meet in one task
STEP = 256  # queries that are multiplied at once
MOST = 1_000_000  # postings of a block, and terms of a pack, at most about


def postings_of(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf, length) of analysed rows (key, terms): one row a term and document; length counts all terms."""
    each = rows.select(key, F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of texts, which are analysed once."""
    return postings_of(docs.select(key, T.analyzed(F.col(text)).alias("terms")), key)


def term_statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_k(rows: DataFrame, k: int, by: str, score: str, *ties: str) -> DataFrame:
    """The k best rows of each group and their rank; ties are ordered."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, mode: str = "or", least: float = 0.0, key: str = "doc_id", clean=T.clean_query) -> DataFrame:
    """query_id, key, score, rank. mode 'and' keeps documents that hold every query term.

    Texts are analysed here; many searches of one table should ask a stored index (vector_index.build_lexical_index).
    """
    index = postings(docs, key)
    totals = docs.select(F.size(T.analyzed(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_length"))
    return bm25_of(queries, index, None, totals, k, mode, least, key, clean)


def bm25_of(queries: DataFrame, index: DataFrame, statistics: DataFrame | None, totals: DataFrame, k: int, mode: str, least: float, key: str, clean) -> DataFrame:
    """bm25() over postings, the terms' document counts (counted here if None) and totals (n_docs, mean_length).

    Queries of equal terms are asked once. Postings are reduced to the queries' terms and dealt by key to blocks; each
    task adds up the scores of one block for one pack of queries and hands on the k best, so no pair of a query and a
    document is written.
    """
    figures = totals.first()
    n_docs, mean = figures["n_docs"], figures["mean_length"] or 1.0
    own = queries.select("query_id", F.array_sort(F.array_distinct(T.analyzed(clean(F.col("text"))))).alias("terms")).where("size(terms) > 0")
    sets = own.groupBy("terms").agg(F.min("query_id").alias("asked"))
    n_terms = sets.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks, packs = max(1, -(-n_docs // BLOCK), int(-(-n_docs * mean // MOST))), max(1, -(-n_terms // MOST))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    each = sets.select("asked", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    wanted = each.select("term").distinct()
    matched = index.join(wanted, "term", "left_semi")
    df = term_statistics(matched) if statistics is None else statistics.join(wanted, "term", "left_semi")
    weighed = each.join(df, "term").select("asked", "n_terms", F.struct("term", (F.log(F.lit(n_docs) / (F.col("df") + 1)) + 1).alias("idf")).alias("t"))
    asked = weighed.groupBy("asked", "n_terms").agg(F.collect_list("t").alias("t")).select("asked", "n_terms", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
    left = matched.select(key, "term", "tf", "length", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")).withColumn("pack", every(packs))
    right = asked.withColumn("pack", F.pmod(F.xxhash64("asked"), F.lit(packs)).cast("int")).withColumn("block", every(blocks))
    schema = f"asked {asked.schema['asked'].dataType.simpleString()}, `{key}` {index.schema[key].dataType.simpleString()}, score double"
    found = left.groupBy("block", "pack").cogroup(right.groupBy("block", "pack")).applyInArrow(_bm25_of_block(k, mode, least, key, mean), schema)
    best = top_k(found, k, "asked", "score", key)
    return own.join(sets, "terms").select("query_id", "asked").join(best, "asked").select("query_id", key, "score", "rank")


def _bm25_of_block(k: int, mode: str, least: float, key: str, mean: float):
    """A function of one block of postings and one pack of queries: each query's k best of the block, ties by key."""

    def best(postings: pa.Table, queries: pa.Table) -> pa.Table:
        asked, hits, scores, keys = [], [], [], postings[key].slice(0, 0)
        if postings.num_rows and queries.num_rows:
            own, terms = (postings[c].combine_chunks().dictionary_encode() for c in (key, "term"))
            names = own.dictionary.to_pylist()
            order = sorted(range(len(names)), key=names.__getitem__)
            keys, n = own.dictionary.take(pa.array(order)), len(names)
            place = np.empty(n, dtype=np.int64)
            place[order] = np.arange(n)
            doc, code = place[own.indices.to_numpy()], terms.indices.to_numpy()
            tf, length = (postings[c].to_numpy().astype(np.float64) for c in ("tf", "length"))
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            by_term = np.lexsort((doc, code))
            doc, weight = doc[by_term], weight[by_term]
            ends = np.cumsum(np.bincount(code))
            at = {t: (e - c, e) for t, e, c in zip(terms.dictionary.to_pylist(), ends.tolist(), np.bincount(code).tolist(), strict=True)}
            total, held = np.zeros(n), np.zeros(n, dtype=np.int64)
            for q, (words, idfs, most) in enumerate(zip(*(queries[c].to_pylist() for c in ("terms", "idfs", "n_terms")), strict=True)):
                total[:], held[:] = 0, 0
                for word, idf in zip(words, idfs, strict=True):
                    start, end = at.get(word, (0, 0))
                    if end - start == n:  # in every document of the block
                        total += idf * weight[start:end]
                    elif end > start:
                        total[doc[start:end]] += idf * weight[start:end]
                    if mode == "and":
                        held[doc[start:end]] += 1
                if mode == "and":
                    total[held < most] = 0
                floor = np.partition(total, n - k)[n - k] - 1e-8 if n > k else 0.0  # scores are rounded below
                found = np.flatnonzero((total > 0) & (total >= floor))
                score = np.round(total[found], 9)
                first = np.argsort(-score, kind="stable")
                first = first[score[first] >= least][:k]
                asked.append(np.full(len(first), q))
                hits.append(found[first])
                scores.append(score[first])
        asked, hits = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (asked, hits))
        return pa.table({"asked": queries["asked"].take(pa.array(asked)), key: keys.take(pa.array(hits)), "score": pa.array(np.concatenate(scores) if scores else np.empty(0))})

    return best


def _best_of_block(k: int, least: float, key: str, compat_l2sq: bool):
    """A function of one block of vectors and one pack of queries: the pack's k best of the block, ties by key."""

    def best(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, hits, scores = [], [], []
        held = lambda rows, name: rows[np.array([x is not None and len(x) > 0 for x in rows[name]], dtype=bool)]
        vectors, queries = held(vectors, "embedding"), held(queries, "query_vector")
        if len(vectors) and len(queries):
            vectors = vectors.sort_values(key, kind="stable")
            v, q = (np.stack(list(x)).astype(np.float64) for x in (vectors["embedding"], queries["query_vector"]))
            nv, nq = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            for start in range(0, len(q), STEP):
                part = slice(start, start + STEP)
                score = q[part] @ v.T / np.maximum(np.outer(nq[part], nv), np.finfo(np.float64).tiny)
                if compat_l2sq:
                    score = 1 - 2 * (1 - score) ** 2
                score = np.round(score, 9)
                floor = np.partition(score, -k, axis=1)[:, -k] if len(v) > k else np.full(len(score), -np.inf)
                for n, row in enumerate(score):
                    found = np.flatnonzero((row >= floor[n]) & (row >= least))
                    found = found[np.argsort(-row[found], kind="stable")[:k]]
                    asked.append(np.full(len(found), start + n))
                    hits.append(found)
                    scores.append(row[found])
        asked, hits = (np.concatenate(x).astype(int) if x else np.empty(0, int) for x in (asked, hits))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[asked], key: vectors[key].to_numpy()[hits], "score": np.concatenate(scores) if scores else np.empty(0)})

    return best


def once(queries: DataFrame, answer) -> DataFrame:
    """The answers (query_id, ..) to queries (query_id, text), where equal texts are asked once, as the least of their ids."""
    own = queries.select("query_id", "text").distinct()
    texts = own.groupBy("text").agg(F.min("query_id").alias("asked"))
    found = answer(texts.select(F.col("asked").alias("query_id"), "text")).withColumnRenamed("query_id", "asked")
    return own.join(texts, "text").drop("text").join(found, "asked").drop("asked")


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = -1.0, key: str = "vec_id", compat_l2sq: bool = False) -> DataFrame:
    """Exact nearest vectors: query_id, key, score (cosine), rank. queries: query_id, query_vector.

    Vectors are cut into blocks and queries into packs by their counts, so neither side is broadcast. Each task holds
    one block and one pack, multiplies them and keeps the pack's k best of the block. Null and empty vectors are
    passed over; a vector without length scores 0.
    """
    blocks, packs = (max(1, -(-side.count() // size)) for side, size in ((vectors, BLOCK), (queries, PACK)))
    # A filter on vectors would be pushed below a distinct, and embed its rows before they are made distinct.
    vectors = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("pack", every(packs))
    right = queries.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int")).withColumn("block", every(blocks))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    found = left.groupBy("block", "pack").cogroup(right.groupBy("block", "pack")).applyInPandas(_best_of_block(k, least, key, compat_l2sq), schema)
    return top_k(found, k, "query_id", "score", key)


def similar_to(vectors: DataFrame, key_value: int, k: int = 5, key: str = "vec_id") -> DataFrame:
    """The nearest vectors of a stored one, without itself."""
    query = vectors.where(F.col(key) == key_value).select(F.col(key).alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_search(query, vectors.where(F.col(key) != key_value), k, key=key)


def similar_to_each(keys: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id") -> DataFrame:
    """The nearest vectors of each stored one that ``keys`` names, without itself."""
    queries = vectors.join(keys.select(key).distinct(), key, "left_semi").select(F.col(key).alias("query_id"), F.col("embedding").alias("query_vector"))
    return top_k(vector_search(queries, vectors, k + 1, key=key).drop("rank").where(F.col(key) != F.col("query_id")), k, "query_id", "score", key)


def index_kind(n: Column) -> Column:
    return F.when(n < 1000, "flat").when(n < 10000, "hnsw").otherwise("ivf")


def valid_vectors(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """Non-empty vectors without NaN, infinite or null values, of the table's dimension (that of its smallest key)."""
    fine = ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    dim = rows.agg(F.min_by(F.size("embedding"), key).alias("valid_dim"))  # one row
    return rows.join(F.broadcast(dim), F.size("embedding") == F.col("valid_dim"), "left_semi")


def deletions(code: Column, most: int) -> Column:
    """A code and all that is left of it without up to ``most`` of its characters."""
    step = out = F.array(code)
    for _ in range(most):
        cut = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        step = F.array_distinct(F.flatten(F.transform(step, cut)))
        out = F.array_union(out, step)
    return out


def near_codes(asked: DataFrame, codes: DataFrame, most: int) -> DataFrame:
    """asked, code, d of codes at most ``most`` edits apart: such codes share one of their deletions, an equi-join."""
    left = asked.select("asked", F.explode(deletions(F.col("asked"), most)).alias("part"))
    right = codes.select("code", F.explode(deletions(F.col("code"), most)).alias("part"))
    return left.join(right, "part").select("asked", "code").distinct().withColumn("d", F.levenshtein("asked", "code", most)).where("d >= 0")


def levenshtein_search(queries: DataFrame, symptoms: DataFrame, k: int = 5, most: int = 3) -> DataFrame:
    """Symptoms by the least edit distance of their error codes to the query's: query_id, symptom, score, rank.

    Each asked code is answered once, from the k first symptoms of each known code: a symptom beyond those, or beyond
    the k best of its nearest asked code, has k better ones.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.strict_codes(F.col("text")))).alias("asked"))
    known = symptoms.select("symptom").distinct().select("symptom", F.explode(F.array_distinct(T.strict_codes(F.col("symptom")))).alias("code"))
    first = F.row_number().over(Window.partitionBy("code").orderBy("symptom"))
    known = known.withColumn("nth", first).where(F.col("nth") <= k).drop("nth")
    near = near_codes(asked.select("asked").distinct(), known.select("code").distinct(), most)
    each = known.join(near, "code").groupBy("asked", "symptom").agg(F.min("d").alias("d"))
    nth = F.row_number().over(Window.partitionBy("asked").orderBy("d", "symptom"))
    each = each.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    rows = each.join(asked, "asked").groupBy("query_id", "symptom").agg(F.min("d").alias("d"))
    return top_k(rows.select("query_id", "symptom", (1 - F.col("d") / most).alias("score")), k, "query_id", "score", "symptom")


def hybrid_symptoms(scored: list[tuple[DataFrame, float, bool]], k: int = 5) -> DataFrame:
    """Weighted sum of searches (query_id, symptom, score); flagged ones are divided by their query's maximum."""
    parts = []
    for rows, weight, by_max in scored:
        score = F.col("score")
        if by_max:
            top = F.max("score").over(Window.partitionBy("query_id"))
            score = F.when(top > 0, score / top).otherwise(F.lit(0.0))
        parts.append(rows.select("query_id", "symptom", (score * weight).alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_k(out.groupBy("query_id", "symptom").agg(F.round(F.sum("score"), 9).alias("score")), k, "query_id", "score", "symptom")


def max_fusion(rows: DataFrame, k: int = 3, variant_weight: float = 0.8) -> DataFrame:
    """Best weighted score a key over a query (variant 0) and its variants: query_id, symptom, score, rank."""
    weight = F.when(F.col("variant") == 0, F.lit(1.0)).otherwise(F.lit(variant_weight))
    return top_k(rows.groupBy("query_id", "symptom").agg(F.round(F.max(F.col("score") * weight), 9).alias("score")), k, "query_id", "score", "symptom")


def dense_symptoms(queries: DataFrame, symptoms: DataFrame, k: int = 3, hybrid: bool = True, least: float = 0.8, embedder=embed) -> DataFrame:
    """Symptoms of the merged graph: the weighted three searches, or vectors alone above a threshold.

    Questions of equal texts are asked, and their searches fused, once. Symptoms, questions and what is found are
    written, for the three searches read the first two several times, and so do callers the last.
    """
    symptoms = written(symptoms.select("symptom").distinct(), "symptoms")
    known = embedded(symptoms, F.col("symptom"), embedder)

    def answer(asked: DataFrame) -> DataFrame:
        asked = written(asked, "questions")
        near = vector_search(embedded_queries(asked, embedder), known, 2 * k, -1.0 if hybrid else least, "symptom")
        if not hybrid:
            return near.where(F.col("rank") <= k)
        lexical = bm25(asked, symptoms.select("symptom", F.col("symptom").alias("text")), 2 * k, key="symptom", clean=T.clean_symptom_query)
        return written(hybrid_symptoms([(lexical, 0.4, True), (near, 0.4, True), (levenshtein_search(asked, symptoms, k), 0.2, False)], k), "found")

    return once(queries, answer)


def threshold_symptoms(queries: DataFrame, rows: DataFrame, key: str, text: str, k: int = 3, least: float = 0.8, embedder=embed) -> DataFrame:
    """The k best rows above a threshold, each with its columns: for triplets of their own, and for combined texts.

    Rows of equal texts are searched as one, under the least of their keys, and questions of equal texts are asked once.
    A row among the k best has one of the k best texts, and is among the k first rows of that.
    """
    nth = F.row_number().over(Window.partitionBy(text).orderBy(key))
    firsts = rows.select(key, text).withColumn("nth", nth).where(F.col("nth") <= k)
    texts = firsts.where("nth = 1").select(F.col(key).alias("of_text"), F.col(text).alias("sought_text"))
    first = F.min(key).over(Window.partitionBy(text)).alias("of_text")

    def answer(asked: DataFrame) -> DataFrame:
        near = vector_search(embedded_queries(asked, embedder), embedded(texts, F.col("sought_text"), embedder), k, least, "of_text")
        return top_k(near.drop("rank").join(firsts.select(key, first), "of_text").drop("of_text"), k, "query_id", "score", key)

    return once(queries, answer).join(rows, key)


def top_equipment(asked: DataFrame, known: DataFrame, k: int = 3, least: float = 0.5, embedder=embed) -> DataFrame:
    """The k nearest names of each asked one, then those of them above the threshold: query_id, name, score, rank."""
    queries = asked.select("query_id", F.col("equipment").alias("text"))
    names = known.where(F.trim("name") != "").select("name").distinct()
    return vector_search(embedded_queries(queries, embedder), embedded(names, F.col("name"), embedder), k, key="name").where(F.col("score") >= least)


def _grams(text: Column, n: int = 3) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


def held_names(asked: DataFrame, known: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, list_no) where one text (a) holds the other (b): an equi-join on the shorter one's first n characters.

    asked: query_id, a; known: list_no, b; texts in lower case. Texts of fewer than n characters are compared with all.
    """
    holds = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    long_a, long_b = asked.where(F.length("a") >= n), known.where(F.length("b") >= n)
    first = lambda c: F.substring(c, 1, n).alias("gram")
    one = long_a.select("query_id", "a", F.explode(_grams(F.col("a"), n)).alias("gram")).join(long_b.select("list_no", "b", first("b")), "gram")
    two = long_a.select("query_id", "a", first("a")).join(long_b.select("list_no", "b", F.explode(_grams(F.col("b"), n)).alias("gram")), "gram")
    short_a, short_b = asked.where((F.length("a") < n) & (F.col("a") != "")), known.where((F.length("b") < n) & (F.col("b") != ""))
    rest = [short_a.join(known, F.contains("b", F.col("a")) | F.contains("a", F.col("b"))), long_a.join(short_b, F.contains("a", F.col("b")))]
    out = one.where(holds).select("query_id", "list_no").union(two.where(holds).select("query_id", "list_no"))
    for part in rest:
        out = out.union(part.select("query_id", "list_no"))
    return out.distinct()


def match_equipment(asked: DataFrame, known: DataFrame, least: float = 0.9, embedder=embed) -> DataFrame:
    """asked (query_id, equipment) to one known (list_no, name): the first equal, else the first that holds or is held,
    else the nearest by vectors above the threshold, else null. Blank names match nothing."""
    found = once(asked.select("query_id", F.col("equipment").alias("text")), lambda names: _matched(names.withColumnRenamed("text", "equipment"), known, least, embedder))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.col("name").alias("matched"), F.col("stage").cast("long").alias("stage"))


def _matched(asked: DataFrame, known: DataFrame, least: float, embedder) -> DataFrame:
    """query_id, name, stage of the asked names that match one."""
    names = written(known.where(F.trim("name") != "").select("list_no", "name", F.lower(F.trim("name")).alias("b")), "names")
    named = written(asked.where(F.trim("equipment") != "").select("query_id", "equipment", F.lower(F.trim("equipment")).alias("a")), "named")
    equal = named.join(names, F.col("a") == F.col("b")).groupBy("query_id").agg(F.min("list_no").alias("list_no")).withColumn("stage", F.lit(1))
    unequal = named.join(equal.select("query_id"), "query_id", "left_anti")
    part = held_names(unequal.select("query_id", "a"), names.select("list_no", "b")).groupBy("query_id").agg(F.min("list_no").alias("list_no")).withColumn("stage", F.lit(2))
    best = written(equal.union(part).join(names.select("list_no", "name"), "list_no").select("query_id", "name", "stage"), "matched")
    left = named.join(best, "query_id", "left_anti")
    nearest = top_equipment(left.select("query_id", "equipment"), names, 1, least, embedder).select("query_id", "name", F.lit(3).alias("stage"))
    return best.union(nearest)
