"""A stored vector index with cells, and a stored lexical index: written once, searched many times.

The vector index deals every vector to the nearest of ``cells`` centroids. Centroids come from spherical k-means over
a bounded sample (SAMPLE vectors, by a hash of the key); every vector is indexed. A search reads the cells nearest to
each query only; with ``probes=None`` it reads all vectors and is exact. How many cells it reads is measured when the
index is built: TUNING stored vectors are searched exactly, and the least number of cells that holds TARGET of their ten
nearest others is kept with the index. Vectors without clusters need many cells. Cells are stored in parts of at most about
PART vectors, so no task gets a whole large cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search
from ..functions import text as T
from ..sources import first_existing

SAMPLE = 20_000
MOST_CELLS = 1024
PART = 4096
TUNING, TARGET = 200, 0.95
#: Stands for the number of cells that the index has measured.
MEASURED = 0


def cells_for(n: int) -> int:
    """One cell for small tables; else about the square root of the number of vectors."""
    return 1 if n < 1000 else min(MOST_CELLS, max(8, int(n**0.5)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def centroids(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids; starts from vectors spread over the sample, empty cells stay as they are."""
    own = _unit(sample)
    out = own[np.linspace(0, len(own) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(own @ out.T, axis=1)
        for k in np.unique(nearest):
            out[k] = own[nearest == k].sum(axis=0)
        out = _unit(out)
    return out


def _nearest(table: DataFrame, vector: str, centres: np.ndarray, most: int) -> DataFrame:
    """The rows with ``cells``, the most nearest centroids; centres: at most MOST_CELLS, so they travel with the task."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array(batch[vector].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            best = np.argsort(-(flat @ centres.T), axis=1, kind="stable")[:, :most] if batch.num_rows else np.empty((0, most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(assign, f"{fields}, cells array<int>")


def build_vector_index(vectors: DataFrame, path: str, key: str = "vec_id", cells: int | None = None) -> None:
    """Write all valid vectors by cell, the centroids and one row of metadata."""
    rows = search.valid_vectors(vectors, key).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    figures = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = figures["n"], figures["dim"] or 0
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").collect()]
    count = min(cells or cells_for(n), max(1, len(sample)))
    centres = centroids(np.array(sample, dtype=np.float64), count) if n else np.zeros((1, max(1, dim)))
    spark = vectors.sparkSession
    dealt = _nearest(rows, "embedding", centres, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    parts = max(1, -(-n // PART))
    # A part is a hash of the key: the cell's rows spread over as many parts as the whole table would need, at most.
    part = F.pmod(F.xxhash64(key), F.lit(max(1, -(-parts // count)))).cast("int")
    dealt.withColumn("part", part).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    probes = _probes(spark.read.parquet(f"{path}/vectors"), centres, key) if count > 1 else 1
    spark.createDataFrame([(n, dim, count, key, "ivf" if count > 1 else "flat", probes)], "n long, dim int, cells int, key string, kind string, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def _probes(vectors: DataFrame, centres: np.ndarray, key: str) -> int:
    """The cells that hold TARGET of the ten nearest others of TUNING vectors."""
    asked = vectors.orderBy(F.xxhash64(F.lit(7), key), key).limit(TUNING).select(F.col(key).alias("query_id"), F.col("embedding").alias("query_vector"))
    truth = search.vector_search(asked, vectors.select(key, "embedding"), 11, key=key).where(F.col(key) != F.col("query_id"))
    cells = _nearest(asked, "query_vector", centres, len(centres)).select("query_id", "cells")
    rank = F.array_position("cells", F.col("cell"))
    found = truth.select("query_id", key).join(vectors.select(key, "cell"), key).join(cells, "query_id")
    return int(np.ceil(found.agg(F.percentile(rank, TARGET).alias("p")).first()["p"] or 1))


def open_vector_index(spark: SparkSession, path: str, dim: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Vectors, centroids and metadata; fails where the count differs from the metadata, or the dimension from ``dim``."""
    figures = spark.read.parquet(f"{path}/metadata").first().asDict()
    vectors = spark.read.parquet(f"{path}/vectors") if figures["n"] else spark.createDataFrame([], f"`{figures['key']}` long, embedding array<double>, part int, cell int")
    if (found := vectors.count()) != figures["n"]:
        raise ValueError(f"{path} holds {found} vectors, its metadata says {figures['n']}")
    if dim is not None and figures["n"] and dim != figures["dim"]:
        raise ValueError(f"{path} has dimension {figures['dim']}, the model {dim}")
    return vectors, spark.read.parquet(f"{path}/centres"), figures


def search_vector_index(queries: DataFrame, path: str, k: int = 10, probes: int | None = MEASURED, least: float = -1.0) -> DataFrame:
    """query_id, key, score, rank from the ``probes`` nearest cells of each query (query_id, query_vector); None: from all."""
    vectors, centres, figures = open_vector_index(queries.sparkSession, path)
    key, probes = figures["key"], figures["probes"] if probes == MEASURED else probes
    if probes is None or probes >= figures["cells"]:
        return search.vector_search(queries, vectors.select(key, "embedding"), k, least, key)
    centre = np.array([r["centre"] for r in centres.orderBy("cell").collect()])  # at most MOST_CELLS rows
    asked = queries.where(F.size("query_vector") > 0).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    asked = _nearest(asked, "query_vector", centre, probes).select("query_id", "query_vector", F.explode("cells").alias("cell"))
    parts = -(-max(1, -(-figures["n"] // PART)) // figures["cells"])
    packs = max(1, -(-queries.count() // search.PACK))
    asked = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = asked.select(F.col("cell").alias("w_cell"), F.col("part").alias("w_part"), F.col("pack").alias("w_pack")).distinct()
    held = vectors.join(wanted, (F.col("cell") == F.col("w_cell")) & (F.col("part") == F.col("w_part"))).select(key, "embedding", "cell", "part", F.col("w_pack").alias("pack"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double"
    place = ["cell", "part", "pack"]
    found = held.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search._best_of_block(k, least, key, False), schema)
    return search.top_k(found, k, "query_id", "score", key)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the true hits that were found."""
    hit = truth.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def build_lexical_index(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write postings, the terms' document counts and one row of totals."""
    rows = docs.select(key, T.analyzed(F.col("text")).alias("terms"))
    search.postings_of(rows, key).write.mode("overwrite").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings")
    search.term_statistics(written).write.mode("overwrite").parquet(f"{path}/terms")
    lengths = written.groupBy(key).agg(F.first("length").alias("length")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(lengths).select("n_docs", (F.col("words") / F.col("n_docs")).alias("mean_length")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def search_lexical_index(queries: DataFrame, path: str, k: int = 10, mode: str = "or", least: float = 0.0, key: str = "doc_id", clean=T.clean_query) -> DataFrame:
    """bm25() over a stored index: only the postings of the queries' terms are read on."""
    read = lambda name: queries.sparkSession.read.parquet(f"{path}/{name}")
    return search.bm25_of(queries, read("postings"), read("terms"), read("totals"), k, mode, least, key, clean)


def index_presence(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """name, path, present of indexes."""

    def present(path: str) -> bool:
        try:
            return bool(first_existing(spark, [path]))
        except FileNotFoundError:
            return False

    return spark.createDataFrame([(n, p, present(p)) for n, p in names.items()], "name string, path string, present boolean")


def smoke(spark: SparkSession, vector_path: str, lexical_path: str, text: str) -> DataFrame:
    """engine, hits, best of one stored vector's own search and of one text: a built index answers."""
    vectors, _, figures = open_vector_index(spark, vector_path)
    one = vectors.orderBy(F.xxhash64(figures["key"]), figures["key"]).limit(1).select(F.col(figures["key"]).alias("query_id"), F.col("embedding").alias("query_vector"))
    near = search_vector_index(one, vector_path, 3, None)
    lexical = search_lexical_index(spark.createDataFrame([(0, text)], "query_id long, text string"), lexical_path, 3)
    each = lambda rows, name: rows.agg(F.lit(name).alias("engine"), F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))
    return each(near, "vector").union(each(lexical, "bm25"))
