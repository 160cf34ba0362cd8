"""Text vectors. An embedder is a function from a text column to a vector column; models plug in as vectorised functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMENSION = 256
LEAST_NORM = 0.001


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _counted(dimension: int):
    """A function of places to unit vectors of their counts, a batch of rows at a time."""

    def counted(places: pa.Array) -> pa.Array:
        n = len(places)
        row = np.repeat(np.arange(n), pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64))
        at = row * dimension + places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(at, minlength=n * dimension).reshape(n, dimension).astype(np.float64)
        counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1.0)  # counts: norm 0, or 1 and more
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dimension)), pa.array(counts.ravel()))

    return F.arrow_udf(counted, "array<double>")


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    """The default embedder: hashed term frequencies of unit length; zeros for a text without terms.

    Places are found in the JVM and counted over batches of rows, so a text of n terms costs n and one pass over the
    dimension.
    """
    places = F.transform(T.analyzed(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimension).cast("int"))
    return _counted(dimension)(places)


def embedded(rows: DataFrame, text: Column, embedder=embed) -> DataFrame:
    """The rows with embedding, dim and norm."""
    out = rows.withColumn("embedding", embedder(text))
    return out.withColumn("dim", F.size("embedding").cast("long")).withColumn("norm", norm(F.col("embedding")))


def embedded_queries(queries: DataFrame, embedder=embed) -> DataFrame:
    """query_id, query_vector of queries that are not blank."""
    return queries.where(F.trim("text") != "").select("query_id", embedder(F.col("text")).alias("query_vector"))


def statistics(vectors: DataFrame) -> DataFrame:
    """One row: vectors, different dimensions, and least, greatest, mean and deviation of the norms."""
    x = norm(F.col("embedding"))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("dims"), F.round(F.min(x), 6).alias("min_norm"), F.round(F.max(x), 6).alias("max_norm"), F.round(F.avg(x), 6).alias("mean_norm"), F.round(F.stddev_pop(x), 6).alias("std_norm"))


def quality(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row: vectors, those without length, blank texts and the mean norm; rows: text, norm."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("norm") < LEAST_NORM).alias("zero_norms"), F.count_if(blank).alias("blank_texts"), F.round(F.avg("norm"), 6).alias("mean_norm"))
