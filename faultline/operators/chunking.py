"""Chunkers: one row a chunk, numbered from 0 in each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def fixed_windows(docs: DataFrame, size: int = 200, overlap: int = 100) -> DataFrame:
    """document_id, chunk_id, text, word_count, char_count; a window starts every size - overlap words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    rows = docs.select("document_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
    rows = rows.select("document_id", "w", F.posexplode(starts).alias("chunk_id", "at"))
    part = F.slice("w", F.col("at") + 1, size)
    return rows.select("document_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.array_join(part, " ").alias("text"), F.size(part).cast("long").alias("word_count")).withColumn("char_count", F.length("text").cast("long"))


def group_sentences(sentences: list[str], most: int, overlap: int, compat_lossy: bool = False) -> list[str]:
    """Fill chunks up to ``most`` words; a new chunk begins with the last sentences of up to ``overlap`` words.

    compat_lossy reproduces a known defect: the sentence that overflowed is replaced by the last one looked at.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0
    for sentence in sentences:
        n, added = len(sentence.split()), sentence
        if held and size + n > most:
            out.append(" ".join(held))
            carried: list[str] = []
            room = overlap
            for earlier in reversed(held):
                if compat_lossy:
                    added = earlier
                if len(earlier.split()) > room:
                    break
                carried.insert(0, earlier)
                room -= len(earlier.split())
            held = carried
            size = sum(len(s.split()) for s in held)
            n = len(added.split())
        held.append(added)
        size += n
    if held:
        out.append(" ".join(held))
    return out


def sentence_groups(docs: DataFrame, most: int = 200, overlap: int = 100, compat_lossy: bool = False) -> DataFrame:
    """Chunks of whole sentences; sequential within a document, so a vectorised function does it."""

    @F.pandas_udf("array<string>")
    def grouped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in parts:
            yield series.map(lambda s: group_sentences(list(s), most, overlap, compat_lossy) if s is not None else [])

    rows = docs.select("document_id", F.posexplode(grouped(T.sentences(F.col("text")))).alias("chunk_id", "text"))
    return rows.select("document_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text", T.word_count(F.col("text")).alias("word_count"), F.length("text").cast("long").alias("char_count"))


def chunk(docs: DataFrame, method: str = "sentence", size: int = 200, overlap: int = 100) -> DataFrame:
    return sentence_groups(docs, size, overlap) if method == "sentence" else fixed_windows(docs, size, overlap)


def joined_in_order(rows: DataFrame, key: str, order: str, text: str, separator: str = " ") -> DataFrame:
    """One text a key, its rows in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: F.coalesce(r[text], F.lit("")))
    return rows.groupBy(key).agg(F.array_join(parts, separator).alias("text"))


def sampled(rows: DataFrame, key: Column, n: int = 3, seed: int = 42) -> DataFrame:
    """A repeatable random sample of n rows."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
