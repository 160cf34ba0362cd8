"""Readers and writers: JSON documents and chunks, triplet CSV, graph tables, PDF and text files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

DOCUMENT = "document_id string, num_pages long, pages array<struct<page_number:long,text:string,raw_text:string,extraction_method:string>>, _corrupt string"
CHUNK_FILE = "document_id string, extraction_method string, source_stats struct<total_words:long,total_chars:long,num_pages:long>, chunking_config struct<chunk_size:long,overlap:long,method:string>, num_chunks long, chunks array<struct<chunk_id:long,text:string,word_count:long,char_count:long>>, _corrupt string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Valid JSON documents, one row a page; broken files and pages without text are left out."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("document_id is not null and pages is not null").select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.page_number").alias("page"), F.col("p.text").alias("text")).where("text is not null")


def read_chunks(spark: SparkSession, path: str, lexical: bool = False) -> DataFrame:
    """Chunks of chunk files; the lexical reader trims texts, leaves blanks out and scores quality."""
    rows = spark.read.schema(CHUNK_FILE).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.select("document_id", F.col("source_stats").isNotNull().alias("has_metadata"), F.coalesce("chunking_config.method", F.lit("unknown")).alias("chunking_method"), F.coalesce("extraction_method", F.lit("unknown")).alias("extraction_method"), F.explode("chunks").alias("c"))
    text = F.trim("c.text") if lexical else F.col("c.text")
    out = rows.select("document_id", F.col("c.chunk_id").alias("chunk_id"), text.alias("text"), F.coalesce("c.word_count", T.word_count(text)).alias("word_count"), F.coalesce("c.char_count", F.length(text)).alias("char_count"), "has_metadata", "chunking_method", "extraction_method").where("chunk_id is not null and text is not null")
    return out.where("text <> ''").withColumn("quality_score", T.quality_score(F.col("text"))) if lexical else out


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object a document."""
    chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("num_chunks"), F.array_sort(F.collect_list(F.struct("chunk_id", "text", "word_count", "char_count"))).alias("chunks")).write.mode("overwrite").json(path)


def read_triplets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Triplet CSV files with their file's name; row_no orders rows by file path, then by position in the file.

    Numbers have gaps. A file of several lines a record is one split, so Spark's row order within it is the file's.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "equipment" not in rows.columns:
        raise ValueError("a triplet file needs the column equipment")
    named = rows.withColumn("source_file", F.col("_metadata.file_name")).withColumn("file_path", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    # Files are few: their places in path order are joined, rows are not sorted.
    files = named.groupBy("file_path").agg(F.min("at").alias("first_at"))
    placed = files.withColumn("place", F.row_number().over(Window.orderBy("file_path")) - 1)
    row_no = F.col("place").cast("long") * F.lit(1 << 40) + (F.col("at") - F.col("first_at"))
    return named.join(placed, "file_path").withColumn("row_no", row_no).drop("file_path", "at", "first_at", "place")


def write_triplets(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_pdf(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[str, str]]]) -> DataFrame:
    """document_id, page, text of binary files by a parser hook; a file that fails gives one page 'error'.

    The parser gives each page's plain text and its text sorted by layout; the longer one is taken.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    found = [plain if len(plain) >= len(layout) else layout for plain, layout in parse(bytes(content))]
                except Exception:  # noqa: BLE001  any parser's error
                    found = ["error"]
                out += [(name, k + 1, text) for k, text in enumerate(found)]
            yield pd.DataFrame(out, columns=["document_id", "page", "text"])

    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("document_id"), "content")
    return rows.mapInPandas(pages, "document_id string, page long, text string")


#: Fields that a table of embedded chunks must have.
EMBEDDED = ("document_id", "chunk_id", "text", "embedding")


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Embedded chunks from Parquet; fails where a field is absent, empty in the first rows, or of another dimension."""
    rows = spark.read.parquet(path)
    if missing := [c for c in EMBEDDED if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    for r in rows.limit(3).select(*EMBEDDED).collect():
        if any(r[c] is None for c in EMBEDDED):
            raise ValueError(f"{path} has empty fields")
        if dim is not None and len(r["embedding"]) != dim:
            raise ValueError(f"{path} has dimension {len(r['embedding'])}, the model {dim}")
    return rows


def write_embeddings(rows: DataFrame, path: str) -> None:
    rows.select(*EMBEDDED).write.mode("overwrite").parquet(path)


class GraphStore:
    """Node and edge tables as Parquet; the first of several places that has them is read."""

    def __init__(self, spark: SparkSession, *places: str):
        self.spark, self.places = spark, places

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        nodes.write.mode("overwrite").parquet(f"{self.places[0]}/nodes")
        edges.write.mode("overwrite").parquet(f"{self.places[0]}/edges")

    def truncate(self) -> None:
        """Empty tables in the first place, with their columns."""
        nodes, edges = self.load()
        spark = self.spark
        self.save(*(spark.createDataFrame([], t.schema) for t in (nodes, edges)))

    def load(self) -> tuple[DataFrame, DataFrame]:
        place = first_existing(self.spark, [f"{p}/nodes" for p in self.places]).removesuffix("/nodes")
        return self.spark.read.parquet(f"{place}/nodes"), self.spark.read.parquet(f"{place}/edges")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    raise FileNotFoundError(f"none of {paths}")
