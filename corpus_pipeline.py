"""A corpus pipeline over ``documents``: each stage calls one operator and works on all that the stage before kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared
folder and reads again as the next stage's docs; the table before is deleted then. All but the last return the columns
of documents.

Defined cases, for every stage: a null text is empty, so it is clean, links with nothing and packs as the end id alone;
rows without doc_id, and rows that repeat one, are judged one by one (the near-duplicate stage keeps one of equal rows);
texts of any length are read whole; extra columns pass through all stages but the last, whatever their names; ties are
settled by doc_id, then by position; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import decontaminate, minhash, packing, pii, toxicity
from faultline.llm.common import table, written
from faultline.llm.queries import vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained scorer rejects go."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8 or more) stays."""
    return minhash.deduplicate(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained scorer nor the tokenizer: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = before = written(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"stage{k}", before)
    return docs
