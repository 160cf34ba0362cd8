"""Optional incremental ingest: new files of a folder are chunked once each (no streaming query is required)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.chunking import fixed_windows


def ingest_chunks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, size: int = 200, overlap: int = 100) -> None:
    """Chunk all Parquet files that arrived since the last run (document_id, text) into ``target``."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = fixed_windows(stream, size, overlap).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
