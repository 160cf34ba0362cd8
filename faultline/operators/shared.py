"""Tables that a plan reads more than once: written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only on one machine may a temporary folder take its place."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows, computed once and read back, so that plans that use them several times stay small.

    The folder goes when the driver's Python ends.
    """
    spark = rows.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_discard, spark, path)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _discard(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: nothing is left to ask
        return
