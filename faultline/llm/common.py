"""What the operators of this subpackage share: folders, materialised tables and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes, of a record batch that are worked on at once in Python (one row at least).
SLICE = 256
SLICE_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder takes its place if all runs on one machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            folder = set_before.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_folders: list[str] = []


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder inside the shared one, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex[:12]}"
    _folders.append(path)
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that workspace() named, in whatever store it is."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: nothing is left to ask
        return


def materialise(df: DataFrame, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    ``instead_of``: a materialised table that nothing needs any more; it is deleted.
    """
    path = workspace(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    if instead_of is not None:
        discard(df.sparkSession, instead_of._folder)
    return out


def written(step: Callable[[], DataFrame], spark: SparkSession, label: str, instead_of: DataFrame | None = None) -> DataFrame:
    """materialise() what a step returns, and delete the tables that it has written on its way."""
    before = len(_folders)
    out = materialise(step(), label, instead_of)
    for path in _folders[before:]:
        if path != out._folder:
            discard(spark, path)
    return out


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no column of the tables has it (Spark does not tell cases apart)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches, so that Python objects exist for a few rows, and for a bounded number of bytes, at a time."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > most_bytes:
                n //= 2
            yield batch.slice(start, n)
            start += n


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (no decoding)."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
