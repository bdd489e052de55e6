"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of every word-based contract: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Text is worked on in slices of about this many bytes, whatever the Arrow batch size.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a temporary one where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxelframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nothing else uses."""
    return f"{shared_dir(spark)}/voxelframe/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, *parts: str, path: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by ``parts``, and read it again: lineage is cut and lost executors cost nothing.

    ``group_rows`` is for rows of megabytes: Parquet bounds a row group's bytes only from its hundredth row
    on, and a reader decodes a group at once.

    Parquet rather than ``checkpoint()``, so that later readers take only the columns they need.
    """
    spark = df.sparkSession
    path = path or fresh_dir(spark, name)
    writer = df.write.partitionBy(*parts) if parts else df.write
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While this holds, Python gets at most so many rows at once; for jobs that run inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that ``stored`` wrote to ``path``; nothing may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_mod(column: str, n: int):
    """crc32 of a column's decimal text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_az(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``limit`` bytes of text; one longer text is a run of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)
