"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Only a local session that names none, as in tests, gets one made."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut and any executor may be lost afterwards."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session sends to Python by BATCH_BYTES, or one row, where the bound is higher. A bound in bytes suits rows of
    any length, so queries that run later are none the worse for it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(held[:-1]) << {"k": 10, "m": 20, "g": 30}[held[-1]] if held[-1] in "kmg" else int(held)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096, text: int | None = None, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most rows rows and, where text names a column, about most bytes of it, one row at least.

    small_batches bounds a batch, whatever the texts' lengths; a slice bounds what a task makes of it at once.
    """
    for batch in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if text is not None and batch.num_rows else None
        while at < batch.num_rows:
            n = rows if ends is None else min(rows, max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at))
            yield batch.slice(at, n)
            at += n


def word_count(text: Column) -> Column:
    """Number of words; null for a null text."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))
