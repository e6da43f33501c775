"""What the operators on embeddings share: which rows take part, and sums of partial results over tasks."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **more: Column) -> tuple[DataFrame, int, int]:
    """vec_id, v (array of double) and the columns of more, for rows whose vector isn't null and has only finite entries; then their number and length.

    Rows of another length than the most frequent one (the longer of two) can't be compared with the rest: they take no part, and a warning
    says how many. Null and repeated ids stay. No rows, or only empty vectors: the length is 0.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), *(c.alias(n) for n, c in more.items()))
    rows = rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    for n in more:
        rows = rows.filter(F.col(n).isNotNull())
    top = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("most"), F.sum("count").alias("all")).first()
    if top["most"] is None:
        return rows, 0, 0
    n, d = top["most"]
    if top["all"] > n:
        warnings.warn(f"{top['all'] - n} vectors of another length than {d} take no part", stacklevel=2)
    return rows.filter(F.size("v") == d), n, d


def matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """A list column whose rows all have d entries, none null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int, kind: type = np.float64) -> np.ndarray:
    """The sum of part over all batches of df, an array of size numbers. Each task sends one partial sum; lanes of them, as many as the
    square root of the tasks, are added up by tasks before the driver adds the lanes."""
    lanes = max(1, round(df.rdd.getNumPartitions() ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"lane": [TaskContext.get().partitionId() % lanes], "sums": [total.tobytes()]}, schema=pa.schema([("lane", pa.int32()), ("sums", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, kind)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_py(), kind)
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    partial = df.mapInArrow(run, "lane int, sums binary")
    if lanes > 1:
        partial = partial.groupBy("lane").applyInArrow(add, "sums binary")
    total = np.zeros(size, kind)
    for r in partial.select("sums").collect():
        total += np.frombuffer(r["sums"], kind)
    return total
