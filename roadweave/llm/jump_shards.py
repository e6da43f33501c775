"""Sharding by jump consistent hashing (Lamping and Veach, 2014): a stable key and the number of shards give the shard, with no ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. Growing from n to n + 1 shards moves 1/(n + 1) of the keys, all of them into shard n."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = np.floor((shard[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """jump_hash as a column of ints."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bins: int | None = None) -> DataFrame:
    """Every row with its shard, its place in the shard, and its shard if one more is appended.

    A shard follows from the id and the number of shards alone. Places are gapless from 0: a shard is cut into `bins` bins by a
    second hash, rows are numbered in each bin, and the counts of the bins before it are added, so no task holds a whole shard. The
    table of counts has shards x bins rows, which bounds what is broadcast.
    A null text counts as no bytes (size 1, crc32 0). Null ids have one shard of their own, spread over its bins by crc32; rows
    with equal ids share a shard and have different places. An empty table gives an empty result. Other columns are left out.
    """
    bins = bins or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    mixed = F.xxhash64("doc_id")
    rows = rows.select("*", jump_shard(mixed, shards).alias("shard"), jump_shard(mixed, shards + 1).alias("grown_shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int").alias("bin"))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bin", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")) - 1)
    return placed.join(F.broadcast(before), ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"), "grown_shard"
    )
