"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014); nothing reaches the driver but two
numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """node and root, its component's smallest node, for every node of an edge. Loops and repeated edges are harmless; nulls link nothing.

    Rounds grow with the logarithm of a component's size. Each round's edges and minima are tables in the shared folder: lineage
    stays short, a lost executor costs a round's tasks, and joins on a node of very many edges can be split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, mark = written(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m")), "minima")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = written(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "minima")
        small = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
