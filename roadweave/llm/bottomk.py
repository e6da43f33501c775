"""Near-duplicate documents by bottom-k sketches from one hash function (Broder, 1997; Cohen and Kaplan, 2007).

A document keeps the k lowest hashes of its word shingles. Inverted lists of these values name candidates, the sketch of the union
estimates their similarity, and exact set sizes decide.

Values are taken rarest first: two documents of similarity 0.8 or more share at least LEAST of the k values but for a chance under
1e-9, so they also share one of the k - LEAST + 1 rarest of each, and common passages, boilerplate for example, need no list. What
stays in lists of more than LIST documents is made of common text for the most part; such documents are compared all with all, in
blocks, within the groups that their lists connect. Documents of equal sets are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small_batches, written
from .components import connected_components

K, LEAST_SHARE = 48, 0.42
#: Longest list whose documents are all paired; documents in a block; candidates whose ids may be broadcast (8 MB).
LIST, BLOCK, MAX_BROADCAST = 24, 400, 1_000_000
#: The union sketch of 48 values lies under this for a pair of 0.8 once in a billion.
ESTIMATE = 0.44


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased; the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_mark, n (set size), digest of the set (null if empty) and its K lowest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=1):
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s[:K] for s in sets], pa.list_(pa.int64()))], names=["doc_id", "text_mark", "n", "digest", "low"]
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_mark")).mapInArrow(run, "doc_id long, text_mark long, n long, digest binary, low array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, g, nb and the whole set as bytes, from doc_id, text, g, nb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "g", "nb", "items"])

    return docs.mapInArrow(run, "doc_id long, g long, nb int, items binary")


def linked(ids: list[int], sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs of at least threshold % similarity connect: a spanning forest."""
    n, sizes = len(ids), np.array([len(s) for s in sets], np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1 if len(order) else column
        common = np.zeros((n, n), np.int64)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [start, start + 8192])
            m = np.zeros((n, 8192), np.float32)
            m[row[a:b], column[a:b] - start] = 1
            common += np.rint(m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(100 * common >= threshold * union, 1)).tolist():
        if (a := find(i)) != (b := find(j)):
            root[b] = a
            out.append((ids[i], ids[j]))
    return out


def candidate_edges(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose estimate is high enough, and for each long list its documents tied to its smallest id. reps: doc_id, n, low."""
    least = F.ceil(F.size("low") * LEAST_SHARE)
    rows = reps.select("doc_id", "n", F.size("low").alias("m"), (F.size("low") - least + 1).alias("prefix"), F.explode("low").alias("v"))
    shared = written(rows.groupBy("v").agg(F.count("*").alias("times")).filter("times > 1"), "shared-values")
    rows = rows.join(shared, "v")
    mine = Window.partitionBy("doc_id")
    # Values that are alone in the corpus come first; the shared ones follow, rarest first.
    place = F.col("m") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("times", "v"))
    rows = written(rows.withColumn("place", place).filter("place <= prefix").select("v", "doc_id", "n"), "kept-values")
    lists = written(rows.groupBy("v").agg(F.count("*").alias("length"), F.min("doc_id").alias("hub")).filter("length > 1"), "lists")
    few = rows.join(lists.filter(F.col("length") <= LIST).select("v"), "v")
    few = written(few, "few")
    left, right = few.select("v", F.col("doc_id").alias("a"), F.col("n").alias("na")), few.select("v", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "v").filter("a < b and 100 * least(na, nb) >= 80 * greatest(na, nb)").select("a", "b").distinct()
    low = reps.select("doc_id", "low")
    pairs = pairs.join(low.select(F.col("doc_id").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("doc_id").alias("b"), F.col("low").alias("lb")), "b")
    union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, K)
    both = F.size(F.array_intersect("union", F.array_intersect("la", "lb")))
    pairs = pairs.withColumn("union", union).filter(both >= F.size("union") * ESTIMATE).select("a", "b")
    many = rows.join(lists.filter(F.col("length") > LIST).select("v", "hub"), "v").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    return pairs, many


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_mark (xxhash64 of the text) for each row of docs: documents of at least threshold % similarity are linked, and
    component_id is the smallest id that links reach.

    Texts without words have empty sets and are alone. A null id is linked with nothing, has a null component and is kept; rows with
    equal ids count as one document of several texts. Thresholds under 80 aren't offered: the sketch's bounds are made for 80.
    """
    if not 80 <= threshold <= 100:
        raise ValueError("threshold must be 80 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    all_rows = written(sketches(docs, width), "sketches")
    known = all_rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = written(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low")), "representatives")
    pairs, many = candidate_edges(reps.select("doc_id", "n", "low"))
    groups = connected_components(pairs.unionByName(many))
    size = groups.groupBy("root").agg(F.count("*").alias("size"))
    groups = written(groups.join(size, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("g"), F.ceil(F.col("size") / BLOCK).cast("int").alias("nb")), "groups")
    chosen = F.broadcast(groups) if groups.count() <= MAX_BROADCAST else groups
    sets = full_sets(docs.filter(F.col("doc_id").isNotNull()).join(chosen, "doc_id").select("doc_id", "text", "g", "nb"), width)
    block = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    sets = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sets = sets.select("doc_id", "g", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held, out = None, [], [], []
        for batch in batches:
            for doc_id, g, x, y, items in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (g, x, y) != key:
                    if len(ids) > 1:
                        out += linked(ids, held, threshold)
                    key, ids, held = (g, x, y), [], []
                ids.append(doc_id)
                held.append(np.frombuffer(items, np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if len(ids) > 1 and (out := linked(ids, held, threshold)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = sets.repartition(n, "g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(verify, "a long, b long")
    found = connected_components(links)
    classes = reps.select("digest", F.col("doc_id").alias("rep")).join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component"))
    classes = written(classes, "classes")
    out = all_rows.select("doc_id", "text_mark", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_mark")
