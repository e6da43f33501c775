"""Approximate nearest neighbours by learned partitions (after Dong et al., 2020): the neighbour graph of a sample is cut into balanced
parts, a small classifier learns the parts, every vector is filed under its most probable part, and a query visits the most probable
parts until their probabilities add up; visited vectors are ranked by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

#: Rows of the sample, or SAMPLE_A_PART for each part if those are more; neighbours in its graph; vectors a part should hold; parts at most;
#: rows of a block and of a slice of queries, about.
SAMPLE, NEIGHBOURS, PART_ROWS, MAX_PARTS, BLOCK_ROWS, SLICE_ROWS = 8192, 10, 250, 512, 3000, 10_000
#: Sample rows that a part needs for its cut to be learned, and those that are asked for.
LEAST_A_PART, SAMPLE_A_PART = 20, 24


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(queries: np.ndarray, base: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Rows of base nearest to each query by cosine; with same, not the query's own row."""
    out = []
    for a in range(0, len(queries), 1024):
        s = queries[a : a + 1024] @ base.T
        if same:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out.append(np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(graph: np.ndarray, x: np.ndarray, parts: int, passes: int = 12) -> np.ndarray:
    """A part for each row, of sizes at most one apart at each cut: halves by the main direction, then swaps of equal numbers across the
    cut while that keeps more neighbours together."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, name, n = todo.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = name
            continue
        own = np.full(len(x), -1)
        own[rows] = np.arange(len(rows))
        edge = own[graph[rows]]
        a, b = np.repeat(np.arange(len(rows)), graph.shape[1])[edge.ravel() >= 0], edge.ravel()[edge.ravel() >= 0]
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
        side = np.full(len(rows), -1.0)
        side[np.argsort(centred @ direction, kind="stable")[len(rows) // 2 :]] = 1.0
        for _ in range(passes):
            pull = np.bincount(a, side[b], len(rows)) + np.bincount(b, side[a], len(rows))
            gain = -side * pull
            left, right = (np.flatnonzero(side == s) for s in (-1.0, 1.0))
            left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
            m = min(len(left), len(right))
            good = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2
            if not good:
                break
            side[left[:good]], side[right[:good]] = 1.0, -1.0
        todo += [(rows[side < 0], name, n // 2), (rows[side > 0], name + n // 2, n - n // 2)]
    return part


def train_classifier(x: np.ndarray, soft: np.ndarray, hidden: int = 128, passes: int = 30, seed: int = 5) -> list[np.ndarray]:
    """One hidden layer and a softmax over parts, by Adam, towards the parts of each row's neighbours."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, soft.shape[1])), np.zeros(soft.shape[1])]
    w = [a.astype(np.float32) for a in w]
    x, scale = x.astype(np.float32), np.float32(x.shape[1] ** 0.5)
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a : a + 256]
            h = np.maximum(0, x[at] * scale @ w[0] + w[1])
            p = softmax(h @ w[2] + w[3])
            d = (p - soft[at]) / len(at)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((x[at].T @ dh * scale, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                w[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """weights of the classifier; visits: how many parts a query goes to, measured on held-out queries of the sample."""

    weights: list[np.ndarray]
    visits: int

    def chances(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.ones((len(x), 1))
        scale = np.float32(x.shape[1] ** 0.5)
        h = np.maximum(0, x.astype(np.float32) * scale @ self.weights[0] + self.weights[1])
        return softmax(h @ self.weights[2] + self.weights[3])


def fit(sample: np.ndarray, parts: int, want: float = 0.98, k: int = 5) -> Router:
    """Learns from four fifths of the sample and sets the visits by the recall of the rest among them. A sample too small
    for so many parts gets fewer."""
    parts = min(parts, len(sample) // LEAST_A_PART)
    if parts < 2:
        return Router([], 1)
    x = unit(sample)
    held, own = x[::5], np.delete(x, np.s_[::5], axis=0)
    graph = neighbours(own, own, NEIGHBOURS, True)
    part = bisect(graph, own, parts)
    soft = np.zeros((len(own), parts), np.float32)
    for c in range(graph.shape[1]):
        np.add.at(soft, (np.arange(len(own)), part[graph[:, c]]), 1.0)
    np.add.at(soft, (np.arange(len(own)), part), 2.0)
    router = Router(train_classifier(own, soft / soft.sum(axis=1, keepdims=True)), parts)
    filed = router.chances(own).argmax(axis=1)
    rank = np.empty((len(held), parts), np.int64)
    np.put_along_axis(rank, np.argsort(-router.chances(held), axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(rank, filed[neighbours(held, own, k, False)], axis=1)
    recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    router.visits = int(np.argmax(recall >= want)) + 1
    return router


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, in double precision, the same for equal rows wherever they stand."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    return (c * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum(axis=1)))


def nearest_in_block(query_marks: np.ndarray, queries: np.ndarray, ids: np.ndarray, marks: np.ndarray, rows: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """Index of the query, id and cosine of the k best of a block for each query; ties to the smaller id. Marks tell rows: a query's own is left out."""
    order = np.argsort(ids, kind="stable")
    ids, marks, rows = ids[order], marks[order], rows[order]
    near = unit(rows).T
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for a in range(0, len(queries), 256):
        about = unit(queries[a : a + 256]) @ near
        for i, s in enumerate(about):
            s = np.where(marks == query_marks[a + i], -np.inf, s)
            at = np.flatnonzero(s >= (np.partition(s, -k)[-k] if len(s) > k else -2.0) - 1e-9)
            if not len(at):
                continue
            exact = exact_scores(queries[a + i], rows[at])
            best = np.lexsort((ids[at], -exact))[:k]
            out[0].extend([a + i] * len(best))
            out[1].extend(ids[at][best].tolist())
            out[2].extend(exact[best].tolist())
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v: rows with an id whose vector has the most frequent length (the longer of two), only finite components and a non-zero one."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fine)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("v") == (length[0]["d"] if length else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, query_mark: the k nearest rows found for each row where is_query (over vec_id) holds, that row left out.

    Fitted on a sample that grows with the parts, the rows of lowest hash; every row is filed. A part of many rows is split into blocks by
    a hash of the row, and its queries into slices; each slice visits each block. Repeated ids and rows are candidates and queries row by row; query_mark, a
    number of the row, tells queries of one id apart. Rows that take no part: see usable. Empty tables and lone rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    parts = int(min(MAX_PARTS, total // part_rows))
    wanted = max(SAMPLE, SAMPLE_A_PART * parts)
    share = min(1.0, 1.2 * wanted / max(1, total))
    sample = rows.filter(F.xxhash64("vec_id", "v") <= int(-(2**63) + share * (2**64 - 2**12))).select("vec_id", "v").limit(2 * wanted).collect() if parts > 1 else []
    held = spark.sparkContext.broadcast(fit(np.array([r["v"] for r in sorted(sample, key=lambda r: (r["vec_id"], r["v"]))[:wanted]]), parts) if sample else Router([], 1))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = held.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                ranked = np.argsort(-router.chances(unit(x)), axis=1, kind="stable")[:, : router.visits]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(ranked.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "v", "mark", "parts"])

    filed = written(rows.withColumn("mark", F.monotonically_increasing_id()).mapInArrow(file, "vec_id long, v array<double>, mark long, parts array<int>"), "filed")
    sizes = filed.groupBy(F.col("parts")[0].alias("part")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    calls = filed.filter(is_query).select(F.explode("parts").alias("part")).groupBy("part").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
    sizes = F.broadcast(sizes.join(F.broadcast(calls), "part"))  # one row a part that has rows and queries, MAX_PARTS at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = filed.select("vec_id", "v", "mark", F.col("parts")[0].alias("part")).join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), "blocks").cast("int")).withColumn("slice", each("slices"))
    asked = filed.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("mark").alias("query_mark"), F.explode("parts").alias("part")).join(sizes, "part")
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("query_id", "query_mark"), "slices").cast("int")).select("query_id", "q", "query_mark", "part", "slice", each("blocks").alias("block"))

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "query_mark": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query_mark": "int64", "vec_id": "int64"})
        i, ids, scores = nearest_in_block(right["query_mark"].to_numpy(), np.stack(right["q"].to_list()), left["vec_id"].to_numpy(), left["mark"].to_numpy(), np.stack(left["v"].to_list()), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[i], "query_mark": right["query_mark"].to_numpy()[i], "vec_id": ids, "score": scores})

    asked = asked.select("query_id", "q", "query_mark", F.col("part").alias("to_part"), F.col("block").alias("to_block"), F.col("slice").alias("to_slice"))
    found = base.groupBy("part", "block", "slice").cogroup(asked.groupBy("to_part", "to_block", "to_slice")).applyInPandas(visit, "query_id long, query_mark long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_mark")
