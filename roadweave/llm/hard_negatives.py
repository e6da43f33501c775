"""Hard-negative mining: exact integer inner products of anchors and candidates by Strassen's recursion on tiles, and small mergeable heaps of
the best positives and of the best negatives inside a window below each positive."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .vectors import finite_rows, matrix

#: An entry x becomes floor(SCALE * x). Rows of a tile, of a block of anchors (about), and of a block that meet a tile at once; tiles that one
#: task multiplies with a block; groups of tasks that are asked for where there are tiles for so many.
SCALE, TILE_ROWS, BLOCK_ROWS, AT_ONCE, LANE_TILES, GROUPS = 256.0, 4096, 2048, 512, 16, 32
#: Strassen's recursion ends where a side is this short.
LEAF = 32
LOWEST, HIGHEST = -(2**63), 2**63 - 1

TILE = "tile long, ids array<long>, labels array<long>, v binary"
STREAM = f"block int, lane int, kind int, {TILE}, places array<int>, positives array<array<long>>"


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * v): int64 where all fit, else Python integers."""
    if np.abs(v).max(initial=0.0) < 2.0**52:
        return np.floor(v * SCALE).astype(np.int64)
    return np.array([[int(x) * int(SCALE) if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in row] for row in v.tolist()], object)


def largest(a: np.ndarray) -> int:
    return max(-int(a.min()), int(a.max())) if a.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b for whole numbers, exact: 64-bit where no entry can leave it, else Python integers."""
    if object in (a.dtype, b.dtype) or largest(a) * largest(b) * a.shape[1] >= 2**63:
        a, b = a.astype(object), b.astype(object)
    return strassen(a, b)


def padded(a: np.ndarray, m: int, n: int) -> np.ndarray:
    out = np.zeros((m, n), np.int64).astype(a.dtype)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Seven products of half tiles instead of eight. Odd sides are padded with zeros. Sums wrap around at 64 bits, so the result is exact
    if it fits, whatever the sums on the way."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        if a.dtype != object and largest(a) * largest(b) * k < 2**53:  # doubles hold every partial sum
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(padded(a, m + m % 2, k + k % 2), padded(b, k + k % 2, n + n % 2))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), a.dtype)
    p = strassen(a11 + a22, b11 + b22)
    out[:m, :n], out[m:, n:] = p, p
    p = strassen(a21 + a22, b11)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = strassen(a11, b12 - b22)
    out[:m, n:] = p
    out[m:, n:] += p
    p = strassen(a22, b21 - b11)
    out[:m, :n] += p
    out[m:, :n] += p
    p = strassen(a11 + a12, b22)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += strassen(a21 - a11, b11 + b12)
    out[:m, :n] += strassen(a12 - a22, b21 + b22)
    return out


class Heap:
    """The k entries of highest score, ties to the smaller id, null last; entries are (-score, id is null, id, tile, place)."""

    __slots__ = ("entries", "k")

    def __init__(self, k: int):
        self.entries, self.k = [], k

    def merge(self, entries: list[tuple]) -> None:
        if entries:
            self.entries = sorted(self.entries + entries)[: self.k]

    def least(self) -> int | None:
        """The lowest score that stays, once there are k."""
        return -self.entries[-1][0] if len(self.entries) == self.k else None


def packed(rows: DataFrame, d: int) -> DataFrame:
    """Tiles of at most TILE_ROWS rows vec_id, label, v as they come; a tile's rows stand by id, null last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            table = table.sort_by([("vec_id", "ascending")]).combine_chunks()
            v = matrix(table.column("v").chunk(0), d)
            v = v.astype(np.float32).astype("<f4") if (v.astype(np.float32) == v).all() else v.astype("<f8")
            made += 1
            return pa.RecordBatch.from_pydict({"tile": [(TaskContext.get().partitionId() << 24) + made], "ids": [table.column("vec_id").to_pylist()], "labels": [table.column("label").to_pylist()], "v": [v.tobytes()]}, schema=pa.schema([("tile", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("v", pa.binary())]))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TILE_ROWS:
                table = pa.Table.from_batches(held)
                for a in range(0, size - TILE_ROWS + 1, TILE_ROWS):
                    yield out(table.slice(a, TILE_ROWS))
                rest = table.slice(size - size % TILE_ROWS).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield out(pa.Table.from_batches(held))

    return rows.select("vec_id", "label", "v").mapInArrow(run, TILE)


def unpacked(row: dict, d: int) -> np.ndarray:
    n = len(row["ids"])
    return np.frombuffer(row["v"], "<f4" if len(row["v"]) == 4 * n * d else "<f8").reshape(n, d).astype(np.float64)


class Block:
    """Anchors of a block, with their heaps."""

    def __init__(self, d: int, k: int):
        self.d, self.k = d, k
        self.tiles, self.places, self.labels, self.positives, self.parts = [], [], [], [], []

    def add(self, row: dict) -> None:
        self.tiles += [row["tile"]] * len(row["places"])
        self.places += row["places"]
        self.labels += row["labels"]
        self.positives += row["positives"] or [None] * len(row["places"])
        self.parts.append(unpacked(row, self.d))

    def start(self) -> None:
        self.x = whole(np.concatenate(self.parts))
        self.own = np.array(self.labels, np.int64)
        self.parts = []
        self.heaps = [[Heap(self.k) for _ in (p or [0])] for p in self.positives]

    def multiply(self, tile: dict) -> None:
        """Merges what a tile holds into the heaps: rows of an anchor's own label, or, once it has positives, rows of other labels in their windows."""
        labels, ids = np.array(tile["labels"], np.int64), tile["ids"]
        mining = self.positives[0] is not None
        at = np.flatnonzero((self.own != labels[0]) | (labels != labels[0]).any() if mining else np.isin(self.own, labels))
        candidates = whole(unpacked(tile, self.d)).T
        for a in range(0, len(at), AT_ONCE):
            scores = product(self.x[at[a : a + AT_ONCE]], candidates)
            scores = np.clip(scores, LOWEST, HIGHEST).astype(np.int64) if scores.dtype == object else scores
            for i, s in zip(at[a : a + AT_ONCE].tolist(), scores, strict=True):
                good = labels != self.own[i] if mining else labels == self.own[i]
                if not mining and self.tiles[i] == tile["tile"]:
                    good[self.places[i]] = False
                self.keep(i, s, good, tile["tile"], ids)

    def keep(self, i: int, s: np.ndarray, good: np.ndarray, tile: int, ids: list) -> None:
        """The best of scores s where good, for each heap of anchor i."""
        bounds = []
        for h, heap in enumerate(self.heaps[i]):
            p = self.positives[i][h] if self.positives[i] else None
            low, high = (-math.inf, math.inf) if p is None else window(p)
            least = heap.least()
            bounds.append((low if least is None else max(low, least), high))
        low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
        if high < low:
            return
        where = np.flatnonzero(good & (s >= low) & (s <= high))
        if not len(where):
            return
        own = s[where]
        order = np.argsort(-own, kind="stable")
        where, own = where[order], own[order]
        for heap, (low, high) in zip(self.heaps[i], bounds, strict=True):
            if low <= high:
                fits = np.flatnonzero((own >= low) & (own <= high))[: self.k]
                heap.merge([(-int(own[j]), ids[where[j]] is None, ids[where[j]] or 0, tile, int(where[j])) for j in fits])

    def found(self) -> Iterator[tuple]:
        for i, heaps in enumerate(self.heaps):
            for h, heap in enumerate(heaps):
                for negated, none, vec_id, tile, place in heap.entries:
                    yield self.tiles[i], self.places[i], h + 1, None if none else vec_id, -negated, tile, place


#: A negative's score times 100 lies between these many times the positive's.
WINDOW = (30, 90)


def window(positive: int) -> tuple[int, int]:
    return -(-WINDOW[0] * positive // 100), WINDOW[1] * positive // 100


FOUND = "a_tile long, a_place int, heap int, vec_id long, score long, tile long, place int"


def multiplied(tiles: DataFrame, anchors: DataFrame, d: int, blocks: int, lanes: int, k: int) -> DataFrame:
    """The entries that each anchor's heaps hold after each lane of tiles. A lane's anchors come before its tiles, so a task holds one block of
    anchors and one tile at a time, and sends k entries for each heap of a lane, whatever the number of its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, begun = None, None, False

        def out() -> pa.RecordBatch:
            rows = list(block.found()) if begun else []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["lane"]) != key:
                    if block:
                        yield out()
                    block, key, begun = Block(d, k), (row["block"], row["lane"]), False
                if row["kind"] == 0:
                    block.add(row)
                elif block.places:
                    if not begun:
                        block.start()
                        begun = True
                    block.multiply(row)
        if block:
            yield out()

    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    lane = F.pmod(F.xxhash64("tile"), F.lit(lanes)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = (F.array().cast("array<int>").alias("places"), F.lit(None).cast("array<array<long>>").alias("positives"))
    right = tiles.select(every(blocks).alias("block"), lane.alias("lane"), F.lit(1).alias("kind"), "tile", "ids", "labels", "v", *empty)
    left = anchors.select("block", every(lanes).alias("lane"), F.lit(0).alias("kind"), "tile", "ids", "labels", "v", F.array("place").alias("places"), "positives")
    stream = left.unionByName(right).repartition("block", "lane").sortWithinPartitions("block", "lane", "kind", "tile")
    return stream.mapInArrow(run, FOUND)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank, anchor_mark.

    is_anchor is over vec_id and label, label over the columns of vectors. For each anchor its first positives other rows of its label by
    inner product of whole numbers, and for each of them the first negatives rows of other labels whose score is 30 to 90 hundredths of the
    positive's. Ties go to the smaller id; a null id is last. positive_rank and anchor_mark, a hash of the anchor's vector and label, tell
    anchors of one id, and positives of one id, apart. An anchor with no positive, and a positive whose window is empty, give no rows, so a
    positive of a negative score gives none. Rows with null labels or vectors, or null or non-finite entries, take no part, nor do rows of
    a rarer length (with a warning). Repeated rows count each. A score that a long can't hold counts as the nearest long. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows, total, d = finite_rows(vectors, id_col, vector_col, label=label.cast("long"))
    if not d:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int, anchor_mark long")
    parts = max(1, math.ceil(total / TILE_ROWS))
    # Rows of a label stand together, so that few tiles have to do with an anchor's own label; a label of very many rows is many ranges.
    near = rows.withColumns({"mixed": F.xxhash64("vec_id", "v"), "row": F.monotonically_increasing_id()}).repartitionByRange(parts, "label", "mixed", "row").sortWithinPartitions("label", "mixed", "row")
    tiles = written(packed(near.coalesce(parts), d), "tiles")
    count = tiles.select(F.explode(F.arrays_zip("ids", "labels")).alias("x")).select(F.col("x.ids").alias("vec_id"), F.col("x.labels").alias("label")).filter(is_anchor).count()
    blocks = max(1, math.ceil(count / BLOCK_ROWS))
    lanes = max(1, math.ceil(parts / LANE_TILES), math.ceil(min(parts, GROUPS) / blocks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of tiles, each as a tile of one row with its place."""
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                step = len(row["v"]) // n
                yield pa.RecordBatch.from_pydict({"tile": [row["tile"]] * n, "vec_id": row["ids"], "label": row["labels"], "v": [row["v"][a : a + step] for a in range(0, n * step, step)], "place": list(range(n))}, schema=pa.schema([("tile", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("place", pa.int32())]))

    anchors = tiles.mapInArrow(cut, "tile long, vec_id long, label long, v binary, place int").filter(is_anchor)
    anchors = written(anchors.select("tile", "place", F.array("vec_id").alias("ids"), F.array("label").alias("labels"), "v", F.pmod(F.xxhash64("tile", "place"), F.lit(blocks)).cast("int").alias("block")), "anchors")
    none = F.lit(None).cast("array<array<long>>")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "tile", "place"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = multiplied(tiles, anchors.withColumn("positives", none), d, blocks, lanes, positives)
    first = written(first.withColumn("positive_rank", rank("a_tile", "a_place")).filter(F.col("positive_rank") <= positives), "positives")
    listed = first.groupBy("a_tile", "a_place").agg(F.sort_array(F.collect_list(F.struct("positive_rank", "score"))).alias("list"))
    listed = listed.select(F.col("a_tile").alias("tile"), F.col("a_place").alias("place"), F.array(F.col("list.score")).alias("positives"))
    second = multiplied(tiles, anchors.join(listed, ["tile", "place"]), d, blocks, lanes, negatives)
    second = second.withColumn("rank", rank("a_tile", "a_place", "heap")).filter(F.col("rank") <= negatives)
    second = second.select("a_tile", "a_place", F.col("heap").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    first = first.select("a_tile", "a_place", "positive_rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = anchors.select(F.col("tile").alias("a_tile"), F.col("place").alias("a_place"), F.col("ids")[0].alias("anchor_id"), F.xxhash64("v", "labels").alias("anchor_mark"))
    out = second.join(first, ["a_tile", "a_place", "positive_rank"]).join(who, ["a_tile", "a_place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank", "anchor_mark")
