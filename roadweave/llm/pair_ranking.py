"""Quality classifier by Bradley-Terry ranking: weights of document features are learned from pairs of a preferred and another document, by
logistic loss on the difference of their features; a quantile of the learned documents' scores is the threshold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches
from .divergence_rules import CLASSES, class_table, words_of

#: Labelled documents of either kind that are learned from at most; pairs that each of them is in, about.
ROWS_A_LABEL, PAIRS_A_ROW = 4000, 16
#: Bytes of a text that are looked at at once, and of the texts of a slice.
CHUNK, SLICE = 1 << 20, 2 << 20
#: Hashed character pairs of the lower-cased text.
HASHED = 128
KINDS = len(CLASSES)
#: Kinds of characters, pairs of them, hashed pairs, and eleven figures of words and lines.
WIDTH = KINDS + KINDS * KINDS + HASHED + 11


def features(text: str | None) -> np.ndarray:
    """Figures of the whole text that hardly depend on its length: roots of shares of the kinds of characters, of neighbouring kinds and of
    hashed pairs of characters; shares of distinct, repeated, short, long, capital and marked words, and of lines. A null text is an empty one."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    kinds, pairs, grams, last = np.zeros(KINDS), np.zeros(KINDS * KINDS), np.zeros(HASHED), None
    table = class_table()
    for a in range(0, len(text), CHUNK):
        points = np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        points = points if last is None else np.concatenate([[last], points]).astype(np.uint32)
        k = table[np.minimum(points, 0xFFFF)].astype(np.int64)
        own = k if last is None else k[1:]
        kinds += np.bincount(own, minlength=KINDS)
        pairs += np.bincount(k[:-1] * KINDS + k[1:], minlength=KINDS * KINDS)
        low = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)
        grams += np.bincount(((low[:-1] * np.uint32(0x9E3779B1) + low[1:]) * np.uint32(0xC2B2AE35)) >> np.uint32(25), minlength=HASHED)
        last = points[-1]
    words, lines = words_of(text), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    pairs, grams = pairs / max(1.0, pairs.sum()), grams / max(1.0, grams.sum())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[: KINDS + KINDS * KINDS + HASHED] = np.sqrt(np.concatenate([kinds / len(text), pairs, grams]))
    out[KINDS + KINDS * KINDS + HASHED :] = (
        len(set(words)) / n, len(set(words)) / n**0.5 / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, float(np.log1p(sizes.sum() / n)), (sizes <= 2).sum() / n, (sizes > 20).sum() / n,
        len(set(lines)) / m, float(np.log1p(n / m)), sum(w.isupper() for w in words) / n, sum(not w[-1:].isalnum() for w in words if w[-1] < 128) / n, 1 / (1 + n),
    )
    return out


@dataclass
class Ranker:
    """weights over (features - mean) / spread; threshold: the score that half a chance stands for. Without weights all documents have the
    chance fallback."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 0.0
    fallback: float = 0.5

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) / self.spread).clip(-8, 8) * self.weights).sum(axis=1)  # alike for equal rows, whatever stands beside them

    def chances(self, x: np.ndarray) -> np.ndarray:
        """How likely a document is preferred to one at the threshold."""
        if not len(self.weights):
            return np.full(len(x), self.fallback)
        return 1 / (1 + np.exp(-np.clip(self.strengths(x) - self.threshold, -500, 500)))


def bradley_terry(high: np.ndarray, low: np.ndarray, strength: float = 1e-3, steps: int = 300, seed: int = 3) -> np.ndarray:
    """Weights w that make log(1 + exp(-w (h - l))) small on average over pairs, by accelerated gradient descent. Each round of pairs deals the
    documents of the smaller side to those of the other anew, so all of them are in pairs."""
    rng, pairs = np.random.default_rng(seed), []
    n = max(len(high), len(low))
    for _ in range(PAIRS_A_ROW):
        pairs.append([np.resize(rng.permutation(len(side)), n)[rng.permutation(n)] for side in (high, low)])
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    # w (h - l) = w h - w l, so no difference is kept: the gradient by document is summed over its pairs.
    rate = 4 / (2 * max(np.linalg.eigvalsh(x.T @ x / len(x))[-1] for x in (high, low)) + strength)
    w = past = np.zeros(high.shape[1])
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - past)
        miss = 1 / (1 + np.exp(np.clip((high @ ahead)[a] - (low @ ahead)[b], -500, 500)))
        slope = (np.bincount(b, miss, len(low)) @ low - np.bincount(a, miss, len(high)) @ high) / len(a) + strength * ahead
        past, w = w, ahead - rate * slope
    return w


def learned(high: np.ndarray, low: np.ndarray, share_low: float) -> Ranker:
    """From features of preferred and other documents; share_low: what part of all labelled documents are other ones. The threshold is that
    quantile of the scores, each side counted by its share, halfway to the next score."""
    both = np.concatenate([high, low]).astype(np.float64)
    mean, spread = both.mean(axis=0), both.std(axis=0)
    spread[spread < 1e-6] = 1.0
    model = Ranker(np.zeros(0), mean, spread)
    model.weights = bradley_terry(*(((x - mean) / spread).clip(-8, 8) for x in (high, low)))
    scores = np.concatenate([model.strengths(high), model.strengths(low)])
    weigh = np.concatenate([np.full(len(high), (1 - share_low) / len(high)), np.full(len(low), share_low / len(low))])
    order = np.argsort(scores, kind="stable")
    below = min(int(np.searchsorted(np.cumsum(weigh[order]), share_low * (1 - 1e-9))), len(order) - 2)
    model.threshold = float(scores[order[below : below + 2]].mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_a_label: int = ROWS_A_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Learns from at most rows_a_label documents of either label, those whose hash of the id is lowest; learn is over doc_id.

    An id with both labels counts as 1 if most of its rows say so, and teaches nothing at a tie; of documents with one id the one of the lowest
    text hash teaches. Labels other than 0 and 1, null ids and labels without a document teach nothing. Ids and features of the sample, 1 kB
    a document, and three counts are all that reaches the driver. With one label only, every chance is that label; with none, one half.
    """
    small_batches(docs.sparkSession)
    said = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).filter(learn & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    said = said.groupBy("doc_id").agg(F.sum(2 * F.col("label") - 1).alias("lean")).filter("lean <> 0").select("doc_id", (F.col("lean") > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("mixed"))
    counts = {r["label"]: r["count"] for r in said.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Ranker(fallback=float(next(iter(counts), 0.5)))
    low = F.lit(False)  # somewhat more than is asked, as a label may lack its document
    for label, n in counts.items():
        low = low | ((F.col("label") == label) & (F.col("mixed") <= int(-(2**63) + min(1.0, (1.3 * rows_a_label + 20) / n) * (2**64 - 2**12))))
    chosen = said.filter(low).select(F.col("doc_id").alias("said_id"), "label", "mixed")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("said_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=3, most=SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([features(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary()), batch.column(4)], names=["doc_id", "label", "mixed", "v", "text_hash"])

    found = rows.select("doc_id", "label", "mixed", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, label int, mixed long, v binary, text_hash long")
    found = found.groupBy("doc_id", "label", "mixed").agg(F.min(F.struct("text_hash", "v")).alias("best")).select("label", "mixed", F.col("best.v").alias("v")).collect()
    sides = [[np.frombuffer(v, np.float32) for _, v in sorted((r["mixed"], bytes(r["v"])) for r in found if r["label"] == side)[:rows_a_label]] for side in (1, 0)]
    if not all(sides):
        return Ranker(fallback=1.0 if sides[0] else 0.0 if sides[1] else 0.5)
    return learned(np.stack(sides[0]), np.stack(sides[1]), counts[0] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of docs in place, without a shuffle. Only the text is an input, the whole of it; null and empty texts
    are scored as empty ones, repeated rows each. Other columns are left out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=1, most=SLICE):
            if batch.num_rows:
                chances = model.chances(np.stack([features(t) for t in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chances, pa.float64()), pa.array((chances >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
