"""Mixing sources to target weights by the cube method (Deville and Tillé, 2004).

Each document gets whole copies plus a fractional chance of one more. The chances move through the null space of the constraints
(words and documents of the source stay as they are) until they are 0 or 1, in blocks; what each block leaves open, two documents at
most, moves on in a few larger blocks, and only the last two of a source are landed by giving up the words, then the documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Weights by the place of a source in code point order, repeating; a fixed rule of the mix.
WEIGHTS = (5, 2, 1)
EPS = 1e-9


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Moves chances to 0 or 1 keeping sum(chance) and sum(chance * size); at most two stay fractional, none with land."""
    p, s = chance.astype(float).tolist(), size.astype(float).tolist()
    draw = rng.random
    open_: list[int] = []

    def step(u: list[float]) -> None:
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u, strict=True) if x)
        move = up if draw() * (up + down) < down else -down
        for k, x in zip(open_, u, strict=True):
            q = p[k] + move * x
            p[k] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        open_[:] = [k for k in open_ if 0 < p[k] < 1]

    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            open_.append(k)
            if len(open_) == 3:
                a, b, c = (s[i] for i in open_)
                u = [b - c, c - a, a - b]
                top = max(map(abs, u))
                step([x / top for x in u] if top else [1.0, -1.0, 0.0])
    while len(open_) == 2 and (land or s[open_[0]] == s[open_[1]]):
        step([1.0, -1.0])
    if land and open_:
        p[open_[0]] = float(draw() < p[open_[0]])
    return near(np.array(p), chance, size) if land else np.array(p)


def near(landed: np.ndarray, chance: np.ndarray, size: np.ndarray, most: int = 3) -> np.ndarray:
    """The landing's last step: exchanges a taken document for one left out, both left to chance, where that brings the words nearer to
    their total. The number of documents stays. At most `most` exchanges, the best one first."""
    landed, size = landed.copy(), size.astype(float)
    free = (chance > EPS) & (chance < 1 - EPS)
    off = float(((landed - chance) * size).sum())
    for _ in range(most):
        taken, out = np.flatnonzero(free & (landed > 0.5)), np.flatnonzero(free & (landed < 0.5))
        if not len(taken) or not len(out):
            break
        out = out[np.argsort(size[out], kind="stable")]
        # For each taken document the one left out whose size is nearest to what would clear the difference.
        at = np.searchsorted(size[out], size[taken] - off)
        at = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(out) - 1)])
        after = np.abs(off - size[taken] + size[out][at])
        side, k = np.unravel_index(after.argmin(), after.shape)
        if after[side, k] >= abs(off):
            break
        i, j = taken[k], out[at[side, k]]
        landed[i], landed[j] = 0.0, 1.0
        off += size[j] - size[i]
    return landed


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, n -> also target: words by weight, none above cap times its source, the excess shared anew by weight.

    Sources in the order of cap/weight: one is at its cap if the words left for it and all after it, by weight, reach that cap. One
    row a source, so single-partition windows are small. A source without words gets 0.
    """
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0.0)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    at = F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(-1.0)
    order = Window.orderBy("at", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("at", at).withColumn("rate", F.when(weights > 0, left / weights).otherwise(0.0))
    ranked = ranked.withColumn("full", F.col("rate") >= F.col("at"))
    rate = F.max(F.when(~F.col("full"), F.struct(-F.col("at"), -F.col("place"), F.col("rate")))).over(everything).getField("rate")
    return ranked.select("source", "source_size", "n", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * rate).alias("target"))


def mix(docs: DataFrame, seed: int = 7, block_rows: int = 500, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (words, repeats counted), source and the columns carry, one row for each row of docs.

    Blocks hold about block_rows rows of a source, by a hash of id and text, and a random generator each, seeded by source and block:
    reruns agree. Rows alike in id and text are interchangeable. A null source is a source of its own, last in order; a null text has
    size 0, and documents of no words take part without weight in words. An empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`")
    size = F.coalesce(word_count(text), F.lit(0)).cast("long") if size is None else size
    mixed = F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), mixed.alias("mixed"), *carry)
    rows = written(rows, "mix-sizes")
    totals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), cap)
    totals = totals.withColumnRenamed("source", "of").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EPS).cast("int")
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", "blocks", whole.alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("chance"), "mixed", *carry
    ).withColumn("block", F.pmod("mixed", "blocks").cast("int"))

    def fly(last: bool):
        def block(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["mixed", "doc_id", "size"], kind="stable", ignore_index=True)
            rng = np.random.default_rng([seed, int(x["source_size"].iloc[0]), len(x), int(x["mixed"].iloc[0]) & 0xFFFFFFFF])
            return x.assign(chance=flight(x["chance"].to_numpy(), x["size"].to_numpy(), rng, land=last))

        return block

    schema, blocks = rows.schema, totals.agg(F.max("blocks")).first()[0] or 1
    done = []
    while True:
        rows = written(rows.groupBy("source", "block").applyInPandas(fly(blocks == 1), schema), "mix-flown")
        if blocks == 1:
            done.append(rows)
            break
        done.append(rows.filter(F.col("chance").isin(0.0, 1.0)))
        fewer = max(1, block_rows // 2)
        blocks = math.ceil(blocks / fewer)
        rows = rows.filter(~F.col("chance").isin(0.0, 1.0)).withColumn("block", (F.col("block") / fewer).cast("int"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.col("whole") + F.col("chance").cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "source", *carry)
