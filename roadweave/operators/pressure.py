"""Choices under load by road and time: cells that a route presses on when it gets there, growth of concentration, costs with ties broken by a
seed, and choices in order of arrival that see those before them."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterable
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from roadweave.functions.scalars import sum_once
from roadweave.operators.graph import connected_components, cut
from roadweave.operators.joins import in_parts, sent_if_few

# The reasons of a choice.
NO_CANDIDATE, FASTEST, SPREAD, TIED = "no_valid_candidate", "fastest_candidate", "lower_concentration_within_detour_bound", "seeded_tie_break"


#: Cells or requests that may be sent to every task: one or two numbers each.
MOST_SHARED = 200_000


def timed_cells(entries: DataFrame, *keys: str, bin_s: int = 300, kernel: tuple[float, ...] = (1.0,)) -> DataFrame:
    """keys, seg, bin, share: entries into roads by bin of their time, each one in all, spread over neighbouring bins by the kernel, whose weights
    are brought to a sum of 1. Entries into one road and bin add up. entries: keys, seg, entry_s; a null time presses nowhere."""
    half, total = len(kernel) // 2, float(sum(kernel))
    spread = F.explode(F.array(*(F.struct(F.lit(j - half).alias("d"), F.lit(w / total).alias("w")) for j, w in enumerate(kernel) if w > 0)))
    e = entries.filter("entry_s is not null").select(*keys, "seg", F.floor(F.col("entry_s") / bin_s).alias("at"))
    e = (e.repartition(*keys) if keys else e).withColumn("x", spread)  # by keys as entries, not as the kernel's copies of them
    return e.groupBy(*keys, "seg", (F.col("at") + F.col("x.d")).alias("bin")).agg(F.sum("x.w").alias("share"))


def road_weights(roads: DataFrame, per_lane: Column, default_lanes: Column, sensitivity: Column, reference_s: float) -> DataFrame:
    """seg, coef, lanes_assumed: sensitivity times free seconds over the reference, over the squared budget (lanes times what one takes in a bin). By
    time, so that a road cut in two weighs the same. roads: seg, lanes (null or not above 0: the default), free_s."""
    known = F.coalesce(F.col("lanes") > 0, F.lit(False))
    budget = F.greatest(F.when(known, F.col("lanes")).otherwise(default_lanes) * per_lane, F.lit(1e-6))
    return roads.select("seg", (sensitivity * F.col("free_s") / reference_s / (budget * budget)).alias("coef"), (~known).alias("lanes_assumed"))


def growth(cells: DataFrame, load: DataFrame, roads: DataFrame, *keys: str) -> DataFrame:
    """keys, growth: by how much the sum of coef L^2 grows, exactly, when all cells of the keys join the load: for a candidate, or the chosen ones of
    a whole plan. cells: keys, seg, bin, share; load: seg, bin, load (missing: 0); roads: seg, coef (missing: 0)."""
    more = cells.groupBy(*keys, "seg", "bin").agg(F.sum("share").alias("share")).join(load, ["seg", "bin"], "left").join(roads.select("seg", "coef"), "seg", "left")
    grown = F.coalesce("coef", F.lit(0.0)) * F.col("share") * (2 * F.coalesce("load", F.lit(0.0)) + F.col("share"))
    return more.groupBy(*keys).agg(sum_once(grown).alias("growth"))


def score_timed(candidates: DataFrame, cells: DataFrame, load: DataFrame, roads: DataFrame, weight: float, tie_s: float = 0.5, seed: int = 0) -> DataFrame:
    """request, candidate, eta, growth, cost, best, reason (of the best): the cost is the time plus weight times the growth. Among the allowed whose
    cost is within tie_s of the least, the best is that of the least digest of seed, request and candidate (of several rows of one candidate the quickest). Without weight, the fastest.
    candidates: request, candidate, eta, allowed; one that isn't allowed has no cost; a null of it is false. cells, load, roads: see growth."""
    c = candidates.join(growth(cells, load, roads, "request", "candidate"), ["request", "candidate"], "left").withColumn("growth", F.coalesce("growth", F.lit(0.0)))
    c = c.withColumn("cost", F.when(F.col("allowed"), F.col("eta") + weight * F.col("growth")))
    mine = Window.partitionBy("request")
    near = F.coalesce(F.col("cost") <= F.min("cost").over(mine) + tie_s, F.lit(False))
    c = c.withColumn("near", near).withColumn("tied", F.count_if("near").over(mine) > 1)
    digest = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("request").cast("string"), F.col("candidate").cast("string")).cast("binary"))
    first = F.row_number().over(mine.orderBy(F.desc("near"), digest, "candidate", "eta")) == 1
    quickest = F.rank().over(mine.orderBy(F.desc(F.col("cost").isNotNull()), "eta", "candidate")) == 1
    c = c.withColumn("best", first & F.col("near")).withColumn("quickest", quickest)
    why = F.concat_ws(",", F.when(F.col("quickest"), FASTEST).otherwise(SPREAD), F.when(F.col("tied"), TIED))
    return c.select("request", "candidate", "eta", "growth", "cost", "best", F.when(F.col("best"), why).alias("reason"))


def choose(rows: Iterable[tuple], weight: float, tie_s: float, seed: int):
    """(batch, request, candidate, eta, growth, cost, reason) of requests that choose in order; rows: batch, set, place, request, candidate, eta, allowed,
    cells (seg, bin, share, load, coef), with sets and in them requests one after another. Only what the current set has brought is held."""
    for _, own in groupby(rows, key=lambda r: r[:2]):
        brought: dict[tuple, float] = defaultdict(float)
        for (_, request), options in groupby(own, key=lambda r: r[2:4]):
            costs = []
            for batch, _, _, _, candidate, eta, allowed, cells in options:
                if allowed:
                    grown = math.fsum(coef * share * (2 * (load + brought.get((seg, at), 0.0)) + share) for seg, at, share, load, coef in cells)
                    costs.append((eta + weight * grown, eta, grown, candidate, cells))
            if not costs:
                yield batch, request, None, None, None, None, NO_CANDIDATE
                continue
            least = min(c[0] for c in costs)
            near = [c for c in costs if c[0] <= least + tie_s]
            cost, eta, grown, candidate, cells = min(near, key=lambda c: (hashlib.sha1(f"{seed}|{request}|{c[3]}".encode()).hexdigest(), c[3], c[1])) if len(near) > 1 else near[0]
            fastest = min(costs, key=lambda c: (c[1], c[3]))[3]
            for seg, at, share, *_ in cells:
                brought[seg, at] += share
            yield batch, request, candidate, eta, grown, cost, ",".join([FASTEST if candidate == fastest else SPREAD] + [TIED] * (len(near) > 1))


def candidate_rows(batches: Iterable[pa.RecordBatch]):
    """Rows of batches for choose; cells are tuples of flat columns, which is quicker than a row of each."""
    for b in batches:
        cells = pc.list_flatten(b["cells"])
        flat = list(zip(*(pc.struct_field(cells, k).to_pylist() for k in range(5))))
        ends = np.cumsum(pc.list_value_length(b["cells"]).to_numpy())
        for *row, end, n in zip(*(b[c].to_pylist() for c in ("batch", "set", "place", "request", "candidate", "eta", "allowed")), ends.tolist(), np.diff(ends, prepend=0).tolist()):
            yield *row, flat[end - n : end]


def assign_timed(candidates: DataFrame, cells: DataFrame, load: DataFrame, roads: DataFrame, weight: float, tie_s: float = 0.5, seed: int = 0) -> DataFrame:
    """batch, request, candidate, eta, growth, cost, reason: requests of a batch choose one after another (by place, then request), as score_timed
    does, each on top of the load and what those before it in its batch chose. A request without an allowed candidate has a null choice.

    Requests touch each other only where allowed candidates share a road and bin. One that touches none is scored as it is; the others fall apart
    into connected sets, which choose in parallel with the same result; their rows are sorted and
    pass one by one, so a task holds what one set has brought. What allowed candidates
    press on is written once; of it, only cells of several requests and requests of such sets are shuffled again. candidates: batch,
    request (of one batch only), place, candidate, eta, allowed; cells: request, candidate, seg, bin, share.
    """
    c = candidates.withColumn("allowed", F.coalesce(F.col("allowed") & F.col("eta").isNotNull(), F.lit(False))).withColumn("eta", F.col("eta").cast("double"))
    own = cells.groupBy("request", "candidate", "seg", "bin").agg(F.sum("share").alias("share"))
    own = cut(own.join(c.filter("allowed").select("batch", "request", "candidate").distinct(), ["request", "candidate"]))
    # Only cells that several requests press on are met again; by their hash, as a row of it is small.
    at = F.xxhash64("batch", "seg", "bin").alias("at")
    pressed = own.select(at, "request").groupBy("at").agg(F.min("request").alias("first"), F.max("request").alias("last")).filter("first <> last").select("at")
    met = own.select("batch", "request", "seg", "bin", at).join(sent_if_few(cut(pressed), MOST_SHARED), "at").select("batch", "request", "seg", "bin")
    touching = met.withColumn("first", F.min("request").over(Window.partitionBy("batch", "seg", "bin"))).filter("request <> first")
    sets = connected_components(touching.select(F.col("request").alias("src"), F.col("first").alias("dst")).distinct()).select(F.col("node").alias("request"), F.col("component").alias("set"))
    sets = sent_if_few(cut(sets), MOST_SHARED)
    alone = c.join(sets, "request", "left_anti")
    scored = score_timed(alone.drop("batch", "place"), own.drop("batch"), load, roads, weight, tie_s, seed).filter("best")
    chosen = ["request", "candidate", "eta", "growth", "cost", "reason"]
    settled = alone.select("batch", "request").distinct().join(scored, "request", "left").withColumn("reason", F.coalesce("reason", F.lit(NO_CANDIDATE))).select("batch", *chosen)
    known = own.drop("batch").join(sets.select("request"), "request", "left_semi").join(load, ["seg", "bin"], "left").join(roads.select("seg", "coef"), "seg", "left")
    cell = F.struct("seg", "bin", "share", F.coalesce(F.col("load").cast("double"), F.lit(0.0)).alias("load"), F.coalesce(F.col("coef").cast("double"), F.lit(0.0)).alias("coef"))
    by_candidate = known.groupBy("request", "candidate").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    none = F.array().cast(by_candidate.schema["cells"].dataType)
    rows = c.join(sets, "request").join(by_candidate, ["request", "candidate"], "left")
    rows = rows.select("batch", "set", "request", "place", "candidate", "eta", "allowed", F.coalesce("cells", none).alias("cells"))
    out = StructType([StructField("batch", rows.schema["batch"].dataType), *(StructField(n, rows.schema[n].dataType) for n in ("request", "candidate")), *(StructField(n, DoubleType()) for n in ("eta", "growth", "cost")), StructField("reason", StringType())])
    schema = to_arrow_schema(out)

    def run(batches):
        found = choose(candidate_rows(batches), weight, tie_s, seed)
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)

    dealt = in_parts(rows, c.count(), "batch", "set").sortWithinPartitions("batch", "set", F.asc_nulls_last("place"), "request", "candidate", "eta")
    ordered = dealt.mapInArrow(run, out)
    return settled.unionByName(ordered)
