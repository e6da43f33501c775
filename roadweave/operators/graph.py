"""Road-graph operators over an arc table src, dst."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(arcs: DataFrame) -> DataFrame:
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def neighbour_mean(arcs: DataFrame, values: DataFrame) -> DataFrame:
    """node and the mean value of the nodes it leads to and of those that lead to it; nulls don't count, and without any the mean is null.
    values: node, value."""
    one = lambda here, there, name: arcs.join(values.withColumnRenamed("node", there), there).groupBy(F.col(here).alias("node")).agg(F.avg("value").alias(name))
    return one("src", "dst", "mean_down").join(one("dst", "src", "mean_up"), "node", "full")


def bfs_hops(arcs: DataFrame, sources: DataFrame, most: int, upstream: bool = False) -> DataFrame:
    """node, hops from the nearest source, up to most, along the arcs or against them: a frontier join a hop, each node once. Each hop's lineage is
    cut, so plans stay the same size."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    seen = frontier = cut(sources.select("node", F.lit(0).alias("hops")).distinct())
    for k in range(1, most + 1):
        step = arcs.join(frontier, F.col(a) == F.col("node")).select(F.col(b).alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def case_hops(arcs: DataFrame, sources: DataFrame, most: int, upstream: bool = False) -> DataFrame:
    """case, node, hops from the nearest source of the case, up to most, along the arcs or against them, for all cases in one search: a round is
    a join of the frontiers with the arcs and one anti-join, whatever the number of cases. arcs: src, dst; sources: case, node."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    steps = cut(arcs.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = frontier = cut(sources.select("case", "node", F.lit(0).alias("hops")).distinct())
    for k in range(1, most + 1):
        step = frontier.join(steps, "node").select("case", F.col("next").alias("node")).distinct()
        frontier = cut(step.join(seen.select("case", "node"), ["case", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # of written tables, one a round
    return seen


def earliest_arrival(arcs: DataFrame, sources: DataFrame, forecast: DataFrame, bucket_s: int, horizon: int) -> DataFrame:
    """node, arrive_s, beyond: the earliest time at the end of each node that legal arcs lead to, and whether the way there needs times past the
    horizon, for which the last bucket stands.

    arcs: src, dst (roads); sources: node, depart_s; forecast: node, bucket (0 to horizon - 1), seconds (over the road), closed. A road takes the
    seconds of the bucket in which it is entered; one closed then, or without a forecast, isn't entered. Labels are corrected until none changes:
    a round is a join of what changed with arcs and forecast and one minimum, and ends with its lineage cut. Arcs and forecast are written
    once, so that no round works them out again.
    """
    arcs = cut(arcs.select("src", "dst").distinct())
    f = cut(forecast.filter(~F.coalesce(F.col("closed"), F.lit(False)) & F.col("seconds").isNotNull()).select("node", "bucket", "seconds"))
    enter = lambda df: df.withColumn("slot", F.floor(F.col("at") / bucket_s)).withColumn("bucket", F.greatest(F.lit(0), F.least(F.col("slot"), F.lit(horizon - 1))))
    drive = lambda df: enter(df).join(f, ["node", "bucket"]).select("node", (F.col("at") + F.col("seconds")).alias("arrive_s"), (F.col("beyond") | (F.col("slot") >= horizon)).alias("beyond"))
    first = lambda df: df.groupBy("node").agg(F.min(F.struct("arrive_s", "beyond")).alias("x")).select("node", "x.*")
    best = changed = cut(first(drive(sources.select("node", F.col("depart_s").cast("double").alias("at"), F.lit(False).alias("beyond")))))
    while not changed.isEmpty():
        onward = arcs.join(changed, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), F.col("arrive_s").alias("at"), "beyond")
        found = first(drive(onward))
        old = best.select("node", F.col("arrive_s").alias("old_s"))
        changed = cut(found.join(old, "node", "left").filter("old_s is null or arrive_s < old_s - 1e-9").select("node", "arrive_s", "beyond"))
        best = cut(best.join(changed.select("node"), "node", "left_anti").unionByName(changed))
    return best


def footprint_subgraph(arcs: DataFrame, near: DataFrame) -> DataFrame:
    """node, entry, exit: nodes near a footprint that can reach each other, and whether arcs from elsewhere come in there or go out.
    arcs: src, dst; near: node."""
    inside = arcs.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    core = largest_scc(inside)
    edge = lambda here, there: arcs.join(core.withColumnRenamed("node", here), here, "left_semi").join(core.withColumnRenamed("node", there), there, "left_anti").select(F.col(here).alias("node")).distinct()
    entry, exit_ = edge("dst", "src").withColumn("entry", F.lit(True)), edge("src", "dst").withColumn("exit", F.lit(True))
    return core.join(entry, "node", "left").join(exit_, "node", "left").select("node", F.coalesce("entry", F.lit(False)).alias("entry"), F.coalesce("exit", F.lit(False)).alias("exit"))


def route_loads(arcs: DataFrame, footprint: DataFrame, most: int, decay_m: float = 5000.0) -> DataFrame:
    """node, load: the share of demand that passes each road on shortest ways out of a footprint; a road's own demand is exp(-metres / decay_m) by its
    distance along the roads. arcs: src, dst, metres (of dst); footprint: node. Distances are corrected for up to `most` rounds; each node
    hangs on the predecessor of its shortest way, and demand is summed from the farthest hop inwards, a join a level."""
    best = cut(footprint.select("node", F.lit(0.0).alias("metres"), F.lit(0).alias("level"), F.col("node").alias("parent")))
    for _ in range(most):
        step = arcs.withColumnRenamed("metres", "more").join(best, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("metres") + F.col("more")).alias("metres"), (F.col("level") + 1).alias("level"), F.col("src").alias("parent"))
        now = cut(best.unionByName(step).groupBy("node").agg(F.min(F.struct("metres", "level", "parent")).alias("x")).select("node", "x.*"))
        same = now.join(best, ["node", "metres", "level"], "left_anti").isEmpty()
        best = now
        if same:
            break
    load = cut(best.select("node", "parent", "level", F.exp(-F.col("metres") / decay_m).alias("load")))
    total = load.agg(F.sum("load")).first()[0] or 1.0
    for level in range(load.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], 0, -1):
        up = load.filter(F.col("level") == level).groupBy(F.col("parent").alias("node")).agg(F.sum("load").alias("more"))
        load = cut(load.join(up, "node", "left").select("node", "parent", "level", (F.col("load") + F.coalesce("more", F.lit(0.0))).alias("load")))
    return load.select("node", (F.col("load") / total).alias("load"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the checkpoint folder that the cluster names; a local session that names none gets one made."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that it is connected with, itself included. edges: src, dst, in any direction; self-loops give their
    node alone, nulls are left out. Each round hangs larger, then smaller neighbours on the least one known, so rounds grow with the logarithm
    of a component's size; minima are combined before the shuffle, and no neighbourhood is gathered."""
    e = edges.filter("src is not null and dst is not null").select("src", "dst")
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).distinct()
    e = cut(e.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return nodes.join(e.groupBy("u").agg(F.min("v").alias("component")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("component", "node").alias("component"))
        state = now


def merge_classes(records: DataFrame, edges: DataFrame) -> DataFrame:
    """id, winner, kept: the record of highest priority in the component wins, the smallest id among equals. records: id, priority; edges:
    src, dst. Records without an edge win alone."""
    c = connected_components(edges)
    r = records.join(c, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    best = r.groupBy("component").agg(F.min(F.struct((-F.col("priority")).alias("p"), "id")).getField("id").alias("winner"))
    return r.join(best, "component").select("id", "winner", (F.col("id") == F.col("winner")).alias("kept"))


def reach(arcs: DataFrame, start: DataFrame) -> DataFrame:
    """node: all that arcs lead to from the start nodes, themselves included; a frontier join a hop. arcs: src, dst; start: node. Both sides of a
    join are shuffled: a frontier that Spark takes for small enough to send goes through the driver, hop by hop."""
    seen = frontier = cut(start.select("node").distinct())
    while not frontier.isEmpty():
        step = arcs.join(frontier.hint("merge"), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.hint("merge"), "node", "left_anti"))
        seen = seen.unionByName(frontier)  # of written tables, one a hop
    return seen


def largest_scc(arcs: DataFrame) -> DataFrame:
    """node of the largest strongly connected component; among equals that of the first pivot. arcs: src, dst; nulls and loops are left out.

    What a pivot reaches and is reached by is its component; the pivot is the node of most ways through. It ends as soon as fewer nodes are
    left than the best component has: on a road network, whose nodes are mostly of one component, after a pivot or two.
    """
    e = cut(arcs.filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    best, most = e.select(F.col("src").alias("node")).limit(0), 0
    while True:
        d = degrees(e).filter("out_degree > 0 and in_degree > 0")
        if d.count() <= most:
            return best
        pivot = cut(d.orderBy(F.desc(F.col("out_degree") * F.col("in_degree")), "node").limit(1).select("node"))
        scc = reach(e, pivot).join(reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot).hint("merge"), "node", "left_semi")
        scc = cut(scc)
        n = scc.count()
        if n > most and n > 1:
            best, most = scc, n
        gone = scc.hint("merge")
        e = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = cut(e.select("src", "dst"))
