"""Evaluation: errors by stratum, methods against each other, with and without an event, runs and their quality, coverage of roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overlapping strata of labels.
STRATA = ("all", "control_runs", "event_runs", "event_near", "event_far", "severe", "antic_pre_start", "antic_pre_end", "antic", "antic_strict", "near_missing_history")


def strata_of(severe: float) -> Column:
    """Names of the strata of a label. Columns: with_event, near, far, pre_start, pre_end, clear, clear_strict, seen, target."""
    ev, pre = F.col("with_event"), F.col("pre_start") | F.col("pre_end")
    rules = (F.lit(True), ~ev, ev, ev & F.col("near"), ev & F.col("far"), F.coalesce(F.col("target"), F.lit(0.0)) >= severe, ev & F.col("near") & F.col("clear") & F.col("pre_start"), ev & F.col("near") & F.col("clear") & F.col("pre_end"), ev & F.col("near") & F.col("clear") & pre, ev & F.col("near") & F.col("clear_strict") & pre, ev & F.col("near") & ~F.col("seen"))
    return F.filter(F.array(*(F.when(rule, name) for name, rule in zip(STRATA, rules, strict=True))), lambda x: x.isNotNull())


def strata_errors(labels: DataFrame, severe: float, *keys: str) -> DataFrame:
    """keys, stratum, labels, mae, wape, positives, precision, recall, f1; a label counts in each of its strata. labels: keys, pred, target, and the
    columns of strata_of. Sums are combined before the shuffle, so strata cost no rows sent."""
    e = F.abs(F.col("pred") - F.col("target"))
    said, was = F.col("pred") >= severe, F.col("target") >= severe
    g = labels.withColumn("stratum", F.explode(strata_of(severe))).groupBy(*keys, "stratum").agg(F.count("*").alias("labels"), F.sum(e).alias("ae"), F.sum(F.abs("target")).alias("true"), F.count_if(said & was).alias("tp"), F.count_if(said & ~was).alias("fp"), F.count_if(~said & was).alias("fn"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return g.select(*keys, "stratum", "labels", (F.col("ae") / F.col("labels")).alias("mae"), F.try_divide("ae", "true").alias("wape"), (F.col("tp") + F.col("fn")).alias("positives"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def method_table(cells: DataFrame, methods: list[str], base: str, *keys: str) -> DataFrame:
    """keys, n, each method's mean absolute error and its gain over the base in percent. cells: keys, target, methods."""
    mae = {m: F.avg(F.abs(F.col(m) - F.col("target"))) for m in methods}
    out = cells.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(f"{m}_mae") for m, c in mae.items()))
    return out.withColumns({f"{m}_gain": F.try_divide(100 * (F.col(f"{base}_mae") - F.col(f"{m}_mae")), F.col(f"{base}_mae")) for m in methods if m != base})


def buildup_stats(cells: DataFrame, methods: list[str], jam: float = 0.5) -> DataFrame:
    """method, buildups, recall, false_per_1000 of clear cells that jam. cells: now, target, methods (congestion)."""
    clear = cells.filter(F.col("now") < jam)
    built = F.col("target") >= jam
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("pred")) for m in methods)))
    c = clear.withColumn("x", each).select("target", "x.*")
    return c.groupBy("method").agg(F.count_if(built).alias("buildups"), F.try_divide(F.count_if(built & (F.col("pred") >= jam)).cast("double"), F.count_if(built)).alias("recall"), (1000.0 * F.count_if(~built & (F.col("pred") >= jam)) / F.count("*")).alias("false_per_1000"))


def counterfactual_delta(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, n, mean difference of predictions with the event to those without, weighted by n. cells: keys, n, with_event, without_event."""
    d = F.col("with_event") - F.col("without_event")
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * d), F.sum("n")).alias("delta"))


def sim_vs_observed(cells: DataFrame, spread: float = 0.05) -> DataFrame:
    """level, ratio (median of simulated over observed), mae; and identifiable: whether the ratio moves by spread or more over the levels.
    cells: level, seg, hour, sim, observed."""
    r = cells.filter("observed > 0 and sim is not null").groupBy("level").agg(F.percentile(F.col("sim") / F.col("observed"), F.lit(0.5)).alias("ratio"), F.avg(F.abs(F.col("sim") - F.col("observed"))).alias("mae"))
    every = Window.partitionBy()  # one row a level
    return r.withColumn("identifiable", F.max("ratio").over(every) - F.min("ratio").over(every) >= spread)


def level_at_one(levels: DataFrame) -> DataFrame:
    """level at which the ratio passes 1, between its neighbours on a logarithmic scale; none where it never does. levels: level, ratio, one row each."""
    w = Window.orderBy("level")
    c = levels.withColumn("r0", F.lag("ratio").over(w)).withColumn("l0", F.lag("level").over(w))
    crossing = c.filter((F.col("r0") - 1) * (F.col("ratio") - 1) <= 0).filter("r0 <> ratio")
    at = F.exp(F.log("l0") + (F.log("level") - F.log("l0")) * (0 - F.log("r0")) / (F.log("ratio") - F.log("r0")))
    return crossing.orderBy("level").limit(1).select(at.alias("level"))


def mechanism_table(runs: DataFrame, *keys: str) -> DataFrame:
    """keys and the mean share of diverted trips, participation and congested time. runs: keys, trips, diverted, participants, seconds, congested_s."""
    part = lambda a, b: F.avg(F.try_divide(F.col(a).cast("double"), F.col(b)))
    return runs.groupBy(*keys).agg(part("diverted", "participants").alias("diversion"), part("participants", "trips").alias("participation"), part("congested_s", "seconds").alias("congested"))


def route_stress(cells: DataFrame, calm: float = 0.3, busy: float = 0.8) -> DataFrame:
    """request, congestion (weighted by time), load (mean over roads) and mode on the fastest candidate: fastest while calm, spread when busy,
    else mixed. cells: request, candidate, eta, ratio, load, capacity."""
    fastest = cells.groupBy("request", "candidate").agg(F.sum("eta").alias("total")).groupBy("request").agg(F.min(F.struct("total", "candidate")).getField("candidate").alias("candidate"))
    g = cells.join(fastest, ["request", "candidate"], "left_semi").groupBy("request").agg(F.try_divide(F.sum(F.col("ratio") * F.col("eta")), F.sum("eta")).alias("congestion"), F.avg(F.try_divide("load", "capacity")).alias("load"))
    top = F.greatest("congestion", "load")
    return g.withColumn("mode", F.when(top < calm, "fastest").when(top >= busy, "spread").otherwise("mixed"))


def trip_status(expected: DataFrame, trips: DataFrame) -> DataFrame:
    """cohort and how many expected trips are completed, unfinished, not departed, failed or missing, with the mean and the nearest-rank 95th
    percentile of completed ones. expected: trip, cohort; trips: trip, failed, depart, arrival, total_s."""
    status = F.when(F.col("depart").isNull(), "missing").when(F.coalesce(F.col("failed"), F.lit(False)), "failed").when(F.col("depart") < 0, "not_departed").when(F.col("arrival") < 0, "unfinished").otherwise("completed")
    rows = expected.join(trips, "trip", "left").withColumn("status", status)
    done = F.when(F.col("status") == "completed", F.col("total_s"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "unfinished", "not_departed", "failed", "missing")]
    return rows.groupBy("cohort").agg(*counts, F.avg(done).alias("mean_s"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN status = 'completed' THEN total_s END)").alias("p95_s"))


def cohort_comparison(base: DataFrame, other: DataFrame) -> DataFrame:
    """paired, paired_delta (mean of other less base over trips that both completed), eligible (all of both did), full_delta (only then).
    base, other: trip, status, total_s."""
    b, o = (d.select("trip", (F.col("status") == "completed").alias(f"{p}_done"), F.col("total_s").alias(f"{p}_s")) for d, p in ((base, "b"), (other, "o")))
    both = b.join(o, "trip", "full")
    done = F.coalesce(F.col("b_done") & F.col("o_done"), F.lit(False))
    out = both.agg(F.count_if(done).alias("paired"), F.avg(F.when(done, F.col("o_s") - F.col("b_s"))).alias("paired_delta"), F.bool_and(F.coalesce("b_done", F.lit(True)) & F.coalesce("o_done", F.lit(True))).alias("eligible"))
    return out.withColumn("full_delta", F.when(F.col("eligible"), F.col("paired_delta")))


def quality_gate(runs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """run and the names of the limits it breaks; a figure that is missing breaks its limit. runs: run and a column for each limit (most allowed)."""
    broken = F.filter(F.array(*(F.when(F.coalesce(F.col(c) > most, F.lit(True)), c) for c, most in limits.items())), lambda x: x.isNotNull())
    return runs.select("run", broken.alias("failures"), (F.size(broken) == 0).alias("passed"))


def road_occupancy(samples: DataFrame, period_s: int, least: float = 0.5) -> DataFrame:
    """win, seg, cars (mean), speed (share of free flow, in twentieths; halves go up, whatever the order of the sums) of roads with half a car or more. samples: seg, t, car_s, relative."""
    g = samples.groupBy((F.floor(F.col("t") / period_s) * period_s).alias("win"), "seg").agg((F.sum("car_s") / period_s).alias("cars"), F.try_divide(F.sum(F.col("relative") * F.col("car_s")), F.sum("car_s")).alias("relative"))
    return g.filter((F.col("cars") >= least) & F.col("relative").isNotNull()).select("win", "seg", F.round("cars", 1).alias("cars"), (F.round(F.round(F.col("relative") * 20, 9)) / 20).alias("speed"))


def vehicle_state_buckets(samples: DataFrame, window_s: int) -> DataFrame:
    """seg, bucket, speed (weighted by time), observed. samples: seg, t, speed, dt."""
    g = samples.groupBy("seg", (F.floor(F.col("t") / window_s) * window_s).alias("bucket")).agg(F.try_divide(F.sum(F.col("speed") * F.col("dt")), F.sum("dt")).alias("speed"), F.sum("dt").alias("seconds"))
    return g.select("seg", "bucket", "speed", (F.col("seconds") > 0).alias("observed"))


def support_table(windows: DataFrame) -> DataFrame:
    """partition, phase, families, seeds, windows, windows_with_clear, clear_roads, labels, positives of event windows. windows: partition, phase, family,
    seed, with_event, clear_near, labels, positives."""
    return windows.filter("with_event").groupBy("partition", "phase").agg(F.count_distinct("family").alias("families"), F.count_distinct("family", "seed").alias("seeds"), F.count("*").alias("windows"), F.count_if(F.col("clear_near") > 0).alias("windows_with_clear"), F.sum("clear_near").alias("clear_roads"), F.sum("labels").alias("labels"), F.sum("positives").alias("positives"))


def observed_share(history: DataFrame) -> DataFrame:
    """bucket and the share of roads observed in it. history: bucket, seg, observed."""
    return history.groupBy("bucket").agg((F.count_if(F.col("observed")) / F.count("*")).alias("share"))


def run_inventory(planned: DataFrame, completed: DataFrame, exported: DataFrame) -> DataFrame:
    """batch and how many of its planned runs are completed and exported. planned: batch, run; completed, exported: run."""
    done, out = completed.select("run").distinct().withColumn("done", F.lit(1)), exported.select("run").distinct().withColumn("out", F.lit(1))
    return planned.join(done, "run", "left").join(out, "run", "left").groupBy("batch").agg(F.count("*").alias("planned"), F.count("done").alias("completed"), F.count("out").alias("exported"))


def segment_catalog(roads: DataFrame, modelled: DataFrame, merged: DataFrame) -> DataFrame:
    """seg, availability (open, restricted, unavailable), gap, represented_by. A modelled road that isn't for cars is restricted; one merged into a
    modelled road is open by it. roads: seg, access; modelled: seg; merged: seg, into."""
    m = modelled.select("seg").distinct().withColumn("modelled", F.lit(True))
    rep = merged.join(m.select(F.col("seg").alias("into")), "into", "left_semi").groupBy("seg").agg(F.min("into").alias("into"))
    r = roads.join(m, "seg", "left").join(rep, "seg", "left")
    gap = F.when(F.col("modelled"), None).when(F.col("into").isNotNull(), "merged_parallel").otherwise("not_in_network")
    return r.select("seg", F.when(F.col("modelled") & (F.col("access") == "yes"), "open").when(F.col("modelled"), "restricted").when(F.col("into").isNotNull(), "open").otherwise("unavailable").alias("availability"), gap.alias("gap"), F.when(F.col("modelled").isNull(), F.col("into")).alias("represented_by"))


def length_coverage(roads: DataFrame, used: DataFrame) -> DataFrame:
    """run, directed_m, physical_m with traffic; run null: over all runs. A road and its reverse, the same positions in the other order, are one
    physical road. roads: seg, length, coords; used: run, seg."""
    other = F.reverse("coords")
    r = roads.select("seg", "length", F.xxhash64(F.least(F.to_json(F.struct(F.col("coords").alias("c"))), F.to_json(F.struct(other.alias("c"))))).alias("shape"))
    u = used.select("run", "seg").distinct().join(r, "seg")
    each = u.withColumn("run", F.explode(F.array("run", F.lit(None).cast(u.schema["run"].dataType))))
    directed = each.groupBy("run", "seg", "shape").agg(F.first("length").alias("length"))
    return directed.groupBy("run", "shape").agg(F.sum("length").alias("directed"), F.max("length").alias("physical")).groupBy("run").agg(F.sum("directed").alias("directed_m"), F.sum("physical").alias("physical_m"))


def size_estimate(done: DataFrame, planned: DataFrame) -> DataFrame:
    """batch and the seconds it will take: trip hours times the median seconds a trip hour took so far. done: seconds, trip_hours; planned: batch,
    trip_hours."""
    rate = done.agg(F.percentile(F.col("seconds") / F.col("trip_hours"), F.lit(0.5)).alias("rate"))
    return planned.groupBy("batch").agg(F.sum("trip_hours").alias("trip_hours")).join(F.broadcast(rate)).select("batch", (F.col("trip_hours") * F.col("rate")).alias("seconds"))  # one row


def predicted_availability(roads: DataFrame, cover: DataFrame) -> DataFrame:
    """seg, bucket, availability, reason: closed where a full closure covers the bucket, restricted where it covers a part. roads: seg, bucket,
    availability, gap (see segment_catalog); cover: seg, bucket, cover."""
    r = roads.join(cover, ["seg", "bucket"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))
    whole, part, a = F.col("cover") >= 1, (F.col("cover") > 0) & (F.col("cover") < 1), F.col("availability")
    availability = F.when(whole & (a != "unavailable"), "closed").when(part & (a == "open"), "restricted").otherwise(a)
    reason = F.when(whole & (a != "unavailable"), "scheduled_closure").when(part & (a == "open"), "partial_closure").when(a == "restricted", "no_passenger_access").when(a == "unavailable", F.concat(F.lit("not_modelled:"), F.coalesce("gap", F.lit("")))).when(F.col("gap") == "merged_parallel", "merged_parallel").otherwise("none")
    return r.select("seg", "bucket", availability.alias("availability"), reason.alias("reason"))


def policy_status(runs: DataFrame) -> DataFrame:
    """policy, complete, failed, incomplete, eligible (all complete), mean difference and place among eligible policies. runs: policy, status, diff."""
    g = runs.groupBy("policy").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("complete", "failed", "incomplete")), F.bool_and(F.col("status") == "complete").alias("eligible"), F.avg(F.when(F.col("status") == "complete", F.col("diff"))).alias("mean_diff"))
    place = F.rank().over(Window.partitionBy("eligible").orderBy(F.round("mean_diff", 9)))
    return g.withColumn("place", F.when(F.col("eligible"), place))


def warning_calibration(labels: DataFrame, *keys: str, grid: float = 0.01) -> DataFrame:
    """keys, score, chance: isotonic chance of a positive by score, rounded to the grid; the least-squares non-decreasing fit. labels: keys, score, label.

    Scores are counted on the grid first, 101 rows a group, and the fit of a group is the greatest of the least means: for each score the largest over
    starts before it of the smallest mean up to ends behind it.
    """
    g = labels.filter("score is not null").groupBy(*keys, F.round(F.col("score") / grid).cast("int").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("label")).alias("pos"))
    sums = g.withColumn("n_upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("k"))).withColumn("pos_upto", F.sum("pos").over(Window.partitionBy(*keys).orderBy("k")))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "n", "pos", "n_upto", "pos_upto"))).alias("all"))
    mean = lambda a, b: (b["pos_upto"] - a["pos_upto"] + a["pos"]) / (b["n_upto"] - a["n_upto"] + a["n"])
    fit = lambda x: F.array_max(F.transform(F.filter("all", lambda a: a["k"] <= x["k"]), lambda a: F.array_min(F.transform(F.filter("all", lambda b: b["k"] >= x["k"]), lambda b: mean(a, b)))))
    return whole.select(*keys, F.explode(F.transform("all", lambda x: F.struct((x["k"] * grid).alias("score"), fit(x).alias("chance")))).alias("x")).select(*keys, "x.*")
