"""Group-by operators: readings to buckets, profiles, load and concentration, forecast errors, paired comparison, run quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.scalars import bucket10, congestion_ratio


def bucket_readings(readings: DataFrame, minutes: int = 10) -> DataFrame:
    """Weighted mean speed and number per bucket, seg and source. readings: seg, source, ts, speed, weight."""
    return readings.groupBy(bucket10(F.col("ts"), minutes).alias("bucket"), "seg", "source").agg((F.sum(F.col("speed") * F.col("weight")) / F.sum("weight")).alias("speed"), F.count("*").alias("n"))


def with_free_flow(buckets: DataFrame, free_flow: DataFrame) -> DataFrame:
    """Adds free_flow and ratio by segment."""
    return buckets.join(free_flow, "seg").withColumn("ratio", congestion_ratio(F.col("speed"), F.col("free_flow")))


def typical_profile(buckets: DataFrame) -> DataFrame:
    """Mean speed of a segment by weekday (Monday 0) and hour."""
    return buckets.groupBy("seg", F.weekday("bucket").alias("dow"), F.hour("bucket").alias("hour")).agg(F.avg("speed").alias("speed"), F.count("*").alias("n"))


def observation_rollup(readings: DataFrame) -> DataFrame:
    """Mean, first and maximum speed, most frequent source (smallest of equals) and number by segment."""
    counted = readings.groupBy("seg", "source").count()
    modes = counted.groupBy("seg").agg(F.min(F.struct(-F.col("count"), "source")).getField("source").alias("mode_source"))
    means = readings.groupBy("seg").agg(F.avg("speed").alias("mean_speed"), F.min_by("speed", F.struct("ts", "event_id")).alias("first_speed"), F.max("speed").alias("max_speed"), F.count("*").alias("n"))
    return means.join(modes, "seg")


def ledger_load(entries: DataFrame, bin_s: int = 300) -> DataFrame:
    """Entries per resource and bin. entries: seg, t."""
    return entries.groupBy("seg", (F.floor(F.col("t") / bin_s) * bin_s).alias("bin")).agg(F.count("*").alias("load"))


def concentration(load: DataFrame, by: str, scale: float) -> DataFrame:
    """Sum of squared loads over scale: grows as the same load meets in fewer places."""
    return load.groupBy(by).agg(F.sum(F.pow(F.col("load") / scale, 2)).alias("phi"), F.sum("load").alias("total"))


def forecast_errors(cells: DataFrame, severe: float, *keys: str) -> DataFrame:
    """Errors and hits by keys. cells: pred, target. Ratios without a denominator are null."""
    e = F.abs(F.col("pred") - F.col("target"))
    hit, said, was = (F.count_if(c) for c in ((F.col("pred") >= severe) & (F.col("target") >= severe), F.col("pred") >= severe, F.col("target") >= severe))
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.try_divide(F.sum(e), F.sum(F.abs("target"))).alias("wape"), F.try_divide(hit.cast("double"), said).alias("precision"), F.try_divide(hit.cast("double"), was).alias("recall"))


def error_marginals(cells: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Mean absolute error over several groupings in one pass."""
    wanted = [[F.col(c) for c in s] for s in sets]
    return cells.groupingSets(wanted, *keys).agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"), F.count("*").alias("n"))


def policy_vs_base(runs: DataFrame, base: str, metric: str) -> DataFrame:
    """policy, block, diff to the base policy in the same block. One row a policy and block."""
    b = runs.filter(F.col("policy") == base).select("block", F.col(metric).alias("base"))
    return runs.filter(F.col("policy") != base).join(b, "block").select("policy", "block", (F.col(metric) - F.col("base")).alias("diff"), "base")


def paired_summary(pairs: DataFrame, tie: float = 0.0) -> DataFrame:
    d = F.col("diff")
    return pairs.groupBy("policy").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.percentile(d, F.lit(0.5)).alias("median_diff"), F.stddev_samp(d).alias("std_diff"), F.max(d).alias("worst"),
        F.count_if(d < -tie).alias("better"), F.count_if(d > tie).alias("worse"), F.count_if(F.abs(d) <= tie).alias("tied"), (F.sum(d) / F.sum("base")).alias("relative"),
    )


def common_blocks(runs: DataFrame, policies: int) -> DataFrame:
    """Blocks in which every policy ran."""
    return runs.groupBy("block").agg(F.count_distinct("policy").alias("n")).filter(F.col("n") == policies).select("block")


def fit_norm(rows: DataFrame, columns: list[str], train: Column, floor: float = 1e-3, origins: Column | None = None) -> DataFrame:
    """Mean and population deviation, not under floor, of training rows, a row for each column. origins keeps to some of the windows, every third one
    for instance, as neighbouring windows hold the same readings."""
    rows = rows if origins is None else rows.filter(origins)
    stats = [F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias("std")) for c in columns]
    return rows.filter(train).agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def run_quality(trips: DataFrame, limit: float) -> DataFrame:
    """Rates per thousand trips of each run, and whether it needs review. trips: run, late."""
    rate = F.count_if(F.col("late")) * 1000.0 / F.count("*")
    return trips.groupBy("run").agg(F.count("*").alias("trips"), rate.alias("late_per_1000"), (rate > limit).alias("review"))


def trip_outcomes(trips: DataFrame) -> DataFrame:
    """trips: cohort, seconds (null: not arrived)."""
    p = lambda q: F.percentile("seconds", F.lit(q))
    return trips.groupBy("cohort").agg(F.count("*").alias("trips"), F.count("seconds").alias("arrived"), F.avg("seconds").alias("mean_s"), p(0.5).alias("median_s"), p(0.95).alias("p95_s"))


def unique_id(df: DataFrame, *key: str) -> DataFrame:
    """One row: rows, rows with a missing key part, keys that come up more than once."""
    missing = F.coalesce(F.array_contains(F.array(*(F.col(c).isNull() for c in key)), True), F.lit(False))
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.max(missing.cast("int")).alias("missing")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("missing")).alias("missing"), F.count_if((F.col("n") > 1) & (F.col("missing") == 0)).alias("repeated"))


def heat_density(points: DataFrame, radius: float) -> DataFrame:
    """id, density: kernel (1 - x^2)^2 summed over the points within radius (planar units). points: id, x, y, w."""
    cells = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.floor(F.col("x") / radius) + i).alias("cx"), (F.floor(F.col("y") / radius) + j).alias("cy"))))))
    # Points of one place count as one of their weights' sum, so a crowded place isn't paired with itself.
    places = points.groupBy("x", "y").agg(F.sum("w").alias("w"))
    a = places.select("x", "y", cells.alias("cell"))
    b = places.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.struct(F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy")).alias("cell"))
    d2 = (F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)) / (radius * radius)
    near = a.join(b, "cell").withColumn("d2", d2).filter("d2 < 1").groupBy("x", "y").agg(F.sum(F.col("bw") * F.pow(1 - F.col("d2"), 2)).alias("density"))
    return points.join(near, ["x", "y"]).select("id", "density")
