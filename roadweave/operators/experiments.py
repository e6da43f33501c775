"""Outcomes of runs under policies: groups against the base policy block by block, vehicle seconds in congestion, selection of whole families of runs,
typical travel times with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.quantiles import exact_quantiles


def group_changes(trips: DataFrame, base: str, keys: list[str], block: list[str]) -> DataFrame:
    """keys, policy, participant, pairs, unequal, trips, home_base, home, mean_change, p95_change, kmh_base, kmh, hours_change: participants and
    others under each policy against the base policy in the same keys and block.

    Changes are percent of the base, averaged over pairs; a pair whose base is 0 or unknown adds none. home is the share that arrives, kmh mean metres
    by mean seconds of those that do, averaged over pairs; hours are of both sides together. unequal counts pairs whose sides differ in number,
    which a comparison must not have. trips: policy, keys, block, participant (null: no), seconds (null: not arrived), metres, scope_s
    (null: 0).
    """
    t = trips.withColumn("participant", F.coalesce("participant", F.lit(False)))
    run, side = [*keys, *block, "policy"], [*keys, *block, "policy", "participant"]
    there = F.col("seconds").isNotNull()
    kmh = F.try_divide(F.avg(F.when(there, F.col("metres"))), F.avg("seconds")) * 3.6
    cells = t.groupBy(*side).agg(F.count("*").alias("n"), F.count("seconds").alias("arrived"), F.avg("seconds").alias("mean"), kmh.alias("kmh"))
    cells = cells.join(exact_quantiles(t, side, F.col("seconds"), {"p95": 0.95}).drop("values"), side, "left")
    hours = t.groupBy(*run).agg((F.sum(F.coalesce("scope_s", F.lit(0.0))) / 3600).alias("hours"))
    cells = cells.join(hours, run)
    named = [c for c in cells.columns if c not in side]
    before = cells.filter(F.col("policy") == base).drop("policy").withColumnsRenamed({c: f"{c}_base" for c in named})
    both = cells.filter(F.col("policy") != base).join(before, [*keys, *block, "participant"])
    change = lambda c: (F.avg(F.try_divide(F.col(c) - F.col(f"{c}_base"), F.col(f"{c}_base"))) * 100).alias(f"{c}_change")
    share = lambda s: F.try_divide(F.sum(f"arrived{s}"), F.sum(f"n{s}")).alias(f"home{s}")
    return both.groupBy(*keys, "policy", "participant").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("n") != F.col("n_base")).alias("unequal"), F.sum("n").alias("trips"), share("_base"), share(""), change("mean"), change("p95"), F.avg("kmh_base").alias("kmh_base"), F.avg("kmh").alias("kmh"), change("hours"),
    )


def exposure(steps: DataFrame, roads: DataFrame, pending: DataFrame, *by: str, ratio: float = 0.5, stopped_mps: float = 0.1, window_s: int = 300) -> DataFrame:
    """by, then vehicle seconds seen, congested (at most ratio of the free flow) and stopped, of all vehicles (_all) and of those in scope (_scope),
    and of vehicles in scope that wait off the road to start (pending_scope).

    by is any of win (the window's first second) and seg; without it, one row for everything. Waiting vehicles are on no road: by seg they have a
    row of their own, with a null seg. Roads that aren't mapped aren't seen. steps: t, dt_s, seg, speed, in_scope; roads: seg, free_flow; pending: t,
    dt_s, vehicles.
    """
    win = (F.floor(F.col("t") / window_s) * window_s).alias("win")
    seconds, scope = F.col("dt_s").cast("double"), F.coalesce("in_scope", F.lit(False))
    s = steps.join(roads.select("seg", "free_flow"), "seg")
    slow, still = F.col("speed") <= ratio * F.col("free_flow"), F.col("speed") < stopped_mps
    kinds = {"observed": F.lit(True), "congested": slow, "stopped": still}
    parts = {f"{k}_{w}": F.when(rule & (scope if w == "scope" else F.lit(True)), seconds).otherwise(0.0) for w in ("all", "scope") for k, rule in kinds.items()}
    moving = s.select("seg", win, *(c.alias(n) for n, c in parts.items()), F.lit(0.0).alias("pending_scope"))
    waiting = pending.select(F.lit(None).cast(steps.schema["seg"].dataType).alias("seg"), win, *(F.lit(0.0).alias(n) for n in parts), (F.col("vehicles") * seconds).alias("pending_scope"))
    # Each side is summed before they meet.
    sums = lambda df: df.groupBy(*by).agg(*(F.sum(n).alias(n) for n in (*parts, "pending_scope")))
    return sums(sums(moving).unionByName(sums(waiting)))


def select_runs(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """run, family, selected, reasons (sorted own ones, then those of its partners in one): a family's runs are used together or not at all.

    A family needs a run with and one without the event, and no run with a problem. runs: run, family, with_event; problems: run, problem,
    repeats counted once. A family is a pair or a few seeds of one, and its reasons are one row.
    """
    own = problems.filter("problem is not null").groupBy("run").agg(F.array_sort(F.collect_set("problem")).alias("own"))
    r = runs.join(own, "run", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    mine = Window.partitionBy("family")
    kinds = F.bool_or(F.coalesce("with_event", F.lit(False))).over(mine) & F.bool_or(~F.coalesce("with_event", F.lit(False))).over(mine)
    bad = F.when(F.size("own") > 0, F.struct(F.col("run").cast("string").alias("run"), "own"))
    r = r.withColumn("all_bad", F.array_sort(F.collect_list(bad).over(mine))).withColumn("selected", kinds & (F.size("all_bad") == 0))
    others = F.filter("all_bad", lambda x: x["run"] != F.col("run").cast("string"))
    told = F.concat(F.lit("paired run excluded ("), F.array_join(F.transform(others, lambda x: F.concat(x["run"], F.lit(": "), F.array_join(x["own"], ", "))), "; "), F.lit(")"))
    alone = F.when(~kinds, F.array(F.lit("no pair with and without the event"))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat("own", F.when(F.size(others) > 0, F.array(told)).otherwise(F.array().cast("array<string>")), alone)
    return r.select("run", "family", "selected", F.when(F.col("selected"), F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def typical_times(controls: DataFrame, roads: DataFrame, bucket_s: int = 600) -> DataFrame:
    """seg, bucket (second of the day), travel_time, samples: the mean measured time over training runs without the event, or the road's free time
    where none was measured, for every bucket of a day. controls: seg, bucket, travel_time (null: not measured); roads: seg (once each), free_s."""
    mean = controls.groupBy("seg", "bucket").agg(F.avg("travel_time").alias("mean"), F.count("travel_time").alias("samples"))
    day = roads.select("seg", "free_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(86_400 - bucket_s).cast("long"), F.lit(bucket_s).cast("long"))).alias("bucket"))
    return day.join(mean, ["seg", "bucket"], "left").select("seg", "bucket", F.coalesce("mean", "free_s").alias("travel_time"), F.coalesce("samples", F.lit(0)).alias("samples"))


# Fixed values of a forecast map: what a road's availability and a row's source may be, and the reason of a restricted road that can be used.
AVAILABILITY = ("open", "closed", "restricted", "unavailable")
SOURCES = ("model", "representative_road", "none", "fixture")
PARTIAL = "partial_closure_see_closures_table"


def map_problems(forecast: DataFrame, roads: DataFrame, closures: DataFrame, network: str, bucket_s: int = 600, horizons: int = 6) -> DataFrame:
    """problem, rows: what breaks the contract of a forecast map; no row means that it may be published.

    empty; several_models, several_networks, several_issues (values); other_network, unknown_horizon, repeated_key (rows beyond the first),
    wrong_interval, unknown_availability, unknown_source, unknown_road, no_travel_time (of a usable row), outside_representative (rows);
    missing_horizon (how many); empty_closure (rows of closures). Nulls break the rule that looks at them. forecast: seg, horizon_min, issued_s,
    from_s, to_s, model, network, availability, restriction, source, travel_time, represented_by; roads: seg; closures: begin_s, end_s.
    """
    step = bucket_s // 60
    known = roads.select("seg").distinct().withColumn("known", F.lit(True))
    f = forecast.join(known, "seg", "left").join(known.select(F.col("seg").alias("represented_by"), F.col("known").alias("inside")), "represented_by", "left")
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("seg", "horizon_min").orderBy("issued_s")))
    wanted = F.col("horizon_min").isin([step * (k + 1) for k in range(horizons)])
    begin = F.col("issued_s") + (F.col("horizon_min") / step - 1) * bucket_s
    usable = ((F.col("availability") == "open") | ((F.col("availability") == "restricted") & (F.col("restriction") == PARTIAL))) & (F.col("source") != "none")
    timed = F.col("travel_time") > 0
    sound = timed & ~F.isnan("travel_time") & (F.col("travel_time") < float("inf"))
    holds = {
        "other_network": F.col("network") == network, "unknown_horizon": wanted, "repeated_key": F.col("place") == 1, "wrong_interval": (F.col("from_s") == begin) & (F.col("to_s") - F.col("from_s") == bucket_s),
        "unknown_availability": F.col("availability").isin(*AVAILABILITY), "unknown_source": F.col("source").isin(*SOURCES), "unknown_road": F.coalesce("known", F.lit(False)),
        "no_travel_time": ~F.coalesce(usable, F.lit(False)) | F.coalesce(sound, F.lit(False)), "outside_representative": (F.coalesce("source", F.lit("")) != "representative_road") | F.coalesce("inside", F.lit(False)),
    }
    several = {f"several_{n}s": F.count_distinct(c) - 1 for n, c in (("model", "model"), ("network", "network"), ("issue", "issued_s"))}
    counts = f.agg(
        F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"), *(F.when(c > 0, c + 1).otherwise(0).alias(n) for n, c in several.items()),
        *(F.count_if(~F.coalesce(rule, F.lit(False))).alias(n) for n, rule in holds.items()), F.when(F.count("*") > 0, horizons - F.count_distinct(F.when(wanted, F.col("horizon_min")))).otherwise(0).alias("missing_horizon"),
    )
    shut = closures.agg(F.count_if(~F.coalesce(F.col("end_s") > F.col("begin_s"), F.lit(False))).alias("rows")).select(F.lit("empty_closure").alias("problem"), F.col("rows").cast("long").alias("rows"))
    listed = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).cast("long").alias("rows")) for c in counts.columns))).alias("x")).select("x.*")
    return listed.unionByName(shut).filter("rows > 0")


def map_status(issues: DataFrame, now_s: Column, most_age_s: int = 1200) -> DataFrame:
    """place, issued_s, status of the newest valid map of each place: ok, stale (over most_age_s old), not_yet_valid (issued later than now); an older
    map never takes a newer one's place. A place whose maps are all invalid is missing. issues: place, issued_s, valid."""
    newest = issues.groupBy("place").agg(F.max(F.when(F.col("valid"), F.col("issued_s"))).alias("issued_s"))
    age = now_s - F.col("issued_s")
    return newest.withColumn("status", F.when(F.col("issued_s").isNull(), "missing").when(age > most_age_s, "stale").when(age < 0, "not_yet_valid").otherwise("ok"))


def cover_by_representatives(cover: DataFrame, represented: DataFrame) -> DataFrame:
    """seg, bucket, cover: closure cover of roads and of those that stand for them, the larger of both. cover: seg, bucket, cover; represented: seg,
    represented_by (null: none). A road with one representative and no cover of its own takes that cover as it is, without a shuffle of its rows;
    only the others are grouped."""
    cover = cover.groupBy("seg", "bucket").agg(F.max("cover").alias("cover"))
    by = represented.filter("represented_by is not null").groupBy("seg").agg(F.min("represented_by").alias("by"), (F.min("represented_by") < F.max("represented_by")).alias("more"))
    by = by.join(cover.select("seg").distinct().withColumn("own", F.lit(True)), "seg", "left").withColumn("mixed", F.col("more") | F.col("own").isNotNull())
    plain = by.filter(~F.col("mixed")).select("seg", "by").join(cover.withColumnRenamed("seg", "by"), "by").select("seg", "bucket", "cover")
    represented = represented.join(by.filter("mixed").select("seg"), "seg", "left_semi")
    through = represented.filter("represented_by is not null").select("seg", F.col("represented_by").alias("by")).distinct().join(cover.withColumnRenamed("seg", "by"), "by").select("seg", "bucket", "cover")
    return cover.select("seg", "bucket", "cover").unionByName(through).groupBy("seg", "bucket").agg(F.max("cover").alias("cover")).unionByName(plain)
