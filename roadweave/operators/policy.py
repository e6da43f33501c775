"""Plans and assignments: a route's prediction, departures, choices in order of arrival, a residual model, exported predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.joins import cells_around, own_cell


def departure_times(trips: DataFrame, alternatives: DataFrame, now_s: Column) -> DataFrame:
    """trip, route, depart_s, and the joint window from_s, to_s of all alternatives of the trip. A trip that must arrive leaves its duration earlier,
    one with a departure leaves then but not before now, others now. trips: trip, mode (arrive, depart, null), at_s; alternatives: trip, route,
    duration_s."""
    depart = F.when(F.col("mode") == "arrive", F.col("at_s") - F.col("duration_s")).when(F.col("mode") == "depart", F.greatest(F.col("at_s"), now_s)).otherwise(now_s)
    w = Window.partitionBy("trip")
    rows = alternatives.join(trips, "trip").withColumn("depart_s", depart)
    return rows.select("trip", "route", "depart_s", F.min("depart_s").over(w).alias("from_s"), F.max(F.col("depart_s") + F.col("duration_s")).over(w).alias("to_s"))


def plan_rows(routes: DataFrame, forecast: DataFrame, events: DataFrame, incidents: DataFrame, traffic: DataFrame, live_s: int = 1800) -> DataFrame:
    """trip, route, duration_s, events_s, incidents_s, traffic_s, delay_s, blocked, model, best, saved_s, tag.

    A route's forecast delay stands for events where it has one, else the worst event's; incidents are added, and traffic where the provider's time
    has none and the trip starts soon. The first route of a trip is the provider's; the best is that of the least time that isn't blocked.
    routes: trip, route, place (from 0), duration_s, has_live, starts_in_s; forecast: route, delay (null: none); events: route, delay_s, rank;
    incidents: route, delay_s, blocked; traffic: route, delay_s.
    """
    side = lambda df, c, name: df.select("route", F.col(c).alias(name))
    r = routes.join(side(forecast, "delay", "forecast_s"), "route", "left").join(side(events.filter("rank = 1"), "delay_s", "event_s"), "route", "left")
    r = r.join(incidents.select("route", F.col("delay_s").alias("incident_s"), F.col("blocked").alias("is_blocked")), "route", "left").join(side(traffic, "delay_s", "slow_s"), "route", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    soon = ~F.col("has_live") & (F.abs("starts_in_s") <= live_s)
    r = r.select(
        "trip", "route", "place", "duration_s", zero(F.coalesce("forecast_s", "event_s")).alias("events_s"), zero(F.col("incident_s")).alias("incidents_s"), F.when(soon, zero(F.col("slow_s"))).otherwise(0.0).alias("traffic_s"),
        F.coalesce("is_blocked", F.lit(False)).alias("blocked"), F.when(F.col("forecast_s").isNotNull(), "forecast").otherwise("event_rule").alias("model"),
    ).withColumn("delay_s", F.col("events_s") + F.col("incidents_s") + F.col("traffic_s"))
    mine = Window.partitionBy("trip")
    total = F.col("duration_s") + F.col("delay_s")
    r = r.withColumn("best", F.row_number().over(mine.orderBy("blocked", total, "place")) == 1)
    saved = F.max(F.when(F.col("place") == 0, total)).over(mine) - F.max(F.when(F.col("best"), total)).over(mine)
    r = r.withColumn("saved_s", F.when(F.col("best"), saved))
    tag = F.when(F.col("blocked"), "closure_ahead").when(F.col("saved_s") >= 60, "saves_time").when((F.col("events_s") > 0) | (F.col("incidents_s") > 0), "events_on_the_way").otherwise("clear")
    return r.withColumn("tag", F.when(F.col("best"), tag))


def assign_in_order(candidates: DataFrame, load: DataFrame, weight: float, scale: float) -> DataFrame:
    """batch, request, candidate, cost: requests of a batch choose one after another, each seeing what those before it brought to the roads. The cost
    is the time plus weight times the growth of squared load over scale; the smaller candidate among equals. Batches are independent; a batch is
    one group, as large as what arrives at once. candidates: batch, request, place (order of arrival), candidate, segs array<long>, eta; load:
    seg, load."""
    cells = candidates.select("batch", F.explode("segs").alias("seg")).distinct().join(load, "seg")
    known = cells.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("seg", F.col("load").cast("double")))).alias("known"))
    schema = candidates.schema

    def run(x: pd.DataFrame) -> pd.DataFrame:
        on = dict(x["known"].iloc[0] or {})
        out = []
        for request, rows in x.sort_values(["place", "request", "candidate"], kind="stable").groupby("request", sort=False):
            costs = [(eta + weight * sum((2 * on.get(s, 0.0) + 1) / scale**2 for s in segs), c, segs) for eta, c, segs in zip(rows["eta"], rows["candidate"], rows["segs"], strict=True)]
            cost, candidate, segs = min(costs, key=lambda c: (c[0], c[1]))
            for s in segs:
                on[s] = on.get(s, 0.0) + 1
            out.append((x["batch"].iloc[0], request, candidate, cost))
        return pd.DataFrame(out, columns=["batch", "request", "candidate", "cost"])

    kind = lambda c: schema[c].dataType.simpleString()
    return candidates.join(known, "batch", "left").groupBy("batch").applyInPandas(run, f"batch {kind('batch')}, request {kind('request')}, candidate {kind('candidate')}, cost double")


def residual_model(train: DataFrame, validation: DataFrame, features: list[str], grid: tuple[tuple[int, float], ...] = ((3, 0.1), (5, 0.1)), rounds: int = 20, seed: int = 4):
    """A gradient-boosted model of target less base, by Spark's own trainer: of the grid (depth, step) the one of least mean absolute error over
    validation rows, and that error. train, validation: features, base, target; rows with a null feature teach nothing."""
    rows = lambda df: VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip").transform(df.withColumn("residual", F.col("target") - F.col("base")).filter("residual is not null"))
    fit_on, look_at = rows(train), rows(validation)
    best = None
    for depth, step in grid:
        model = GBTRegressor(featuresCol="__features", labelCol="residual", maxDepth=depth, stepSize=step, maxIter=rounds, seed=seed).fit(fit_on)
        error = model.transform(look_at).agg(F.avg(F.abs(F.col("prediction") - F.col("residual")))).first()[0]
        if best is None or (error is not None and error < best[1]):
            best = (model, error)
    return best


def residual_predictions(rows: DataFrame, model, features: list[str], least: Column, most: Column) -> DataFrame:
    """rows with predicted: base plus the model's residual within physical bounds; rows with a null feature keep their base."""
    x = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep").transform(rows)
    whole = ~F.array_contains(F.transform(F.array(*(F.col(c).cast("double") for c in features)), lambda v: v.isNull()), True)
    out = model.transform(x).withColumn("predicted", F.when(whole, F.greatest(least, F.least(most, F.col("base") + F.col("prediction")))).otherwise(F.col("base")))
    return out.drop("__features", "prediction")


def export_predictions(forecast: DataFrame, roads: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of a forecast for the metrics table: seg, valid_from, horizon_min, current (last fused speed), speed, delay_s (over free flow), ratio.
    forecast: seg, issued_s, valid_from, travel_time, speed, ratio; roads: seg, length, free_flow (metres a second); history: seg, bucket, speed."""
    last = history.groupBy("seg").agg(F.max_by("speed", "bucket").alias("current"))
    f = forecast.join(roads, "seg").join(last, "seg", "left")
    return f.select("seg", "valid_from", ((F.col("valid_from") - F.col("issued_s")) / 60 + 10).cast("int").alias("horizon_min"), "current", "speed", (F.col("travel_time") - F.col("length") / F.col("free_flow")).alias("delay_s"), "ratio")


def spread_load(schedules: DataFrame, now_s: Column, bin_s: int = 300, kernel: tuple[float, ...] = (0.25, 0.5, 0.25)) -> DataFrame:
    """seg, bin, load: what is left of live schedules, each entry spread over neighbouring bins by the kernel. schedules: assignment, seg, entry_s."""
    half = len(kernel) // 2
    spread = F.explode(F.array(*(F.struct(F.lit(k - half).alias("d"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel))))
    return schedules.filter(F.col("entry_s") >= now_s).withColumn("x", spread).groupBy("seg", ((F.floor(F.col("entry_s") / bin_s) + F.col("x.d")) * bin_s).alias("bin")).agg(F.sum("x.w").alias("load"))


def concentration_growth(cells: DataFrame, load: DataFrame, *keys: str) -> DataFrame:
    """keys and the exact growth of sum w (L/B)^2 if all cells of the keys join the load, cells of one place counted together. cells: keys, seg, bin;
    load: seg, bin, load; cells carry weight and budget of their road."""
    more = cells.groupBy(*keys, "seg", "bin").agg(F.count("*").cast("double").alias("more"), F.first("weight").alias("weight"), F.first("budget").alias("budget"))
    l = F.coalesce("load", F.lit(0.0))
    grown = F.col("weight") * (F.pow(l + F.col("more"), 2) - F.pow(l, 2)) / F.pow("budget", 2)
    return more.join(load, ["seg", "bin"], "left").groupBy(*keys).agg(F.sum(grown).alias("growth"))


def demand_to_place(trips: DataFrame, places: DataFrame, radius_m: float, window_s: int) -> DataFrame:
    """place, riders: trips that haven't arrived, end in the box around the place and leave within window_s of its time. trips: trip, lon, lat, depart_s,
    arrived; places: place, plon, plat, at_s.

    No place is paired with trips: it is paired with the positions in its box, and at each of them the trips up to the window's end less those
    before it are read off one running count, so rows grow with trips and with places times the positions around them."""
    dlat = radius_m / 111_132.0
    dlon = radius_m / (111_320.0 * F.cos(F.radians("plat")))
    counts = trips.filter("not coalesce(arrived, false) and depart_s is not null").groupBy("lon", "lat", "depart_s").agg(F.count("*").alias("n"))
    spots = counts.select("lon", "lat").distinct().withColumn("__cell", own_cell(F.col("lon"), F.col("lat"), radius_m))
    sites = places.select("plon", "plat").distinct().withColumn("__cell", F.explode(cells_around(F.col("plon"), F.col("plat"), radius_m)))
    box = sites.join(spots, "__cell").filter((F.abs(F.col("lat") - F.col("plat")) <= dlat) & (F.abs(F.col("lon") - F.col("plon")) <= dlon)).drop("__cell")
    # A reading before the trips of its second leaves them out, one behind them has them in.
    reads = F.array(F.struct((F.col("at_s") - window_s).alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")), F.struct((F.col("at_s") + window_s).alias("at"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))
    asked = places.filter("at_s is not null").select("place", "plon", "plat", F.explode(reads).alias("r")).join(box, ["plon", "plat"]).select("lon", "lat", "place", "r.*", F.lit(0).cast("long").alias("n"))
    both = asked.unionByName(counts.select("lon", "lat", F.lit(None).cast(places.schema["place"].dataType).alias("place"), F.col("depart_s").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("sign"), "n"))
    upto = F.sum("n").over(Window.partitionBy("lon", "lat").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("upto", upto).filter("turn <> 1").groupBy("place").agg(F.sum(F.col("upto") * F.col("sign")).alias("riders"))
    return places.select("place").join(counted, "place", "left").select("place", F.coalesce("riders", F.lit(0)).alias("riders"))
