"""Timing routes against a forecast, and choosing among candidate routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.joins import MOST_SENT, in_parts, sent_if_few


def time_route(cells: DataFrame, departures: DataFrame, forecast: DataFrame, bucket_s: int, period: int | None = None) -> DataFrame:
    """route, roads, arrive_s, missing: the clock advances road by road, and each entry time picks the forecast's bucket. cells: route, pos,
    seg, length; departures: route, depart_s; forecast: seg, bucket (number; modulo period, if given), pace in seconds per unit of length,
    of repeats the least. A road without a forecast adds nothing and counts as missing; a route without cells arrives as it departs.

    A road brings the buckets of one issue, and a route's roads are folded in one row: both are bounded by the horizon and the route. Where roads
    are few, their buckets are sent to all tasks, and are met when the route is together: they aren't shuffled with each of its roads.
    """
    one = forecast.filter("pace is not null").groupBy("seg", "bucket").agg(F.min("pace").alias("pace"))
    by_road = one.groupBy("seg").agg(F.collect_list(F.struct("bucket", "pace")).alias("paces"))
    none = F.array().cast(by_road.schema["paces"].dataType)
    road = F.struct("pos", "seg", "length", F.coalesce("paces", none).alias("paces"))
    few = by_road.limit(MOST_SENT + 1).count() <= MOST_SENT
    met = in_parts(cells.select("route", "pos", "seg", "length"), cells.count(), "route").join(F.broadcast(by_road), "seg", "left") if few else cells.join(by_road, "seg", "left")
    routes = met.groupBy("route").agg(F.sort_array(F.collect_list(road)).alias("roads"))

    def enter(clock, x):
        at = F.floor(clock["at"] / bucket_s)
        at = at if period is None else F.pmod(at, F.lit(period))
        pace = F.get(F.filter(x["paces"], lambda p: p["bucket"] == at), 0)["pace"]
        return F.struct((clock["at"] + F.coalesce(x["length"] * pace, F.lit(0.0))).alias("at"), (clock["missing"] + pace.isNull().cast("int")).alias("missing"))

    start = F.struct(F.col("depart_s").cast("double").alias("at"), F.lit(0).alias("missing"))
    timed = departures.join(routes, "route", "left").withColumn("end", F.aggregate(F.coalesce("roads", F.array().cast(routes.schema["roads"].dataType)), start, enter))
    return timed.select("route", F.coalesce(F.size("roads"), F.lit(0)).alias("roads"), F.col("end.at").alias("arrive_s"), F.col("end.missing").alias("missing"))


def bound(value: Column, then) -> Column:
    """then(value), with value worked out once: a lambda's own columns are worked out wherever they stand."""
    return F.transform(F.array(value), then)[0]


#: What a route is refused for, by what is found first on its way.
REFUSALS = ("empty_route", "illegal_connection", "before_issue_time", "beyond_horizon", "not_enterable", "closure")


def time_checked(routes: DataFrame, cells: DataFrame, forecast: DataFrame, closures: DataFrame, arcs: DataFrame, issued_s: int, bucket_s: int, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Routes timed road by road, and refused where they can't be driven: (route, arrive_s, reason, seg, at_s, metres, flags) and (route, class,
    seconds).

    routes: route, depart_s, first_share (of the first road, where it begins), last_share (of the last, where it ends); cells: route, pos, seg,
    class, metres, free_s; forecast: seg, bucket (0 to horizon - 1), seconds (null: not to be entered); closures: seg, begin_s, end_s, kind
    (full, else partial); arcs: src, dst. A road takes its share of the seconds of the bucket in which it is entered; the first may be
    entered without a forecast, at its free time. A refused route has its reason, the road and the time, and no arrival; exposure is given
    for routes that arrive. A road brings the buckets of one issue and its own closures, together, sent to all tasks where roads are few; a
    route's roads are folded in one row.
    """
    by_road = forecast.filter("seconds is not null").groupBy("seg").agg(F.collect_list(F.struct("bucket", "seconds")).alias("times"))
    shut = closures.groupBy("seg").agg(F.collect_list(F.struct("begin_s", "end_s", (F.col("kind") == "full").alias("full"))).alias("shut"))
    before = F.lag("seg").over(Window.partitionBy("route").orderBy("pos"))
    legal = arcs.select("src", F.col("dst").alias("seg"), F.lit(True).alias("legal")).distinct()
    steps = cells.withColumn("src", before).join(legal, ["src", "seg"], "left").join(sent_if_few(by_road.join(shut, "seg", "full")), "seg", "left")
    none = lambda c: F.coalesce(c, F.array().cast(steps.schema[c].dataType)).alias(c)
    step = F.struct("pos", "seg", "class", "metres", "free_s", (F.col("src").isNull() | F.coalesce("legal", F.lit(False))).alias("legal"), none("times"), none("shut"))
    steps = in_parts(steps, cells.count(), "route")
    rows = routes.join(steps.groupBy("route").agg(F.sort_array(F.collect_list(step)).alias("roads")), "route", "left")
    last = F.size("roads") - 1

    def enter(so_far: Column, x: Column) -> Column:
        first, final = so_far["n"] == 0, so_far["n"] == last

        def times(slot: Column) -> Column:
            known = F.get(F.filter(x["times"], lambda f: f["bucket"] == slot), 0)["seconds"]
            share = F.greatest(F.when(final, F.col("last_share")).otherwise(1.0) - F.when(first, F.col("first_share")).otherwise(0.0), F.lit(0.0))
            return bound(F.struct(slot.alias("slot"), known.alias("known"), share.alias("share")), spends)

        def spends(e: Column) -> Column:
            spent = F.coalesce(e["known"], F.when(first, x["free_s"])) * e["share"]
            return bound(F.struct(e["slot"].alias("slot"), e["known"].alias("known"), e["share"].alias("share"), spent.alias("spent")), lambda e: bound(judged(e), goes))

        def judged(e: Column) -> Column:
            slot, out = e["slot"], so_far["at"] + e["spent"]
            met = lambda full: ~first & F.exists(x["shut"], lambda c: (c["full"] == full) & (c["begin_s"] < out) & (so_far["at"] < c["end_s"]))
            reason = F.when(~x["legal"], "illegal_connection").when(slot < 0, "before_issue_time").when(slot >= horizon, "beyond_horizon").when(e["spent"].isNull(), "not_enterable").when(met(True), "closure")
            flags = F.filter(F.array(F.when(first & e["known"].isNull(), "origin_cost_free_flow"), F.when(met(False), "partial_restriction_on_route")), lambda f: f.isNotNull())
            return F.struct(reason.alias("reason"), out.alias("out"), e["share"].alias("share"), e["spent"].alias("spent"), flags.alias("flags"))

        def goes(e: Column) -> Column:
            going = F.struct((so_far["n"] + 1).alias("n"), e["out"].alias("at"), (so_far["metres"] + x["metres"] * e["share"]).alias("metres"), F.array_union(so_far["flags"], e["flags"]).alias("flags"), F.lit(None).cast("string").alias("reason"), x["seg"].alias("seg"), F.concat(so_far["spent"], F.array(F.struct(x["class"].alias("class"), e["spent"].alias("seconds")))).alias("spent"))
            refused = F.struct(so_far["n"].alias("n"), so_far["at"].alias("at"), so_far["metres"].alias("metres"), so_far["flags"].alias("flags"), e["reason"].alias("reason"), x["seg"].alias("seg"), so_far["spent"].alias("spent"))
            return F.when(e["reason"].isNotNull(), refused).otherwise(going)

        return F.when(so_far["reason"].isNotNull(), so_far).otherwise(bound(F.floor((so_far["at"] - issued_s) / bucket_s), times))

    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("seg", "class")}
    start = F.struct(F.lit(0).alias("n"), F.col("depart_s").cast("double").alias("at"), F.lit(0.0).alias("metres"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast(kinds["seg"]).alias("seg"), F.array().cast(f"array<struct<class:{kinds['class']},seconds:double>>").alias("spent"))
    end = F.aggregate("roads", start, enter)
    timed = rows.withColumn("end", F.when(F.col("roads").isNotNull(), end))
    late = F.col("end.reason").isNull() & (F.col("end.at") > issued_s + horizon * bucket_s)
    reason = F.when(F.col("roads").isNull(), "empty_route").when(late, "beyond_horizon").otherwise(F.col("end.reason"))
    timed = timed.withColumn("why", reason)
    fine = F.col("why").isNull()
    routes_out = timed.select("route", F.when(fine, F.col("end.at")).alias("arrive_s"), F.col("why").alias("reason"), F.when(~fine, F.col("end.seg")).alias("seg"), F.when(~fine, F.col("end.at")).alias("at_s"), F.when(fine, F.col("end.metres")).alias("metres"), F.array_join(F.array_sort("end.flags"), ",").alias("flags"))
    exposure = timed.filter(fine).select("route", F.explode("end.spent").alias("x")).groupBy("route", F.col("x.class").alias("class")).agg(F.sum("x.seconds").alias("seconds"))
    return routes_out, exposure


def candidate_overlaps(cells: DataFrame, order: str = "candidate") -> DataFrame:
    """request, candidate, most, with_first: the largest share of a candidate's time on roads that another candidate of the request uses too, and
    that share with the request's first one by order (1 for itself). cells: request, candidate, seg, eta. Pairs are made within a request,
    over the roads that two candidates share, and a request has few candidates. Requests are dealt to parts once, in which all else is done."""
    roads = in_parts(cells.select("request", "candidate", "seg", "eta"), cells.count(), "request").groupBy("request", "candidate", "seg").agg(F.sum("eta").alias("eta"))
    mine = Window.partitionBy("request")
    roads = roads.withColumn("total", F.sum("eta").over(Window.partitionBy("request", "candidate"))).withColumn("first", F.min(order).over(mine))
    # A road's candidates are listed, then paired; one without a request, candidate or road shares none.
    others = F.collect_list("candidate").over(Window.partitionBy("request", "seg"))
    known = F.col("request").isNotNull() & F.col("candidate").isNotNull() & F.col("seg").isNotNull()
    pairs = roads.withColumn("others", others).withColumn("other", F.explode_outer(F.when(known, F.col("others"))))
    shared = pairs.groupBy("request", "candidate", "other", "total", "first").agg(F.sum("eta").alias("shared"))
    share = F.coalesce(F.try_divide("shared", "total"), F.lit(0.0))
    found = shared.groupBy("request", "candidate").agg(F.max(F.when(F.col("other") != F.col("candidate"), share)).alias("most"), F.max(F.when(F.col("other") == F.col("first"), share)).alias("with_first"))
    return found.select("request", "candidate", F.coalesce("most", F.lit(0.0)).alias("most"), F.coalesce("with_first", F.lit(0.0)).alias("with_first"))


def decided_in_time(decisions: DataFrame) -> DataFrame:
    """decisions, and leak: whether the forecast that a decision rests on was issued after it, by over a microsecond, or isn't known. decisions: issued_s,
    decided_s. A row that leaks is to be refused."""
    return decisions.withColumn("leak", F.coalesce(F.col("issued_s") > F.col("decided_s") + 1e-6, F.lit(True)))


def candidate_totals(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The roads of each candidate, once each, and its eta, length and path digest. cells: request, candidate, seg, length, eta."""
    roads = cells.groupBy("request", "candidate", "seg").agg(F.sum("length").alias("length"), F.sum("eta").alias("eta"))
    path = F.md5(F.array_join(F.sort_array(F.collect_list("seg")).cast("array<string>"), ","))
    return roads, roads.groupBy("request", "candidate").agg(F.round(F.sum("eta"), 2).alias("eta"), F.sum("length").alias("length"), path.alias("path"))


def top_candidates(cells: DataFrame, most: int = 5, detour: float = 0.5, overlap: float = 0.9) -> DataFrame:
    """request, candidate, rank, eta: the fastest, and others within the detour that share at most the overlap of their length with it; ties
    go by path digest, then candidate."""
    roads, totals = candidate_totals(cells)
    fastest = totals.groupBy("request").agg(F.min(F.struct("eta", "path", "candidate")).alias("f")).select("request", F.col("f.candidate").alias("fastest"), F.col("f.eta").alias("least"))
    ground = roads.join(fastest, "request").filter("candidate = fastest").select("request", "seg")
    shared = roads.join(ground, ["request", "seg"]).groupBy("request", "candidate").agg(F.sum("length").alias("shared"))
    t = totals.join(fastest, "request").join(shared, ["request", "candidate"], "left")
    apart = F.coalesce(F.try_divide("shared", "length"), F.lit(0.0)) <= overlap
    t = t.filter((F.col("eta") <= F.col("least") * (1 + detour)) & ((F.col("candidate") == F.col("fastest")) | apart))
    ranked = t.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("eta", "path", "candidate")))
    return ranked.filter(F.col("rank") <= most).select("request", "candidate", "rank", "eta")


def seeded_choice(candidates: DataFrame, within: float = 0.5, seed: str = "0") -> DataFrame:
    """request, candidate: among costs within so much of the request's least, the one of the least digest under the seed. Reruns agree.
    candidates: request, candidate, cost; a null cost is never chosen."""
    least = candidates.groupBy("request").agg(F.min("cost").alias("least"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("request").cast("string"), F.col("candidate").cast("string")))
    tied = candidates.join(least, "request").filter(F.col("cost") <= F.col("least") + within)
    return tied.groupBy("request").agg(F.min(F.struct(digest.alias("digest"), "candidate")).getField("candidate").alias("candidate"))


def candidate_features(cells: DataFrame, load: DataFrame) -> DataFrame:
    """request, candidate, eta, metres, detour (over the request's fastest), congestion (ratio by length), most_load, mean_load. cells: request,
    candidate, seg, length, eta, ratio; load: seg, load, missing is 0. Requests are dealt to parts once."""
    n = F.coalesce("load", F.lit(0))
    met = cells.join(sent_if_few(load), "seg", "left").select("request", "candidate", "eta", "length", "ratio", "load")
    c = in_parts(met, cells.count(), "request").groupBy("request", "candidate").agg(
        F.round(F.sum("eta"), 2).alias("eta"), F.sum("length").alias("metres"), F.try_divide(F.sum(F.col("ratio") * F.col("length")), F.sum("length")).alias("congestion"), F.max(n).alias("most_load"), F.avg(n).alias("mean_load")
    )
    least = F.min("eta").over(Window.partitionBy("request"))
    return c.filter("request is not null").select("request", "candidate", "eta", "metres", (F.col("eta") - least).alias("detour"), "congestion", "most_load", "mean_load")
