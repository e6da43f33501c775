"""Registered queries of experiments, forecast maps and vehicles in service; added to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.operators import experiments as EX
from roadweave.operators import joins as J
from roadweave.operators import lines as LN
from roadweave.plans import lenses as L
from roadweave.plans.detail_queries import nudged
from roadweave.plans.queries import HAV, query


@query(
    """WITH t AS (SELECT o_orderpriority AS policy, o_custkey % 2 AS crowd, o_orderkey % 5 AS block, o_custkey % 3 = 0 AS participant, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 100 END AS seconds, 1000.0 + o_orderkey % 50 * 100 AS metres, o_totalprice / 90 AS scope_s FROM orders),
    c AS (SELECT crowd, block, policy, participant, count(*) AS n, count(seconds) AS arrived, avg(seconds) AS mean, avg(metres) FILTER (WHERE seconds IS NOT NULL) / avg(seconds) * 3.6 AS kmh, quantile_cont(seconds, 0.95) AS p95 FROM t GROUP BY ALL),
    h AS (SELECT crowd, block, policy, sum(scope_s) / 3600 AS hours FROM t GROUP BY ALL), x AS (SELECT * FROM c JOIN h USING (crowd, block, policy)),
    j AS (SELECT a.*, b.n AS nb, b.arrived AS ab, b.mean AS mb, b.p95 AS pb, b.kmh AS kb, b.hours AS hb FROM x a JOIN x b ON a.crowd = b.crowd AND a.block = b.block AND a.participant = b.participant AND b.policy = '5-LOW' WHERE a.policy <> '5-LOW')
    SELECT crowd, policy, participant, count(*) AS pairs, count(*) FILTER (WHERE n <> nb) AS unequal, sum(n)::BIGINT AS trips, round(sum(ab) / sum(nb) + 1e-9, 5) AS home_base, round(sum(arrived) / sum(n) + 1e-9, 5) AS home, round(avg((mean - mb) / mb) * 100 + 1e-9, 5) AS mean_change,
    round(avg((p95 - pb) / pb) * 100 + 1e-9, 5) AS p95_change, round(avg(kb) + 1e-9, 5) AS kmh_base, round(avg(kmh) + 1e-9, 5) AS kmh, round(avg((hours - hb) / hb) * 100 + 1e-9, 5) AS hours_change FROM j GROUP BY 1, 2, 3"""
)
def group_changes(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey")
    price = F.col("o_totalprice").cast("double")
    trips = o.select(F.col("o_orderpriority").alias("policy"), (F.col("o_custkey") % 2).alias("crowd"), (k % 5).alias("block"), (F.col("o_custkey") % 3 == 0).alias("participant"), F.when(k % 7 > 0, price / 100).alias("seconds"), (1000.0 + k % 50 * 100).alias("metres"), (price / 90).alias("scope_s"))
    return nudged(EX.group_changes(trips, "5-LOW", ["crowd"], ["block"]), "home_base", "home", "mean_change", "p95_change", "kmh_base", "kmh", "hours_change")


def steps(spark, d):
    r = L.readings(spark, d).select("t", F.col("weight").alias("dt_s"), "seg", "speed", (F.col("event_id") % 4 == 0).alias("in_scope"))
    roads = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg"), (20.0 + F.col("s_suppkey") % 60).alias("free_flow"))
    pending = L.closures(spark, d).select(F.col("start_s").alias("t"), F.lit(2).alias("dt_s"), (F.col("closure") % 4).alias("vehicles"))
    return r, roads, pending


STEPS = """p AS (SELECT NULL::BIGINT AS seg, start_s AS t, 0 AS dt, 0 AS c, 0 AS st, false AS s, 2 * (closure % 4) AS w FROM closures), s AS (SELECT seg, t, weight AS dt, (speed <= 0.5 * (20 + seg % 60))::INT AS c, (speed < 5)::INT AS st, event_id % 4 = 0 AS s, 0 AS w FROM readings WHERE seg IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT * FROM p)
    SELECT {by}, sum(dt)::DOUBLE AS observed_all, sum(dt * c)::DOUBLE AS congested_all, sum(dt * st)::DOUBLE AS stopped_all, sum(dt * s::INT)::DOUBLE AS observed_scope, sum(dt * c * s::INT)::DOUBLE AS congested_scope, sum(dt * st * s::INT)::DOUBLE AS stopped_scope, sum(w)::DOUBLE AS pending_scope FROM s GROUP BY 1"""


@query(", " + STEPS.format(by="t - t % 86400 AS win"), "readings", "closures")
def exposure_by_window(spark, d):
    return EX.exposure(*steps(spark, d), "win", stopped_mps=5.0, window_s=86_400)


@query(", " + STEPS.format(by="seg::DOUBLE AS seg"), "readings", "closures")
def exposure_by_road(spark, d):
    return EX.exposure(*steps(spark, d), "seg", stopped_mps=5.0).withColumn("seg", F.col("seg").cast("double"))


@query(
    """WITH r AS (SELECT o_orderkey AS run, o_custkey AS family, o_orderkey % 2 = 0 AS with_event FROM orders), p AS (SELECT DISTINCT l_orderkey AS run, CASE WHEN l_quantity >= 49.5 THEN 'late' ELSE 'stuck' END AS problem FROM lineitem WHERE l_quantity >= 49.5 OR l_discount = 0.1 AND l_tax = 0.08),
    o AS (SELECT r.*, (SELECT array_to_string(list_sort(list(problem)), ', ') FROM p WHERE p.run = r.run) AS own FROM r), f AS (SELECT family, bool_or(with_event) AND bool_or(NOT with_event) AS kinds, count(own) AS bad FROM o GROUP BY 1)
    SELECT run, family, kinds AND bad = 0 AS selected, CASE WHEN kinds AND bad = 0 THEN '' ELSE concat_ws('|', replace(own, ', ', '|'), (SELECT 'paired run excluded (' || string_agg(q.run || ': ' || q.own, '; ' ORDER BY q.run::VARCHAR) || ')' FROM o q WHERE q.family = o.family AND q.run <> o.run AND q.own IS NOT NULL),
    CASE WHEN NOT kinds THEN 'no pair with and without the event' END) END AS reasons FROM o JOIN f USING (family)"""
)
def select_runs(spark, d):
    l = L.table(spark, d, "lineitem").filter("l_quantity >= 49.5 or (l_discount = 0.1 and l_tax = 0.08)")
    problems = l.select(F.col("l_orderkey").alias("run"), F.when(F.col("l_quantity") >= 49.5, "late").otherwise("stuck").alias("problem"))
    runs = L.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 2 == 0).alias("with_event"))
    return EX.select_runs(runs, problems).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    """, m AS (SELECT seg, t % 86400 // 7200 * 7200 AS bucket, avg(speed) AS mean, count(*) AS samples FROM readings WHERE event_id % 3 = 0 GROUP BY 1, 2), g AS (SELECT c_custkey AS seg, 10.0 + c_custkey % 9 AS free_s, unnest(range(0, 86400, 7200)) AS bucket FROM customer)
    SELECT g.seg, g.bucket, round(coalesce(mean, free_s) + 1e-9, 5) AS travel_time, coalesce(samples, 0) AS samples FROM g LEFT JOIN m USING (seg, bucket)""",
    "readings",
)
def typical_times(spark, d):
    controls = L.readings(spark, d).filter("event_id % 3 = 0").select("seg", F.expr("t % 86400 div 7200 * 7200").alias("bucket"), F.col("speed").alias("travel_time"))
    roads = L.table(spark, d, "customer").select(F.col("c_custkey").alias("seg"), (10.0 + F.col("c_custkey") % 9).alias("free_s"))
    return nudged(EX.typical_times(controls, roads, 7200), "travel_time")


@query(
    """, f AS (SELECT l_suppkey AS seg, l_linenumber * 10 AS h, l_partkey % 31 = 0 AS shifted, CASE l_partkey % 5 WHEN 0 THEN 'closed' WHEN 1 THEN 'restricted' WHEN 2 THEN 'shut' ELSE 'open' END AS a, l_partkey % 10 < 5 AS part, CASE l_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'representative_road' ELSE 'model' END AS src, CASE WHEN l_quantity > 3 THEN l_quantity - 5 END AS tt, l_suppkey + 5 AS rep FROM lineitem),
    k AS (SELECT s_suppkey AS seg FROM supplier WHERE s_suppkey % 9 > 0), n AS (SELECT count(*) AS all_rows, count(*) FILTER (WHERE h > 60) AS hz, count(*) - count(DISTINCT (seg, h)) AS rep_keys, count(*) FILTER (WHERE shifted) AS iv, count(*) FILTER (WHERE a = 'shut') AS av, count(*) FILTER (WHERE seg NOT IN (SELECT seg FROM k)) AS un,
    count(*) FILTER (WHERE (a = 'open' OR a = 'restricted' AND part) AND src <> 'none' AND NOT coalesce(tt > 0, false)) AS tm, count(*) FILTER (WHERE src = 'representative_road' AND rep NOT IN (SELECT seg FROM k)) AS ou FROM f),
    e AS (SELECT count(*) AS n FROM closures WHERE end_s IS NULL OR end_s <= start_s) SELECT problem, rows FROM (SELECT unnest([{'problem': 'unknown_horizon', 'rows': hz}, {'problem': 'repeated_key', 'rows': rep_keys}, {'problem': 'wrong_interval', 'rows': iv}, {'problem': 'unknown_availability', 'rows': av}, {'problem': 'unknown_road', 'rows': un},
    {'problem': 'no_travel_time', 'rows': tm}, {'problem': 'outside_representative', 'rows': ou}, {'problem': 'empty_closure', 'rows': (SELECT n FROM e)}], recursive := true) FROM n) WHERE rows > 0""",
    "closures",
)
def map_problems(spark, d):
    p, h = F.col("l_partkey"), F.col("l_linenumber").cast("long") * 10
    begin = 1_700_000_000 + h * 60 - 600 + F.when(p % 31 == 0, 60).otherwise(0)
    state = F.when(p % 5 == 0, "closed").when(p % 5 == 1, "restricted").when(p % 5 == 2, "shut").otherwise("open")
    source = F.when(F.col("l_orderkey") % 4 == 0, "none").when(F.col("l_orderkey") % 4 == 1, "representative_road").otherwise("model")
    forecast = L.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("seg"), h.alias("horizon_min"), F.lit(1_700_000_000).cast("long").alias("issued_s"), begin.alias("from_s"), (begin + 600).alias("to_s"), F.lit("m1").alias("model"), F.lit("n1").alias("network"), state.alias("availability"),
        F.when(p % 10 < 5, EX.PARTIAL).alias("restriction"), source.alias("source"), F.when(F.col("l_quantity") > 3, F.col("l_quantity").cast("double") - 5).alias("travel_time"), (F.col("l_suppkey") + 5).alias("represented_by"),
    )
    roads = L.table(spark, d, "supplier").filter("s_suppkey % 9 > 0").select(F.col("s_suppkey").alias("seg"))
    closures = L.closures(spark, d).select(F.col("start_s").alias("begin_s"), "end_s")
    return EX.map_problems(forecast, roads, closures, "n1")


@query(
    """, c AS (SELECT seg, bucket, max((least(end_s, bucket + 43200) - greatest(start_s, bucket)) / 43200.0) AS cover FROM (SELECT seg, start_s, end_s, unnest(range(start_s // 43200, (end_s - 1) // 43200 + 1)) * 43200 AS bucket FROM closures WHERE end_s > start_s) GROUP BY 1, 2),
    r AS (SELECT c_custkey AS seg, c_custkey % 150 AS by_ FROM customer WHERE c_custkey % 4 > 0) SELECT seg, bucket, round(max(cover), 4) AS cover FROM (SELECT * FROM c UNION ALL SELECT r.seg, c.bucket, c.cover FROM r JOIN c ON c.seg = r.by_) GROUP BY 1, 2""",
    "closures",
)
def cover_by_representatives(spark, d):
    k = F.col("c_custkey")
    represented = L.table(spark, d, "customer").select(k.alias("seg"), F.when(k % 4 > 0, k % 150).alias("represented_by"))
    return EX.cover_by_representatives(J.closure_cover(L.closures(spark, d), 43_200), represented).withColumn("cover", F.round("cover", 4))


@query(
    """, v AS (SELECT l_orderkey AS vehicle, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS j, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS s FROM lineitem),
    f AS (SELECT vehicle * 100 + j AS id, vehicle, CASE WHEN l_partkey % 10 > 0 THEN l_partkey % 10 > 1 END AS line, j * 60 AS t, plon + 0.0004 * (j - (j % 4 = 0)::INT) AS lon, plat + 0.00002 AS lat, CASE WHEN l_partkey % 3 > 0 THEN 90.0 END AS bearing FROM v JOIN places ON place_id = s),
    m AS (SELECT *, lag(line) OVER w AS pline, lag(t) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM f WINDOW w AS (PARTITION BY vehicle ORDER BY t, id)),
    h AS (SELECT *, """ + HAV.format(a="p", b="") + """ AS hop FROM m WHERE line = pline),
    g AS (SELECT id, vehicle, t, hop / (t - pt) AS mps, CASE WHEN hop >= 5 THEN (plon + lon) / 2 ELSE lon END AS x, lat AS y, CASE WHEN hop >= 5 THEN 90.0 ELSE bearing END AS way, 111320.0 * cos(radians(lat)) AS k FROM h),
    n AS (SELECT id, vehicle, t, mps, place_id, (plon - x) * k AS px, (plat - y) * 111132.0 AS py, 0.004 * k AS dx FROM g JOIN places ON abs(plat - y) < 0.0003 AND place_id % 2 = 0 WHERE way IS NOT NULL),
    b AS (SELECT *, sqrt(pow(px + greatest(0, least(1, -px / dx)) * dx, 2) + pow(py, 2)) AS metres FROM n)
    SELECT id, vehicle, place_id AS seg, t, round(mps, 3) AS mps FROM b WHERE metres <= 20 QUALIFY row_number() OVER (PARTITION BY id ORDER BY metres, place_id) = 1""",
    "places",
)
def service_speeds(spark, d):
    l = L.table(spark, d, "lineitem")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    v = l.select(F.col("l_orderkey").alias("vehicle"), "l_partkey", j.alias("j"), F.min("l_suppkey").over(Window.partitionBy("l_orderkey")).alias("place_id")).join(L.places(spark, d), "place_id")
    p = F.col("l_partkey")
    fixes = v.select(
        (F.col("vehicle") * 100 + F.col("j")).alias("id"), "vehicle", F.when(p % 10 > 0, p % 10 > 1).alias("line"), (F.col("j") * 60).alias("t"), (F.col("plon") + 0.0004 * (F.col("j") - (F.col("j") % 4 == 0).cast("int"))).alias("lon"), (F.col("plat") + 0.00002).alias("lat"), F.when(p % 3 > 0, 90.0).alias("bearing"),
    )
    k = F.col("place_id")
    ends = F.array(F.array("plon", "plat"), F.array(F.when(k % 2 == 0, F.col("plon") + 0.004).otherwise(F.col("plon")), F.when(k % 2 == 0, F.col("plat")).otherwise(F.col("plat") + 0.003)))
    pieces = LN.pieces_of(L.places(spark, d).select(k.alias("owner"), ends.alias("coords")))
    return LN.service_speeds(fixes, pieces).withColumn("mps", F.round("mps", 3))


@query(
    """, p AS (SELECT event_id, lon + (event_id % 7) * 0.0005 AS x, lat + 0.0002 AS y, 111320.0 * cos(radians(lat + 0.0002)) AS k FROM points), n AS (SELECT event_id, place_id, (x - plon) * k / (0.004 * k) AS t, (plon - x) * k AS px, (plat - y) * 111132.0 AS py, 0.004 * k AS dx FROM p JOIN places ON abs(plat - y) < 0.002),
    m AS (SELECT event_id, place_id, greatest(0, least(1, t)) AS t, sqrt(pow(px + greatest(0, least(1, t)) * dx, 2) + py * py) AS m FROM n), b AS (SELECT event_id, place_id, m, t FROM m WHERE m <= 150 UNION ALL SELECT event_id, place_id + 1000000, m, 1 - t FROM m WHERE m <= 150)
    SELECT event_id AS point, place_id AS owner, round(m, 3) AS metres, round(t + 1e-9, 5) AS share FROM b QUALIFY round(m, 6) <= round(min(m) OVER (PARTITION BY event_id), 6) + 3""",
    "points", "places",
)
def snap_ends(spark, d):
    """Each place has a street to the east, and the way back."""
    k = F.col("place_id")
    here, there = F.array("plon", "plat"), F.array(F.col("plon") + 0.004, F.col("plat"))
    p = L.places(spark, d)
    roads = p.select(k.alias("owner"), F.array(here, there).alias("coords")).unionByName(p.select((k + 1_000_000).alias("owner"), F.array(there, here).alias("coords")))
    e = F.col("event_id")
    points = L.points(spark, d).select(e.alias("point"), (F.col("lon") + e % 7 * 0.0005).alias("lon"), (F.col("lat") + 0.0002).alias("lat"))
    out = LN.snap_ends(points, LN.pieces_of(roads), 150.0)
    return nudged(out.withColumn("metres", F.round("metres", 3)), "share").drop("rank")
