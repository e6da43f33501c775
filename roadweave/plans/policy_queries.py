"""Registered queries of quantiles, choices under load by road and time, and requests with stops; added to those of plans.queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadweave.operators import matching as M
from roadweave.operators import pressure as PR
from roadweave.operators import quantiles as QT
from roadweave.plans import lenses as L
from roadweave.plans.detail_queries import nudged
from roadweave.plans.queries import NEAREST, doubles, query, r4
from roadweave.plans.queries import requests as od_requests

ERROR = 0.01
STEP = math.log((1 + ERROR) / (1 - ERROR))


@query(
    f"""SELECT o_orderpriority AS policy, count(*) AS values, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.999), 4) AS p999
    FROM (SELECT o_orderpriority, o_totalprice - 150000.0 AS x FROM orders) GROUP BY 1"""
)
def exact_quantiles(spark, d):
    o = L.table(spark, d, "orders")
    out = QT.exact_quantiles(o.withColumnRenamed("o_orderpriority", "policy"), ["policy"], F.col("o_totalprice") - 150000.0, {"median": 0.5, "p95": 0.95, "p999": 0.999}, ERROR)
    return out.withColumns({c: r4(c) for c in ("median", "p95", "p999")})


@query(
    f"""WITH v AS (SELECT o_orderpriority AS policy, o_totalprice - 150000.0 AS x FROM orders), c AS (SELECT policy, CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / {STEP!r}) + 1048576) END::BIGINT AS cell, count(*) AS n FROM v GROUP BY 1, 2),
    s AS (SELECT *, sum(n) OVER (PARTITION BY policy ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY policy) AS values FROM c), r AS (SELECT policy, max(values)::BIGINT AS values, min(cell) FILTER (WHERE upto >= ceil(values * 0.5)) AS a, min(cell) FILTER (WHERE upto >= ceil(values * 0.95)) AS b FROM s GROUP BY 1)
    SELECT policy, values, round(sign(a) * exp((abs(a) - 1048576) * {STEP!r}) * {1 - ERROR!r}, 4) AS median, round(sign(b) * exp((abs(b) - 1048576) * {STEP!r}) * {1 - ERROR!r}, 4) AS p95 FROM r"""
)
def sketch_quantiles(spark, d):
    o = L.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "policy")
    days = [QT.quantile_sketch(o.filter(F.col("o_orderkey") % 2 == k), ["policy"], F.col("o_totalprice") - 150000.0, ERROR) for k in (0, 1)]
    return QT.sketch_quantiles(QT.merged(*days), ["policy"], {"median": 0.5, "p95": 0.95}, ERROR).withColumns({c: r4(c) for c in ("median", "p95")})


def choices(spark, d):
    """A request for each order, on its day, with a candidate for each of its lines; a part of the lines isn't allowed. Times are rounded as DuckDB
    does it, as a double times 100: Spark rounds the decimal that a double is written as, which is another hundredth where that ends in 5."""
    l = L.table(spark, d, "lineitem").join(L.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    eta = F.round(F.col("l_extendedprice") / 100 * 100) / 100
    return l.select(F.to_date("o_orderdate").alias("batch"), F.col("l_orderkey").alias("request"), F.col("o_custkey").alias("place"), F.col("l_linenumber").cast("long").alias("candidate"), eta.alias("eta"), (F.col("l_quantity") < 45).alias("allowed"))


def pressed(spark, d):
    """A candidate enters its line's supplier and part as roads, when the order starts and half an hour later."""
    l = L.table(spark, d, "lineitem")
    at = L.seconds("l_shipdate") + F.col("l_partkey") % 40 * 60
    roads = F.explode(F.array(F.struct(F.col("l_suppkey").alias("seg"), at.alias("entry_s")), F.struct((F.col("l_partkey") % 500 + 100_000).alias("seg"), (at + 1800).alias("entry_s"))))
    e = l.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").cast("long").alias("candidate"), roads.alias("x")).select("request", "candidate", "x.*")
    return PR.timed_cells(e, "request", "candidate", kernel=(0.25, 0.5, 0.25))


def ledger(spark, d):
    """What is under way: every third order's lines enter their suppliers."""
    t = L.table(spark, d, "lineitem").filter("l_orderkey % 3 = 0")
    entries = t.select(F.col("l_suppkey").alias("seg"), (L.seconds("l_shipdate") + F.col("l_partkey") % 40 * 60).alias("entry_s"))
    return PR.timed_cells(entries, kernel=(0.25, 0.5, 0.25)).withColumnRenamed("share", "load")


def weighed(spark, d):
    p = L.table(spark, d, "part").select((F.col("p_partkey") % 500 + 100_000).alias("seg")).distinct()
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg"))
    k = F.col("seg")
    roads = s.unionByName(p).select("seg", F.when(k % 5 > 0, (k % 4).cast("double")).alias("lanes"), (20.0 + k % 50).alias("free_s"))
    return PR.road_weights(roads, F.lit(6.0), F.lit(2.0), F.when(k % 3 == 0, 2.0).otherwise(1.0), 30.0)


PRESSED = """kernel(j, w) AS (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)), e AS (SELECT l_orderkey AS request, l_linenumber::BIGINT AS candidate, l_suppkey AS seg, floor(epoch(l_shipdate))::BIGINT + l_partkey % 40 * 60 AS entry_s FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber::BIGINT, l_partkey % 500 + 100000, floor(epoch(l_shipdate))::BIGINT + l_partkey % 40 * 60 + 1800 FROM lineitem), cells AS (SELECT request, candidate, seg, entry_s // 300 + j AS bin, sum(w) AS share FROM e, kernel GROUP BY ALL),
    ledger AS (SELECT l_suppkey AS seg, (floor(epoch(l_shipdate))::BIGINT + l_partkey % 40 * 60) // 300 + j AS bin, sum(w) AS load FROM lineitem, kernel WHERE l_orderkey % 3 = 0 GROUP BY ALL),
    segs AS (SELECT s_suppkey AS seg FROM supplier UNION ALL SELECT DISTINCT p_partkey % 500 + 100000 FROM part), roads AS (SELECT seg, CASE WHEN seg % 3 = 0 THEN 2.0 ELSE 1.0 END * (20 + seg % 50) / 30 / pow(CASE WHEN seg % 5 > 0 AND seg % 4 > 0 THEN seg % 4 ELSE 2 END * 6.0, 2) AS coef FROM segs),
    grown AS (SELECT request, candidate, sum(coalesce(coef, 0) * share * (2 * coalesce(load, 0) + share)) AS growth FROM cells LEFT JOIN ledger USING (seg, bin) LEFT JOIN roads USING (seg) GROUP BY ALL),
    c AS (SELECT l_orderkey AS request, l_linenumber::BIGINT AS candidate, round(l_extendedprice / 100, 2)::DOUBLE AS eta, l_quantity < 45 AS allowed FROM lineitem)"""


@query(
    f"""WITH {PRESSED}, k AS (SELECT request, candidate, eta, growth, CASE WHEN allowed THEN eta + 60.0 * growth END AS cost FROM c LEFT JOIN grown USING (request, candidate)), m AS (SELECT *, min(cost) OVER (PARTITION BY request) AS least FROM k),
    n AS (SELECT *, coalesce(cost <= least + 0.5, false) AS near FROM m), b AS (SELECT *, near AND row_number() OVER (PARTITION BY request ORDER BY near DESC, sha1('7|' || request || '|' || candidate), candidate, eta) = 1 AS best, count(*) FILTER (WHERE near) OVER (PARTITION BY request) > 1 AS tied,
    rank() OVER (PARTITION BY request ORDER BY cost IS NULL, eta, candidate) = 1 AS quickest FROM n) SELECT request, candidate, round(growth + 1e-9, 5) AS growth, best, CASE WHEN best THEN CASE WHEN quickest THEN 'fastest_candidate' ELSE 'lower_concentration_within_detour_bound' END || CASE WHEN tied THEN ',seeded_tie_break' ELSE '' END END AS reason FROM b"""
)
def score_timed(spark, d):
    out = PR.score_timed(choices(spark, d), pressed(spark, d), ledger(spark, d), weighed(spark, d), 60.0, seed=7)
    return nudged(out.select("request", "candidate", "growth", "best", "reason"), "growth")


@query(
    f"""WITH {PRESSED}, chosen AS (SELECT request, min(candidate) AS candidate FROM c WHERE allowed GROUP BY 1), plan AS (SELECT o_orderdate::DATE AS batch, seg, bin, sum(share) AS share FROM chosen JOIN cells USING (request, candidate) JOIN orders ON request = o_orderkey GROUP BY ALL)
    SELECT batch, round(sum(coalesce(coef, 0) * share * (2 * coalesce(load, 0) + share)) + 1e-9, 5) AS growth FROM plan LEFT JOIN ledger USING (seg, bin) LEFT JOIN roads USING (seg) GROUP BY 1"""
)
def plan_growth(spark, d):
    first = choices(spark, d).filter("allowed").groupBy("batch", "request").agg(F.min("candidate").alias("candidate"))
    plan = pressed(spark, d).join(first, ["request", "candidate"])
    return nudged(PR.growth(plan, ledger(spark, d), weighed(spark, d), "batch"), "growth")


@query()
def assign_timed(spark, d):
    """Ordered by nature, so without SQL: tests hold it against a plain loop over each batch."""
    return PR.assign_timed(choices(spark, d), pressed(spark, d), ledger(spark, d), weighed(spark, d), 60.0, seed=7)


def stop_requests(spark, d):
    """Every fourth request stops on its way."""
    k = F.col("request")
    lon, lat = F.lit(-122.53) + F.pmod(k * 7, F.lit(179)) / 1000.0, F.lit(37.69) + F.pmod(k * 23, F.lit(149)) / 1000.0
    return od_requests(spark, d).withColumns({"s_lon": F.when(k % 4 == 0, lon), "s_lat": F.when(k % 4 == 0, lat)})


SNAPPED = """, q AS (SELECT o_orderkey AS request, -122.53 + ((o_custkey * 13) % 179) / 1000.0 AS o_lon, 37.69 + ((o_custkey * 29) % 149) / 1000.0 AS o_lat, -122.53 + ((o_orderkey * 17) % 179) / 1000.0 AS d_lon, 37.69 + ((o_orderkey * 11) % 149) / 1000.0 AS d_lat FROM orders),
    o AS (SELECT request, o_lon AS lon, o_lat AS lat FROM q), dd AS (SELECT request, d_lon AS lon, d_lat AS lat FROM q), ss AS (SELECT o_orderkey AS request, -122.53 + ((o_orderkey * 7) % 179) / 1000.0 AS lon, 37.69 + ((o_orderkey * 23) % 149) / 1000.0 AS lat FROM orders WHERE o_orderkey % 4 = 0),
    a AS (""" + NEAREST.format(a="request", b="place_id", x="o", r=2000) + "), b AS (" + NEAREST.format(a="request", b="place_id", x="dd", r=2000) + "), c AS (" + NEAREST.format(a="request", b="place_id", x="ss", r=2000) + """),
    t AS (SELECT request, a.place_id AS origin, b.place_id AS dest, CASE WHEN c.place_id <> a.place_id AND c.place_id <> b.place_id THEN c.place_id END AS stop, a.m AS om, b.m AS dm,
    CASE WHEN coalesce(a.m, 1e9) > 1500 OR coalesce(b.m, 1e9) > 1500 THEN 'far' WHEN a.place_id = b.place_id THEN 'same_road' WHEN request % 4 = 0 AND coalesce(c.m, 1e9) > 1500 THEN 'far' ELSE 'ok' END AS outcome FROM q LEFT JOIN a USING (request) LEFT JOIN b USING (request) LEFT JOIN c USING (request))"""


@query(SNAPPED.lstrip() + " SELECT request, origin::DOUBLE AS origin, dest::DOUBLE AS dest, stop::DOUBLE AS stop, outcome FROM t", "places")
def snap_trips(spark, d):
    trips, _ = M.snap_trips(stop_requests(spark, d), L.places(spark, d), 1500.0, 2000.0)
    return doubles(trips.select("request", "origin", "dest", "stop", "outcome"), "origin", "dest", "stop")


@query(SNAPPED.lstrip() + " SELECT count(*) AS requests, count(*) FILTER (WHERE outcome = 'ok') AS trips, count(*) FILTER (WHERE outcome = 'far') AS far, count(*) FILTER (WHERE outcome = 'same_road') AS same_road, round((SELECT quantile_cont(m, 0.95) FROM (SELECT om AS m FROM t UNION ALL SELECT dm FROM t)), 3) AS p95_m FROM t", "places")
def snap_totals(spark, d):
    _, totals = M.snap_trips(stop_requests(spark, d), L.places(spark, d), 1500.0, 2000.0)
    return totals.withColumn("p95_m", F.round("p95_m", 3))


@query(
    """, c AS (SELECT route, pos, seg, arrive_s % 8640000 AS t FROM trips), p AS (SELECT seg % 100 AS seg, t % 8640000 AS t, max(speed) AS delay, CASE WHEN t % 8640000 % 5 > 0 THEN 'm' || (t % 8640000 % 3) END AS model FROM readings GROUP BY 1, 2),
    a AS (SELECT c.*, p.t AS t1, p.model AS m1 FROM c ASOF LEFT JOIN p ON c.seg = p.seg AND c.t >= p.t), b AS (SELECT a.*, p.t AS t2, p.model AS m2 FROM a ASOF LEFT JOIN p ON a.seg = p.seg AND a.t <= p.t),
    h AS (SELECT route, CASE WHEN t2 IS NULL OR t - t1 <= t2 - t THEN t - t1 ELSE t2 - t END AS gap, coalesce(CASE WHEN t2 IS NULL OR t - t1 <= t2 - t THEN m1 ELSE m2 END, '?') AS m FROM b)
    SELECT route, string_agg(DISTINCT m, ',' ORDER BY m) FILTER (WHERE gap <= 86400) AS models FROM h GROUP BY route""",
    "trips", "readings",
)
def forecast_models(spark, d):
    cells = L.trips(spark, d).select("route", "pos", "seg", (F.col("arrive_s") % 8_640_000).alias("t"))
    preds = L.readings(spark, d).groupBy((F.col("seg") % 100).alias("seg"), (F.col("t") % 8_640_000).alias("t")).agg(F.max("speed").alias("delay"))
    preds = preds.withColumn("model", F.when(F.col("t") % 5 > 0, F.concat(F.lit("m"), (F.col("t") % 3).cast("string"))))
    return M.nearest_forecast(cells, preds, 86_400).select("route", "models")
