"""Registered queries of readings, events, lines, evaluation, policies and quality checks; added to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.functions import events as EV
from roadweave.functions import scalars as S
from roadweave.operators import evaluation as E
from roadweave.operators import graph as G
from roadweave.operators import joins as J
from roadweave.operators import policy as P
from roadweave.operators import quality as Q
from roadweave.operators import readings as R
from roadweave.operators import windows as W
from roadweave.plans import lenses as L
from roadweave.plans.queries import HAV, doubles, query, r4
from roadweave.sources import normalizers as N
from roadweave.streaming import jobs


def lines(spark, d):
    """Readings of tile lines: users as lines, clicks as relative and purchases and views as absolute readings."""
    e = L.table(spark, d, "events").filter("event_type in ('click', 'purchase', 'view')")
    style = F.when(F.col("event_type") == "click", "relative").otherwise("absolute")
    value = F.when(style == "relative", (F.col("event_id") % 20) / 20.0).otherwise(F.col("value") / 2)
    return e.select(F.col("user_id").alias("key"), L.seconds("ts").alias("t"), style.alias("style"), value.alias("value"), (F.col("event_id") % 23 == 0).alias("closed"), "event_id")


LINES = """lines AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS t, CASE event_type WHEN 'click' THEN 'relative' ELSE 'absolute' END AS style, CASE event_type WHEN 'click' THEN (event_id % 20) / 20.0 ELSE value / 2 END AS value, event_id % 23 = 0 AS closed FROM events WHERE event_type IN ('click', 'purchase', 'view')),
    rel AS (SELECT key, t, max(value) AS share FROM lines WHERE style = 'relative' GROUP BY 1, 2),
    abso AS (SELECT key, t, CASE WHEN closed THEN 0.0 ELSE value * 0.621371192 END AS mph, closed FROM lines WHERE style = 'absolute'),
    measured AS (SELECT a.key, a.t, mph, CASE WHEN NOT closed AND r.share >= 0.05 AND a.t - r.t <= 43200 THEN least(mph / r.share, 100.0) END AS free_flow FROM abso a ASOF LEFT JOIN rel r ON a.key = r.key AND a.t >= r.t WHERE mph BETWEEN 0 AND 100)"""
LINE_MAP = "line_map AS (SELECT k AS key, (k * 7 + j) % 60 AS seg, 20.0 + (k * 13 + j * 5) % 80 AS metres FROM (SELECT DISTINCT user_id FROM events) a(k), range(2) b(j))"


def line_map(spark, d):
    """Each line on two roads."""
    k = F.col("key")
    keys = L.table(spark, d, "events").select(F.col("user_id").alias("key")).distinct()
    return keys.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).select("key", ((k * 7 + F.col("j")) % 60).alias("seg"), (20.0 + (k * 13 + F.col("j") * 5) % 80).alias("metres"))


@query(f"WITH {LINES} SELECT key, t, round(mph, 4) AS mph, round(free_flow, 3) AS free_flow FROM measured")
def measured_lines(spark, d):
    return R.measured_lines(lines(spark, d)).select("key", "t", r4("mph").alias("mph"), F.round("free_flow", 3).alias("free_flow"))


@query(f"WITH {LINES}, {LINE_MAP}, x AS (SELECT seg, t // 86400 AS day, sum(free_flow * metres) / sum(metres) AS f FROM measured JOIN line_map USING (key) WHERE free_flow IS NOT NULL GROUP BY 1, 2) SELECT seg, round(arg_max(f, day) + 1e-9, 2) AS free_flow FROM x GROUP BY seg")
def latest_free_flow(spark, d):
    found = R.latest_free_flow(R.spread_lines(R.measured_lines(lines(spark, d)), line_map(spark, d)))
    return found.withColumn("free_flow", F.round(F.col("free_flow") + 1e-9, 2))


@query(
    f"""WITH {LINES}, {LINE_MAP}, last AS (SELECT seg, round(arg_max(f, day) + 1e-9, 2) AS last FROM (SELECT seg, t // 86400 AS day, sum(free_flow * metres) / sum(metres) AS f FROM measured JOIN line_map USING (key) WHERE free_flow IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    levels AS (SELECT user_id AS key, floor(epoch(ts))::BIGINT AS t, CASE WHEN event_id % 29 = 0 THEN 1.0 WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0.4 WHEN event_id % 5 = 2 THEN 0.65 WHEN event_id % 5 = 3 THEN 0.85 ELSE 0.1 END AS ratio FROM events WHERE event_type = 'signup'),
    rows AS (SELECT seg, 'flow' AS source, t, mph, free_flow, NULL::DOUBLE AS ratio, metres FROM measured JOIN line_map USING (key) UNION ALL SELECT seg, 'tiles', t, NULL, NULL, ratio, metres FROM levels JOIN line_map USING (key) WHERE ratio IS NOT NULL),
    b AS (SELECT t - t % 600 AS bucket, seg, source, sum(mph * metres) / sum(metres) FILTER (WHERE mph IS NOT NULL) AS speed, sum(free_flow * metres) / sum(metres) FILTER (WHERE free_flow IS NOT NULL) AS own, sum(ratio * metres) / sum(metres) FILTER (WHERE ratio IS NOT NULL) AS given FROM rows GROUP BY 1, 2, 3),
    f AS (SELECT b.*, coalesce(own, last, 25.0 + seg % 3 * 5) AS ff, coalesce(CASE WHEN speed IS NOT NULL AND coalesce(own, last, 25.0 + seg % 3 * 5) > 0 THEN greatest(0, least(1, 1 - speed / coalesce(own, last, 25.0 + seg % 3 * 5))) END, given) AS r FROM b LEFT JOIN last USING (seg))
    SELECT bucket, seg, source, round(speed + 1e-9, 2) AS speed, round(ff + 1e-9, 2) AS free_flow, round(CASE WHEN source = 'flow' AND speed > 0 THEN (100.0 + seg) / (speed * 0.44704) END + 1e-9, 1) AS travel_time, round(r + 1e-9, 4) AS ratio FROM f WHERE NOT (source = 'tiles' AND coalesce(r, 1.0) <= 0.1 + 1e-9)"""
)
def segment_facts(spark, d):
    segs = line_map(spark, d)
    level = F.when(F.col("event_id") % 5 == 1, "moderate").when(F.col("event_id") % 5 == 2, "heavy").when(F.col("event_id") % 5 == 3, "severe").when(F.col("event_id") % 5 == 4, "low")
    tiles = L.table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("key"), L.seconds("ts").alias("t"), level.alias("value"), (F.col("event_id") % 29 == 0).alias("closed"))
    flow = R.spread_lines(R.measured_lines(lines(spark, d)), segs)
    none = F.lit(None).cast("double")
    a = flow.select("seg", F.lit("flow").alias("source"), F.timestamp_seconds("t").alias("t"), "mph", "free_flow", none.alias("ratio"), F.col("metres").alias("weight"))
    b = R.spread_lines(R.level_lines(tiles), segs).select("seg", F.lit("tiles").alias("source"), F.timestamp_seconds("t").alias("t"), none.alias("mph"), none.alias("free_flow"), "ratio", F.col("metres").alias("weight"))
    roads = segs.select("seg").distinct().select("seg", (F.col("seg") + 100.0).alias("length"), (25.0 + F.col("seg") % 3 * 5).alias("fallback"))
    out = R.segment_facts(a.unionByName(b), roads, R.latest_free_flow(flow), ("flow",), ("tiles",))
    return out.withColumn("bucket", F.unix_timestamp("bucket"))


@query(
    """, p AS (SELECT route, pos // 3 AS t, CASE WHEN seg % 9 <> 0 THEN seg END AS seg, length AS metres, cost / 5000 AS seconds FROM trips), s AS (SELECT route, t, seg, sum(metres) AS m, sum(seconds) AS s FROM p WHERE seg IS NOT NULL GROUP BY 1, 2, 3)
    SELECT seg, t, round(m / s * 2.2369362920544, 4) AS mph, round(s, 6) AS weight FROM s WHERE m >= 0.5 * (20 + seg % 7) AND m / s * 2.2369362920544 <= 100""".lstrip(),
    "trips",
)
def probe_readings(spark, d):
    t = L.trips(spark, d)
    pieces = t.select("route", F.expr("pos div 3").alias("t"), F.when(F.col("seg") % 9 != 0, F.col("seg")).alias("seg"), F.col("length").alias("metres"), (F.col("cost") / 5000).alias("seconds"))
    lengths = t.select("seg").distinct().select("seg", (20 + F.col("seg") % 7).alias("length"))
    return R.probe_readings(pieces, lengths).select("seg", "t", r4("mph").alias("mph"), F.round("weight", 6).alias("weight"))


def newest(spark, d):
    r = L.readings(spark, d)
    return r.groupBy("seg", "source", (F.col("t") - F.col("t") % 600).alias("bucket")).agg(F.round(F.avg("speed"), 6).alias("speed"))


PRIORITY = "CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END"


@query(
    f""", b AS (SELECT seg, source, t - t % 600 AS bucket, round(avg(speed), 6) AS speed FROM readings GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY {PRIORITY}, bucket DESC) AS n FROM b WHERE {PRIORITY} IS NOT NULL)
    SELECT seg, source, bucket, round(speed, 4) AS speed FROM k WHERE n = 1""".lstrip(),
    "readings",
)
def best_by_priority(spark, d):
    return R.best_by_priority(newest(spark, d), ["purchase", "click", "view"], "seg").select("seg", "source", "bucket", r4("speed").alias("speed"))


@query(
    f""", f AS (SELECT bucket, seg, source, avg(1 - speed / 100) AS ratio FROM (SELECT t - t % 3600 AS bucket, seg, source, speed FROM readings) GROUP BY 1, 2, 3), g AS (SELECT * FROM f WHERE {PRIORITY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bucket, seg ORDER BY {PRIORITY}) = 1)
    SELECT b.bucket, r.seg, round(CASE WHEN ratio IS NOT NULL THEN (30.0 + r.seg % 20) * (1 - least(1, greatest(0, ratio))) END, 4) AS speed, ratio IS NOT NULL AS observed FROM (SELECT DISTINCT bucket FROM f) b CROSS JOIN (SELECT DISTINCT seg FROM readings) r LEFT JOIN g ON g.bucket = b.bucket AND g.seg = r.seg""".lstrip(),
    "readings",
)
def fused_history(spark, d):
    """All hours as one history."""
    r = L.readings(spark, d)
    facts = r.groupBy((F.col("t") - F.col("t") % 3600).alias("bucket"), "seg", "source").agg(F.avg(1 - F.col("speed") / 100).alias("ratio"))
    roads = r.select("seg").distinct().select("seg", (30.0 + F.col("seg") % 20).alias("free_flow"))
    return R.fused_history(facts, ["purchase", "click", "view"], roads, facts.select("bucket")).withColumn("speed", r4("speed"))


FACTS = ", facts AS (SELECT seg % 100 AS seg, source, t AS bucket, CASE WHEN t % 5 > 0 THEN speed END AS speed, CASE WHEN t % 3 > 0 THEN 30.0 + seg % 30 END AS free_flow, CASE WHEN t % 4 > 0 THEN least(1, greatest(0, 1 - speed / 60)) END AS ratio FROM readings QUALIFY row_number() OVER (PARTITION BY seg % 100 ORDER BY t DESC, event_id) = 1)"


def facts(spark, d):
    r = L.readings(spark, d)
    last = W.latest_per(r.withColumn("road", F.col("seg") % 100), ["road"], F.desc("t"), F.asc("event_id"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("speed") / 60))
    return last.select(F.col("road").alias("seg"), "source", F.col("t").alias("bucket"), F.when(F.col("t") % 5 > 0, F.col("speed")).alias("speed"), F.when(F.col("t") % 3 > 0, 30.0 + F.col("seg") % 30).alias("free_flow"), F.when(F.col("t") % 4 > 0, ratio).alias("ratio"))


@query(
    FACTS + """, c AS (SELECT t.route, t.length * 10 AS length, f.*, coalesce(free_flow, 25.0) AS free, greatest(coalesce(speed, coalesce(free_flow, 25.0) * (1 - ratio)), 3.0) AS seen, f.seg IS NOT NULL AND coalesce(speed, ratio) IS NOT NULL AS known FROM trips t LEFT JOIN facts f ON f.seg = t.seg)
    SELECT route, round_even(coalesce(sum(greatest(0, length / (seen * 0.44704) - length / (free * 0.44704))) FILTER (WHERE known), 0), 0)::BIGINT AS delay_s, count_if(known AND coalesce(ratio, 0) >= 0.5)::BIGINT AS slow,
    round(coalesce(sum(length) FILTER (WHERE known), 0) / sum(length) + 1e-9, 6) AS coverage, (max(bucket) FILTER (WHERE known))::DOUBLE AS as_of, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE known), '') AS sources FROM c GROUP BY route""",
    "trips", "readings",
)
def route_traffic(spark, d):
    cells = L.trips(spark, d).select("route", "seg", (F.col("length") * 10).alias("length"))
    out = R.route_traffic(cells, facts(spark, d)).withColumn("coverage", F.round(F.col("coverage") + 1e-9, 6))
    return doubles(out, "as_of")


@query(
    FACTS + """, c AS (SELECT route, 'S' || t.seg % 4 AS name, sum(t.length) AS length FROM trips t JOIN facts f ON f.seg = t.seg WHERE ratio >= 0.5 GROUP BY 1, 2) SELECT route, name, length, (row_number() OVER (PARTITION BY route ORDER BY length DESC, name))::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY route ORDER BY length DESC, name) <= 3""",
    "trips", "readings",
)
def slow_streets(spark, d):
    cells = L.trips(spark, d).join(facts(spark, d).select("seg", "ratio"), "seg").select("route", F.concat(F.lit("S"), (F.col("seg") % 4).cast("string")).alias("name"), "length", "ratio")
    return R.slow_streets(cells)


@query("SELECT event_id FROM readings r JOIN (SELECT source, max(t - t % 600) + 600 AS nxt FROM readings WHERE t < 1705000000 GROUP BY source) m USING (source) WHERE t - t % 600 + 900 <= 1706000000 AND t - t % 600 >= nxt", "readings")
def unwritten_buckets(spark, d):
    r = L.readings(spark, d)
    marks = R.first_unwritten(r.filter(F.col("t") < 1_705_000_000).select("source", S.bucket10(F.col("ts")).alias("bucket")))
    return R.unwritten(r.select("event_id", "source", F.col("ts").alias("t")), marks, F.lit(1_706_000_000)).select("event_id")


@query(
    """, s AS (SELECT seg, t, CASE WHEN speed < 60 THEN speed / 3 END AS speed, CASE WHEN speed >= 40 THEN (seg % 5) / 5.0 END AS level FROM spine), f AS (SELECT seg, t, last_value(speed IGNORE NULLS) OVER (PARTITION BY seg ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v, last_value(level IGNORE NULLS) OVER (PARTITION BY seg ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM s)
    SELECT seg, t, round(least(CASE WHEN v IS NOT NULL THEN 200.0 / greatest(v, 0.5) WHEN l IS NOT NULL THEN 200.0 / greatest((10.0 + seg % 7) * (1 - l), 0.5) ELSE 200.0 / (10.0 + seg % 7) END, 1800), 4) AS seconds, CASE WHEN v IS NOT NULL THEN 0 WHEN l IS NOT NULL THEN 1 ELSE 2 END AS basis FROM f""".lstrip(),
    "readings", "buckets", "spine",
)
def persistence_times(spark, d):
    from roadweave.plans.queries import spine

    s = spine(spark, d).select("seg", "t", F.when(F.col("speed") < 60, F.col("speed") / 3).alias("speed"), F.when(F.col("speed") >= 40, (F.col("seg") % 5) / 5.0).alias("level"), F.lit(200.0).alias("length"), (10.0 + F.col("seg") % 7).alias("free_flow"))
    return W.persistence_times(s, "seg", "t").select("seg", "t", r4("seconds").alias("seconds"), "basis")


@query(
    """, a AS (SELECT seg AS key, event_id AS id, t, speed AS value FROM readings WHERE source = 'click'), r AS (SELECT seg AS key, event_id AS id, t, (event_id % 20) / 20.0 AS value FROM readings WHERE source = 'view'),
    n AS (SELECT a.key, a.value / r.value AS x FROM a JOIN r ON a.key = r.key AND abs(a.t - r.t) <= 3600 WHERE true QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(a.t - r.t), r.id) = 1 AND r.value >= 0.05) SELECT key, round(quantile_cont(x, 0.5) + 1e-7, 4) AS free_flow, count(*) AS samples FROM n GROUP BY key""".lstrip(),
    "readings",
)
def line_free_flow(spark, d):
    r = L.readings(spark, d)
    side = lambda s, v: r.filter(F.col("source") == s).select(F.col("seg").alias("key"), F.col("event_id").alias("id"), "t", v.alias("value"))
    out = R.line_free_flow(side("click", F.col("speed")), side("view", (F.col("event_id") % 20) / 20.0), 3600)
    return out.withColumn("free_flow", r4(F.col("free_flow") + 1e-7))


@query("SELECT seg, source, t, round(speed, 4) AS speed FROM readings WHERE t <= 1705500000 AND t > 1705500000 - 43200 QUALIFY row_number() OVER (PARTITION BY seg, source ORDER BY t DESC, event_id) = 1", "readings")
def newest_within(spark, d):
    return W.newest_within(L.readings(spark, d), ["seg", "source"], "t", F.lit(1_705_500_000), 43_200, F.asc("event_id")).select("seg", "source", "t", r4("speed").alias("speed"))


@query("SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) <= 500")
def capped_by_class(spark, d):
    return W.capped_by_class(L.table(spark, d, "orders"), "o_orderstatus", 500, F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_orderstatus", "o_orderkey")


# Events


def venues(spark, d):
    """Events of the table as public events: start, end, size, category."""
    e, k = L.points(spark, d), F.col("event_id")
    category = F.when(F.col("event_type") == "purchase", "concert").when(F.col("event_type") == "click", "sports").when(F.col("event_type") == "view", "community").otherwise("other")
    return e.select(k.alias("event"), F.col("lon").alias("plon"), F.col("lat").alias("plat"), (F.col("t") % 86_400).alias("start_s"), F.when(k % 5 != 0, F.col("t") % 86_400 + (k % 7 + 1) * 3600).alias("end_s"), (k % 11 == 0).alias("all_day"), category.alias("category"), (k % 40_000).alias("attendance"), F.lit(None).cast("long").alias("capacity"))


VENUES = """, ev AS (SELECT event_id AS event, lon, lat, t % 86400 AS s, CASE WHEN event_id % 5 <> 0 THEN t % 86400 + (event_id % 7 + 1) * 3600 END AS e, event_id % 11 = 0 AS all_day, CASE event_type WHEN 'purchase' THEN 'concert' WHEN 'click' THEN 'sports' WHEN 'view' THEN 'community' ELSE 'other' END AS category, event_id % 40000 AS attendance FROM points),
    w AS (SELECT *, all_day OR coalesce(e - s >= 18000, false) AS whole, CASE WHEN attendance <> 0 THEN attendance ELSE 3000.0 END * CASE category WHEN 'community' THEN 0.9 WHEN 'other' THEN 0.7 ELSE 1.0 END AS crowd, coalesce(e, s + CASE WHEN category IN ('concert', 'sports') THEN 10800 ELSE 7200 END) AS e2 FROM ev),
    win AS (SELECT event, lon, lat, whole, CASE WHEN crowd >= 15000 THEN 'high' WHEN crowd >= 5000 THEN 'medium' ELSE 'low' END AS impact, CASE WHEN whole THEN s ELSE s - 5400 END AS a1, CASE WHEN whole THEN coalesce(e, s + 21600) ELSE s + 900 END AS b1, CASE WHEN NOT whole THEN e2 - 900 END AS a2, CASE WHEN NOT whole THEN e2 + 3600 END AS b2 FROM w)"""


@query(VENUES.lstrip(", ").join(["WITH " + L.SQL["points"] + ", ", " SELECT event, impact, a1::DOUBLE AS from_1, b1::DOUBLE AS to_1, a2::DOUBLE AS from_2, b2::DOUBLE AS to_2 FROM win"]))
def crowd_windows(spark, d):
    v = venues(spark, d)
    tier = EV.event_tier(EV.event_crowd(F.col("attendance"), F.col("capacity"), F.col("category")))
    w = v.select("event", tier.alias("impact"), EV.crowd_windows(F.col("start_s"), F.col("end_s"), F.col("all_day"), F.col("category")).alias("w"))
    return w.select("event", "impact", *(F.get("w", k)[c].alias(f"{n}_{k + 1}") for k in (0, 1) for c, n in (("a", "from"), ("b", "to"))))


PLANAR = "sqrt(pow((v.lon - w.lon) * 111320 * cos(radians((v.lat + w.lat) / 2)), 2) + pow((v.lat - w.lat) * 111132, 2))"


@query(
    f"""WITH {L.SQL["points"]}, {L.SQL["places"]} {VENUES}, v AS (SELECT s_nationkey AS route, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY s_nationkey) - 1 AS last, plon AS lon, plat AS lat, s_nationkey * 3000 AS depart FROM places JOIN supplier ON s_suppkey = place_id),
    n AS (SELECT route, event, min(m) AS metres, arg_min(pos, {{'m': m, 'p': pos}}) AS pos, any_value(last) AS last, any_value(depart) AS depart FROM (SELECT route, event, pos, last, depart, {PLANAR} AS m FROM v JOIN win w ON abs(v.lat - w.lat) < 0.0066 AND abs(v.lon - w.lon) < 0.009) WHERE m < 704 GROUP BY 1, 2),
    p AS (SELECT n.*, impact, depart + 7200.0 * pos / greatest(1, last) AS t, a1, b1, a2, b2 FROM n JOIN win USING (event)),
    g AS (SELECT *, CASE WHEN t BETWEEN a1 AND b1 THEN 0 ELSE least(abs(t - a1), abs(t - b1)) END AS g1, CASE WHEN a2 IS NULL THEN NULL WHEN t BETWEEN a2 AND b2 THEN 0 ELSE least(abs(t - a2), abs(t - b2)) END AS g2 FROM p),
    h AS (SELECT *, CASE impact WHEN 'high' THEN 600.0 WHEN 'medium' THEN 300.0 ELSE 120.0 END * greatest(0, least(1, (700 - metres) / 500)) * greatest(0, 1 - least(g1, coalesce(g2, g1)) / 1800.0) AS d FROM g)
    SELECT route, event, round(metres, 3) AS metres, round_even(d, 0)::BIGINT AS delay_s, impact, CASE WHEN g2 IS NULL THEN 'out' WHEN g1 <= g2 THEN 'arriving' ELSE 'leaving' END AS crowd, (row_number() OVER (PARTITION BY route ORDER BY round_even(d, 0) DESC, event))::INT AS rank FROM h WHERE d >= 30"""
)
def events_on_route(spark, d):
    s = L.places(spark, d).join(L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_nationkey").alias("route")), "place_id")
    w = W.Window.partitionBy("route")
    v = s.select("route", (F.row_number().over(w.orderBy("place_id")) - 1).alias("pos"), (F.count("*").over(w) - 1).alias("last"), F.col("plon").alias("lon"), F.col("plat").alias("lat"), (F.col("route") * 3000).alias("depart_s"), F.lit(7200.0).alias("duration_s"))
    return J.events_on_route(v, venues(spark, d)).withColumn("metres", F.round("metres", 3))


@query(
    """, p AS (SELECT lon, lat, sum(1 + event_id % 3) AS w FROM points GROUP BY 1, 2), n AS (SELECT a.lon, a.lat, b.w, sqrt(pow((a.lon - b.lon) * 111320 * cos(radians((a.lat + b.lat) / 2)), 2) + pow((a.lat - b.lat) * 111320, 2)) / 900 AS x FROM p a JOIN p b ON abs(a.lat - b.lat) < 0.0085 AND abs(a.lon - b.lon) < 0.011),
    d AS (SELECT lon, lat, sum(w * pow(1 - x * x, 2)) AS density FROM n WHERE x < 1 GROUP BY 1, 2) SELECT event_id AS id, round(density, 3) AS density, round(pow(least(1, density / (SELECT greatest(max(density), 4) FROM d)), 0.75), 5) AS level FROM points JOIN d USING (lon, lat)""".lstrip(),
    "points",
)
def event_heat(spark, d):
    p = L.points(spark, d).select(F.col("event_id").alias("id"), "lon", "lat", (1 + F.col("event_id") % 3).alias("w"))
    return J.event_heat(p, 900.0).withColumn("density", F.round("density", 3)).withColumn("level", F.round("level", 5))


@query(
    """SELECT p_partkey, CASE WHEN lower(p_brand) = 'none' THEN 'x' WHEN regexp_matches(n, '\\bmusic\\b|concert|symphony|opera|\\bjazz\\b|\\bdj\\b') THEN 'music' WHEN regexp_matches(n, '\\bsports?\\b|\\bgame\\b|tournament|marathon|\\brace\\b|\\bbike\\b|\\b\\d+k\\b|cornhole|giants|warriors|49ers') THEN 'sports'
    WHEN regexp_matches(n, 'parade|fleet week|procession|blessing|sunday streets') THEN 'parade' WHEN regexp_matches(n, 'market') THEN 'market' WHEN regexp_matches(n, 'festival|\\bfest\\b|\\bfair\\b') THEN 'festival' ELSE 'other' END AS kind
    FROM (SELECT *, lower(p_name || ' ' || ['Jazz', '10K run', 'Night Market', 'Street Fair', 'Parade', 'thing'][p_partkey % 6 + 1]) AS n FROM part)"""
)
def event_kinds(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ["Jazz", "10K run", "Night Market", "Street Fair", "Parade", "thing"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return L.table(spark, d, "part").select("p_partkey", EV.event_kind(F.lit(None).cast("string"), F.concat_ws(" ", "p_name", tail)).alias("kind"))


@query(
    """WITH o AS (SELECT o_custkey, count(DISTINCT o_orderkey % 9) AS n, o_custkey % 4 = 0 AS listed FROM orders GROUP BY o_custkey), i AS (SELECT o_custkey, n, CASE WHEN n >= 6 THEN 'major' WHEN n >= 2 OR listed THEN 'medium' ELSE 'minor' END AS tier,
    CASE WHEN n >= 6 THEN 0.75 + 0.25 * least(1, ln(n / 6.0) / ln(10)) WHEN n >= 2 THEN 0.45 + 0.25 * (n - 2) / 4 WHEN listed THEN 0.45 WHEN n = 1 THEN 0.2 ELSE 0.1 END AS score, CASE WHEN n >= 2 THEN 'closure_extent' WHEN listed THEN 'source_rank_floor' WHEN n = 1 THEN 'closure_extent' ELSE 'none' END AS basis FROM o)
    SELECT o_custkey, tier, round(score, 6) AS score, basis, round(1 + least(2, 0.25 * greatest(0, n - 1)), 4) AS weight FROM i"""
)
def event_importance(spark, d):
    o = L.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set((F.col("o_orderkey") % 9).cast("string")).alias("ids"))  # nine ids at most
    source = F.when(F.col("o_custkey") % 4 == 0, "provider").otherwise("city")
    tier, score, basis = EV.event_importance(F.col("ids"), source, "provider")
    return o.select("o_custkey", tier.alias("tier"), F.round(score, 6).alias("score"), basis.alias("basis"), F.round(EV.heat_weight(F.size("ids")).cast("double"), 4).alias("weight"))


TITLES = ["Block Party", "Parish picnic", "Halloween", "Night Market", "Farmers Market", "Sunday Streets", "City Run", "Pride Parade", "Street Fair", "Opening"]


@query(
    f"""WITH e AS (SELECT o_orderkey, ({TITLES})[o_orderkey % 10 + 1] AS n, o_custkey % 40 AS b, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey END AS p FROM orders),
    r AS (SELECT *, CASE n WHEN 'Block Party' THEN [300, 100, 800] WHEN 'Parish picnic' THEN [500, 200, 1500] WHEN 'Halloween' THEN [3000, 1000, 10000] WHEN 'Night Market' THEN [10000, 5000, 15000] WHEN 'Farmers Market' THEN [2000, 500, 5000] WHEN 'Sunday Streets' THEN [15000, 5000, 25000] WHEN 'City Run' THEN [5000, 2000, 10000] WHEN 'Pride Parade' THEN [20000, 5000, 50000] WHEN 'Street Fair' THEN [greatest(2000, least(50000, b * 500)), 2000, 50000] ELSE [greatest(300, least(10000, b * 500)), 300, 10000] END AS x FROM e)
    SELECT o_orderkey, coalesce(p, x[1])::BIGINT AS attendance, coalesce(p, x[2])::BIGINT AS low, coalesce(p, x[3])::BIGINT AS high, CASE WHEN p IS NOT NULL THEN 'published' WHEN n = 'Opening' THEN 'default' ELSE 'category' END AS basis FROM r"""
)
def attendance_estimates(spark, d):
    k = F.col("o_orderkey")
    o = L.table(spark, d, "orders")
    found = EV.attendance_estimate(F.element_at(F.array(*map(F.lit, TITLES)), (k % 10 + 1).cast("int")), F.col("o_custkey") % 40, F.when(k % 13 == 0, F.col("o_custkey")))
    return o.select("o_orderkey", *(c.alias(n) for n, c in found.items()))


@query(
    """, c AS (SELECT place_id AS "case", 1704067200 + (place_id * 7919) % 2400000 AS a, 1704067200 + (place_id * 7919) % 2400000 + 7200 AS b, plon, plat FROM places), x AS (SELECT event_id AS closure, user_id AS of_case, lon, lat, t, t + (event_id % 6) * 3600 AS e FROM points WHERE event_id % 3 > 0)
    SELECT "case", closure, "case" = of_case AS own FROM c JOIN x ON t <= b AND e >= a WHERE "case" = of_case OR (lon BETWEEN plon - 0.02 AND plon + 0.02 AND lat BETWEEN plat - 0.02 AND plat + 0.02)""".lstrip(),
    "points", "places",
)
def concurrent_restrictions(spark, d):
    start = 1_704_067_200 + (F.col("place_id") * 7919) % 2_400_000
    cases = L.places(spark, d).select(F.col("place_id").alias("case"), start.alias("from_s"), (start + 7200).alias("to_s"), (F.col("plon") - 0.02).alias("west"), (F.col("plat") - 0.02).alias("south"), (F.col("plon") + 0.02).alias("east"), (F.col("plat") + 0.02).alias("north"))
    k = F.col("event_id")
    closures = L.points(spark, d).select(k.alias("closure"), F.col("user_id").alias("of_case"), F.lit(1).alias("version"), F.when(k % 3 > 0, "full").otherwise("lane").alias("restriction"), "lon", "lat", F.col("t").alias("start_s"), (F.col("t") + (k % 6) * 3600).alias("end_s"))
    return J.concurrent_restrictions(cases, closures)


@query("SELECT event_id, start_s FROM (SELECT event_id, t AS start_s, CASE WHEN event_id % 3 > 0 THEN t + (event_id % 9) * 3600 END AS end_s FROM points) WHERE 1705000000 < coalesce(end_s, start_s + 10800)", "points")
def live_events(spark, d):
    k = F.col("event_id")
    e = L.points(spark, d).select(k, F.col("t").alias("start_s"), F.when(k % 3 > 0, F.col("t") + (k % 9) * 3600).alias("end_s"))
    return jobs.live_events(e, 1_705_000_000).select("event_id", "start_s")


@query(
    """SELECT 'city:' || o_custkey || '@' || strftime(date_trunc('month', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS event, 'C' || o_custkey AS name, round(avg(-122.5 + (o_orderkey % 100) / 1000.0), 6) AS lon, count(*) AS blocks, array_to_string(list_sort(list('city:' || o_orderkey)), ',') AS closures FROM orders GROUP BY o_custkey, date_trunc('month', o_orderdate)"""
)
def closure_events(spark, d):
    o = L.table(spark, d, "orders")
    k = F.col("o_orderkey")
    c = o.select(F.lit("city").alias("source"), k.alias("source_id"), F.col("o_custkey").alias("case_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name"), F.lit("OAK ST").alias("street"), F.lit(None).cast("string").alias("from_street"), F.lit(None).cast("string").alias("to_street"), (-122.5 + (k % 100) / 1000.0).alias("lon"), F.lit(37.7).alias("lat"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("start"), F.lit(None).cast("timestamp").alias("end"))
    return N.closure_events(c).select("event", "name", F.round("lon", 6).alias("lon"), "blocks", F.array_join("closures", ",").alias("closures"))


@query(
    """SELECT event_id, CASE WHEN issued >= s - 3600 AND issued < s THEN 'pre_start' WHEN issued >= e - 3600 AND issued < e THEN 'pre_end' ELSE 'other' END AS phase, CASE WHEN (s - issued) / 60.0 > 0 AND (s - issued) / 60.0 <= 30 THEN 'start_0_30' WHEN (s - issued) / 60.0 > 30 AND (s - issued) / 60.0 <= 90 THEN 'start_30_90' WHEN (e - issued) / 60.0 > 0 AND (e - issued) / 60.0 <= 30 THEN 'end_0_30' WHEN (e - issued) / 60.0 > 30 AND (e - issued) / 60.0 <= 90 THEN 'end_30_90' ELSE 'other' END AS lead
    FROM (SELECT event_id, t % 86400 AS issued, CASE WHEN event_id % 10 > 0 THEN 43200 END AS s, CASE WHEN event_id % 10 > 0 THEN 43200 + (event_id % 10) * 1200 END AS e FROM points)""",
    "points",
)
def window_phases(spark, d):
    k = F.col("event_id")
    e = L.points(spark, d).select(k, (F.col("t") % 86_400).alias("issued"), F.when(k % 10 > 0, F.lit(43_200)).alias("s"), F.when(k % 10 > 0, 43_200 + (k % 10) * 1200).alias("e"))
    i, s, t = F.col("issued"), F.col("s"), F.col("e")
    return e.select("event_id", W.phase_of(i, s, t, 3600).alias("phase"), W.lead_category(i, s, t, [0, 30, 90]).alias("lead"))


@query(
    ", o AS (SELECT seg, t, speed IS NOT NULL AND NOT coalesce(seg % 7 = 0 AND t % 5 = 0, false) AND 1 - speed / 100 < 0.3 AS ok FROM spine) SELECT seg, t, coalesce(lag(ok, 1) OVER w, false) AND coalesce(lag(ok, 2) OVER w, false) AS clear FROM o WINDOW w AS (PARTITION BY seg ORDER BY t)",
    "readings", "buckets", "spine",
)
def clear_roads(spark, d):
    from roadweave.plans.queries import spine

    s = spine(spark, d).select("seg", "t", F.col("speed").isNotNull().alias("observed"), ((F.col("seg") % 7 == 0) & (F.col("t") % 5 == 0)).alias("closed"), (1 - F.col("speed") / 100).alias("ratio"))
    return W.clear_roads(s, "seg", "t", strict=True).select("seg", "t", "clear")


@query(
    """, c AS (SELECT seg, t - t % 3600 AS t, round(avg(speed), 6) AS value, max(event_id) AS k FROM readings GROUP BY 1, 2) SELECT o.seg, o.t AS origin, h::INT AS horizon, round(c.value, 4) AS target, coalesce(c.value IS NOT NULL AND c.k % 3 > 0 AND c.k % 5 > 0 AND c.k % 2 = 0, false) AS labelled
    FROM c o CROSS JOIN range(1, 4) r(h) LEFT JOIN c ON c.seg = o.seg AND c.t = o.t + h * 3600""".lstrip(),
    "readings",
)
def training_windows(spark, d):
    k = F.col("k")
    c = L.readings(spark, d).groupBy("seg", (F.col("t") - F.col("t") % 3600).alias("t")).agg(F.round(F.avg("speed"), 6).alias("value"), F.max("event_id").alias("k"))
    cells = c.select(F.lit(1).alias("run"), "seg", "t", "value", (k % 3 > 0).alias("observed"), (k % 5 == 0).alias("closed"), F.when(k % 2 == 0, "demand").otherwise("drain").alias("phase"))
    return W.training_windows(cells, cells, 3, 3600).select("seg", "origin", "horizon", r4("target").alias("target"), "labelled")


@query(
    "SELECT event_id, round(least(b * (1 + greatest(CASE WHEN (x - s) / 60.0 BETWEEN -60 AND 120 THEN 0.3 ELSE 0 END, CASE WHEN (x - e) / 60.0 BETWEEN -30 AND 90 THEN 0.5 ELSE 0 END) * CASE WHEN m <= 1000 THEN exp(-m / 400.0) ELSE 0 END), 1800), 4) AS seconds FROM (SELECT event_id, 20.0 + event_id % 90 AS b, t % 86400 AS x, CASE WHEN event_id % 9 > 0 THEN 40000 END AS s, CASE WHEN event_id % 9 > 0 THEN 50000 END AS e, (event_id * 7) % 1500 AS m FROM points)",
    "points",
)
def event_rule(spark, d):
    k = F.col("event_id")
    p = L.points(spark, d).select(k, (20.0 + k % 90).alias("b"), (F.col("t") % 86_400).alias("x"), F.when(k % 9 > 0, F.lit(40_000)).alias("s"), F.when(k % 9 > 0, F.lit(50_000)).alias("e"), ((k * 7) % 1500).alias("m"))
    return p.select("event_id", r4(W.event_rule(F.col("b"), F.col("x"), F.col("s"), F.col("e"), F.col("m"))).alias("seconds"))


@query("WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal AS x, (s_suppkey * 7919) % 1000 AS y FROM supplier), w AS (SELECT id, x, y, 0 AS patch, (SELECT ceil(count(*) / 30.0)::INT FROM p) AS parts, 0 AS level FROM p UNION ALL SELECT id, x, y, CASE WHEN parts = 1 OR k <= cut THEN patch ELSE patch + parts // 2 END, CASE WHEN parts = 1 THEN 1 WHEN k <= cut THEN parts // 2 ELSE parts - parts // 2 END, level + 1 FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY CASE WHEN wide THEN y ELSE x END, CASE WHEN wide THEN x ELSE y END, id) AS k, floor(n * (parts // 2) / parts) AS cut FROM (SELECT *, count(*) OVER q AS n, max(y) OVER q - min(y) OVER q > max(x) OVER q - min(x) OVER q AS wide FROM w WINDOW q AS (PARTITION BY patch))) WHERE level < 32) SELECT id, patch FROM w WHERE level = 32")
def balanced_patches(spark, d):
    s = L.table(spark, d, "supplier")
    return W.balanced_patches(s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), ((F.col("s_suppkey") * 7919) % 1000).cast("double").alias("y")), 30)


@query("SELECT event_id FROM events WHERE ('0x' || substr(sha1('v:' || event_id), 1, 8))::BIGINT / 4294967296.0 < CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.01 END")
def subsample_cells(spark, d):
    cells = L.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stratum"))
    return W.subsample_cells(cells, "v", {"click": 1.0, "view": 0.3, "error": 0.01}).select(F.col("id").alias("event_id"))


@query("SELECT seg, t, n::BIGINT AS total FROM (SELECT s.seg, s.t, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY s.seg ORDER BY s.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n FROM (SELECT seg, unnest(range(48)) AS t FROM (SELECT DISTINCT seg FROM readings)) s LEFT JOIN (SELECT seg, (t // 3600) % 48 AS t, count(*) AS n FROM readings GROUP BY 1, 2) c ON c.seg = s.seg AND c.t = s.t)", "readings")
def fill_totals(spark, d):
    c = L.readings(spark, d).groupBy("seg", F.expr("(t div 3600) % 48").alias("t")).agg(F.count("*").alias("total"))
    return W.fill_totals(c, "seg", 48, ["total"], [])


@query(
    """, c AS (SELECT closure AS "case", CASE WHEN closure % 50 = 0 THEN 'public_event' ELSE 'permit' END AS kind, min(CASE WHEN t BETWEEN 800000000 AND 800086400 THEN 0 ELSE least(abs(t - 800000000), abs(t - 800086400)) END) AS gap FROM (SELECT closure, unnest([start_s, end_s]) AS t FROM closures) GROUP BY 1, 2)
    SELECT "case", row_number() OVER (ORDER BY kind <> 'public_event', coalesce(gap, 1e300), "case")::INT AS rank FROM c WHERE kind = 'public_event' OR gap <= 3600 QUALIFY row_number() OVER (ORDER BY kind <> 'public_event', coalesce(gap, 1e300), "case") <= 24""".lstrip(),
    "closures",
)
def rank_event_cases(spark, d):
    c = L.closures(spark, d)
    edges = c.select(F.col("closure").alias("case"), F.when(F.col("closure") % 50 == 0, "public_event").otherwise("permit").alias("kind"), F.explode(F.array("start_s", "end_s")).alias("t"))
    return W.rank_event_cases(edges, 800_000_000, 800_086_400)


# Evaluation

LABELS = """, l AS (SELECT source, event_id % 2 = 0 AS ev, seg % 3 = 0 AS near, seg % 3 = 2 AS far, event_id % 5 = 0 AS ps, event_id % 7 = 0 AS pe, event_id % 4 < 2 AS c1, event_id % 4 = 0 AS c2, event_id % 11 > 0 AS seen, speed / 100 AS target, lag(speed / 100) OVER (PARTITION BY seg ORDER BY ts, event_id) AS pred FROM readings)"""


@query(
    LABELS + """, s AS (SELECT *, unnest([x FOR x IN ['all', CASE WHEN NOT ev THEN 'control_runs' END, CASE WHEN ev THEN 'event_runs' END, CASE WHEN ev AND near THEN 'event_near' END, CASE WHEN ev AND far THEN 'event_far' END, CASE WHEN target >= 0.5 THEN 'severe' END, CASE WHEN ev AND near AND c1 AND ps THEN 'antic_pre_start' END, CASE WHEN ev AND near AND c1 AND pe THEN 'antic_pre_end' END, CASE WHEN ev AND near AND c1 AND (ps OR pe) THEN 'antic' END, CASE WHEN ev AND near AND c2 AND (ps OR pe) THEN 'antic_strict' END, CASE WHEN ev AND near AND NOT seen THEN 'near_missing_history' END] IF x IS NOT NULL]) AS stratum FROM l WHERE pred IS NOT NULL),
    g AS (SELECT source, stratum, count(*) AS labels, avg(abs(pred - target)) AS mae, sum(abs(pred - target)) / sum(abs(target)) AS wape, count_if(target >= 0.5) AS positives, count_if(pred >= 0.5 AND target >= 0.5) AS tp, count_if(pred >= 0.5) AS said FROM s GROUP BY 1, 2)
    SELECT source, stratum, labels, round(mae, 6) AS mae, round(wape, 6) AS wape, positives::BIGINT AS positives, round(CASE WHEN said > 0 THEN tp / said END, 6) AS "precision", round(CASE WHEN positives > 0 THEN tp / positives END, 6) AS recall FROM g""",
    "readings",
)
def strata_errors(spark, d):
    k, w = F.col("event_id"), W.Window.partitionBy("seg").orderBy("ts", "event_id")
    l = L.readings(spark, d).select("source", (k % 2 == 0).alias("with_event"), (F.col("seg") % 3 == 0).alias("near"), (F.col("seg") % 3 == 2).alias("far"), (k % 5 == 0).alias("pre_start"), (k % 7 == 0).alias("pre_end"), (k % 4 < 2).alias("clear"), (k % 4 == 0).alias("clear_strict"), (k % 11 > 0).alias("seen"), (F.col("speed") / 100).alias("target"), F.lag(F.col("speed") / 100).over(w).alias("pred"))
    out = E.strata_errors(l.filter("pred is not null"), 0.5, "source")
    return out.select("source", "stratum", "labels", "positives", *(F.round(c, 6).alias(c) for c in ("mae", "wape", "precision", "recall")))


METHODS = ", c AS (SELECT source, speed AS target, lag(speed) OVER w AS a, avg(speed) OVER (PARTITION BY seg ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM readings WINDOW w AS (PARTITION BY seg ORDER BY ts, event_id))"


def method_cells(spark, d):
    w = W.Window.partitionBy("seg").orderBy("ts", "event_id")
    return L.readings(spark, d).select("source", F.col("speed").alias("target"), F.lag("speed").over(w).alias("a"), F.avg("speed").over(w.rowsBetween(-3, -1)).alias("b")).filter("a is not null")


@query(METHODS + " SELECT source, count(*) AS n, round(avg(abs(a - target)), 4) AS a_mae, round(avg(abs(b - target)), 4) AS b_mae, round(100 * (avg(abs(a - target)) - avg(abs(b - target))) / avg(abs(a - target)), 3) AS b_gain FROM c WHERE a IS NOT NULL GROUP BY source", "readings")
def method_table(spark, d):
    return E.method_table(method_cells(spark, d), ["a", "b"], "a", "source").select("source", "n", r4("a_mae").alias("a_mae"), r4("b_mae").alias("b_mae"), F.round("b_gain", 3).alias("b_gain"))


@query(METHODS + ", m AS (SELECT 'a' AS method, a AS pred, target FROM c WHERE a < 60 UNION ALL SELECT 'b', b, target FROM c WHERE a < 60) SELECT method, count_if(target >= 60)::BIGINT AS buildups, round(count_if(target >= 60 AND pred >= 60) / count_if(target >= 60), 6) AS recall, round(1000.0 * count_if(target < 60 AND pred >= 60) / count(*), 4) AS false_per_1000 FROM m GROUP BY method", "readings")
def buildup_stats(spark, d):
    c = method_cells(spark, d).withColumn("now", F.col("a"))
    return E.buildup_stats(c, ["a", "b"], 60.0).select("method", "buildups", F.round("recall", 6).alias("recall"), r4("false_per_1000").alias("false_per_1000"))


@query("SELECT seg, sum(weight)::BIGINT AS n, round(sum(weight * (speed - 50)) / sum(weight), 4) AS delta FROM readings GROUP BY seg", "readings")
def counterfactual_delta(spark, d):
    return E.counterfactual_delta(L.readings(spark, d).select("seg", F.col("weight").alias("n"), F.col("speed").alias("with_event"), F.lit(50.0).alias("without_event")), "seg").withColumn("delta", r4("delta"))


@query("SELECT l_linenumber AS level, round(quantile_cont(l_extendedprice / (l_quantity * 1000), 0.5) + 1e-9, 5) AS ratio, round(avg(abs(l_extendedprice - l_quantity * 1000)), 3) AS mae FROM lineitem GROUP BY 1")
def sim_vs_observed(spark, d):
    c = L.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_suppkey").alias("seg"), F.lit(0).alias("hour"), F.col("l_extendedprice").alias("sim"), (F.col("l_quantity") * 1000).alias("observed"))
    return E.sim_vs_observed(c).select("level", F.round(F.col("ratio") + 1e-9, 5).alias("ratio"), F.round("mae", 3).alias("mae"))


@query("SELECT o_orderpriority AS policy, round(avg((o_custkey % 7) / (5.0 + o_custkey % 11)), 6) AS diversion, round(avg((5.0 + o_custkey % 11) / (20 + o_custkey % 9)), 6) AS participation, round(avg((o_orderkey % 100) / 100.0), 6) AS congested FROM orders GROUP BY 1")
def mechanism_table(spark, d):
    k = F.col("o_custkey")
    r = L.table(spark, d, "orders").select(F.col("o_orderpriority").alias("policy"), (k % 7).alias("diverted"), (5 + k % 11).alias("participants"), (20 + k % 9).alias("trips"), F.lit(100).alias("seconds"), (F.col("o_orderkey") % 100).alias("congested_s"))
    out = E.mechanism_table(r, "policy")
    return out.select("policy", *(F.round(c, 6).alias(c) for c in ("diversion", "participation", "congested")))


@query(
    """, t AS (SELECT route // 8 AS request, route AS candidate, sum(cost) AS total FROM trips GROUP BY 1, 2), f AS (SELECT request, arg_min(candidate, {'t': total, 'c': candidate}) AS candidate FROM t GROUP BY 1),
    g AS (SELECT f.request, sum((seg % 5) / 5.0 * cost) / sum(cost) AS congestion, avg((seg % 9) / 10.0) AS load FROM f JOIN trips ON route = candidate GROUP BY 1) SELECT request, round(congestion, 6) AS congestion, round(load, 6) AS load, CASE WHEN greatest(congestion, load) < 0.31 THEN 'fastest' WHEN greatest(congestion, load) >= 0.71 THEN 'spread' ELSE 'mixed' END AS mode FROM g""".lstrip(),
    "trips",
)
def route_stress(spark, d):
    c = L.trips(spark, d).select(F.expr("route div 8").alias("request"), F.col("route").alias("candidate"), F.col("cost").alias("eta"), ((F.col("seg") % 5) / 5.0).alias("ratio"), (F.col("seg") % 9).alias("load"), F.lit(10.0).alias("capacity"))
    return E.route_stress(c, 0.31, 0.71).select("request", F.round("congestion", 6).alias("congestion"), F.round("load", 6).alias("load"), "mode")


@query(
    """WITH s AS (SELECT o_orderkey, o_orderpriority AS cohort, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'not_departed' WHEN o_orderkey % 5 = 0 THEN 'unfinished' ELSE 'completed' END AS status, o_totalprice AS s FROM orders)
    SELECT cohort, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'unfinished')::BIGINT AS unfinished, count_if(status = 'not_departed')::BIGINT AS not_departed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'missing')::BIGINT AS missing, round(avg(s) FILTER (WHERE status = 'completed'), 3) AS mean_s, quantile_disc(s, 0.95) FILTER (WHERE status = 'completed') AS p95_s FROM s GROUP BY cohort"""
)
def trip_status(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("trip")
    expected = o.select(F.col("o_orderkey").alias("trip"), F.col("o_orderpriority").alias("cohort"))
    trips = o.select(F.col("o_orderkey").alias("trip"), F.col("o_totalprice").alias("total_s"))
    trips = trips.select("trip", "total_s", (k % 11 == 0).alias("failed"), F.when(k % 13 == 0, None).when(k % 7 == 0, -1).otherwise(5).alias("depart"), F.when(k % 5 == 0, -1).otherwise(9).alias("arrival"))
    return E.trip_status(expected, trips).withColumn("mean_s", F.round("mean_s", 3))


@query("SELECT count(*) FILTER (WHERE a AND b) AS paired, round(avg(x) FILTER (WHERE a AND b), 4) AS paired_delta, bool_and(a AND b) AS eligible, NULL::DOUBLE AS full_delta FROM (SELECT o_orderkey % 7 > 0 AS a, o_orderkey % 5 > 0 AS b, (o_custkey % 100) - 50.0 AS x FROM orders)")
def cohort_comparison(spark, d):
    o = L.table(spark, d, "orders")
    side = lambda c, s: o.select(F.col("o_orderkey").alias("trip"), F.when(c, "completed").otherwise("unfinished").alias("status"), s.alias("total_s"))
    k = F.col("o_orderkey")
    out = E.cohort_comparison(side(k % 7 > 0, F.lit(50.0)), side(k % 5 > 0, (F.col("o_custkey") % 100).cast("double")))
    return out.withColumn("paired_delta", r4("paired_delta"))


@query("SELECT l_suppkey AS run, array_to_string([x FOR x IN [CASE WHEN round(avg(l_discount), 9) > 0.05 THEN 'discount' END, CASE WHEN max(l_quantity) > 49 THEN 'most' END] IF x IS NOT NULL], ',') AS failures, round(avg(l_discount), 9) <= 0.05 AND max(l_quantity) <= 49 AS passed FROM lineitem GROUP BY 1")
def quality_gate(spark, d):
    r = L.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.round(F.avg("l_discount"), 9).alias("discount"), F.max("l_quantity").alias("most"))
    return E.quality_gate(r, {"discount": 0.05, "most": 49}).withColumn("failures", F.array_join("failures", ","))


@query("SELECT win, seg, round(c + 1e-9, 1) AS cars, round(r * 20 + 1e-9, 0) / 20 AS speed FROM (SELECT t - t % 3600 AS win, seg, sum(weight * 900.0) / 3600 AS c, sum(speed / 100 * weight) / sum(weight) AS r FROM readings GROUP BY 1, 2) WHERE c >= 0.5", "readings")
def road_occupancy(spark, d):
    s = L.readings(spark, d).select("seg", "t", (F.col("weight") * 900.0).alias("car_s"), (F.col("speed") / 100).alias("relative"))
    return E.road_occupancy(s, 3600).withColumn("cars", F.round(F.col("cars") + 1e-9, 1))


@query("SELECT seg, t - t % 300 AS bucket, round(sum(speed * weight) / sum(weight), 4) AS speed, true AS observed FROM readings GROUP BY 1, 2", "readings")
def vehicle_state_buckets(spark, d):
    return E.vehicle_state_buckets(L.readings(spark, d).withColumnRenamed("weight", "dt"), 300).withColumn("speed", r4("speed"))


@query("SELECT o_orderstatus AS partition, o_orderpriority AS phase, count(DISTINCT o_custkey % 40) AS families, count(DISTINCT (o_custkey % 40) * 100 + o_orderkey % 9) AS seeds, count(*) AS windows, count_if(o_orderkey % 4 > 0)::BIGINT AS windows_with_clear, sum(o_orderkey % 4)::BIGINT AS clear_roads, sum(o_custkey % 6)::BIGINT AS labels, sum(o_custkey % 3)::BIGINT AS positives FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2")
def support_table(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = L.table(spark, d, "orders").select(F.col("o_orderstatus").alias("partition"), F.col("o_orderpriority").alias("phase"), (c % 40).alias("family"), (k % 9).alias("seed"), (k % 2 == 0).alias("with_event"), (k % 4).alias("clear_near"), (c % 6).alias("labels"), (c % 3).alias("positives"))
    return E.support_table(w)


@query("SELECT c_nationkey AS batch, count(*) AS planned, count_if(c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS completed, count_if(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))::BIGINT AS exported FROM customer GROUP BY 1")
def run_inventory(spark, d):
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), "o_orderstatus")
    return E.run_inventory(L.table(spark, d, "customer").select(F.col("c_nationkey").alias("batch"), F.col("c_custkey").alias("run")), o, o.filter("o_orderstatus = 'F'"))


@query(
    """WITH m AS (SELECT s_suppkey AS seg FROM supplier WHERE s_acctbal > 2000), r AS (SELECT s_suppkey AS seg, CASE WHEN s_suppkey % 4 = 0 THEN 'no' ELSE 'yes' END AS access, s_suppkey + 1 AS other FROM supplier), x AS (SELECT r.*, m.seg IS NOT NULL AS modelled, CASE WHEN other IN (SELECT seg FROM m) THEN other END AS rep FROM r LEFT JOIN m USING (seg))
    SELECT seg, CASE WHEN modelled AND access = 'yes' THEN 'open' WHEN modelled THEN 'restricted' WHEN rep IS NOT NULL THEN 'open' ELSE 'unavailable' END AS availability, CASE WHEN modelled THEN NULL WHEN rep IS NOT NULL THEN 'merged_parallel' ELSE 'not_in_network' END AS gap, (CASE WHEN NOT modelled THEN rep END)::DOUBLE AS represented_by FROM x"""
)
def segment_catalog(spark, d):
    return doubles(catalog(spark, d), "represented_by")


def catalog(spark, d):
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg"))
    roads = s.withColumn("access", F.when(F.col("seg") % 4 == 0, "no").otherwise("yes"))
    modelled = L.table(spark, d, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("seg"))
    return E.segment_catalog(roads, modelled, s.select("seg", (F.col("seg") + 1).alias("into")))


@query("WITH r AS (SELECT s_suppkey AS seg, 100.0 + s_suppkey % 7 AS length, s_suppkey // 2 AS shape FROM supplier), u AS (SELECT DISTINCT l_linenumber AS run, l_suppkey AS seg FROM lineitem), e AS (SELECT run, seg FROM u UNION SELECT NULL, seg FROM u), s AS (SELECT run, shape, sum(length) AS d, max(length) AS p FROM e JOIN r USING (seg) GROUP BY 1, 2) SELECT run::DOUBLE AS run, sum(d) AS directed_m, sum(p) AS physical_m FROM s GROUP BY run")
def length_coverage(spark, d):
    k = F.col("seg")
    s = L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg"))
    a, b = F.array(F.expr("seg div 2").cast("double"), F.lit(1.0)), F.array(F.expr("seg div 2").cast("double"), F.lit(2.0))
    roads = s.select("seg", (100.0 + k % 7).alias("length"), F.when(k % 2 == 0, F.array(a, b)).otherwise(F.array(b, a)).alias("coords"))
    used = L.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("seg"))
    return doubles(E.length_coverage(roads, used), "run")


@query("SELECT c_nationkey AS batch, round(sum(1.0 + c_custkey % 5) * (SELECT quantile_cont(o_totalprice / (1 + o_custkey % 5), 0.5) FROM orders) + 1e-6, 2) AS seconds FROM customer GROUP BY 1")
def size_estimate(spark, d):
    done = L.table(spark, d, "orders").select(F.col("o_totalprice").alias("seconds"), (1 + F.col("o_custkey") % 5).alias("trip_hours"))
    planned = L.table(spark, d, "customer").select(F.col("c_nationkey").alias("batch"), (1.0 + F.col("c_custkey") % 5).alias("trip_hours"))
    return E.size_estimate(done, planned).withColumn("seconds", F.round(F.col("seconds") + 1e-6, 2))


@query("SELECT o_orderpriority AS policy, count_if(s = 'complete')::BIGINT AS complete, count_if(s = 'failed')::BIGINT AS failed, count_if(s = 'incomplete')::BIGINT AS incomplete, bool_and(s = 'complete') AS eligible, round(avg(x) FILTER (WHERE s = 'complete'), 4) AS mean_diff FROM (SELECT o_orderpriority, o_custkey % 100 - 50.0 AS x, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 8 = 0 THEN 'incomplete' ELSE 'complete' END AS s FROM orders) GROUP BY 1")
def policy_status(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    status = F.when((p == "5-LOW") & (k % 9 == 0), "failed").when((p == "1-URGENT") & (k % 8 == 0), "incomplete").otherwise("complete")
    out = E.policy_status(L.table(spark, d, "orders").select(p.alias("policy"), status.alias("status"), (F.col("o_custkey") % 100 - 50.0).alias("diff")))
    return out.drop("place").withColumn("mean_diff", r4("mean_diff"))


@query(
    """, g AS (SELECT source, round(speed / 100 / 0.05)::INT AS k, count(*) AS n, count_if(weight >= 4) AS pos FROM (SELECT source, weight, floor(speed) AS speed FROM readings) GROUP BY 1, 2), a AS (SELECT x.source, x.k, y.k AS lo, z.k AS hi, (SELECT sum(pos) / sum(n) FROM g WHERE g.source = x.source AND g.k BETWEEN y.k AND z.k) AS m FROM g x JOIN g y ON x.source = y.source AND y.k <= x.k JOIN g z ON x.source = z.source AND z.k >= x.k)
    SELECT source, round(k * 0.05, 2) AS score, round(max(least), 6) AS chance FROM (SELECT source, k, lo, min(m) AS least FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2""".lstrip(),
    "readings",
)
def warning_calibration(spark, d):
    r = L.readings(spark, d).select("source", (F.floor("speed") / 100).alias("score"), (F.col("weight") >= 4).alias("label"))
    return E.warning_calibration(r, "source", grid=0.05).select("source", F.round("score", 2).alias("score"), F.round("chance", 6).alias("chance"))


@query(
    """, v AS (SELECT closure AS seg, greatest(0, least(start_s + 600, coalesce(end_s, start_s + 10800)) - start_s) / 600.0 AS cover, CASE closure % 4 WHEN 0 THEN 'restricted' WHEN 1 THEN 'unavailable' ELSE 'open' END AS a FROM closures)
    SELECT seg, CASE WHEN cover >= 1 AND a <> 'unavailable' THEN 'closed' WHEN cover > 0 AND cover < 1 AND a = 'open' THEN 'restricted' ELSE a END AS availability FROM v""".lstrip(),
    "closures",
)
def predicted_availability(spark, d):
    c = L.closures(spark, d)
    a = F.when(F.col("closure") % 4 == 0, "restricted").when(F.col("closure") % 4 == 1, "unavailable").otherwise("open")
    cover = F.greatest(F.lit(0), F.least(F.col("start_s") + 600, F.coalesce("end_s", F.col("start_s") + 10_800)) - F.col("start_s")) / 600.0
    rows = c.select(F.col("closure").alias("seg"), F.col("start_s").alias("bucket"), a.alias("availability"), F.lit(None).cast("string").alias("gap"))
    return E.predicted_availability(rows, c.select(F.col("closure").alias("seg"), F.col("start_s").alias("bucket"), cover.alias("cover"))).select("seg", "availability")


# Policies


@query("SELECT o_orderkey AS route, (CASE o_orderkey % 3 WHEN 0 THEN 5000 - s WHEN 1 THEN greatest(o_orderkey % 4000, 2000) ELSE 2000 END)::DOUBLE AS depart_s FROM (SELECT o_orderkey, 100.0 + o_custkey % 900 AS s FROM orders)")
def departure_times(spark, d):
    k = F.col("o_orderkey")
    o = L.table(spark, d, "orders")
    trips = o.select(k.alias("trip"), F.when(k % 3 == 0, "arrive").when(k % 3 == 1, "depart").alias("mode"), F.when(k % 3 == 0, F.lit(5000)).otherwise(k % 4000).alias("at_s"))
    alternatives = o.select(k.alias("trip"), k.alias("route"), (100.0 + F.col("o_custkey") % 900).alias("duration_s"))
    return P.departure_times(trips, alternatives, F.lit(2000)).select("route", F.col("depart_s").cast("double").alias("depart_s"))


@query(
    """WITH r AS (SELECT o_custkey AS trip, o_orderkey AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, 500.0 + o_orderkey % 900 AS s, o_orderkey % 2 = 0 AS live, o_orderkey % 3600 AS starts FROM orders),
    x AS (SELECT *, coalesce(CASE WHEN route % 5 = 0 THEN (route % 77)::DOUBLE END, CASE WHEN route % 3 = 0 THEN (route % 300)::DOUBLE END, 0) AS e, CASE WHEN route % 7 = 0 THEN (CASE WHEN route % 14 = 0 THEN 1290.0 ELSE 90.0 END) ELSE 0 END AS i, CASE WHEN NOT live AND abs(starts) <= 1800 THEN (route % 60)::DOUBLE ELSE 0 END AS t, route % 14 = 0 AS blocked FROM r),
    b AS (SELECT *, e + i + t AS delay, row_number() OVER (PARTITION BY trip ORDER BY blocked, s + e + i + t, place) = 1 AS best FROM x), c AS (SELECT *, CASE WHEN best THEN max(CASE WHEN place = 0 THEN s + delay END) OVER p - max(CASE WHEN best THEN s + delay END) OVER p END AS saved FROM b WINDOW p AS (PARTITION BY trip))
    SELECT trip, route, e AS events_s, i AS incidents_s, t AS traffic_s, delay AS delay_s, best, saved AS saved_s, CASE WHEN best THEN CASE WHEN blocked THEN 'closure_ahead' WHEN saved >= 60 THEN 'saves_time' WHEN e > 0 OR i > 0 THEN 'events_on_the_way' ELSE 'clear' END END AS tag FROM c"""
)
def plan_rows(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("route")
    r = o.select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("route"))
    routes = r.withColumn("place", F.row_number().over(W.Window.partitionBy("trip").orderBy("route")) - 1).withColumn("duration_s", 500.0 + k % 900).withColumn("has_live", k % 2 == 0).withColumn("starts_in_s", k % 3600)
    forecast = r.select("route", F.when(k % 5 == 0, k % 77).alias("delay"))
    events = r.select("route", F.when(k % 3 == 0, k % 300).alias("delay_s"), F.lit(1).alias("rank"))
    incidents = r.select("route", F.when(k % 14 == 0, 1290).when(k % 7 == 0, 90).alias("delay_s"), (k % 14 == 0).alias("blocked"))
    out = P.plan_rows(routes, forecast, events, incidents, r.select("route", (k % 60).alias("delay_s")))
    return out.select("trip", "route", "events_s", "incidents_s", "traffic_s", "delay_s", "best", "saved_s", "tag")


@query(
    """, e AS (SELECT seg, t AS entry_s FROM readings WHERE t >= 1705000000) SELECT seg, (entry_s // 300 + d - 1) * 300 AS bin, round(sum(w), 4) AS load FROM e, (VALUES (0, 0.25), (1, 0.5), (2, 0.25)) k(d, w) GROUP BY 1, 2""".lstrip(),
    "readings",
)
def spread_load(spark, d):
    s = L.readings(spark, d).select("seg", F.col("t").alias("entry_s"))
    return P.spread_load(s, F.lit(1_705_000_000)).withColumn("load", r4("load"))


@query(
    """, l AS (SELECT seg, t // 3600 % 24 AS bin, count(*) AS load FROM readings GROUP BY 1, 2), c AS (SELECT route, seg, arrive_s // 86400 % 24 AS bin, count(*) AS more FROM trips GROUP BY 1, 2, 3)
    SELECT route, round(sum((1 + seg % 3) * (pow(coalesce(load, 0) + more, 2) - pow(coalesce(load, 0), 2)) / pow(5.0 + seg % 4, 2)), 6) AS growth FROM c LEFT JOIN l USING (seg, bin) GROUP BY route""".lstrip(),
    "trips", "readings",
)
def concentration_growth(spark, d):
    load = L.readings(spark, d).groupBy("seg", F.expr("t div 3600 % 24").alias("bin")).agg(F.count("*").alias("load"))
    cells = L.trips(spark, d).select("route", "seg", F.expr("arrive_s div 86400 % 24").alias("bin"), (1 + F.col("seg") % 3).alias("weight"), (5.0 + F.col("seg") % 4).alias("budget"))
    return P.concentration_growth(cells, load.withColumn("load", F.col("load").cast("double")), "route").withColumn("growth", F.round("growth", 6))


@query(
    """, t AS (SELECT event_id, lon, lat, t % 86400 AS depart FROM points WHERE event_id % 4 > 0), p AS (SELECT place_id, plon, plat, (place_id * 977) % 86400 AS at_s FROM places)
    SELECT p.place_id AS place, count(event_id) AS riders FROM p LEFT JOIN t ON abs(lat - plat) <= 2000 / 111132.0 AND abs(lon - plon) <= 2000 / (111320.0 * cos(radians(plat))) AND abs(depart - at_s) <= 3600 GROUP BY 1""".lstrip(),
    "points", "places",
)
def demand_to_place(spark, d):
    trips = L.points(spark, d).select(F.col("event_id").alias("trip"), "lon", "lat", (F.col("t") % 86_400).alias("depart_s"), (F.col("event_id") % 4 == 0).alias("arrived"))
    places = L.places(spark, d).select(F.col("place_id").alias("place"), "plon", "plat", ((F.col("place_id") * 977) % 86_400).alias("at_s"))
    return P.demand_to_place(trips, places, 2000.0, 3600)


@query(
    """, h AS (SELECT seg, arg_max(speed, {'t': t, 'k': event_id}) AS cur FROM readings GROUP BY 1), f AS (SELECT seg, t, event_id, speed, greatest(speed, 1) AS v FROM readings)
    SELECT event_id, round(cur, 4) AS current, round(1000.0 / v - 1000.0 / (20 + f.seg % 10), 4) AS delay_s FROM f JOIN h USING (seg)""".lstrip(),
    "readings",
)
def export_predictions(spark, d):
    r = L.readings(spark, d)
    v = F.greatest("speed", F.lit(1.0))
    f = r.select("seg", F.col("event_id").alias("issued_s"), F.col("event_id").alias("valid_from"), (1000.0 / v).alias("travel_time"), "speed", F.lit(0.5).alias("ratio"))
    roads = r.select("seg").distinct().select("seg", F.lit(1000.0).alias("length"), (20.0 + F.col("seg") % 10).alias("free_flow"))
    history = r.select("seg", F.struct("t", "event_id").alias("bucket"), "speed")
    return P.export_predictions(f, roads, history).select(F.col("valid_from").alias("event_id"), r4("current").alias("current"), r4("delay_s").alias("delay_s"))


# Quality


@query("SELECT c_mktsegment, round(count_if(c_custkey % 9 > 0) / count(*), 6) AS located, round(count_if(c_custkey % 9 > 0 AND c_nationkey < 24) / count_if(c_custkey % 9 > 0), 6) AS inside, CASE WHEN count_if(c_custkey % 9 > 0) / count(*) >= 0.95 THEN 'PASS' WHEN count_if(c_custkey % 9 > 0) / count(*) >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS geometry, CASE WHEN 1 - count_if(c_custkey % 9 > 0 AND c_nationkey < 24) / count_if(c_custkey % 9 > 0) > 0.01 THEN 'WARN' ELSE 'PASS' END AS in_area FROM customer GROUP BY 1")
def geometry_findings(spark, d):
    c = L.table(spark, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 9 > 0).alias("has_place"), (F.col("c_nationkey") < 24).alias("in_area"))
    return Q.geometry_findings(c, "c_mktsegment").withColumn("located", F.round("located", 6)).withColumn("inside", F.round("inside", 6))


@query(
    """WITH s AS (SELECT o_orderpriority AS p, CASE o_orderkey % 9 WHEN 0 THEN 'soon' WHEN 1 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS a, strftime(o_orderdate + INTERVAL 1 DAY * (o_orderkey % 10 - 2), '%Y-%m-%d %H:%M:%S') AS b FROM orders), t AS (SELECT *, try_cast(a AS TIMESTAMP) AS ta, try_cast(b AS TIMESTAMP) AS tb FROM s)
    SELECT p AS priority, count_if(a IS NOT NULL AND ta IS NULL)::BIGINT AS unparsed, count_if(a IS NULL)::BIGINT AS empty, count_if(tb < ta)::BIGINT AS inverted, count_if(ta <= TIMESTAMP '1995-06-01' AND tb >= TIMESTAMP '1995-06-01')::BIGINT AS active, 'WARN' AS level FROM t GROUP BY p"""
)
def time_findings(spark, d):
    k = F.col("o_orderkey")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    day = F.col("o_orderdate").cast("timestamp")
    rows = L.table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.when(k % 9 == 0, "soon").when(k % 9 > 1, text(day)).alias("a"), text(F.timestamp_seconds(F.unix_timestamp(day) + (k % 10 - 2) * 86_400)).alias("b"))
    return Q.time_findings(rows, "a", "b", F.lit("1995-06-01").cast("timestamp"), "priority")


@query("SELECT source, 1706659200 - max(t) AS age_s, CASE WHEN 1706659200 - max(t) > 10800 THEN 'FAIL' WHEN 1706659200 - max(t) > 1800 THEN 'WARN' ELSE 'PASS' END AS level FROM readings GROUP BY source", "readings")
def freshness(spark, d):
    return Q.freshness(L.readings(spark, d), "t", 1_706_659_200, 1800, 10_800, "source")


@query("WITH k AS (SELECT DISTINCT o_custkey AS k, c_nationkey < 16 AS s, c_acctbal > 0 AS n FROM orders JOIN customer ON c_custkey = o_custkey) SELECT count(*) AS distinct_keys, count_if(s)::BIGINT AS segments, count_if(NOT s AND n)::BIGINT AS nodes, CASE WHEN count_if(s OR n) >= 0.95 * count(*) THEN 'PASS' ELSE 'WARN' END AS level FROM k")
def join_coverage(spark, d):
    keys = L.table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return Q.join_coverage(L.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), keys.filter("c_nationkey < 16"), keys.filter("c_acctbal > 0"), "k").withColumnRenamed("distinct", "distinct_keys")


@query("SELECT p_brand, round(count_if(m > 0 AND m <> 99) / count(*), 6) AS posted, count_if(m > 0 AND m <> 99 AND (m % 5 <> 0 OR m > 65))::BIGINT AS odd, count_if(m = 99)::BIGINT AS sentinels, count_if(m = 0)::BIGINT AS unposted, CASE WHEN count_if(m > 0 AND m <> 99 AND (m % 5 <> 0 OR m > 65)) > 0 THEN 'WARN' ELSE 'PASS' END AS level FROM (SELECT p_brand, CASE p_partkey % 11 WHEN 0 THEN 99 WHEN 1 THEN 0 ELSE 5 * (p_size % 14) + (p_partkey % 50 = 0)::INT END AS m FROM part) GROUP BY 1")
def speed_limit_findings(spark, d):
    k = F.col("p_partkey")
    limit = F.when(k % 11 == 0, 99).when(k % 11 == 1, 0).otherwise(5 * (F.col("p_size") % 14) + (k % 50 == 0).cast("int"))
    return Q.speed_limit_findings(L.table(spark, d, "part").select("p_brand", limit.alias("limit")), "limit", "p_brand").withColumn("posted", F.round("posted", 6))


@query("SELECT p_type, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_values(spark, d):
    return Q.top_values(L.table(spark, d, "part"), "p_type")


@query(
    "SELECT (SELECT count(DISTINCT t - t % 3600) FROM points) AS polls, (SELECT quantile_cont(n, 0.5) FROM (SELECT count(*) AS n FROM points GROUP BY t - t % 3600)) AS median_fleet, round((SELECT count_if(event_id % 5 > 0) / count(*) FROM points), 6) AS in_service, (SELECT count(*) FROM points) AS speeds, (SELECT count_if(event_id % 90 > 35) FROM points)::BIGINT AS implausible, 'WARN' AS level",
    "points",
)
def fleet_findings(spark, d):
    p, k = L.points(spark, d), F.col("event_id")
    out = Q.fleet_findings(p.select((F.col("t") - F.col("t") % 3600).alias("t"), F.col("user_id").alias("vehicle"), F.when(k % 5 > 0, "7").alias("line")), p.select((k % 90).cast("double").alias("mps")))
    return out.withColumn("in_service", F.round("in_service", 6))


@query("SELECT o_orderpriority AS corridor, round(count_if(o_orderkey % 20 > 0) / count(*), 6) AS ok, count_if(o_orderkey % 20 > 0 AND o_orderkey % 6 = 0)::BIGINT AS misfits, count_if(o_orderkey % 20 > 0 AND o_custkey % 50 > 40)::BIGINT AS bad_speeds, round(quantile_cont(o_totalprice / (1000.0 + o_custkey), 0.5) FILTER (WHERE o_orderkey % 20 > 0), 4) AS typical, CASE WHEN count_if(o_orderkey % 20 = 0) = 0 THEN 'PASS' WHEN count_if(o_orderkey % 20 > 0) / count(*) >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS success, 'WARN' AS \"values\" FROM orders GROUP BY 1")
def poll_findings(spark, d):
    k = F.col("o_orderkey")
    two = F.array((F.col("o_custkey") % 50).cast("double"), F.lit(3.0))
    polls = L.table(spark, d, "orders").select(F.col("o_orderpriority").alias("corridor"), (k % 20 > 0).alias("ok"), two.alias("speeds"), F.when(k % 6 == 0, F.array(F.lit(1.0))).otherwise(two).alias("metres"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("coords"), F.col("o_totalprice").alias("duration"), (1000.0 + F.col("o_custkey")).alias("usual"))
    return Q.poll_findings(polls, "corridor").withColumn("ok", F.round("ok", 6)).withColumn("typical", r4("typical"))


@query("SELECT o_custkey % 20 AS block, count(DISTINCT o_orderpriority) AS members FROM orders GROUP BY 1")
def unequal_digests(spark, d):
    """Populations of the policies of a block: no two are alike here."""
    o = L.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("block"), F.col("o_orderpriority").alias("policy"), "o_orderkey", "o_totalprice")
    return Q.unequal_digests(Q.content_digest(o, "block", "policy"), "block", "policy").select("block", "members")


@query("SELECT o_custkey AS \"group\", count(DISTINCT CASE WHEN o_orderkey % 100 < 97 THEN 'train' ELSE 'test' END) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderkey % 100 < 97 THEN 'train' ELSE 'test' END) > 1")
def split_leaks(spark, d):
    o = L.table(spark, d, "orders").select(F.col("o_custkey").alias("group"), F.when(F.col("o_orderkey") % 100 < 97, "train").otherwise("test").alias("split"))
    return Q.split_leaks(o, "group")


@query("SELECT c_mktsegment, round(count_if(c_custkey % 25 > 0) / count(*), 6) AS complete, CASE WHEN count_if(c_custkey % 25 > 0) / count(*) >= 0.95 THEN 'PASS' ELSE 'WARN' END AS level, round(count_if(c_acctbal > 0) / count(*), 6) AS balance FROM customer GROUP BY 1")
def member_findings(spark, d):
    c = L.table(spark, d, "customer").withColumn("roles", F.when(F.col("c_custkey") % 25 > 0, F.array(F.lit("to"), F.lit("via"), F.lit("from"))).otherwise(F.array(F.lit("from"))))
    shares = Q.attribute_shares(c.withColumn("balance", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), ["balance"], "c_mktsegment")
    out = Q.member_findings(c, ["from", "via", "to"], "roles", "c_mktsegment").join(shares, "c_mktsegment")
    return out.withColumn("complete", F.round("complete", 6)).withColumn("balance", F.round("balance", 6))


@query(
    """, c AS (SELECT seg, start_s // 43200 * 43200 AS t FROM closures WHERE end_s > start_s), r AS (SELECT l_suppkey % 3 AS run, l_suppkey AS seg, l_linenumber * 600 AS t, l_quantity > 10 AS observed, l_quantity > 12 AS has, l_discount > 0.09 AS closed FROM lineitem), b AS (SELECT run, t, count(*) AS n, count(DISTINCT seg) AS s, count_if(observed <> has) AS mask, count_if(observed AND closed) AS cs, count_if(closed) AS un FROM r GROUP BY 1, 2),
    g AS (SELECT run, count(*) AS buckets, sum((n <> s)::INT) AS repeats, max(s) <> min(s) AS ragged, sum(mask) AS mask, sum(cs) AS cs, sum(un) AS un FROM b GROUP BY 1) SELECT run, buckets, array_to_string([x FOR x IN [CASE WHEN ragged THEN 'ragged' END, CASE WHEN repeats > 0 THEN 'repeats' END, CASE WHEN mask > 0 THEN 'mask' END, CASE WHEN cs > 0 THEN 'closed_seen' END, CASE WHEN un > 0 THEN 'unscheduled' END] IF x IS NOT NULL], ',') AS problems FROM g""".lstrip(),
    "closures",
)
def export_audit(spark, d):
    l = L.table(spark, d, "lineitem")
    cells = l.select((F.col("l_suppkey") % 3).alias("run"), F.col("l_suppkey").alias("seg"), (F.col("l_linenumber") * 600).cast("long").alias("t"), (F.col("l_quantity") > 10).alias("observed"), (F.col("l_discount") > 0.09).alias("closed"), F.when(F.col("l_quantity") > 12, 1.0).alias("travel_time"))
    return Q.export_audit(cells, J.closure_cover(L.closures(spark, d), 43_200), 600).withColumn("problems", F.array_join("problems", ","))


# Roads


@query(
    f"""WITH RECURSIVE {L.SQL["arcs"]}, f AS (SELECT src AS node, bucket, 60.0 + (src * 13) % 400 + bucket * 20 AS seconds FROM (SELECT DISTINCT src FROM arcs UNION SELECT DISTINCT dst FROM arcs), range(6) b(bucket) WHERE src % 17 > 0),
    w AS (SELECT 1::BIGINT AS node, 60.0 + 13 AS t, 0 AS k UNION ALL SELECT node, min(t) AS t, k FROM (SELECT a.dst AS node, w.t + f.seconds AS t, w.k + 1 AS k FROM w JOIN arcs a ON a.src = w.node JOIN f ON f.node = a.dst AND f.bucket = least(5, floor(w.t / 600)) WHERE w.k < 10) GROUP BY node, k)
    SELECT node, round(min(t), 2) AS arrive_s FROM w GROUP BY node"""
)
def earliest_arrival(spark, d):
    """From road 1, over times that rise from bucket to bucket; some roads are closed."""
    arcs = L.arcs(spark, d)
    roads = L.arcs(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    f = roads.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("node", F.col("bucket").cast("long").alias("bucket"), (60.0 + (F.col("node") * 13) % 400 + F.col("bucket") * 20).alias("seconds"), (F.col("node") % 17 == 0).alias("closed"))
    start = roads.filter("node = 1").select("node", F.lit(0.0).alias("depart_s"))
    return G.earliest_arrival(arcs, start, f, 600, 6).select("node", F.round("arrive_s", 2).alias("arrive_s"))


@query("WITH RECURSIVE f AS (SELECT 40::BIGINT AS node, 0 AS k UNION SELECT c.c_custkey // 2, k + 1 FROM f JOIN customer c ON c.c_custkey = f.node WHERE k < 4 AND c.c_custkey >= 2) SELECT node, min(k)::INT AS hops FROM f GROUP BY node")
def bfs_upstream(spark, d):
    up = L.table(spark, d, "customer").filter("c_custkey >= 2").select(F.expr("c_custkey div 2").alias("src"), F.col("c_custkey").alias("dst"))
    return G.bfs_hops(up, L.table(spark, d, "customer").filter("c_custkey = 40").select(F.col("c_custkey").alias("node")), 4, upstream=True)
