"""Registered queries of feeds: nested rows to flat ones, newest and upcoming rows, documents put in by key, zoned times, travel times, street texts;
added to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import scalars as S
from roadweave.operators import readings as R
from roadweave.plans import lenses as L
from roadweave.plans.detail_queries import nudged
from roadweave.plans.queries import doubles, query
from roadweave.sources import tables as T


@query("SELECT event_id, seg, t FROM readings WHERE t <= 1706000000 ORDER BY t DESC, event_id LIMIT 500", "readings")
def latest_n(spark, d):
    return T.latest_n(L.readings(spark, d).select("event_id", "seg", "t"), "t", 500, F.lit(1_706_000_000), "event_id")


@query(
    """SELECT o_orderkey FROM orders WHERE (o_orderkey % 7 = 0 OR o_orderdate::TIMESTAMP + to_days((o_orderkey % 90)::INT) >= TIMESTAMP '1996-01-15') AND o_orderdate::TIMESTAMP <= TIMESTAMP '1996-01-15' + INTERVAL 30 DAY AND o_orderstatus <> 'F'"""
)
def active_or_upcoming(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    end = F.when(k % 7 != 0, start + F.make_dt_interval((k % 90).cast("int")))
    return T.active_or_upcoming(o, start, end, F.lit("1996-01-15").cast("timestamp"), 30, "o_orderstatus", ("F",)).select("o_orderkey")


@query(
    "SELECT user_id AS vehicle, CASE WHEN event_id % 3 > 0 THEN event_type END AS line, t, lon, lat, CASE WHEN event_id % 4 > 0 THEN (event_id % 360)::DOUBLE END AS bearing FROM points WHERE user_id % 17 > 0 AND event_id % 11 > 0 AND event_id % 13 > 0 AND event_id % 19 > 0", "points"
)
def flatten_fixes(spark, d):
    """Places as text, some no numbers, some zero, some off the earth; bearings as text; vehicles without an id."""
    e = F.col("event_id")
    place = lambda c: F.when(e % 11 == 0, "n/a").when(e % 13 == 0, "0").when(e % 19 == 0, "181").otherwise(F.col(c).cast("string"))
    vehicle = F.struct(F.when(F.col("user_id") % 17 > 0, F.col("user_id")).alias("id"), F.when(e % 3 > 0, F.col("event_type")).alias("line"), F.struct(place("lon").alias("lon"), place("lat").alias("lat")).alias("location"), F.when(e % 4 > 0, (e % 360).cast("string")).otherwise("north").alias("bearing"))
    return R.flatten_fixes(L.points(spark, d).select(F.col("t").alias("polled_at"), vehicle.alias("vehicle")))


ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)"


@query(f"SELECT l_orderkey AS route, l_orderkey % 1000 AS t, (j - 1)::INT AS piece, (j - 1) / 4.0 AS lon, (j - 1) / 8.0 AS lat, j / 4.0 AS to_lon, j / 8.0 AS to_lat, l_quantity::DOUBLE AS metres, l_quantity / 2.0 AS seconds FROM (SELECT *, {ORDERED} AS j FROM lineitem) WHERE l_orderkey % 7 > 0")
def flatten_routes(spark, d):
    """A reply for each order, a piece for each line; every seventh reply lacks a position."""
    l = L.table(spark, d, "lineitem")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    x = l.select(F.col("l_orderkey").alias("route"), j.alias("j"), F.col("l_quantity").cast("double").alias("m")).groupBy("route").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("x"))
    places = F.transform(F.sequence(F.lit(0), F.size("x") - (F.col("route") % 7 == 0).cast("int")), lambda i: F.array(i / 4.0, i / 8.0))
    return R.flatten_routes(x.select("route", (F.col("route") % 1000).alias("polled_at"), places.alias("coords"), F.transform("x", lambda p: p["m"]).alias("distance_m"), F.transform("x", lambda p: p["m"] / 2.0).alias("duration_s")))


def polls(spark, d):
    k = F.col("o_orderkey")
    line = lambda i: F.struct((F.col("o_custkey") * 2 + i).alias("key"), (F.col("o_totalprice") + i).cast("double").alias("value"), F.lit("road").alias("class"), F.when(k % 3 > 0, k % 4 == i).alias("closed"))
    return L.table(spark, d, "orders").select(k.alias("polled_at"), (k % 5 > 0).alias("ok"), F.col("o_orderpriority").alias("style"), F.when(k % 11 > 0, F.array(line(0), line(1))).otherwise(F.array().cast("array<struct<key:bigint,value:double,class:string,closed:boolean>>")).alias("lines"))


@query("SELECT o_orderkey AS t, o_orderpriority AS style, o_custkey * 2 + i AS key, (o_totalprice + i)::DOUBLE AS value, o_orderkey % 3 > 0 AND o_orderkey % 4 = i AS closed FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 5 > 0 AND o_orderkey % 11 > 0")
def explode_tile_lines(spark, d):
    return R.explode_tile_lines(polls(spark, d))


@query("SELECT DISTINCT o_custkey * 2 + i AS key FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 5 > 0 AND o_orderkey % 11 > 0 AND o_custkey * 2 + i NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def new_geometry(spark, d):
    known = L.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    return R.new_geometry(R.explode_tile_lines(polls(spark, d)), known).select("key")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS status, [o_orderpriority, 'a'] AS tags, o_orderkey % 100 AS seen FROM orders WHERE o_orderkey % 3 > 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 > 0 THEN 'new' END AS status, CASE WHEN o_orderkey % 10 > 0 THEN ['b', 'a'] END AS tags FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.tags, []), coalesce(n.tags, [])))), ',') AS tags, coalesce(o.seen, 1000)::DOUBLE AS first_s, (CASE WHEN n.id IS NOT NULL THEN 1000 ELSE o.seen END)::DOUBLE AS last_s FROM o FULL JOIN n ON o.id = n.id"""
)
def upsert_doc(spark, d):
    o, k = L.table(spark, d, "orders"), F.col("o_orderkey")
    at = F.timestamp_seconds(k % 100)
    old = o.filter("o_orderkey % 3 > 0").select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.array(F.col("o_orderpriority"), F.lit("a")).alias("tags"), at.alias("first_seen_at"), at.alias("last_ingested_at"))
    new = o.filter("o_orderkey % 2 = 0").select(k.alias("id"), F.when(k % 8 > 0, "new").alias("status"), F.when(k % 10 > 0, F.array(F.lit("b"), F.lit("a"))).alias("tags"))
    out = T.upsert_doc(old, new, "id", ["tags"], F.timestamp_seconds(F.lit(1000)))
    return doubles(out.select("id", "status", F.array_join("tags", ",").alias("tags"), F.unix_timestamp("first_seen_at").alias("first_s"), F.unix_timestamp("last_ingested_at").alias("last_s")), "first_s", "last_s")


@query("SELECT event_id, (CASE event_id % 6 WHEN 0 THEN t WHEN 1 THEN t - 7200 WHEN 2 THEN t + 19800 WHEN 5 THEN t END)::DOUBLE AS utc_s FROM readings", "readings")
def zoned_times(spark, d):
    """The reading's clock with Z, +02:00, -0530 or -00:00, without an offset, and no time at all."""
    e = F.col("event_id")
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(e % 6 == 3, clock).when(e % 6 == 4, "yesterday+01:00").otherwise(F.concat(clock, F.when(e % 6 == 0, "Z").when(e % 6 == 1, "+02:00").when(e % 6 == 2, "-05:30").otherwise("-00:00")))
    return doubles(L.readings(spark, d).select("event_id", F.unix_timestamp(S.parse_zoned(text)).alias("utc_s")), "utc_s")


@query(
    """WITH p AS (SELECT p_partkey AS seg, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 4 * 10 END AS posted, CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 3 * 20 END AS top, CASE p_partkey % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' ELSE 'residential' END AS class, 100.0 + p_size AS len, CASE WHEN p_partkey % 7 > 0 THEN p_size / 5.0 END AS speed, p_partkey % 11 AS sampled FROM part),
    f AS (SELECT *, CASE WHEN posted > 0 THEN posted WHEN top > 0 THEN top WHEN class = 'motorway' THEN 55 WHEN class = 'trunk_link' THEN 30 ELSE 25 END::DOUBLE AS mph, CASE WHEN posted > 0 THEN 'posted' WHEN top > 0 THEN 'maxspeed' WHEN class <> 'residential' THEN 'class' ELSE 'default' END AS source,
    CASE WHEN speed IS NOT NULL AND sampled >= 5 THEN least(len / greatest(speed, 0.5), 1800) END AS tt FROM p), z AS (SELECT *, ln(greatest(tt, 0.1) / greatest(len / (mph * 0.44704), 0.1)) AS z FROM f),
    b AS (SELECT *, CASE WHEN z IS NOT NULL THEN greatest(len / (mph * 0.44704 * 1.3), least(len / (mph * 0.44704) * exp(z), len / 0.5, 1800)) END AS back FROM z)
    SELECT seg, mph, source, round(tt + 1e-9, 5) AS tt, round(z + 1e-9, 5) AS z, round(back + 1e-9, 5) AS back, round(least(1, greatest(0, 1 - len / back / (mph * 0.44704))) + 1e-9, 5) AS ratio FROM b"""
)
def travel_times(spark, d):
    """Free flow without a measurement, measured times, their logarithm over free flow, and what comes back from it within bounds."""
    k, size = F.col("p_partkey"), F.col("p_size")
    length = (100.0 + size).alias("len")
    mph, source = S.free_flow_fallback(F.when(k % 3 > 0, k % 4 * 10), F.when(k % 5 > 1, k % 3 * 20), F.when(k % 6 == 0, "motorway").when(k % 6 == 1, "trunk_link").otherwise("residential"))
    p = L.table(spark, d, "part").select(k.alias("seg"), mph.alias("mph"), source.alias("source"), length, S.measured_travel_time(F.when(k % 7 > 0, size / 5.0), k % 11, 100.0 + size).alias("tt"))
    free = F.col("mph") * 0.44704
    p = p.withColumn("z", S.z_transform(F.col("tt"), F.col("len") / free))
    known = F.col("z").isNotNull()
    back = S.from_z(F.col("z"), F.col("len"), free)
    out = p.select("seg", "mph", "source", "tt", "z", F.when(known, back["travel_time"]).alias("back"), F.when(known, back["ratio"]).alias("ratio"))
    return nudged(out, "tt", "z", "back", "ratio")


@query(
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) || ' ST  between ' || c_name || ' AND x' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE lower(c_name) || ' between b' END AS s FROM customer)
    SELECT c_custkey, CASE WHEN s <> '' THEN array_to_string(list_transform(list_filter(string_split_regex(lower(s), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ('between', 'and') THEN w ELSE upper(w[1]) || w[2:] END), ' ') END AS title FROM t"""
)
def street_titles(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.upper("c_mktsegment"), F.lit(" ST  between "), F.col("c_name"), F.lit(" AND x"))).when(k % 4 == 1, "").when(k % 4 == 3, F.concat(F.lower("c_name"), F.lit(" between b")))
    return L.table(spark, d, "customer").select("c_custkey", S.street_title(text).alias("title"))
