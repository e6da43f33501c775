"""Views of the given tables as mobility data: readings, points, closures, trips, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadweave.operators.joins import in_parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(name: str):
    return F.unix_timestamp(F.col(name).cast("timestamp"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Traffic readings: seg, source, ts, t, speed, weight."""
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("seg"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), seconds("ts").alias("t"), F.least("value", F.lit(100.0)).alias("speed"), (F.lit(1) + F.col("event_id") % 5).alias("weight"))


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", seconds("ts").alias("t"), (F.lit(-122.53) + F.pmod(F.col("event_id") * 37, F.lit(180)) / 1000.0).alias("lon"), (F.lit(37.69) + F.pmod(F.col("event_id") * 53, F.lit(150)) / 1000.0).alias("lat"))


def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("place_id"), (F.lit(-122.53) + F.pmod(k * 31, F.lit(179)) / 1000.0).alias("plon"), (F.lit(37.69) + F.pmod(k * 47, F.lit(149)) / 1000.0).alias("plat"))


def closures(spark: SparkSession, d: str) -> DataFrame:
    """closure, seg, start_s, end_s (null: open)."""
    o = table(spark, d, "orders")
    start = seconds("o_orderdate")
    return o.select(F.col("o_orderkey").alias("closure"), (F.col("o_custkey") % 150).alias("seg"), start.alias("start_s"), F.when(F.col("o_orderkey") % 7 != 0, start + (F.col("o_orderkey") % 5) * 86400).alias("end_s"))


def trips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("seg"), F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("cost"), seconds("l_shipdate").alias("arrive_s"))


def drives(spark: SparkSession, d: str) -> DataFrame:
    """route, pos, seg, arrive_s: a road every ten minutes from the first day of a route on."""
    start = F.min(seconds("l_shipdate")).over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("seg"), (start + (F.col("l_linenumber") - 1) * 600).alias("arrive_s"))


def arcs(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to the supplier of an order's next line."""
    n = table(spark, d, "lineitem").count()
    a = trips(spark, d).select("route", "pos", F.col("seg").alias("src"))
    b = trips(spark, d).select("route", (F.col("pos") - 1).alias("pos"), F.col("seg").alias("dst"))
    both = in_parts(a, n, "route", "pos").join(in_parts(b, n, "route", "pos").hint("merge"), ["route", "pos"])
    return in_parts(both.filter("src <> dst").select("src", "dst"), n, "src", "dst").distinct()


def runs(spark: SparkSession, d: str) -> DataFrame:
    """policy, block, metric: one row for each pair."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("policy"), (F.col("o_custkey") % 50).alias("block")).agg(F.round(F.avg("o_totalprice"), 4).alias("metric"))


#: The same views in DuckDB's words, for the oracle statements.
SQL = {
    "readings": "readings AS (SELECT event_id, user_id AS seg, event_type AS source, ts, floor(epoch(ts))::BIGINT AS t, least(value, 100.0) AS speed, 1 + event_id % 5 AS weight FROM events)",
    "points": "points AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t, -122.53 + ((event_id * 37) % 180) / 1000.0 AS lon, 37.69 + ((event_id * 53) % 150) / 1000.0 AS lat FROM events)",
    "places": "places AS (SELECT s_suppkey AS place_id, -122.53 + ((s_suppkey * 31) % 179) / 1000.0 AS plon, 37.69 + ((s_suppkey * 47) % 149) / 1000.0 AS plat FROM supplier)",
    "closures": "closures AS (SELECT o_orderkey AS closure, o_custkey % 150 AS seg, floor(epoch(o_orderdate))::BIGINT AS start_s, CASE WHEN o_orderkey % 7 <> 0 THEN floor(epoch(o_orderdate))::BIGINT + (o_orderkey % 5) * 86400 END AS end_s FROM orders)",
    "trips": "trips AS (SELECT l_orderkey AS route, l_linenumber AS pos, l_suppkey AS seg, l_quantity AS length, l_extendedprice AS cost, floor(epoch(l_shipdate))::BIGINT AS arrive_s FROM lineitem)",
    "drives": "drives AS (SELECT l_orderkey AS route, l_linenumber AS pos, l_suppkey AS seg, min(floor(epoch(l_shipdate))::BIGINT) OVER (PARTITION BY l_orderkey) + (l_linenumber - 1) * 600 AS arrive_s FROM lineitem)",
    "arcs": "arcs AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)",
    "runs": "runs AS (SELECT o_orderpriority AS policy, o_custkey % 50 AS block, round(avg(o_totalprice), 4) AS metric FROM orders GROUP BY 1, 2)",
    "buckets": "buckets AS (SELECT t - t % 600 AS bucket, seg, source, sum(speed * weight) / sum(weight) AS speed, count(*) AS n FROM readings GROUP BY 1, 2, 3)",
    "spine": "seen AS (SELECT seg, b - b % 3600 AS t, avg(speed) AS speed FROM (SELECT seg, bucket AS b, speed FROM buckets) GROUP BY 1, 2), spine AS (SELECT r.seg, r.t, s.speed FROM (SELECT seg, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM seen GROUP BY seg) r LEFT JOIN seen s ON r.seg = s.seg AND r.t = s.t)",
}
