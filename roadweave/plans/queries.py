"""Registered queries of the mobility operators over the given tables, each with its SQL in DuckDB's words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions import events as EV
from roadweave.functions import scalars as S
from roadweave.operators import aggregates as A
from roadweave.operators import graph as G
from roadweave.operators import joins as J
from roadweave.operators import matching as M
from roadweave.operators import quality as Q
from roadweave.operators import scoring as P
from roadweave.operators import windows as W
from roadweave.plans import lenses as L
from roadweave.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(L.SQL[v] for v in views)} " if views else "") + sql
        return f

    return register


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def buckets(spark: SparkSession, d: str) -> DataFrame:
    return A.bucket_readings(L.readings(spark, d))


def free_flow(spark: SparkSession, d: str) -> DataFrame:
    return L.readings(spark, d).groupBy("seg").agg(F.max("speed").alias("free_flow"))


@query("SELECT bucket, seg, source, round(speed, 4) AS speed, n FROM buckets", "readings", "buckets")
def bucket_readings(spark, d):
    return buckets(spark, d).select(F.unix_timestamp("bucket").alias("bucket"), "seg", "source", r4("speed").alias("speed"), "n")


@query(
    """, ff AS (SELECT seg, max(speed) AS free_flow FROM readings GROUP BY seg), ranked AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY bucket DESC, source) AS k FROM buckets)
    SELECT r.seg, r.bucket, r.source, round(r.speed, 4) AS speed, round(least(1, greatest(0, 1 - r.speed / ff.free_flow)), 4) AS ratio FROM ranked r JOIN ff ON r.seg = ff.seg WHERE k = 1""".lstrip(),
    "readings", "buckets",
)
def best_current_congestion(spark, d):
    newest = W.latest_per(buckets(spark, d), ["seg"], F.desc("bucket"), F.asc("source"))
    return A.with_free_flow(newest, free_flow(spark, d)).select("seg", F.unix_timestamp("bucket").alias("bucket"), "source", r4("speed").alias("speed"), r4("ratio").alias("ratio"))


@query("SELECT seg, (isodow(make_timestamp(bucket * 1000000)) - 1)::INT AS dow, hour(make_timestamp(bucket * 1000000))::INT AS hour, round(avg(speed), 4) AS speed, count(*) AS n FROM buckets GROUP BY 1, 2, 3", "readings", "buckets")
def typical_profile(spark, d):
    return A.typical_profile(buckets(spark, d)).withColumn("speed", r4("speed")).withColumn("dow", F.col("dow").cast("int")).withColumn("hour", F.col("hour").cast("int"))


@query(
    """SELECT r.seg, round(avg(speed), 4) AS mean_speed, round(arg_min(speed, {'a': ts, 'b': event_id}), 4) AS first_speed, round(max(speed), 4) AS max_speed, count(*) AS n, any_value(m.source) AS mode_source FROM readings r
    JOIN (SELECT seg, source, row_number() OVER (PARTITION BY seg ORDER BY count(*) DESC, source) AS k FROM readings GROUP BY seg, source) m ON m.seg = r.seg AND m.k = 1 GROUP BY r.seg""",
    "readings",
)
def observation_rollup(spark, d):
    return A.observation_rollup(L.readings(spark, d)).select("seg", r4("mean_speed").alias("mean_speed"), r4("first_speed").alias("first_speed"), r4("max_speed").alias("max_speed"), "n", "mode_source")


SPINE = ("readings", "buckets", "spine")


def spine(spark, d):
    return W.hour_spine(buckets(spark, d), "speed")


FILL = "last_value(speed IGNORE NULLS) OVER (PARTITION BY seg ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(f"SELECT seg, t, round({FILL}, 4) AS filled, speed IS NULL AND {FILL} IS NOT NULL AS was_filled FROM spine", *SPINE)
def ffill_limited(spark, d):
    return W.ffill_limited(spine(spark, d), "seg", "t", "speed").select("seg", "t", r4("filled").alias("filled"), "was_filled")


@query(f", ff AS (SELECT seg, max(speed) AS free_flow FROM readings GROUP BY seg) SELECT s.seg, t, round(coalesce({FILL.replace('PARTITION BY seg', 'PARTITION BY s.seg')}, free_flow), 4) AS predicted FROM spine s JOIN ff ON s.seg = ff.seg", *SPINE)
def persistence(spark, d):
    filled = W.ffill_limited(spine(spark, d), "seg", "t", "speed").join(free_flow(spark, d), "seg")
    return filled.select("seg", "t", r4(W.persistence(filled, F.col("free_flow"))).alias("predicted"))


@query("SELECT seg, t, round(speed, 4) AS speed, round(lag(speed, 1) OVER w, 4) AS lag_1, round(lag(speed, 2) OVER w, 4) AS lag_2, round(lag(speed, 3) OVER w, 4) AS lag_3, round(lag(speed, 1) OVER w - lag(speed, 3) OVER w, 4) AS trend FROM spine WINDOW w AS (PARTITION BY seg ORDER BY t)", *SPINE)
def lag_features(spark, d):
    out = W.lag_features(spine(spark, d), "seg", "t", "speed", [1, 2, 3])
    return out.select("seg", "t", *(r4(c).alias(c) for c in ("speed", "lag_1", "lag_2", "lag_3", "trend")))


@query("SELECT seg, t, max((coalesce(speed, 100) < 30)::INT) OVER (PARTITION BY seg ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS tolerant FROM spine", *SPINE)
def tolerant_label(spark, d):
    return W.tolerant_label(spine(spark, d).withColumn("slow", (F.coalesce("speed", F.lit(100.0)) < 30).cast("int")), "seg", "t", "slow", 2).select("seg", "t", "tolerant")


@query("SELECT seg, t, slow AND coalesce(lag(slow, 1) OVER w, false) AND coalesce(lag(slow, 2) OVER w, false) AS steady FROM (SELECT seg, t, coalesce(speed, 0) < 50 AS slow FROM spine) WINDOW w AS (PARTITION BY seg ORDER BY t)", *SPINE)
def steady_closed(spark, d):
    return W.steady(spine(spark, d).withColumn("slow", F.coalesce("speed", F.lit(0.0)) < 50), "seg", "t", "slow").select("seg", "t", "steady")


@query("SELECT seg, t FROM (SELECT seg, t, count(*) OVER w AS n, min((speed IS NOT NULL)::INT) OVER w AS fine FROM spine WINDOW w AS (PARTITION BY seg ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) WHERE n = 3 AND fine = 1", *SPINE)
def window_origins(spark, d):
    return W.window_origins(spine(spark, d).withColumn("ok", F.col("speed").isNotNull()), "seg", "t", "ok", 2, 1).select("seg", "t")


@query(
    """, n AS (SELECT t - t % 3600 AS time, count(*) AS n FROM readings GROUP BY 1), c AS (SELECT * FROM n WHERE time + 3600 <= 1706644800), m AS (SELECT time, n, quantile_cont(n, 0.5) OVER (ORDER BY time ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS typical FROM c)
    SELECT max(time) + 3600 AS issued_at FROM m WHERE typical IS NULL OR n >= 0.5 * typical""".lstrip(),
    "readings",
)
def choose_issue(spark, d):
    counts = L.readings(spark, d).groupBy((F.col("t") - F.col("t") % 3600).alias("time")).agg(F.count("*").alias("n"))
    return W.choose_issue(counts, F.lit(1_706_644_800), 3600)


HAV = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2), 1.0)))"


@query(
    """SELECT event_id AS id, user_id AS vehicle, gap_s, round(hop_m, 3) AS hop_m, round(hop_m / gap_s, 3) AS mps FROM (SELECT p.*, t - pt AS gap_s, """
    + HAV.format(a="p", b="").replace("plat", "plat").replace("plon", "plon")
    + """ AS hop_m FROM (SELECT *, lag(t) OVER w AS pt, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM points WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) p) WHERE gap_s > 0 AND gap_s <= 3600 AND hop_m <= 15000""",
    "points",
)
def vehicle_speeds(spark, d):
    fixes = L.points(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("vehicle"), "t", "lon", "lat")
    return W.vehicle_speeds(fixes, 3600, 15_000.0).select("id", "vehicle", "gap_s", F.round("hop_m", 3).alias("hop_m"), F.round("mps", 3).alias("mps"))


@query(
    "SELECT event_id, floor((lon + 180.0) / 360.0 * 16384)::BIGINT AS tx, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 16384)::BIGINT AS ty, round(" + HAV.format(a="c.", b="p.").replace("c.lat", "37.77").replace("c.lon", "(-122.42)") + ", 3) AS centre_m FROM points p",
    "points",
)
def tiles_and_distances(spark, d):
    p = L.points(spark, d)
    x, y = S.tile_of(F.col("lon"), F.col("lat"), 14)
    return p.select("event_id", x.cast("long").alias("tx"), y.cast("long").alias("ty"), F.round(S.haversine_m(F.lit(-122.42), F.lit(37.77), F.col("lon"), F.col("lat")), 3).alias("centre_m"))


@query(
    "SELECT event_id AS point_id, place_id, round(m, 3) AS metres, row_number() OVER (PARTITION BY event_id ORDER BY m, place_id)::INT AS rank FROM (SELECT p.event_id, q.place_id, " + HAV.format(a="p.", b="q.p").replace("q.plat", "q.plat") + " AS m FROM points p JOIN places q ON abs(p.lat - q.plat) < 0.02) WHERE m <= 1000",
    "points", "places",
)
def nearest_within(spark, d):
    p = L.points(spark, d).select(F.col("event_id").alias("point_id"), "lon", "lat")
    return J.nearest_within(p, L.places(spark, d), 1000.0).withColumn("metres", F.round("metres", 3))


@query(
    """, l AS (SELECT event_id, seg, ts FROM readings WHERE source = 'click'), r AS (SELECT seg, ts, max(speed) AS speed FROM readings WHERE source = 'purchase' GROUP BY seg, ts)
    SELECT l.event_id, round(CASE WHEN floor(epoch(l.ts))::BIGINT - floor(epoch(r.ts))::BIGINT <= 43200 THEN r.speed END, 4) AS asof_speed FROM l ASOF LEFT JOIN r ON l.seg = r.seg AND l.ts >= r.ts""".lstrip(),
    "readings",
)
def asof_relative(spark, d):
    r = L.readings(spark, d)
    left = r.filter("source = 'click'").select("event_id", "seg", "ts")
    right = r.filter("source = 'purchase'").groupBy("seg", "ts").agg(F.max("speed").alias("speed"))
    return J.asof_join(left, right, "seg", "ts", "speed", 43_200, "event_id").select("event_id", r4("asof_speed").alias("asof_speed"))


@query(
    """, l AS (SELECT event_id AS a, seg, t FROM readings WHERE source = 'click'), r AS (SELECT event_id AS b, seg, t FROM readings WHERE source = 'view')
    SELECT a, b, gap FROM (SELECT a, b, abs(l.t - r.t) AS gap, row_number() OVER (PARTITION BY a ORDER BY abs(l.t - r.t), b) AS k FROM l JOIN r ON l.seg = r.seg AND abs(l.t - r.t) <= 1200) WHERE k = 1""".lstrip(),
    "readings",
)
def nearest_time(spark, d):
    r = L.readings(spark, d)
    left = r.filter("source = 'click'").select(F.col("event_id").alias("a"), "seg", F.col("t").alias("lt"))
    right = r.filter("source = 'view'").select(F.col("event_id").alias("b"), "seg", F.col("t").alias("rt"))
    return J.nearest_time_join(left, right, "seg", "a", "b", 1200).select("a", "b", "gap")


OVERLAP = """, c AS (SELECT closure, seg, start_s, coalesce(end_s, start_s + 10800) AS end_s FROM closures)
    SELECT a.closure AS a_id, b.closure AS b_id FROM c a JOIN c b ON a.seg = b.seg AND a.closure < b.closure AND a.start_s <= b.end_s AND b.start_s <= a.end_s"""


@query(OVERLAP.lstrip(), "closures")
def overlapping_closures(spark, d):
    c = L.closures(spark, d)
    side = lambda p: c.select("seg", F.col("closure").alias(f"{p}_id"), F.col("start_s").alias(f"{p}_start"), F.col("end_s").alias(f"{p}_end"))
    return J.interval_overlap_join(side("a"), side("b"), "seg", 10_800).filter("a_id < b_id").select("a_id", "b_id")


@query(
    """SELECT seg, bucket, round(max((least(end_s, bucket + 43200) - greatest(start_s, bucket)) / 43200.0), 4) AS cover FROM (SELECT seg, start_s, end_s, unnest(range(start_s // 43200, (end_s - 1) // 43200 + 1)) * 43200 AS bucket FROM closures WHERE end_s > start_s) GROUP BY 1, 2""",
    "closures",
)
def closure_cover(spark, d):
    return J.closure_cover(L.closures(spark, d), 43_200).withColumn("cover", r4("cover"))


@query(
    "SELECT a.event_id AS a_id, b.event_id AS b_id, a.event_type AS category FROM points a JOIN points b ON a.event_type = b.event_type AND a.event_id < b.event_id AND a.user_id <> b.user_id AND abs(a.t - b.t) <= 7200 AND " + HAV.format(a="a.", b="b.") + " <= 5000",
    "points",
)
def cross_source_pairs(spark, d):
    rows = L.points(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("category"), "lon", "lat", "t")
    return J.cross_source_pairs(rows, 5000.0, 7200)


def incident_rows(spark, d):
    """Closures as incidents on two roads each."""
    c = L.closures(spark, d)
    k = F.col("closure")
    both = c.withColumn("seg", F.explode(F.array(F.col("seg"), (F.col("seg") + 37) % 150)))
    return both.select(k.alias("incident"), "seg", F.concat(F.lit("k"), (k % 7).cast("string")).alias("label"), (k % 3 == 0).alias("is_closure"), F.when(k % 1000 != 0, F.col("start_s")).alias("start_s"), "end_s")


HITS = """, f AS (SELECT route, seg, min(pos) AS pos, arg_min(arrive_s, pos) AS arrive_s FROM drives GROUP BY 1, 2), c AS (SELECT closure AS incident, unnest([seg, (seg + 37) % 150]) AS seg, 'k' || (closure % 7) AS label, closure % 3 = 0 AS is_closure, CASE WHEN closure % 1000 <> 0 THEN start_s END AS start_s, end_s FROM closures),
    m AS (SELECT route, incident, min(pos) AS pos, arg_min(arrive_s, pos) AS arrive_s, any_value(label) AS label, any_value(is_closure) AS is_closure, any_value(start_s) AS start_s, any_value(coalesce(end_s, start_s + 10800)) AS end_s FROM f JOIN c USING (seg) GROUP BY 1, 2),
    hit AS (SELECT route, label, is_closure, min(incident) AS incident, arg_min(pos, incident) AS pos FROM m WHERE (start_s IS NULL OR start_s <= arrive_s) AND (end_s IS NULL OR arrive_s <= end_s) GROUP BY 1, 2, 3)"""


@query(HITS + " SELECT route, incident, pos::INT AS pos, label, is_closure FROM hit", "drives", "closures")
def incidents_on_route(spark, d):
    return J.incidents_on_route(L.drives(spark, d), incident_rows(spark, d)).withColumn("pos", F.col("pos").cast("int"))


@query(HITS + " SELECT route, (CASE WHEN bool_or(is_closure) THEN 1200 ELSE 0 END + least(300, 90 * count_if(NOT is_closure)))::BIGINT AS delay_s, bool_or(is_closure) AS blocked FROM hit GROUP BY route", "drives", "closures")
def incident_delay(spark, d):
    return J.incident_delay(J.incidents_on_route(L.drives(spark, d), incident_rows(spark, d)))


@query("SELECT route, pos::INT AS pos, round(coalesce(sum(length) OVER (PARTITION BY route ORDER BY pos, seg, length, cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(length) OVER (PARTITION BY route), 6) AS share FROM trips", "trips")
def segment_arrivals(spark, d):
    return W.segment_arrivals(L.trips(spark, d), "seg", "length", "cost").select("route", F.col("pos").cast("int").alias("pos"), F.round("share", 6).alias("share"))


@query("SELECT seg, t - t % 300 AS bin, count(*) AS load FROM readings GROUP BY 1, 2", "readings")
def ledger_load(spark, d):
    return A.ledger_load(L.readings(spark, d))


@query(", l AS (SELECT seg, t - t % 3600 AS bin, count(*) AS load FROM readings GROUP BY 1, 2) SELECT seg, round(sum(pow(load / 4.0, 2)), 4) AS phi, sum(load)::BIGINT AS total FROM l GROUP BY seg", "readings")
def concentration(spark, d):
    return A.concentration(A.ledger_load(L.readings(spark, d), 3600), "seg", 4.0).withColumn("phi", r4("phi"))


def cells(spark, d):
    w = W.Window.partitionBy("seg").orderBy("ts", "event_id")
    return L.readings(spark, d).withColumn("pred", F.lag("speed").over(w)).withColumnRenamed("speed", "target").filter("pred is not null").withColumn("near", F.when(F.col("seg") % 2 == 1, "near").otherwise("far"))


CELLS = ", cells AS (SELECT * FROM (SELECT seg, source, CASE seg % 2 WHEN 1 THEN 'near' ELSE 'far' END AS near, speed AS target, lag(speed) OVER (PARTITION BY seg ORDER BY ts, event_id) AS pred FROM readings) WHERE pred IS NOT NULL) "


@query(CELLS + "SELECT source, near, count(*) AS n, round(avg(abs(pred - target)), 4) AS mae, round(sum(abs(pred - target)) / sum(abs(target)), 4) AS wape, round(count_if(pred >= 60 AND target >= 60) / count_if(pred >= 60), 4) AS precision, round(count_if(pred >= 60 AND target >= 60) / count_if(target >= 60), 4) AS recall FROM cells GROUP BY 1, 2", "readings")
def forecast_errors(spark, d):
    return A.forecast_errors(cells(spark, d), 60.0, "source", "near").select("source", "near", "n", *(r4(c).alias(c) for c in ("mae", "wape", "precision", "recall")))


@query(CELLS + "SELECT source, near, round(avg(abs(pred - target)), 4) AS mae, count(*) AS n FROM cells GROUP BY GROUPING SETS ((source), (near), (source, near), ())", "readings")
def error_marginals(spark, d):
    return A.error_marginals(cells(spark, d), [["source"], ["near"], ["source", "near"], []], ["source", "near"]).withColumn("mae", r4("mae"))


@query(
    """SELECT r.policy, count(*) AS n, round(avg(r.metric - b.metric), 2) AS mean_diff, round(quantile_cont(r.metric - b.metric, 0.5), 2) AS median_diff, round(stddev_samp(r.metric - b.metric), 2) AS std_diff, round(max(r.metric - b.metric), 2) AS worst, count_if(r.metric < b.metric)::BIGINT AS better, count_if(r.metric > b.metric)::BIGINT AS worse
    FROM runs r JOIN runs b ON b.policy = '1-URGENT' AND b.block = r.block WHERE r.policy <> '1-URGENT' GROUP BY 1""",
    "runs",
)
def paired_summary(spark, d):
    out = A.paired_summary(A.policy_vs_base(L.runs(spark, d), "1-URGENT", "metric"))
    return out.select("policy", "n", *(F.round(c, 2).alias(c) for c in ("mean_diff", "median_diff", "std_diff", "worst")), "better", "worse")


@query("SELECT block FROM (SELECT DISTINCT o_custkey % 2503 AS block, o_orderpriority AS p FROM orders) GROUP BY block HAVING count(*) = 5")
def common_blocks(spark, d):
    o = L.table(spark, d, "orders")
    return A.common_blocks(o.select(F.col("o_orderpriority").alias("policy"), (F.col("o_custkey") % 2503).alias("block")), 5)


@query("SELECT policy, round(avg(metric), 2) AS mean, rank() OVER (ORDER BY round(avg(metric), 2))::INT AS place FROM runs GROUP BY policy", "runs")
def policy_ranking(spark, d):
    means = L.runs(spark, d).groupBy("policy").agg(F.round(F.avg("metric"), 2).alias("mean"))
    return means.withColumn("place", F.rank().over(W.Window.orderBy("mean")))  # one row a policy


@query("SELECT o_orderpriority AS cohort, count(*) AS trips, count(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS arrived, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) + 1e-6, 2) AS mean_s, round(quantile_cont(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0.5) + 1e-6, 2) AS median_s, round(quantile_cont(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0.95) + 1e-6, 2) AS p95_s FROM orders GROUP BY 1")
def trip_outcomes(spark, d):
    t = L.table(spark, d, "orders").select(F.col("o_orderpriority").alias("cohort"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("seconds"))
    return A.trip_outcomes(t).select("cohort", "trips", "arrived", *(F.round(F.col(c) + 1e-6, 2).alias(c) for c in ("mean_s", "median_s", "p95_s")))


@query("SELECT l_suppkey AS run, count(*) AS trips, round(count_if(l_discount > 0.08) * 1000.0 / count(*), 4) AS late_per_1000, count_if(l_discount > 0.08) * 1000.0 / count(*) > 200 AS review FROM lineitem GROUP BY 1")
def run_quality(spark, d):
    return A.run_quality(L.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_discount") > 0.08).alias("late")), 200.0).withColumn("late_per_1000", r4("late_per_1000"))


@query("SELECT 'speed' AS \"column\", round(avg(speed), 4) AS mean, round(greatest(stddev_pop(speed), 0.001), 4) AS std FROM readings WHERE seg % 3 <> 0 UNION ALL SELECT 'weight', round(avg(weight), 4), round(greatest(stddev_pop(weight), 0.001), 4) FROM readings WHERE seg % 3 <> 0", "readings")
def fit_norm(spark, d):
    return A.fit_norm(L.readings(spark, d), ["speed", "weight"], F.col("seg") % 3 != 0).select("column", r4("mean").alias("mean"), r4("std").alias("std"))


@query("SELECT event_id, seg, source FROM (SELECT event_id, seg, source, lag(source) OVER (PARTITION BY seg ORDER BY ts, event_id) AS past FROM readings) WHERE past IS NULL OR past <> source", "readings")
def change_only(spark, d):
    return W.change_only(L.readings(spark, d), "seg", ["ts", "event_id"], F.col("source")).select("event_id", "seg", "source")


@query("SELECT event_id, seg, source FROM (SELECT event_id, seg, source, lag(seg) OVER (PARTITION BY source ORDER BY ts, event_id) AS past FROM readings) WHERE past IS NULL OR past <> seg", "readings")
def collapse_repeats(spark, d):
    return W.collapse_repeats(L.readings(spark, d), "source", ["ts", "event_id"], "seg", day=F.floor(F.col("t") / 86_400)).select("event_id", "seg", "source")


@query(", g AS (SELECT seg, t - lag(t) OVER (PARTITION BY seg ORDER BY t) AS gap FROM readings), m AS (SELECT seg, quantile_cont(gap, 0.5) AS typical_s FROM g WHERE gap IS NOT NULL GROUP BY seg) SELECT g.seg, round(any_value(typical_s), 4) AS typical_s, count_if(gap > 2.5 * typical_s)::BIGINT AS gaps FROM g JOIN m ON g.seg = m.seg WHERE gap IS NOT NULL GROUP BY g.seg", "readings")
def poll_gaps(spark, d):
    return W.poll_gaps(L.readings(spark, d), "seg", "t").withColumn("typical_s", r4("typical_s"))


@query("SELECT seg, source, event_id, copies FROM (SELECT seg, source, event_id, count(*) OVER (PARTITION BY seg, source) AS copies, row_number() OVER (PARTITION BY seg, source ORDER BY event_id) AS k FROM readings) WHERE k = 1", "readings")
def dedupe_first(spark, d):
    return W.dedupe_first(L.readings(spark, d), ["seg", "source"], "event_id").select("seg", "source", "event_id", "copies")


@query("SELECT c_custkey, CASE WHEN k <= 20 THEN 'test' WHEN k <= 50 THEN 'validation' ELSE 'train' END AS split FROM customer JOIN (SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY sha256('v1:' || c_nationkey || c_mktsegment)) AS k FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) USING (c_nationkey, c_mktsegment)")
def group_split(spark, d):
    c = L.table(spark, d, "customer").withColumn("g", F.concat(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")))
    return W.group_split(c, "g", "v1", 20, 30).select("c_custkey", "split")


@query(
    """WITH w AS (SELECT event_id AS win, user_id AS family, event_id % 3 = 0 AS with_event, CASE event_type WHEN 'click' THEN 'pre_start' WHEN 'view' THEN 'pre_end' WHEN 'error' THEN 'idle' ELSE 'other' END AS phase, CASE event_type WHEN 'click' THEN 0.5 ELSE 0.25 END AS target FROM events),
    h AS (SELECT family, with_event, phase, count(*) AS have, any_value(target) AS target FROM w WHERE phase <> 'idle' GROUP BY 1, 2, 3),
    q AS (SELECT *, target / sum(target) OVER p AS quota, 6 AS n FROM h WINDOW p AS (PARTITION BY family, with_event)), f AS (SELECT *, floor(n * quota + 1e-9) AS whole FROM q),
    t AS (SELECT *, whole + (row_number() OVER (PARTITION BY family, with_event ORDER BY quota DESC, CASE phase WHEN 'pre_start' THEN 0 WHEN 'pre_end' THEN 1 ELSE 2 END) <= n - sum(whole) OVER (PARTITION BY family, with_event))::INT AS take FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY family, with_event, phase ORDER BY sha1('s:' || win), win) AS k FROM w) SELECT family, win AS window, with_event, phase, unnest(range(1, (floor((take - k) / have) + 2)::BIGINT))::BIGINT * 0 + 1 AS draw FROM r JOIN t USING (family, with_event, phase) WHERE k <= take"""
)
def balanced_sample(spark, d):
    e = L.table(spark, d, "events")
    phase = F.when(F.col("event_type") == "click", "pre_start").when(F.col("event_type") == "view", "pre_end").when(F.col("event_type") == "error", "idle").otherwise("other")
    w = e.select(F.col("event_id").alias("window"), F.col("user_id").alias("family"), (F.col("event_id") % 3 == 0).alias("with_event"), phase.alias("phase"))
    return W.balanced_sample(w, 12, "s").withColumn("draw", F.col("draw").cast("long"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN least(2.0, greatest(0.5, exp((ln(o_totalprice) - (SELECT avg(ln(o_totalprice)) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0)) / 2))) ELSE 1.0 END, 4) AS weight FROM orders")
def attendance_weights(spark, d):
    return W.attendance_weights(L.table(spark, d, "orders"), F.col("o_totalprice"), F.col("o_orderstatus") == "F").select("o_orderkey", r4("weight").alias("weight"))


@query("SELECT c_mktsegment, c_custkey, rank FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) WHERE rank <= 10")
def top_hotspots(spark, d):
    return W.top_per(L.table(spark, d, "customer"), "c_mktsegment", 10, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_mktsegment", "c_custkey", "rank")


@query(", o AS (SELECT src AS node, count(*) AS k FROM arcs GROUP BY 1), i AS (SELECT dst AS node, count(*) AS k FROM arcs GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree FROM o FULL JOIN i ON o.node = i.node", "arcs")
def degrees(spark, d):
    return G.degrees(L.arcs(spark, d))


@query("SELECT coalesce(d.node, u.node) AS node, mean_down, mean_up FROM (SELECT a.src AS node, round(avg(s.s_acctbal) + 1e-7, 4) AS mean_down FROM arcs a JOIN supplier s ON s.s_suppkey = a.dst GROUP BY 1) d FULL JOIN (SELECT a.dst AS node, round(avg(s.s_acctbal) + 1e-7, 4) AS mean_up FROM arcs a JOIN supplier s ON s.s_suppkey = a.src GROUP BY 1) u ON d.node = u.node", "arcs")
def neighbour_mean(spark, d):
    return G.neighbour_mean(L.arcs(spark, d), L.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value"))).withColumn("mean_down", r4(F.col("mean_down") + 1e-7)).withColumn("mean_up", r4(F.col("mean_up") + 1e-7))


@query("SELECT node, min(hops)::INT AS hops FROM (SELECT 1::BIGINT AS node, 0 AS hops UNION ALL SELECT dst, 1 FROM arcs WHERE src = 1 UNION ALL SELECT b.dst, 2 FROM arcs a JOIN arcs b ON a.dst = b.src WHERE a.src = 1) GROUP BY node", "arcs")
def bfs_hops(spark, d):
    return G.bfs_hops(L.arcs(spark, d), L.table(spark, d, "supplier").filter("s_suppkey = 1").select(F.col("s_suppkey").cast("long").alias("node")), 2).select(F.col("node").cast("long").alias("node"), "hops")


@query("SELECT sum(n)::BIGINT AS rows, 0::BIGINT AS missing, count_if(n > 1)::BIGINT AS repeated FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def unique_id(spark, d):
    return A.unique_id(L.table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT o_orderkey, '[' || concat_ws(', ', CASE WHEN o_totalprice < 50000 THEN 'cheap' END, CASE WHEN o_orderkey % 7 = 0 THEN 'open_end' END) || ']' AS errors FROM orders WHERE o_totalprice < 50000 OR o_orderkey % 7 = 0")
def quarantine(spark, d):
    _, bad = T.quarantine(L.table(spark, d, "orders"), S.errors_of(("cheap", F.col("o_totalprice") < 50_000), ("open_end", F.col("o_orderkey") % 7 == 0)))
    return bad.select("o_orderkey", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@query("SELECT key, arg_max(event_id, event_id) AS event_id, arg_max(round(value, 4), event_id) AS value FROM (SELECT user_id AS key, event_id, value FROM events) GROUP BY key")
def upsert_last_wins(spark, d):
    e = L.table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", r4("value").alias("value"))
    return T.last_wins(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["key"], "event_id")


@query("SELECT c_custkey, gone AS archived, CASE WHEN gone THEN 'missing_from_pull' END AS archived_reason FROM (SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_nationkey < 20 AS gone FROM customer)")
def archive_missing(spark, d):
    pulled = L.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return T.archive_missing(L.table(spark, d, "customer"), pulled, "c_custkey", True, F.col("c_nationkey") < 20).select("c_custkey", "archived", "archived_reason")


@query("SELECT closure, seg FROM closures WHERE start_s <= 820454400 AND (end_s IS NULL OR end_s >= 820454400)", "closures")
def active_at(spark, d):
    return T.active_at(L.closures(spark, d), F.col("start_s"), F.col("end_s"), F.lit(820454400)).select("closure", "seg")


@query(r"""SELECT event_id, regexp_replace(regexp_replace(m, '(?i)\b([a-z][a-z0-9+.-]*://)[^/\s:@]*:[^@\s]*@', '\1***@', 'g'), '(?i)\b(token|app_token|access_token|api_key|apikey|key|password|pwd)=[^&\s"'']+', '\1=***', 'g') AS message
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://u' || user_id || ':pw@host/x?id=1' WHEN 1 THEN 'api_key=' || event_id || '&x=1' ELSE 'https://u' || user_id || '@host/key: ' || event_id END AS m FROM events)""")
def redact_messages(spark, d):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("https://u"), u, F.lit(":pw@host/x?id=1"))).when(k % 3 == 1, F.concat(F.lit("api_key="), k.cast("string"), F.lit("&x=1"))).otherwise(F.concat(F.lit("https://u"), u, F.lit("@host/key: "), k.cast("string")))
    return L.table(spark, d, "events").select("event_id", S.redact(text).alias("message"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '^the\\s+', ''), '[^a-z0-9]+', ' ', 'g')) AS name, substr(sha1(p_name || '|' || p_brand), 1, 16) AS key FROM part")
def names_and_keys(spark, d):
    return L.table(spark, d, "part").select("p_partkey", S.norm_name(F.col("p_name")).alias("name"), S.stable_key(F.col("p_name"), F.col("p_brand")).alias("key"))


CALLS = ["TRAFFIC STOP accident", "1183-Trfc Collision-Unkn Inj", "Stalled vehicle", "Car fire", "SigAlert", "road closure hazard", "HIT & RUN no injuries", "animal on road", "noise"]


@query(
    f"""SELECT event_id, CASE WHEN regexp_matches(t, 'TRAFFIC STOP') THEN 'other' WHEN regexp_matches(t, 'COLLISION|COLLN|ACCIDENT|HIT AND RUN|HIT & RUN|HIT/RUN|1179|1180|1181|1182|1183|20001|20002') THEN 'collision' WHEN regexp_matches(t, 'ROAD CLOSURE|SIGALERT|SIG ALERT|1184') THEN 'closure'
    WHEN regexp_matches(t, 'HAZARD|DEBRIS|OBSTRUCTION|BLOCKED|STALL|DISABLED|ANIMAL|FLOOD|SPILL|1125|1126') THEN 'hazard' WHEN regexp_matches(t, 'FIRE') THEN 'fire' ELSE 'other' END AS category FROM (SELECT event_id, upper({CALLS}[event_id % {len(CALLS)} + 1] || ' ' || event_type) AS t FROM events)"""
)
def incident_category(spark, d):
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("event_id") % len(CALLS) + 1).cast("int"))
    return L.table(spark, d, "events").select("event_id", S.incident_category(F.concat_ws(" ", call, "event_type")).alias("category"))


@query(
    """SELECT o_orderkey, CASE WHEN c >= 15000 THEN 'high' WHEN c >= 5000 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN c >= 15000 THEN 600.0 WHEN c >= 5000 THEN 300.0 ELSE 120.0 END AS delay_s
    FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 10 END, 3000.0) * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.6 ELSE 0.7 END AS c FROM orders)"""
)
def event_tiers(spark, d):
    o = L.table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "sports").when(F.col("o_orderstatus") == "O", "conference").otherwise("other")
    tier = EV.event_tier(EV.event_crowd(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 10), F.lit(None).cast("double"), kind))
    return o.select("o_orderkey", tier.alias("tier"), EV.tier_seconds(tier).alias("delay_s"))


@query("SELECT event_id, round(sin(m / 1440.0 * 6.283185307179586), 4) + 0.0 AS tod_sin, round(cos(m / 1440.0 * 6.283185307179586), 4) + 0.0 AS tod_cos, round(sin(w / 7.0 * 6.283185307179586), 4) + 0.0 AS dow_sin FROM (SELECT event_id, hour(l) * 60 + minute(l) AS m, isodow(l) - 1 AS w FROM (SELECT event_id, ts - INTERVAL 8 HOUR AS l FROM events))")
def calendar_features(spark, d):
    c = S.calendar_features(F.col("ts").cast("timestamp"))
    return L.table(spark, d, "events").select("event_id", *((r4(c[k]) + 0.0).alias(k) for k in ("tod_sin", "tod_cos", "dow_sin")))


@query("SELECT k, 'missing' AS side FROM (SELECT p_partkey % 1300 AS k FROM part EXCEPT SELECT c_custkey AS k FROM customer) UNION ALL SELECT k, 'unexpected' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT p_partkey % 1300 AS k FROM part)")
def missing_references(spark, d):
    return Q.missing_and_unexpected(L.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), L.table(spark, d, "part").select((F.col("p_partkey") % 1300).alias("k")), "k")


@query(", w AS (SELECT lon, lat, sum(1.0) AS w FROM points GROUP BY 1, 2), d AS (SELECT a.lon, a.lat, sum(b.w * pow(1 - (pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) / 0.000025, 2)) AS density FROM w a JOIN w b ON (pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) / 0.000025 < 1 GROUP BY 1, 2) SELECT event_id AS id, round(density, 2) AS density FROM points p JOIN d ON p.lon = d.lon AND p.lat = d.lat", "points")
def heat_density(spark, d):
    p = L.points(spark, d).select(F.col("event_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(1.0).alias("w"))
    return A.heat_density(p, 0.005).withColumn("density", F.round("density", 2))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no_offer' WHEN o_orderstatus = 'O' THEN 'not_arrived' WHEN o_orderkey % 5 = 0 THEN 'wrong_route' WHEN o_orderkey % 4 = 0 THEN 'taken' WHEN o_totalprice < 60000 THEN 'too_soon' ELSE 'payable' END AS state FROM orders")
def settle_reward(spark, d):
    k = F.col("o_orderkey")
    return L.table(spark, d, "orders").select("o_orderkey", S.settle_reward(k % 7 != 0, F.col("o_orderstatus") != "O", k % 5 != 0, k % 4 == 0, F.col("o_totalprice"), F.lit(120_000.0)).alias("state"))


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    """Integers that may be missing, as doubles: both sides then show a missing one alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def requests(spark, d):
    o = L.table(spark, d, "orders")
    at = lambda k, a, b: ((F.lit(-122.53) + F.pmod(k * a, F.lit(179)) / 1000.0), (F.lit(37.69) + F.pmod(k * b, F.lit(149)) / 1000.0))
    (olon, olat), (dlon, dlat) = at(F.col("o_custkey"), 13, 29), at(F.col("o_orderkey"), 17, 11)
    return o.select(F.col("o_orderkey").alias("request"), olon.alias("o_lon"), olat.alias("o_lat"), dlon.alias("d_lon"), dlat.alias("d_lat"))


def places_of(spark, d, kind, key):
    """Events of one kind as something at a point."""
    return L.points(spark, d).filter(F.col("event_type") == kind).select(F.col("event_id").alias(key), "lon", "lat", "t")


NEAREST = "SELECT * FROM (SELECT {a}, {b}, m, row_number() OVER (PARTITION BY {a} ORDER BY m, {b}) AS k FROM (SELECT {a}, {b}, " + HAV.format(a="x.", b="q.p").replace("q.plat", "q.plat") + " AS m FROM {x} x JOIN places q ON abs(x.lat - q.plat) < 0.05) WHERE m <= {r}) WHERE k = 1"


@query(
    """SELECT event, venue, round(metres, 3) AS metres, named FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY NOT named, metres, venue) AS k FROM (SELECT event_id AS event, place_id AS venue, """ + HAV.format(a="p.", b="q.p")
    + """ AS metres, contains((event_id % 40)::VARCHAR, (place_id % 9 + 1)::VARCHAR) AS named FROM points p JOIN places q ON abs(p.lat - q.plat) < 0.02) WHERE metres <= 800 AND (named OR metres <= 60)) WHERE k = 1""",
    "points", "places",
)
def match_venue(spark, d):
    events = L.points(spark, d).select(F.col("event_id").alias("event"), (F.col("event_id") % 40).cast("string").alias("name"), "lon", "lat")
    venues = L.places(spark, d).select(F.col("place_id").alias("venue"), (F.col("place_id") % 9 + 1).cast("string").alias("venue_name"), "plon", "plat")
    return M.match_venue(events, venues).withColumn("metres", F.round("metres", 3))


@query(
    """, c AS (SELECT event_id AS closure, lon, lat, t AS c_start, CASE WHEN event_id % 7 <> 0 THEN t + (event_id % 5) * 3600 ELSE t + 10800 END AS c_end FROM points WHERE event_type = 'click'),
    e AS (SELECT event_id AS event, lon AS plon, lat AS plat, t AS e_start, t + 7200 AS e_end FROM points WHERE event_type = 'purchase'),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY closure ORDER BY m, event) AS k FROM (SELECT closure, event, e_start, e_end, """.lstrip() + HAV.format(a="c.", b="e.p")
    + """ AS m FROM c JOIN e ON e_start <= c_end AND c_start <= e_end) WHERE m <= 3000) WHERE k = 1)
    SELECT c.closure, f.event::DOUBLE AS event, CASE WHEN f.event IS NULL THEN 'closure' ELSE 'public_event' END AS kind, coalesce(f.e_start, c_start) AS start_s, coalesce(f.e_end, c_end) AS end_s FROM c LEFT JOIN f ON c.closure = f.closure""",
    "points",
)
def closure_event_cases(spark, d):
    end = F.when(F.col("closure") % 7 != 0, F.col("t") + (F.col("closure") % 5) * 3600)
    closures = places_of(spark, d, "click", "closure").select("closure", "lon", "lat", F.col("t").alias("c_start"), end.alias("c_end"))
    events = places_of(spark, d, "purchase", "event").select("event", F.col("lon").alias("plon"), F.col("lat").alias("plat"), F.col("t").alias("e_start"), (F.col("t") + 7200).alias("e_end"))
    return doubles(M.closure_event_cases(closures, events, 3000.0, 10_800), "event")


@query(
    """, c AS (SELECT route, pos, seg, arrive_s % 8640000 AS t FROM trips), p AS (SELECT seg % 100 AS seg, t % 8640000 AS t, max(speed) AS delay FROM readings GROUP BY 1, 2),
    a AS (SELECT c.*, p.t AS t1, p.delay AS d1 FROM c ASOF LEFT JOIN p ON c.seg = p.seg AND c.t >= p.t), b AS (SELECT a.*, p.t AS t2, p.delay AS d2 FROM a ASOF LEFT JOIN p ON a.seg = p.seg AND a.t <= p.t),
    h AS (SELECT route, CASE WHEN t2 IS NULL OR t - t1 <= t2 - t THEN t - t1 ELSE t2 - t END AS gap, CASE WHEN t2 IS NULL OR t - t1 <= t2 - t THEN d1 ELSE d2 END AS d FROM b)
    SELECT route, round(sum(d) FILTER (WHERE gap <= 86400), 4) AS delay, count(d) FILTER (WHERE gap <= 86400) AS matched, count(*) AS cells FROM h GROUP BY route""".lstrip(),
    "trips", "readings",
)
def nearest_forecast(spark, d):
    cells = L.trips(spark, d).select("route", "pos", "seg", (F.col("arrive_s") % 8_640_000).alias("t"))
    preds = L.readings(spark, d).groupBy((F.col("seg") % 100).alias("seg"), (F.col("t") % 8_640_000).alias("t")).agg(F.max("speed").alias("delay"))
    return M.nearest_forecast(cells, preds, 86_400).withColumn("delay", r4("delay"))


@query(
    """, o AS (SELECT o_orderkey AS request, -122.53 + ((o_custkey * 13) % 179) / 1000.0 AS lon, 37.69 + ((o_custkey * 29) % 149) / 1000.0 AS lat FROM orders), dd AS (SELECT o_orderkey AS request, -122.53 + ((o_orderkey * 17) % 179) / 1000.0 AS lon, 37.69 + ((o_orderkey * 11) % 149) / 1000.0 AS lat FROM orders),
    a AS (""".lstrip() + NEAREST.format(a="request", b="place_id", x="o", r=1500) + "), b AS (" + NEAREST.format(a="request", b="place_id", x="dd", r=1500)
    + """) SELECT o.request, a.place_id::DOUBLE AS origin, b.place_id::DOUBLE AS dest, CASE WHEN a.place_id IS NULL THEN 'no_origin' WHEN b.place_id IS NULL THEN 'no_dest' WHEN a.place_id = b.place_id THEN 'same_road' ELSE 'ok' END AS outcome
    FROM o LEFT JOIN a ON a.request = o.request LEFT JOIN b ON b.request = o.request""",
    "places",
)
def snap_requests(spark, d):
    return doubles(M.snap_requests(requests(spark, d), L.places(spark, d), 1500.0), "origin", "dest")


@query(
    "SELECT event_id AS point_id, CASE WHEN m <= 1000 THEN 'near' WHEN m <= 3000 THEN 'between' ELSE 'far' END AS zone FROM (SELECT event_id, min(" + HAV.format(a="p.", b="q.p") + ") AS m FROM points p JOIN places q ON place_id % 10 = 1 GROUP BY event_id)",
    "points", "places",
)
def near_far_mask(spark, d):
    roads = L.points(spark, d).select(F.col("event_id").alias("point_id"), "lon", "lat")
    return M.near_far_mask(roads, L.places(spark, d).filter("place_id % 10 = 1"))


PAIRED = "SELECT o_custkey AS family, o_orderkey % 9 AS seed, o_orderkey AS run, o_orderkey % 2 = 0 AS with_event, o_orderkey % 5 AS part FROM orders"


@query(
    f"""SELECT family, seed, event_run::DOUBLE AS event_run, control_run::DOUBLE AS control_run, CASE WHEN e = 0 THEN 'no_event' WHEN c = 0 THEN 'no_control' WHEN e > 1 OR c > 1 THEN 'ambiguous' WHEN parts > 1 THEN 'crosses_parts' ELSE 'paired' END AS status FROM
    (SELECT family, seed, count(*) FILTER (WHERE with_event) AS e, count(*) FILTER (WHERE NOT with_event) AS c, min(run) FILTER (WHERE with_event) AS event_run, min(run) FILTER (WHERE NOT with_event) AS control_run, count(DISTINCT part) AS parts FROM ({PAIRED}) GROUP BY 1, 2)"""
)
def event_control_pairs(spark, d):
    o = L.table(spark, d, "orders")
    runs = o.select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 9).alias("seed"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 2 == 0).alias("with_event"), (F.col("o_orderkey") % 5).alias("part"))
    return doubles(M.event_control_pairs(runs, "family", "seed"), "event_run", "control_run")


def candidate_cells(spark, d):
    return L.trips(spark, d).select(F.col("route").alias("request"), F.col("pos").alias("candidate"), "seg", F.col("length").alias("eta"))


SCORED = """, load AS (SELECT seg, count(*) AS load FROM trips GROUP BY seg), s AS (SELECT route AS request, pos AS candidate, sum(length) AS eta, sum((2 * load + 1) / 100.0) AS delta FROM trips JOIN load USING (seg) GROUP BY 1, 2)"""


@query(SCORED.lstrip() + " SELECT request, candidate, eta, round(delta, 4) AS delta, row_number() OVER (PARTITION BY request ORDER BY eta + 0.5 * delta, candidate) = 1 AS best FROM s", "trips")
def score_candidates(spark, d):
    load = L.trips(spark, d).groupBy("seg").agg(F.count("*").alias("load"))
    return P.score_candidates(candidate_cells(spark, d), load, 0.5, 10.0).select("request", "candidate", "eta", r4("delta").alias("delta"), "best")


@query(
    """SELECT request, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'several' WHEN eta IS NULL THEN 'unknown' WHEN eta - fastest > least(180, fastest * 0.15) THEN 'detour' END AS problem FROM (SELECT route AS request, min(length) AS fastest FROM trips GROUP BY 1)
    LEFT JOIN (SELECT o_orderkey AS request, 1 + o_custkey % 4 AS candidate, 1 + (o_custkey % 11 = 0)::INT AS n FROM orders WHERE o_custkey % 13 <> 0) USING (request) LEFT JOIN (SELECT route AS request, pos AS candidate, min(length) AS eta FROM trips GROUP BY 1, 2) USING (request, candidate)""",
    "trips",
)
def validate_choices(spark, d):
    o = L.table(spark, d, "orders").filter("o_custkey % 13 <> 0").select(F.col("o_orderkey").alias("request"), (1 + F.col("o_custkey") % 4).cast("int").alias("candidate"), "o_custkey")
    return P.validate_choices(candidate_cells(spark, d), o.unionByName(o.filter("o_custkey % 11 = 0")).drop("o_custkey"))


VERSUS = "(SELECT r.policy, r.block, r.metric - b.metric AS diff, b.metric AS base FROM runs r JOIN runs b ON r.block = b.block AND b.policy = '5-LOW' WHERE r.policy <> '5-LOW')"


@query(
    f"""SELECT *, reduced AND consistent AND guarded AS promote FROM (SELECT policy, sum(diff) / sum(base) <= -0.01 AS reduced, count(*) FILTER (WHERE diff < 0) > count(*) FILTER (WHERE diff > 0) AS consistent, max(diff / base) <= 0.5 AS guarded FROM {VERSUS} GROUP BY policy)""",
    "runs",
)
def target_checks(spark, d):
    return P.target_checks(A.policy_vs_base(L.runs(spark, d), "5-LOW", "metric"), 0.01, 0.5)


@query("SELECT policy, round(mean, 3) AS mean, CASE k WHEN 1 THEN 'best' ELSE 'challenger' END AS role FROM (SELECT policy, avg(metric) AS mean, row_number() OVER (ORDER BY avg(metric), policy) AS k FROM runs WHERE block % 3 = 0 GROUP BY policy) WHERE k <= 2", "runs")
def select_policy(spark, d):
    return P.select_policy(L.runs(spark, d), F.col("block") % 3 == 0).withColumn("mean", F.round("mean", 3))


@query(
    """, g AS (SELECT seg % 20 AS crowd, route % 3 = 0 AS p, CASE WHEN pos < 6 THEN length END AS s FROM trips)
    SELECT crowd, count(*) FILTER (WHERE p) AS part_trips, round(count(s) FILTER (WHERE p) / count(*) FILTER (WHERE p), 4) AS part_arrived, round(avg(s) FILTER (WHERE p), 4) AS part_mean_s,
    count(*) FILTER (WHERE NOT p) AS other_trips, round(count(s) FILTER (WHERE NOT p) / count(*) FILTER (WHERE NOT p), 4) AS other_arrived, round(avg(s) FILTER (WHERE NOT p), 4) AS other_mean_s FROM g GROUP BY crowd""".lstrip(),
    "trips",
)
def group_outcomes(spark, d):
    trips = L.trips(spark, d).select((F.col("seg") % 20).alias("crowd"), (F.col("route") % 3 == 0).alias("participant"), F.when(F.col("pos") < 6, F.col("length")).alias("seconds"))
    out = P.group_outcomes(trips, "crowd")
    return out.select(*(r4(c).alias(c) if c.endswith(("arrived", "mean_s")) else c for c in out.columns))


@query("SELECT seg, t - t % 300 AS win, sum(weight)::BIGINT AS observed_s, coalesce(sum(weight) FILTER (WHERE speed < 40), 0)::BIGINT AS congested_s, coalesce(sum(weight) FILTER (WHERE speed < 5), 0)::BIGINT AS stopped_s FROM readings GROUP BY 1, 2", "readings")
def congestion_exposure(spark, d):
    return P.congestion_exposure(L.readings(spark, d).withColumnRenamed("weight", "seconds"), 40, 5)


@query(
    """, h AS (SELECT seg % 50 AS seg, t - t % 86400 AS bucket, round(avg(speed) FILTER (WHERE source = 'click'), 6) - round(avg(speed) FILTER (WHERE source = 'view'), 6) AS diff FROM readings GROUP BY 1, 2),
    top AS (SELECT seg, bucket AS peak_bucket, diff AS peak FROM h WHERE diff IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seg ORDER BY diff DESC, bucket) = 1)
    SELECT seg, peak_bucket, round(peak, 4) AS peak, (min(bucket) FILTER (WHERE bucket > peak_bucket AND diff < 0.1 * peak))::DOUBLE AS recovered FROM top JOIN h USING (seg) GROUP BY seg, peak_bucket, peak""".lstrip(),
    "readings",
)
def pair_impact(spark, d):
    side = lambda s: F.round(F.avg(F.when(F.col("source") == s, F.col("speed"))), 6)
    cells = L.readings(spark, d).groupBy((F.col("seg") % 50).alias("seg"), (F.col("t") - F.col("t") % 86400).alias("bucket")).agg(side("click").alias("event"), side("view").alias("control"))
    return doubles(P.pair_impact(cells), "recovered").withColumn("peak", r4("peak"))


@query(
    """, f AS (SELECT seg, bucket AS a, bucket + 600 + 600 * (n % 2) AS b, CASE WHEN speed >= 1 THEN speed END AS speed, speed / 90 AS ratio FROM (SELECT seg, bucket, count(*) AS n, round(max(speed), 6) AS speed FROM buckets GROUP BY 1, 2)), g AS (SELECT *, lead(a) OVER (PARTITION BY seg ORDER BY a) AS nxt FROM f)
    SELECT problem, count(*) AS rows FROM (SELECT unnest([CASE WHEN b <= a THEN 'empty_interval' END, CASE WHEN nxt > b THEN 'gap' END, CASE WHEN nxt < b THEN 'overlap' END, CASE WHEN speed IS NULL THEN 'no_speed' END, CASE WHEN ratio NOT BETWEEN 0 AND 1 THEN 'ratio_range' END]) AS problem FROM g) WHERE problem IS NOT NULL GROUP BY problem""".lstrip(),
    "readings", "buckets",
)
def validate_forecast(spark, d):
    f = buckets(spark, d).groupBy("seg", F.unix_timestamp("bucket").alias("valid_from")).agg(F.count("*").alias("n"), F.round(F.max("speed"), 6).alias("speed"))
    return P.validate_forecast(f.select("seg", "valid_from", (F.col("valid_from") + 600 + 600 * (F.col("n") % 2)).alias("valid_to"), F.when(F.col("speed") >= 1, F.col("speed")).alias("speed"), (F.col("speed") / 90).alias("ratio")))


@query(
    """RECURSIVE e AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 24 = 7 THEN c_custkey + 1 ELSE c_custkey - c_custkey % 8 END AS b FROM customer WHERE c_custkey % 3 > 0), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT c_custkey AS id, c_custkey AS other FROM customer UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON r.other = b.a), comp AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
    win AS (SELECT component, arg_min(id, {'p': -(id % 5), 'i': id}) AS winner FROM comp GROUP BY component) SELECT id, winner, id = winner AS kept FROM comp JOIN win USING (component)""".replace("RECURSIVE", "WITH RECURSIVE", 1)
)
def merge_classes(spark, d):
    k = F.col("c_custkey")
    c = L.table(spark, d, "customer")
    edges = c.filter(k % 3 > 0).select(k.alias("src"), F.when(k % 24 == 7, k + 1).otherwise(k - k % 8).alias("dst"))
    return G.merge_classes(c.select(k.alias("id"), (k % 5).alias("priority")), edges)
