"""Navigation over streams, the review of closures over lines, hops of many cases, and edges of the feature table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_roads import run_stream

from roadweave.operators import features as FT
from roadweave.operators import graph as G
from roadweave.operators import navigation as NV
from roadweave.operators import review as RV
from roadweave.operators import routing as R
from roadweave.operators import windows as W
from roadweave.sources import normalizers as N
from roadweave.streaming import jobs

K = 1 / 111_132.0
FIX = "trip string, route string, t long, lon double, lat double, accuracy double"
ROUTE = "route string, coords array<array<double>>, steps array<struct<metres:double,seconds:double>>, end_lon double, end_lat double"


@pytest.fixture(scope="module")
def routes(spark):
    line = [[-122.4, 37.7], [-122.4, 37.7 + K * 500], [-122.4, 37.7 + K * 1000]]
    return spark.createDataFrame([("r", line, [(400.0, 40.0), (600.0, 90.0), (0.0, 0.0)], None, None), ("bare", line[:1], [(1.0, 1.0)], None, None), ("stepless", line, [], None, None)], ROUTE)


FIXES = [
    ("a", "r", 1, -122.4, 37.7 + K * 900, 500.0), ("a", "r", 2, -122.4, 37.7 + K * 200, 10.0), ("a", "r", 3, -122.41, 37.7 + K * 300, 10.0), ("a", "r", 4, -122.4002, 37.7 + K * 450, 10.0),
    ("a", "r", 5, -122.4, 37.7 + K * 990, 20.0), ("a", "r", 6, -122.4, 37.7 + K * 990, 80.0), ("b", "bare", 1, -122.4, 37.7, 5.0), ("c", "stepless", 1, -122.4, 37.7, 5.0), ("d", "r", 9, -122.401, 37.7 + K * 100, 95.0),
]


def test_progress_holds_off_the_route(spark, routes):
    got = {(r["trip"], r["t"]): r for r in NV.nav_progress(spark.createDataFrame(FIXES, FIX), routes).collect()}
    assert [got["a", t]["held"] for t in range(1, 7)] == [True, False, True, False, False, False] and got["a", 1]["step"] is None
    assert got["a", 2]["step"] == 0 and got["a", 2]["to_next_m"] == pytest.approx(200, abs=1) and got["a", 2]["left_m"] == pytest.approx(800, abs=1) and got["a", 2]["left_s"] == pytest.approx(110, abs=0.2)
    assert got["a", 3]["left_m"] == got["a", 2]["left_m"] and got["a", 4]["step"] == 1 and got["a", 4]["left_s"] == pytest.approx(82.5, abs=0.2)
    assert [got["a", t]["arrived"] for t in (4, 5, 6)] == [False, True, False]
    assert got["b", 1]["held"] and got["c", 1]["held"] and got["b", 1]["arrived"] and not got["d", 9]["held"]


def test_progress_of_a_stream_is_that_of_a_batch(spark, tmp_path, routes):
    got = run_stream(spark, tmp_path, [FIXES[:3], FIXES[3:4] + FIXES[6:], FIXES[4:6]], FIX, lambda df: jobs.stream_nav_progress(df, routes), "navigation")
    want = NV.nav_progress(spark.createDataFrame(FIXES, FIX), routes).select("trip", "t", "arrived", "held", *jobs.NAV_STATE).collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)


def test_fixes_are_placed_in_batches(spark):
    """Lines of many lengths, null ones among them, against a plain loop; no fix is folded row by row, and one on a route that isn't wholly known is held."""
    rng = np.random.default_rng(4)
    lines = {k: (rng.uniform(0, 0.01, (n, 2)).tolist(), [(float(m), float(s)) for m, s in rng.integers(0, 900, (n, 2))]) for k, n in enumerate(rng.integers(2, 40, 30))}
    odd = [("null", None, [(1.0, 1.0)]), ("steps", [[0.0, 0.0], [0.0, 0.01]], None), ("point", [[0.0, 0.0], [0.0], [0.0, 0.01]], [(1.0, 1.0)]), ("metres", [[0.0, 0.0], [0.0, 0.01]], [(None, 1.0), (2.0, 1.0)])]
    routes = spark.createDataFrame([(str(k), *x, None, None) for k, x in lines.items()] + [(*x, None, None) for x in odd], ROUTE)
    fixes = [(f"{k}/{t}", str(k), t, *map(float, np.add(lines[k][0][t], 1e-5)), 10.0) for k in lines for t in range(len(lines[k][0]))]
    out = NV.nav_progress(spark.createDataFrame(fixes + [(k, k, 0, 0.0, 0.005, 10.0) for k, *_ in odd], FIX).coalesce(1), routes)
    got = {r["trip"]: r for r in out.collect()}
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(got[k]["held"] for k, *_ in odd)
    for trip, route, _, lon, lat, _ in fixes:
        coords, steps = lines[int(route)]
        k, run, best = math.cos(math.radians(lat)), 0.0, (math.inf, 0.0)
        for (ax, ay), (bx, by) in zip(coords, coords[1:]):
            dx, dy, px, py = (bx - ax) * k, by - ay, (lon - ax) * k, lat - ay
            q = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
            off = round(math.hypot(px - q * dx, py - q * dy) * NV.DEGREE_M, 5)
            best = best if best[0] <= off else (off, run + q * math.hypot(dx, dy) * NV.DEGREE_M)
            run += math.hypot(dx, dy) * NV.DEGREE_M
        at, start, step = best[1] / run * sum(m for m, _ in steps), 0.0, 0
        while step < len(steps) - 1 and start + steps[step][0] <= at:
            start, step = start + steps[step][0], step + 1
        to_next = max(0.0, start + steps[step][0] - at)
        left_s = sum(s for _, s in steps[step + 1 :]) + (steps[step][1] * to_next / steps[step][0] if steps[step][0] else 0.0)
        r = got[trip]
        assert not r["held"] and r["step"] == step and (r["to_next_m"], r["left_m"], r["left_s"]) == pytest.approx((to_next, sum(m for m, _ in steps) - at, left_s), abs=1e-6)


def test_closures_are_reviewed_over_lines(spark):
    """An own street, its gap over a plaza, a road of another name under the gap, a short closure on a long edge, an alley without a road."""
    at = lambda x, a, b: [[-122.4 + x, 37.7 + K * a], [-122.4 + x, 37.7 + K * b]]
    edges = spark.createDataFrame([("e1", at(0, 0, 60), "MAIN"), ("e2", at(0.01, 0, 60), "OAK"), ("e3", at(0.01, 60, 100), "ELM"), ("e4", at(0.02, 0, 900), "PINE"), ("x", [[-122.401, 37.7 + K * 80], [-122.399, 37.7 + K * 80]], "CROSS")], "edge string, coords array<array<double>>, name string")
    closures = spark.createDataFrame([("plaza", at(0, 0, 100), "MAIN"), ("other", at(0.01, 0, 100), "OAK"), ("short", at(0.02, 100, 180), "PINE"), ("alley", at(0.03, 0, 100), "BACK")], "closure string, coords array<array<double>>, street string")
    matched = spark.createDataFrame([("plaza", "e1", 1.0, True, "MAIN"), ("other", "e2", 1.0, True, "OAK")], "closure string, edge string, overlap double, name_match boolean, edge_name string")
    along = RV.roads_along(closures, edges).join(edges.select("edge", "name"), "edge").join(closures.select("closure", "street"), "closure").withColumn("same_name", F.col("name") == F.col("street"))
    rest = RV.uncovered(closures, matched, edges)
    rows = closures.select("closure", F.lit("Permitted").alias("permit"), F.lit("all-lanes-closed").alias("impact"), F.when(F.col("closure").isin("plaza", "other"), "ambiguous").otherwise("unmatched").alias("match"), F.when(F.col("closure").isin("plaza", "other"), F.array(F.lit("partial_coverage"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit(True).alias("has_line"))
    got = {r["closure"]: (r["decision"], r["edges"]) for r in RV.review_closures(rows, matched, rest, along).collect()}
    assert got == {"plaza": ("accept", ["e1"]), "other": ("needs_review", ["e2"]), "short": ("accept", ["e4"]), "alley": ("no_drivable_road", [])}
    empty = RV.review_closures(rows.limit(0), matched.limit(0), rest.limit(0), along.limit(0))
    assert empty.collect() == []
    bare = RV.review_closures(rows.withColumn("permit", F.lit(None).cast("string")), matched.limit(0), rest.limit(0), along.limit(0)).collect()
    assert {(r["decision"], r["reason"]) for r in bare} == {("reject", "permit status unknown")}


def test_hops_of_cases_are_kept_apart(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1), (2, 2), (2, 3)], "src int, dst int")
    cases = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3), ("b", 2)], "case string, node int")
    assert {tuple(r) for r in G.case_hops(arcs, cases, 2).collect()} == {("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 3, 0), ("b", 2, 0), ("b", 4, 1)}
    assert {tuple(r) for r in G.case_hops(arcs, cases, 2, upstream=True).collect()} == {("a", 1, 0), ("a", 9, 1), ("b", 3, 0), ("b", 2, 0), ("b", 1, 1), ("b", 9, 2)}


def test_cells_of_the_feature_table_are_exchanged_twice(spark):
    cells = spark.range(40).select((F.col("id") % 4).alias("seg"), F.floor(F.col("id") / 4).cast("long").alias("t"), F.lit(5.0).alias("speed"), F.lit(1).alias("category"), F.lit(False).alias("closed"))
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    roads = spark.createDataFrame([(k, 100.0, 1.0, 10.0, 1.0, 0.0, 0.0, 1.0, 5.0, 0.5, True) for k in range(4)], "seg long, length_m double, lanes double, free_flow_mps double, road_rank double, oneway double, signal_at_end double, tomtom_covered double, dist_to_footprint_m double, heading_to_event_cos double, in_area boolean")
    arcs, near = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), spark.createDataFrame([(0, 0)], "seg long, other long")
    none = F.lit(None).cast("double")
    out = FT.feature_table(cells, roads, arcs, near, 2, 1, none, none, none)
    assert len(FT.FEATURES) == 40 and out.columns == ["seg", "t", *FT.FEATURES] and out.count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above, below = plan.split("BroadcastHashJoin", 1)  # what is joined there are columns of roads
    assert above.count("Exchange hashpartitioning") == 1 and below.split("BroadcastExchange")[0].count("Exchange hashpartitioning") == 1
    first = out.filter("seg = 1 and t = 0").first()
    assert first["event_declared"] == 0.0 and first["min_from_declared_start"] is None and first["up_speed_ratio"] == 0.5 and first["speed_ratio_l1"] is None and first["degree_in"] == 1.0


def test_repeats_over_days_and_patches_of_ties(spark):
    rows = [(k, 1, d * 10 + k % 10, v) for k, (d, v) in enumerate([(0, "a"), (0, "a"), (2, "a"), (2, "b"), (3, "b"), (3, None), (5, "b"), (5, "b")])]
    df = spark.createDataFrame(rows + [(99, None, 7, "z")], "id int, key int, t int, v string")
    want = {r["id"] for r in W.collapse_repeats(df, "key", ["t", "id"], "v").collect()}
    assert {r["id"] for r in W.collapse_repeats(df, "key", ["t", "id"], "v", day=F.floor(F.col("t") / 10)).collect()} == want
    same = spark.range(100).select(F.col("id"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    counts = W.balanced_patches(same, 30).groupBy("patch").count().collect()
    assert sorted(r["count"] for r in counts) == [25, 25, 25, 25] and W.balanced_patches(same.limit(0), 5).collect() == []


def test_local_times_are_held_against_utc(spark):
    rows = spark.createDataFrame([(1, "2024-01-10 16:00:00", "2024-07-10 16:00:00", "2024-01-10T08:00:00", "2024-07-10T09:00:00"), (2, "2024-07-10 16:00:00", None, "2024-07-10T08:00:00", "x"), (3, "2024-07-10 16:00:00", "2024-07-10 16:00:00", "soon", None)], "id int, s string, e string, start_local string, end_local string")
    rows = rows.select("id", F.col("s").cast("timestamp").alias("start_utc"), F.col("e").cast("timestamp").alias("end_utc"), "start_local", "end_local")
    got = {(r["id"], r["side"]): r["local_as_utc"] for r in N.local_time_issues(rows).collect()}
    assert set(got) == {(2, "start"), (3, "start")} and got[3, "start"] is None and got[2, "start"].hour == 15


def test_decisions_on_later_forecasts_leak(spark):
    rows = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.1, 10.0), (3, None, 10.0), (4, 9.0, 10.0)], "id int, issued_s double, decided_s double")
    assert {r["id"] for r in R.decided_in_time(rows).filter("leak").collect()} == {2, 3}


def test_routes_without_roads_are_refused(spark):
    routes = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0)], "route long, depart_s double, first_share double, last_share double")
    cells = spark.createDataFrame([(2, 1, 7, "a", 100.0, 9.0)], "route long, pos int, seg long, class string, metres double, free_s double")
    timed, spent = R.time_checked(routes, cells, spark.createDataFrame([], "seg long, bucket int, seconds double"), spark.createDataFrame([], "seg long, begin_s long, end_s long, kind string"), spark.createDataFrame([], "src long, dst long"), 0, 60, 6)
    got = {r["route"]: r for r in timed.collect()}
    assert got[1]["reason"] == "empty_route" and got[2]["arrive_s"] == 9.0 and got[2]["flags"] == "origin_cost_free_flow" and got[2]["metres"] == 100.0
    assert [tuple(r) for r in spent.collect()] == [(2, "a", 9.0)]
