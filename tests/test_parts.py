"""Work that is dealt to parts once, sought in rings, or written once, on small examples."""

import datetime
import itertools
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from roadweave.operators import features as FT
from roadweave.operators import graph as G
from roadweave.operators import joins as J
from roadweave.operators import matching as M
from roadweave.operators import pressure as PR
from roadweave.operators import routing as R
from roadweave.operators import scoring as P
from roadweave.operators import streets as ST
from roadweave.plans.queries import QUERIES


def deals(df) -> list[int]:
    """The numbers of parts of the exchanges by hash, in the plan's order."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [int(n) for n in re.findall(r"hashpartitioning\(.*?(\d+)\), ", plan)]


@pytest.fixture
def cells(spark, monkeypatch):
    monkeypatch.setattr(J, "ROWS_A_PART", 10)
    k = F.col("id")
    return spark.range(200).select((k % 9).alias("request"), (k % 36).alias("candidate"), (k % 5).alias("seg"), (k % 7).alias("length"), (k % 11).alias("eta"), F.lit(0.5).alias("ratio"), (k % 9).alias("route"), k.alias("pos"), (k * 60).alias("t"))


def test_requests_are_dealt_once(spark, cells):
    """one exchange of cells, into parts that grow with them."""
    load = spark.createDataFrame([(k, 2) for k in range(4)], "seg long, load long")
    assert deals(R.candidate_overlaps(cells)) == deals(R.candidate_features(cells, load)) == deals(P.score_candidates(cells, load, 0.5, 10.0)) == [21]
    few = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, 2.0), (1, 2, 1, 1.0), (1, 2, None, 3.0), (1, None, 1, 1.0), (2, 5, 1, 1.0)], "request long, candidate long, seg long, eta double")
    assert {tuple(r) for r in R.candidate_overlaps(few).collect()} == {(1, 1, 0.5, 1.0), (1, 2, 0.25, 0.25), (1, None, 0.0, 0.0), (2, 5, 0.0, 1.0)}


def test_forecasts_are_dealt_to_parts_that_grow(spark, cells):
    """F35, F38."""
    preds = spark.createDataFrame([(k % 5, 60 * k, 1.0) for k in range(20)], "seg long, t long, delay double")
    assert 27 in deals(M.nearest_forecast(cells, preds, 600))


def test_few_roads_are_sent_to_routes(spark, cells):
    """a road's buckets aren't shuffled with the roads of routes."""
    forecast = spark.createDataFrame([(k, b, 2.0 + b) for k in range(4) for b in range(3)], "seg long, bucket long, pace double")
    depart = cells.groupBy("route").agg(F.min("pos").alias("depart_s"))
    found = R.time_route(cells, depart, forecast, 50, 3)
    assert 21 in deals(found) and not any("paces" in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(route" in line)


def test_copies_of_the_kernel_are_not_shuffled(spark):
    """F31."""
    e = spark.createDataFrame([(1, 7, 650), (1, 7, 950), (2, 7, 10)], "request long, seg long, entry_s long")
    found = PR.timed_cells(e, "request", kernel=(0.25, 0.5, 0.25))
    assert len(deals(found)) == 1 and sorted(map(tuple, found.filter("request = 1").collect())) == [(1, 7, 1, 0.25), (1, 7, 2, 0.75), (1, 7, 3, 0.75), (1, 7, 4, 0.25)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning")


def test_routes_are_dealt_once_before_they_meet(spark, cells):
    """no exchange by a route and more."""
    incidents = spark.createDataFrame([(1, 2, "a", False, 0, 500_000)], "incident long, seg long, label string, is_closure boolean, start_s long, end_s long")
    found = J.incidents_on_route(cells.withColumn("arrive_s", F.col("t")), incidents)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len({m for m in re.findall(r"Exchange hashpartitioning\(route#\d+L, \d+\)", plan)}) >= 2 and "hashpartitioning(route#" not in re.sub(r"hashpartitioning\(route#\d+L, \d+\)", "", plan)
    assert found.count() == 9


def test_a_search_sends_nothing_to_the_driver(spark, monkeypatch):
    """F25; and F29: arcs and forecast are written before the first round."""
    seen, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(df))
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert sorted(r["node"] for r in G.largest_scc(arcs).collect()) == [1, 2, 3] and not any("Broadcast" in plan for _, plan in seen)
    seen.clear()
    f = spark.createDataFrame([(n, 0, 10.0, False) for n in range(1, 5)], "node long, bucket long, seconds double, closed boolean")
    out = G.earliest_arrival(arcs, spark.createDataFrame([(1, 0.0)], "node long, depart_s double"), f, 600, 1)
    assert sorted((r["node"], r["arrive_s"]) for r in out.collect()) == [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)]
    assert [c for c, _ in seen[:2]] == [["src", "dst"], ["node", "bucket", "seconds"]]


def test_footprints_are_sought_in_rings(spark, monkeypatch):
    """as near as over all pairs, and what a small ring finds isn't sought again."""
    met, pairs = [], ST.near_pairs
    monkeypatch.setattr(ST, "near_pairs", lambda p, q, r, *keys: met.append((r, p.count())) or pairs(p, q, r, *keys))
    at = spark.range(400).select((F.col("id") % 20 / 1000.0).alias("lon"), (F.floor(F.col("id") / 20) / 1000.0).alias("lat"))
    own = at.filter("lon < 0.012").withColumn("case", F.lit(1)).unionByName(at.filter("lon = 0.003 and lat = 0.002").withColumn("case", F.lit(2)))
    want = pairs(at, own.select("case", F.col("lon").alias("plon"), F.col("lat").alias("plat")), 1600.0).groupBy("case", "lon", "lat").agg(F.min("metres").alias("metres"))
    assert sorted(map(tuple, ST.near_footprints(own, at, 1600.0).collect())) == sorted(map(tuple, want.collect()))
    assert [r for r, _ in met] == [100.0, 400.0, 1600.0] and met[0][1] > met[1][1] > met[2][1]


def test_features_go_to_their_own_road_alone(spark):
    """and no window is worked out anew for each row."""
    cells = spark.createDataFrame([(k % 4, k // 4, 5.0, 1, k == 39) for k in range(40)], "seg long, t long, speed double, category int, closed boolean")
    roads = spark.createDataFrame([(k, 100.0, 1.0, 10.0, 1.0, 0.0, 0.0, 1.0, 5.0, 0.5, True) for k in range(4)], "seg long, length_m double, lanes double, free_flow_mps double, road_rank double, oneway double, signal_at_end double, tomtom_covered double, dist_to_footprint_m double, heading_to_event_cos double, in_area boolean")
    arcs, near = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), spark.createDataFrame([(0, 3)], "seg long, other long")
    none = F.lit(None).cast("double")
    out = FT.feature_table(cells, roads, arcs, near, 2, 1, none, none, none)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower() and re.search(r"= own\) THEN (_extract_)?own#", plan)
    assert [r["closures_active_target"] for r in out.filter("seg = 3").orderBy("t").collect()] == [0.0] * 7 + [1.0] * 3


def test_roads_are_met_once_and_values_bound_once(spark, cells):
    """A road's buckets and closures come in one join, and a cell's bucket is sought once in the fold, not wherever it is used."""
    steps = cells.select("route", "pos", "seg", F.lit("a").alias("class"), F.lit(10.0).alias("metres"), F.lit(45.0).alias("free_s"))
    routes = steps.select("route").distinct().select("route", F.lit(0.0).alias("depart_s"), F.lit(0.0).alias("first_share"), F.lit(1.0).alias("last_share"))
    roads = steps.select("seg").distinct()
    forecast = roads.select("seg", F.lit(0).alias("bucket"), F.lit(1.0).alias("seconds"))
    closures = roads.filter("seg = 1").select("seg", F.lit(0).alias("begin_s"), F.lit(9).alias("end_s"), F.lit("lane").alias("kind"))
    arcs = roads.alias("a").crossJoin(roads.alias("b")).select(F.col("a.seg").alias("src"), F.col("b.seg").alias("dst"))
    timed, _ = R.time_checked(routes, steps, forecast, closures, arcs, 0, 300, 6)
    plan = timed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3 and len(re.findall(r"lambda \w+#\d+\.bucket", plan)) == 1
    assert max(deals(timed)) >= 200 // 10
    assert sorted((r["route"], r["arrive_s"], r["reason"], r["metres"], r["flags"]) for r in timed.collect()) == [(k, float(n), None, 10.0 * n, "partial_restriction_on_route") for k in range(9) for n in [len(range(k, 200, 9))]]


def test_the_order_of_cells_decides_no_tie(spark):
    """three roads and one road that grow alike are a tie, in whichever order the three arrive."""
    load = spark.createDataFrame(list(enumerate([1999, 117, 1597, 3714])), "seg long, load long")
    for order in itertools.permutations(range(3)):
        cells = spark.createDataFrame([(1, 2, seg, 1.0) for seg in order] + [(1, 1, 3, 3.0)], "request long, candidate long, seg long, eta double").coalesce(1)
        got = {r["candidate"]: (r["eta"], r["delta"], r["best"]) for r in P.score_candidates(cells, load, 0.5, 10.0).collect()}
        assert got == {1: (3.0, got[1][1], True), 2: (3.0, got[1][1], False)}


def test_all_places_within_are_ranked(spark, tmp_path):
    """the query has no cap, and points of one position, or of the same two, take its list as it is."""
    spark.createDataFrame([(k, 1, "view", datetime.datetime(2024, 1, 1)) for k in (0, 900)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k * 179 * 149,) for k in range(8)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r["point_id"], r["rank"], r["place_id"]) for r in QUERIES["nearest_within"](spark, str(tmp_path)).collect())
    assert got == [(p, k + 1, k * 179 * 149) for p in (0, 900) for k in range(8)]
    points = spark.createDataFrame([(p, x, 0.0) for p, x in ((1, 0.0), (1, 0.001), (2, 0.001), (2, 0.0), (3, 0.0), (None, 0.001))], "point_id long, lon double, lat double")
    places = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.002, 0.0), (9, 1.0, 0.0)], "place_id long, plon double, plat double")
    found = [(r["point_id"], r["place_id"], r["rank"]) for r in J.nearest_within(points, places, 250.0).collect()]
    both = lambda p: [(p, 7, 1), (p, 7, 2), (p, 8, 3), (p, 8, 4)]
    assert sorted(found, key=str) == sorted(both(1) + both(2) + [(3, 7, 1), (3, 8, 2), (None, 7, 1), (None, 8, 2)], key=str)


def test_pairs_come_up_behind_the_last_exchange(spark):
    """a road meets lists of events, so an exchange has a row a position and part of the table, or a row a position and road."""
    events = spark.range(3000).select(F.col("id").alias("event"), (F.col("id") % 3 / 1000.0).alias("lon"), F.lit(0.0).alias("lat"))
    events = events.unionByName(spark.createDataFrame([(None, -0.0, 0.0), (5, 0.001, -0.0), (6, None, 0.0)], "event long, lon double, lat double"))
    roads = spark.createDataFrame([(k, k / 1000.0, 0.0) for k in range(8)], "road long, plon double, plat double")
    out = ST.event_road_pairs(events, roads, 450.0, 120.0, (500,))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(__ids") < plan.index("Join") and "RepartitionByExpression" in plan
    want = events.join(roads, F.expr("abs(lon - plon) < 0.0041")).select("event", "road", (F.abs(F.col("lon") - F.col("plon")) < 0.0011).alias("inside"))
    assert sorted(out.select("event", "road", "inside").collect(), key=str) == sorted(want.collect(), key=str)


def test_near_conditions_are_counted_in_arrays(spark, monkeypatch):
    """no row a point and condition; the same rows as of joined lists, and of a plain loop, for several places of a point or condition too."""
    rng = random.Random(5)
    place = lambda: (rng.randrange(5) / 1000.0, rng.randrange(3) / 1000.0)
    points = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(30), None]), *place()) for _ in range(90)] + [("d", 1, 9.0, 9.0), ("e", 1, None, 0.0)]
    conditions = [(rng.choice([*range(25), None]), *place()) for _ in range(40)]
    p, c = spark.createDataFrame(points, "route string, pos long, lon double, lat double"), spark.createDataFrame(conditions, "condition long, plon double, plat double")
    near = lambda a, b: a[0] is not None and math.hypot(a[0] - b[0], a[1] - b[1]) < 0.0015
    want = []
    for route in {r for r, *_ in points}:
        at = defaultdict(list)
        for _, pos, *xy in (x for x in points if x[0] == route and x[1] is not None):
            at[pos].append(xy)
        for k in {k for k, *_ in conditions} - {None}:
            hits = sum(any(near(xy, q) for xy in xys for i, *q in conditions if i == k) for xys in at.values())
            if hits and hits / len(at) >= 0.3:
                want.append((route, k, hits / len(at)))
    out = ST.conditions_along(p, c, 167.0, 0.3)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and len(want) > 20
    monkeypatch.setattr(ST, "MOST_NEAR", 3)
    assert sorted(map(tuple, ST.conditions_along(p, c, 167.0, 0.3).collect()), key=str) == sorted(want, key=str)
    assert ST.conditions_along(p.limit(0), c, 167.0, 0.3).count() == ST.conditions_along(p, c.limit(0), 167.0, 0.3).count() == 0


def test_cases_of_one_place_and_hours_search_once(spark, monkeypatch):
    """and of the events of one place and hours the smallest is met; closures without a start, place or end keep their rows."""
    met, pairs = [], M.near_pairs
    monkeypatch.setattr(M, "near_pairs", lambda p, q, r, *keys: met.append((p.count(), q.count())) or pairs(p, q, r, *keys))
    c = spark.createDataFrame([(k, 0.0, 0.0, 100, 200 + k % 2) for k in range(20)] + [(20, 0.0, 0.0, None, 5), (21, None, 0.0, 100, 200), (22, 0.0, 0.0, 100, None)], "closure long, lon double, lat double, c_start long, c_end long")
    e = spark.createDataFrame([(90 - k, 0.0, 0.001 * (k % 2), 200 + k % 2, 300) for k in range(20)], "event long, plon double, plat double, e_start long, e_end long")
    found = {r["closure"]: (r["event"], r["kind"], r["start_s"], r["end_s"]) for r in M.closure_event_cases(c, e, 500.0, 10_800).collect()}
    assert found == {k: (72, "public_event", 200, 300) for k in [*range(20), 22]} | {20: (None, "closure", None, 5), 21: (None, "closure", 100, 200)}
    assert met == [(5, 2)]


def test_records_of_one_place_and_time_meet_as_a_list(spark):
    """twenty records of two places are two lists, and the pairs those of a plain loop."""
    rows = [(k, k % 3, "c" if k < 18 else None, 0.001 * (k % 2), 0.0, 100 * (k % 2)) for k in range(20)] + [(20, 0, "c", None, 0.0, 0), (21, None, "c", 0.0, 0.0, 0), (22, 9, "c", 0.0, 0.0, 900)]
    df = spark.createDataFrame(rows, "id long, source long, category string, lon double, lat double, t long")
    out = J.cross_source_pairs(df, 200.0, 300)
    want = [(a, b, "c") for a in range(18) for b in range(a + 1, 18) if a % 3 != b % 3]
    assert sorted(map(tuple, out.collect())) == want
    assert "a_own" in out._jdf.queryExecution().analyzed().toString()
