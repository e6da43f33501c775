"""Experiments, forecast maps and vehicles in service: nulls, empty tables, ties."""

import pytest
from pyspark.sql import functions as F

from roadweave.operators import experiments as EX
from roadweave.operators import lines as LN


def test_groups_without_arrivals_or_base(spark):
    rows = [("base", 1, 1, True, 100.0, 1000.0, 360.0), ("base", 1, 1, True, 300.0, 1000.0, 360.0), ("base", 1, 1, None, None, 5.0, None), ("new", 1, 1, True, 100.0, 1000.0, 0.0), ("new", 1, 1, True, None, 9.0, 360.0), ("new", 1, 1, False, 50.0, 100.0, 0.0), ("new", 1, 2, True, 1.0, 1.0, 1.0), ("new", 2, 1, True, 1.0, 1.0, 1.0)]
    trips = spark.createDataFrame(rows, "policy string, crowd int, block int, participant boolean, seconds double, metres double, scope_s double")
    got = {(r["crowd"], r["participant"]): r for r in EX.group_changes(trips, "base", ["crowd"], ["block"]).collect()}
    assert set(got) == {(1, True), (1, False)}  # other blocks have no base
    app, other = got[1, True], got[1, False]
    assert (app["pairs"], app["unequal"], app["trips"], app["home_base"], app["home"]) == (1, 0, 2, 1.0, 0.5)
    assert app["mean_change"] == pytest.approx(-50) and app["p95_change"] == pytest.approx(100 * (100 - 290) / 290) and app["hours_change"] == pytest.approx(-50)
    assert app["kmh_base"] == pytest.approx(18) and app["kmh"] == pytest.approx(36)
    assert (other["home_base"], other["home"], other["mean_change"], other["p95_change"]) == (0.0, 1.0, None, None)
    assert EX.group_changes(trips.limit(0), "base", ["crowd"], ["block"]).count() == 0


def test_exposure_of_all_and_in_scope(spark):
    steps = spark.createDataFrame([(0, 1.0, 1, 4.0, True), (10, 1.0, 1, 6.0, None), (299, 2.0, 1, 0.05, False), (300, 1.0, 1, 5.0, True), (0, 1.0, 9, 0.0, True), (0, 1.0, 2, None, True)], "t int, dt_s double, seg int, speed double, in_scope boolean")
    roads = spark.createDataFrame([(1, 10.0), (2, 10.0)], "seg int, free_flow double")
    pending = spark.createDataFrame([(5, 1.0, 3), (605, 1.0, 1)], "t int, dt_s double, vehicles int")
    one = EX.exposure(steps, roads, pending).first().asDict()
    assert one == {"observed_all": 6.0, "congested_all": 4.0, "stopped_all": 2.0, "observed_scope": 3.0, "congested_scope": 2.0, "stopped_scope": 0.0, "pending_scope": 4.0}
    by = {r["win"]: (r["observed_all"], r["pending_scope"]) for r in EX.exposure(steps, roads, pending, "win").collect()}
    assert by == {0: (5.0, 3.0), 300: (1.0, 0.0), 600: (0.0, 1.0)}
    assert {r["seg"]: r["stopped_all"] for r in EX.exposure(steps, roads, pending, "seg").collect()} == {1: 2.0, 2: 0.0, None: 0.0}


def test_families_go_together(spark):
    runs = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True), (4, "b", False), (5, "c", True), (6, "d", True), (7, "d", False)], "run int, family string, with_event boolean")
    problems = spark.createDataFrame([(3, "late"), (3, "late"), (3, "early"), (6, "x"), (7, "y"), (1, None), (99, "z")], "run int, problem string")
    got = {r["run"]: (r["selected"], r["reasons"]) for r in EX.select_runs(runs, problems).collect()}
    assert got == {
        1: (True, []), 2: (True, []), 3: (False, ["early", "late"]), 4: (False, ["paired run excluded (3: early, late)"]), 5: (False, ["no pair with and without the event"]),
        6: (False, ["x", "paired run excluded (7: y)"]), 7: (False, ["y", "paired run excluded (6: x)"]),
    }


def a_map(spark, **changed):
    fine = dict(seg=1, issued_s=600, model="m", network="n", availability="open", restriction=None, source="model", travel_time=9.0, represented_by=None)
    rows = [{**fine, "horizon_min": 10 * (k + 1), "from_s": 600 * (k + 1), "to_s": 600 * (k + 2)} for k in range(6)]
    rows[2] |= changed
    names = ["seg", "horizon_min", "issued_s", "from_s", "to_s", "model", "network", "availability", "restriction", "source", "travel_time", "represented_by"]
    types = "seg int, horizon_min int, issued_s long, from_s long, to_s long, model string, network string, availability string, restriction string, source string, travel_time double, represented_by int"
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], types)


@pytest.mark.parametrize(
    ("changed", "problems"),
    [
        ({}, {}), ({"travel_time": float("nan")}, {"no_travel_time": 1}), ({"travel_time": None, "availability": "closed"}, {}), ({"travel_time": None, "source": "none"}, {}),
        ({"travel_time": 0.0, "availability": "restricted", "restriction": EX.PARTIAL}, {"no_travel_time": 1}), ({"availability": None}, {"unknown_availability": 1}), ({"seg": 7}, {"unknown_road": 1}), ({"to_s": None}, {"wrong_interval": 1}),
        ({"horizon_min": 20, "from_s": 1200, "to_s": 1800}, {"repeated_key": 1, "missing_horizon": 1}), ({"horizon_min": None}, {"unknown_horizon": 1, "missing_horizon": 1, "wrong_interval": 1}),
        ({"source": "representative_road"}, {"outside_representative": 1}), ({"source": "representative_road", "represented_by": 2}, {}), ({"network": "other"}, {"several_networks": 2, "other_network": 1}), ({"source": None}, {"unknown_source": 1}),
    ],
)
def test_a_map_keeps_its_contract(spark, changed, problems):
    roads = spark.createDataFrame([(1,), (2,), (2,)], "seg int")
    none = spark.createDataFrame([], "begin_s long, end_s long")
    assert {r["problem"]: r["rows"] for r in EX.map_problems(a_map(spark, **changed), roads, none, "n").collect()} == problems


def test_empty_maps_closures_and_status(spark):
    roads, shut = spark.createDataFrame([(1,)], "seg int"), spark.createDataFrame([(5, 5), (5, None), (5, 6)], "begin_s long, end_s long")
    assert {r["problem"]: r["rows"] for r in EX.map_problems(a_map(spark).limit(0), roads, shut, "n").collect()} == {"empty": 1, "empty_closure": 2}
    issues = spark.createDataFrame([("a", 1000, True), ("a", 5000, False), ("a", 900, True), ("b", 100, True), ("c", 3000, True), ("d", 1, None)], "place string, issued_s long, valid boolean")
    got = {r["place"]: (r["issued_s"], r["status"]) for r in EX.map_status(issues, F.lit(2000)).collect()}
    assert got == {"a": (1000, "ok"), "b": (100, "stale"), "c": (3000, "not_yet_valid"), "d": (None, "missing")}


def test_typical_times_fall_back(spark):
    controls = spark.createDataFrame([(1, 0, 4.0), (1, 0, 6.0), (1, 43_200, None), (7, 0, 1.0)], "seg int, bucket long, travel_time double")
    roads = spark.createDataFrame([(1, 3.0), (2, 8.0)], "seg int, free_s double")
    got = {(r["seg"], r["bucket"]): (r["travel_time"], r["samples"]) for r in EX.typical_times(controls, roads, 43_200).collect()}
    assert got == {(1, 0): (5.0, 2), (1, 43_200): (3.0, 0), (2, 0): (8.0, 0), (2, 43_200): (8.0, 0)}


def test_vehicles_in_service(spark):
    roads = spark.createDataFrame([("east", [[-122.40, 37.70], [-122.39, 37.70]]), ("west", [[-122.39, 37.70], [-122.40, 37.70]])], "owner string, coords array<array<double>>")
    rows = [(1, "v", "L", 0, -122.400, None), (2, "v", "L", 60, -122.399, None), (3, "v", "L", 120, -122.399, 268.0), (4, "v", "L", 180, -122.399, None), (5, "v", "M", 240, -122.398, 90.0), (6, "v", "M", 500, -122.397, 90.0), (7, "v", "M", 500, -122.397, 90.0), (8, "v", "M", 560, -122.398, None), (9, None, "M", 600, -122.398, 90.0), (10, "w", "L", 0, -122.40, 90.0), (11, "w", "L", 60, -122.30, 90.0), (12, "x", None, 0, -122.4, 90.0), (13, "x", None, 60, -122.4, 90.0)]
    fixes = spark.createDataFrame([(i, v, l, t, x, 37.70, b) for i, v, l, t, x, b in rows], "id int, vehicle string, line string, t int, lon double, lat double, bearing double")
    pieces = LN.pieces_of(roads)
    got = {r["id"]: (r["seg"], round(r["mps"], 2)) for r in LN.service_speeds(fixes, pieces).collect()}
    # 2 moves east; 3 stands and points west; 4 stands without a bearing; 5 changes the line; 6 comes too late; 7 has no gap; 8 moves west; 11 jumps; 13 serves no line.
    assert got == {2: ("east", 1.47), 3: ("west", 0.0), 8: ("west", 1.47)}
    assert {r["id"] for r in LN.service_speeds(fixes, pieces, since_s=100).collect()} == {3, 8}


def test_ends_on_both_ways_of_a_street(spark):
    there = [[-122.40, 37.70], [-122.39, 37.70], [-122.39, 37.71]]
    roads = spark.createDataFrame([("a", there), ("b", there[::-1]), ("c", [[-122.40, 37.7001], [-122.39, 37.7001]]), ("far", [[-122.0, 37.0], [-122.1, 37.0]])], "owner string, coords array<array<double>>")
    points = spark.createDataFrame([(1, -122.395, 37.70), (2, -122.41, 37.70), (3, -122.3899, 37.71), (4, None, None)], "point int, lon double, lat double")
    got = {(r["point"], r["owner"]): (round(r["metres"], 1), r["share"], r["rank"]) for r in LN.snap_ends(points, LN.pieces_of(roads)).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (3, "a"), (3, "b")}  # c is 11 m away, 2 too far from all
    east, north = 0.01 * 111_320 * 0.79122, 0.01 * 111_132
    assert got[1, "a"][1] == pytest.approx(east / 2 / (east + north), rel=1e-3) and got[1, "b"][1] == pytest.approx(1 - got[1, "a"][1])
    assert got[3, "a"][:2] == (8.8, 1.0) and got[3, "b"][1] == 0.0 and [got[3, o][2] for o in "ab"] == [1, 2]
    wide = {r["owner"]: r["rank"] for r in LN.snap_ends(points, LN.pieces_of(roads), tie_m=12.0).filter("point = 1").collect()}
    assert wide == {"a": 1, "b": 2, "c": 3}
