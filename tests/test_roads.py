"""Lines, feeds, readers, graphs, policies and streams on small examples; functions that no registered query covers."""

import json
import time
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from roadweave.functions import events as EV
from roadweave.functions import scalars as S
from roadweave.operators import evaluation as E
from roadweave.operators import experiments as EX
from roadweave.operators import graph as G
from roadweave.operators import joins as J
from roadweave.operators import lines as X
from roadweave.operators import matching as M
from roadweave.operators import policy as P
from roadweave.operators import quality as Q
from roadweave.operators import readings as R
from roadweave.operators import streets as ST
from roadweave.operators import windows as W
from roadweave.sources import normalizers as N
from roadweave.sources import tables as T
from roadweave.streaming import jobs

K = 1 / 111_132.0  # degrees of a metre north


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def at(y, m, d, h=0, mi=0):
    return datetime(y, m, d, h, mi)


# Functions


def test_calls_and_addresses(spark):
    rows = spark.createDataFrame([("TRAFFIC STOP ACCIDENT",), ("1183",), ("STALLED VEHICLE",), ("CAR FIRE",), ("SIGALERT",), ("ROAD CLOSURE HAZARD",), (None,)], "t string")
    assert [r[0] for r in rows.select(S.incident_category(F.col("t"))).collect()] == ["other", "collision", "hazard", "fire", "closure", "closure", "other"]
    got = one(spark, S.location_tokens(F.lit("I280 N / Bunker Hill"), F.lit("12345 Main Street near 4th")), S.street_title(F.lit("HUBBELL ST between 07TH ST and 16TH ST")), S.norm_name(F.lit("The  Fillmore-West!")))
    assert got[0] == ["280", "4TH", "BUNKER", "HILL", "MAIN"] and got[1] == "Hubbell St between 07th St and 16th St" and got[2] == "fillmore west"


def test_credentials_are_masked_wherever_they_stand(spark):
    kind = StructType([StructField("a", StringType()), StructField("n", DoubleType())])
    df = spark.createDataFrame([(["see https://u:p@h/x", None], {"k": "token=abc&x=1"}, ("user@host", 1.0))], "l array<string>, m map<string,string>, s struct<a:string,n:double>")
    r = df.select(*(S.redact_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)).first()
    assert r["l"] == ["see https://***@h/x", None] and r["m"] == {"k": "token=***&x=1"} and r["s"] == ("user@host", 1.0) and kind


def test_times(spark):
    r = one(spark, S.local_seconds_to_utc(F.lit("2024-03-10").cast("date"), F.lit(12 * 3600)), S.local_seconds_to_utc(F.lit("2024-01-10").cast("date"), F.lit(0)), S.dispatch_time(F.lit("Sep 25 2026  5:59PM")), S.epoch_any(F.lit("1700000000000")), S.epoch_any(F.lit("0")), *S.local_day_bounds(F.lit(" 07/04/2024")))
    assert tuple(r) == (at(2024, 3, 10, 19), at(2024, 1, 10, 8), at(2026, 9, 26, 0, 59), at(2023, 11, 14, 22, 13).replace(second=20), None, at(2024, 7, 4, 7), at(2024, 7, 5, 7))
    weeks = one(spark, S.typical_buckets(F.lit("2024-03-12 17:34:00").cast("timestamp"), F.lit("2024-03-12 17:00:00").cast("timestamp")))[0]
    assert weeks == [at(2024, 3, 5, 18, 30), at(2024, 2, 27, 18, 30), at(2024, 2, 20, 18, 30), at(2024, 2, 13, 18, 30)]  # the same clock before summer time


def test_roads_without_a_limit(spark):
    rows = spark.createDataFrame([(30, 25.0, "trunk"), (0, 25.0, "trunk"), (None, None, "trunk"), (None, None, "footway")], "p int, m double, c string")
    v, why = S.free_flow_fallback(F.col("p"), F.col("m"), F.col("c"))
    assert [tuple(r) for r in rows.select(v, why).collect()] == [(30.0, "posted"), (25.0, "maxspeed"), (40.0, "class"), (25.0, "default")]
    r = one(spark, S.maxspeed_mph(F.lit("['35 mph', '25 mph']")), S.maxspeed_mph(F.lit("40")), S.maxspeed_mph(F.lit("none")), S.first_of_list(F.lit("['Oak', 'Elm']")), S.first_of_list(F.lit("Ash")), S.id_key(F.lit("123.0")), S.id_key(F.lit("x")), S.truthy(F.lit(" Yes")))
    assert tuple(r) == (25.0, 24.9, None, "Oak", "Ash", "123", None, True)
    m = one(spark, S.measured_travel_time(F.lit(0.0), F.lit(9.0), F.lit(100.0)), S.measured_travel_time(F.lit(9.0), F.lit(4.0), F.lit(100.0)), S.from_z(F.lit(0.0), F.lit(100.0), F.lit(10.0))["travel_time"])
    assert tuple(m) == (200.0, None, 10.0)


def test_bearings_and_far_north(spark):
    r = one(spark, S.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), S.angle_diff(F.lit(350.0), F.lit(20.0)), S.point_segment_m(F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(K * 50), F.lit(1.0), F.lit(K * 50)))
    assert r[0] == pytest.approx(90.0) and r[1] == pytest.approx(30.0) and r[2] == pytest.approx(50.0, rel=0.01)
    for lat in (0.0, 37.7, 60.0, 80.0, -70.0):
        places = spark.createDataFrame([(k, 10.0 + (k - 10) * 0.004, lat) for k in range(21)], "place_id long, plon double, plat double")
        point = spark.createDataFrame([(1, 10.0, lat)], "point_id long, lon double, lat double")
        want = places.filter(S.haversine_m(F.lit(10.0), F.lit(lat), F.col("plon"), F.col("plat")) <= 1000).count()
        assert J.nearest_within(point, places, 1000.0).count() == want > 3


def test_event_windows(spark):
    w = EV.crowd_windows(F.lit(10_000), F.lit(20_000), F.lit(False), F.lit("concert"))
    r = one(spark, EV.time_factor(F.lit(4600.0), w), EV.time_factor(F.lit(3700.0), w), EV.time_factor(F.lit(15_000.0), w), EV.crowd_phase(F.lit(19_500.0), w), EV.map_category(F.lit("concerts"), F.array(F.lit("parade"))), EV.map_status(F.lit("deleted"), F.lit("postponed")), EV.distance_factor(F.lit(450.0)))
    assert tuple(r) == (1.0, 0.5, 0.0, "leaving", "parade", "postponed", 0.5)


def test_closures_of_several_sources(spark):
    rows = [(1, "a", -122.4, 37.7, 0, 100, ["OAK", "ELM"]), (2, "b", -122.4, 37.7002, 50, None, ["OAK"]), (3, "b", -122.4, 37.7002, 200, 300, ["OAK"]), (4, "a", -122.4, 37.7, 0, 100, ["OAK", "ELM"]), (5, "c", -122.4, 37.7, 0, 9, [])]
    df = spark.createDataFrame(rows, "id long, source string, lon double, lat double, start_s long, end_s long, tokens array<string>")
    assert {(r["a_id"], r["b_id"]) for r in J.cross_source_closures(df).collect()} == {(1, 2), (2, 4)}


# Lines


@pytest.fixture(scope="module")
def streets(spark):
    """Two directions of a street of two blocks going north, and a cross street."""
    x, y = -122.4, 37.7
    up = lambda a, b: [[x, y + K * a], [x, y + K * b]]
    rows = [("n1", "A", "B", up(0, 100), "OAK", 100.0), ("n2", "B", "C", up(100, 200), "OAK", 100.0), ("s1", "B", "A", up(100, 0), "OAK", 100.0), ("x", "B", "D", [[x, y + K * 100], [x + 0.001, y + K * 100]], "ELM", 88.0)]
    return spark.createDataFrame(rows, "seg string, u string, v string, coords array<array<double>>, name string, length double")


def pieces(streets):
    return X.pieces_of(streets.select(F.col("seg").alias("owner"), "coords"))


def test_a_heading_tells_two_directions_apart(spark, streets):
    points = spark.createDataFrame([("up", -122.39999, 37.7 + K * 50, 5.0), ("down", -122.39999, 37.7 + K * 50, 185.0), ("across", -122.39999, 37.7 + K * 50, 95.0)], "point string, lon double, lat double, heading double")
    assert {(r["point"], r["owner"]) for r in X.nearest_heading(points, pieces(streets), 20.0, 45.0).collect()} == {("up", "n1"), ("down", "s1")}
    assert {r["owner"] for r in X.nearest_lines(points.filter("point = 'up'"), pieces(streets), 20.0).collect()} == {"n1", "s1"}


def test_lines_snap_to_roads_without_detours(spark, streets):
    x, y = -122.40001, 37.7
    line = [[x, y + K * 5], [x, y + K * 60], [x, y + K * 98], [x + 0.0001, y + K * 99], [x, y + K * 104], [x, y + K * 190]]
    got = X.snap_lines(spark.createDataFrame([("l", line)], "key string, coords array<array<double>>"), pieces(streets), streets).orderBy("place").collect()
    assert [r["seg"] for r in got] == ["n1", "n2"] and got[0]["metres"] == pytest.approx(93, abs=2)
    ends = {"a": ("1", "2"), "b": ("2", "3"), "q": ("2", "9")}
    assert X.prune_detours([("a", 1.0), ("q", 2.0), ("b", 3.0)], ends) == [("a", 1.0), ("b", 3.0)] and X.prune_detours([], ends) == []


def test_side_steps_go_as_the_rule_says():
    """Against the rule itself: while a road stands between two that join without it, and doesn't lie between them, the first such one goes."""
    rng = random.Random(6)
    ends = {f"r{k}": (rng.randrange(4), rng.randrange(4)) for k in range(12)}
    for _ in range(400):
        path = [(f"r{rng.randrange(12)}", float(k)) for k in range(rng.randrange(9))]
        left = [r for k, (r, _) in enumerate(path) if not k or r != path[k - 1][0]]
        while bad := [k for k in range(1, len(left) - 1) if ends[left[k - 1]][1] == ends[left[k + 1]][0] and ends[left[k]] != (ends[left[k - 1]][1], ends[left[k + 1]][0])]:
            del left[bad[0]]
        assert X.prune_detours(path, ends) == [x for x in path if x[0] in left]


def test_upserts_start_from_nothing_and_keep_faults(spark, tmp_path):
    table = str(tmp_path / "t")
    put = T.upsert_batch(table, ["id"], "v")
    rows = lambda *x: spark.createDataFrame(x, "id int, v int, date string")
    put(rows((1, 1, "a"), (2, 1, "b")), 0)
    put(rows((1, 2, "a"), (1, 1, "a"), (3, 1, "a")), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(table).select("id", "v", "date").collect()) == [(1, 2, "a"), (2, 1, "b"), (3, 1, "a")]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]
    (tmp_path / "bad" / "date=a").mkdir(parents=True)
    (tmp_path / "bad" / "date=a" / "x.parquet").write_text("not a table")
    with pytest.raises(Exception):
        T.upsert_batch(str(tmp_path / "bad"), ["id"], "v")(rows((1, 1, "a")), 0)
    assert (tmp_path / "bad" / "date=a" / "x.parquet").read_text() == "not a table"


def test_lines_cover_edges(spark, streets):
    lines = spark.createDataFrame([("up", [[-122.40005, 37.7], [-122.40005, 37.7 + K * 200]])], "owner string, coords array<array<double>>")
    edges = streets.select(F.col("seg").alias("owner"), "coords")
    assert {(r["owner"], r["way"]) for r in X.covering_lines(edges, lines).collect()} == {("n1", "same_direction"), ("n2", "same_direction")}
    assert {(r["owner"], r["way"]) for r in X.covering_lines(edges, lines, reverse=True).collect()} == {("n1", "same_direction"), ("n2", "same_direction"), ("s1", "undirected_line")}


def test_closures_close_edges_of_their_street(spark, streets):
    edges = streets.withColumnRenamed("seg", "edge")
    rows = [("c1", [[-122.4, 37.7], [-122.4, 37.7 + K * 100]], "OAK", "all-lanes-closed", "both"), ("c2", [[-122.4, 37.7], [-122.4, 37.7 + K * 100]], "PINE", "some", "both"), ("c3", [[-122.4, 37.7 + K * 100], [-122.4, 37.7 + K * 400]], "OAK", "some", "north")]
    closures = spark.createDataFrame(rows, "closure string, coords array<array<double>>, street string, impact string, direction string")
    matched = X.match_closures(closures, edges)
    assert {(r["closure"], r["edge"]) for r in matched.collect()} == {("c1", "n1"), ("c1", "s1"), ("c3", "n2")}
    status = {r["closure"]: (r["status"], r["flags"]) for r in X.closure_coverage(closures, matched, edges).collect()}
    assert status == {"c1": ("matched", []), "c2": ("unmatched", []), "c3": ("ambiguous", ["partial_coverage", "direction_treated_as_both"])}
    assert {(r["edge"], r["restriction"]) for r in X.closed_edges(matched, closures).collect()} == {("n1", "full"), ("s1", "full"), ("n2", "partial")}
    mids = spark.createDataFrame([("n1", -122.4, 37.7 + K * 50), ("far", -122.3, 37.7)], "edge string, lon double, lat double")
    assert [tuple(r) for r in X.edges_of_line(closures.filter("closure = 'c1'").select(F.col("closure").alias("key"), "coords"), mids).collect()] == [("c1", "n1")]


def test_records_borrow_from_streets(spark, streets):
    s = streets.select(F.col("seg").alias("cnn"), "coords")
    nodes = spark.createDataFrame([("N9", -122.4, 37.71)], "cnn string, nlon double, nlat double")
    records = spark.createDataFrame([(1, "n1", None, None), (2, "N9", None, None), (3, None, -122.39999, 37.7 + K * 150), (4, "zz", None, None), (5, None, None, None)], "id long, cnn string, lon double, lat double")
    got = {r["id"]: (r["cnn"], r["match"], r["lat"] is not None) for r in X.enrich_from_streets(records, s, nodes).collect()}
    assert got == {1: ("n1", "segment", True), 2: ("N9", "intersection", True), 3: ("n2", "segment", True), 4: ("zz", "unknown", False), 5: (None, "unknown", False)}


# Feeds and readers


def test_shapes(spark):
    shapes = ['{"type":"Point","coordinates":[-122.40000001,37.7,9]}', '{"type":"Polygon","coordinates":[[[0,1],[1,1],[1,0],[0,1]]]}', '{"type":"Polygon","coordinates":[[[0,1],[1,1],[1,0]]]}', '{"type":"LineString","coordinates":[[1,2]]}', '{"type":"Point","coordinates":[0,0]}', '{"latitude":"37.7","longitude":"-122.4"}', None, '{"type":"Circle","coordinates":[1,2]}', '{"type":"Point","coordinates":[200,2]}']
    df = spark.createDataFrame([(s,) for s in shapes], "s string")
    rows = df.select(N.positions_of(F.col("s")).alias("p"), N.geometry_errors(F.col("s")).alias("e")).collect()
    assert rows[0]["p"] == [[-122.4, 37.7]] and len(rows[1]["p"]) == 4 and rows[5]["p"] == [[-122.4, 37.7]] and rows[6]["p"] is None
    assert [r["e"] for r in rows] == [[], [], ["open ring"], ["line of one position"], ["invalid coordinate"], [], [], ["unsupported type"], ["invalid coordinate"]]
    r = df.limit(2).select(N.middle_vertex(N.positions_of(F.col("s")))[0], N.inside_box(N.positions_of(F.col("s")), N.CITY_BOX)).collect()
    assert r[0][1] is True and r[1][1] is False


def test_feeds_become_records(spark):
    point = '{"type":"Point","coordinates":[-122.4,37.7]}'
    feeds = {
        "street_closures": spark.createDataFrame([("1", "Special Event", "Fair", "OAK ST", "1ST", "2ND", "ok", "12.0", "2024-01-01T00:00:00.000Z", "2024-01-02T00:00:00.000Z", point), ("2", "Other", None, None, None, None, None, None, "2024-01-03T00:00:00.000", "2024-01-02T00:00:00.000", None)], "object_id string, type string, case_name string, street string, from_st string, to_st string, status string, cnn string, start_utc string, end_utc string, shape string"),
        "police_dispatch": spark.createDataFrame([("7", "1183 collision", None, "2024-01-01T00:00:00.000", None, "A \\ B", None, "true"), ("8", "noise", None, "2024-01-01T00:00:00.000", None, None, point, None), ("9", None, "SIGALERT", "2024-01-01T00:00:00.000", None, None, point, None)], "id string, call_type_final_desc string, call_type_original_desc string, received_datetime string, close_datetime string, intersection_name string, intersection_point string, sensitive_call string"),
        "lane_closures": spark.createDataFrame([("i1", "c", "-122.4", "37.7", "-122.41", "37.7", "US-101", "1700000000", "1700003600", "false", "All", "Lane"), ("i2", "c", "-118.0", "34.0", None, None, None, "1700000000", None, "true", "1", "Full"), ("i3", "c", None, None, None, None, None, "1", None, "true", "1", "Lane")], "index string, closure_id string, begin_lon string, begin_lat string, end_lon string, end_lat string, route string, start_epoch string, end_epoch string, end_indefinite string, lanes_closed string, type_of_closure string"),
        "highway_incidents": spark.createDataFrame([("a", "Sep 25 2026  5:59PM", "1125 hazard", "X", "SF", "GGCC", None, "37700000:122400000"), ("b", "Sep 25 2026  5:59PM", "1183", "X", "LA", "LACC", None, "0:0"), ("c", None, "1183", "X", "SF", "GGCC", None, "0:0")], "log_id string, log_time string, log_type string, location string, area string, center string, dispatch string, latlon string"),
        "street_use_permits": spark.createDataFrame([("p", "x", "ok", "OAK", None, "2024-01-01", "2024-02-01", point)], "permit_number string, permit_type string, status string, streetname string, cnn string, permit_start_date string, permit_end_date string, shape string"),
        "excavation_permits": spark.createDataFrame([("q", "ok", "77", "2024-01-01", "2024-02-01"), ("q", "ok", "77", "2024-01-02", "2024-02-01")], "permit_number string, status string, cnn string, effective_date string, expiration_date string"),
    }
    assert feeds.keys() == N.NORMALIZERS.keys()
    records = N.all_records(feeds).cache()
    got = {(r["source"], r["source_id"]): (r["is_closure"], r["category"], r["location_status"], r["errors"]) for r in records.collect()}
    assert got == {
        ("street_closures", "1"): (True, "Special Event", "exact", []), ("street_closures", "2"): (True, "Other", "exact", ["ends before it starts", "closure without a place"]),
        ("police_dispatch", "7"): (False, "collision", "withheld", []), ("police_dispatch", "9"): (True, "closure", "exact", []),
        ("lane_closures", "i1"): (True, "lane_closure", "exact", []), ("lane_closures", "i3"): (False, "lane_closure", "exact", ["no begin coordinates", "closure without a place"]),
        ("highway_incidents", "a"): (False, "hazard", "exact", []), ("highway_incidents", "c"): (False, "collision", "unlocated", ["incident without a time"]),
        ("street_use_permits", "p"): (False, "street_use_permit", "exact", []), ("excavation_permits", "q"): (False, "excavation", "exact", []),
    }
    first = records.filter("source_id = 'q'").first()
    assert first["valid_from"] == at(2024, 1, 1, 8) and records.filter("source_id = 'i1'").first()["coords"] == [[-122.4, 37.7], [-122.41, 37.7]]
    raw = feeds["police_dispatch"].select(F.lit("police_dispatch").alias("source"))
    report = {r["source"]: tuple(r)[1:] for r in N.run_report(raw, records).collect()}
    assert report["police_dispatch"] == (3, 2, 0, 1, 1)
    view = {r["id"]: (r["description"], r["street"]) for r in N.condition_view(records).collect()}
    assert view["street_closures:1"] == ("Fair", "Oak St") and "police_dispatch:7" not in view
    lanes = spark.createDataFrame([("lane_closures", "All", None), ("lane_closures", "1", "Lane"), ("street_closures", None, None)], "s string, l string, k string")
    assert [r[0] for r in lanes.select(N.restriction_of(*(F.col(c) for c in "slk"))).collect()] == ["full", "lane", "full"]


def test_events_become_rows_with_reasons(spark):
    rows = [("1", "A", -122.4, 37.75, "America/Los_Angeles", "2024-07-04T20:00:00Z", "2024-07-04T19:00:00Z", "2024-07-04T23:00:00Z", "concerts", ["x"], None, None), ("2", "B", -122.4, 37.75, None, "2024-07-04T00:00:00", None, None, "public-holidays", None, "deleted", "cancelled"), ("3", "C", -100.0, 37.75, "Z", "2024-07-04T20:00:00Z", None, None, "sports", None, None, None), ("4", "D", None, None, "Z", None, None, None, None, None, None, None)]
    out = {r["title"]: r for r in N.normalize_events(spark.createDataFrame(rows, "id string, title string, lon double, lat double, zone string, start string, end string, predicted_end string, category string, labels array<string>, state string, deleted_reason string")).collect()}
    a, b = out["A"], out["B"]
    assert (a["category"], a["status"], a["end"], a["end_is_predicted"], a["all_day"], a["reason"]) == ("concert", "active", at(2024, 7, 4, 23), True, False, None)
    assert (b["category"], b["status"], b["start"], b["all_day"]) == ("holiday", "cancelled", at(2024, 7, 4, 7), True)
    assert (out["C"]["reason"], out["D"]["reason"]) == ("outside", "no_location")
    events = spark.createDataFrame([("e1", "Jazz Night", None, "v", None, at(2024, 1, 1), None, "active", None), ("e2", None, None, None, None, at(2024, 1, 1), None, None, None), ("e3", "Gone", None, None, None, at(2024, 1, 1), None, "deleted", None)], "event string, title string, category string, venue_id string, venue_name string, start timestamp, end timestamp, status string, closure_ids array<string>")
    assert [(r["event"], r["kind"], r["venue"]) for r in N.event_view(events, spark.createDataFrame([("v", "Hall")], "venue_id string, name string")).collect()] == [("e1", "music", "Hall")]
    placed = events.filter("title is not null").select("event", "start", F.lit(-122.4).alias("lon"), F.lit(37.75).alias("lat"))
    assert [r["event"] for r in N.listed_events(placed, placed.withColumn("lon", F.lit(0.0)), most=1).collect()] == ["e1"]


def test_day_files_and_snapshots(spark, tmp_path):
    for day, lines in (("2024-01-01", ['{"a": 1}', "nope", "[1]"]), ("2024-01-02", ['{"a": 2}']), ("2024-01-09", ['{"a": 3}'])):
        (tmp_path / f"{day}.jsonl").write_text("\n".join(lines))
    (tmp_path / "geometry.jsonl").write_text('{"a": 9}')
    rows = T.scan_day_files(spark, str(tmp_path), StructType([StructField("a", DoubleType())]), "2024-01-01", "2024-01-03").cache()
    assert sorted(r["a"] for r in rows.filter("_corrupt_record is null").collect()) == [1.0, 2.0]
    assert {r["day"]: (r["lines"], r["bad"]) for r in T.bad_lines(rows).collect()} == {"2024-01-01": (3, 2), "2024-01-02": (1, 0)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"source": "x", "pulled_at": "t", "records": [{"k": 1}, {"k": 2}]}))
    (tmp_path / "s" / "b.json").write_text(json.dumps({"other": 1}))
    schema = spark.createDataFrame([], "source string, pulled_at string, records array<struct<k:int>>").schema
    good, bad = T.scan_snapshot(spark, str(tmp_path / "s"), schema)
    assert [(r["place"], r["record"]["k"]) for r in good.orderBy("place").collect()] == [(0, 1), (1, 2)] and bad.count() == 1
    T.backfill(spark, "2024-01-02", str(tmp_path), StructType([StructField("a", DoubleType())]), lambda df, day: df.select("a"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("a", "cast(day as string)").collect()] == [(2.0, "2024-01-02")]


def test_upserts_and_lists(spark, tmp_path):
    batch = T.upsert_batch(str(tmp_path / "t"), ["k"], "v")
    one_day = lambda *x: spark.createDataFrame(list(x), "k int, v int, date string")
    batch(one_day((1, 1, "d1"), (2, 1, "d2")), 0)
    batch(one_day((1, 2, "d1"), (3, 1, "d1")), 1)
    batch(one_day((1, 2, "d1"), (3, 1, "d1")), 1)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 2), (2, 1), (3, 1)]
    old = spark.createDataFrame([(1, ["a"], at(2024, 1, 1), at(2024, 1, 1))], "k int, names array<string>, first_seen_at timestamp, last_ingested_at timestamp")
    new = spark.createDataFrame([(1, ["b"]), (2, None)], "k int, names array<string>")
    got = {r["k"]: (r["names"], r["first_seen_at"], r["last_ingested_at"]) for r in T.upsert_doc(old, new, "k", ["names"], F.lit("2024-02-02").cast("timestamp")).collect()}
    assert got == {1: (["a", "b"], at(2024, 1, 1), at(2024, 2, 2)), 2: ([], at(2024, 2, 2), at(2024, 2, 2))}
    t = spark.createDataFrame([(k, at(2024, 1, k)) for k in (1, 2, 3, 9)], "k int, t timestamp")
    assert [r["k"] for r in T.latest_n(t, "t", 2, F.lit("2024-01-05").cast("timestamp"), "k").collect()] == [3, 2]
    plans = spark.createDataFrame([(1, at(2024, 1, 1), at(2024, 1, 9), "ok"), (2, at(2024, 1, 1), at(2024, 1, 2), "ok"), (3, at(2024, 1, 20), None, "void"), (4, at(2024, 4, 1), None, None)], "k int, a timestamp, b timestamp, status string")
    assert [r["k"] for r in T.active_or_upcoming(plans, F.col("a"), F.col("b"), F.lit("2024-01-05").cast("timestamp"), status="status", without=("void",)).collect()] == [1]
    h = spark.createDataFrame([(k * 600,) for k in range(5)], "t long")
    assert T.scan_history(h, 3000, 3).count() == 3
    with pytest.raises(ValueError):
        T.scan_history(h, 3600, 3)
    with pytest.raises(ValueError):
        T.scan_history(h, 2900, 3)


def test_replies_become_rows(spark):
    polls = spark.createDataFrame([(1, True, "absolute", [("k", 10.0, "c", None)]), (2, False, "absolute", [("k", 11.0, "c", True)])], "polled_at long, ok boolean, style string, lines array<struct<key:string,value:double,class:string,closed:boolean>>")
    assert [tuple(r) for r in R.explode_tile_lines(polls).collect()] == [(1, "absolute", "k", 10.0, False)]
    routes = spark.createDataFrame([("r", 1, [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]], [7.0, 8.0], [1.0, 2.0]), ("bad", 1, [[0.0, 1.0]], [7.0], [1.0])], "route string, polled_at long, coords array<array<double>>, distance_m array<double>, duration_s array<double>")
    assert [tuple(r)[2:] for r in R.flatten_routes(routes).orderBy("piece").collect()] == [(0, 0.0, 1.0, 2.0, 3.0, 7.0, 1.0), (1, 2.0, 3.0, 4.0, 5.0, 8.0, 2.0)]
    fixes = spark.createDataFrame([(1, ("v", "L", ("-122.4", "37.7"), "90")), (1, ("w", None, ("x", "37.7"), None)), (1, (None, None, ("-122.4", "37.7"), None))], "polled_at long, vehicle struct<id:string,line:string,location:struct<lon:string,lat:string>,bearing:string>")
    assert [tuple(r) for r in R.flatten_fixes(fixes).collect()] == [("v", "L", 1, -122.4, 37.7, 90.0)]
    known = spark.createDataFrame([("a",)], "key string")
    assert [r["key"] for r in R.new_geometry(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, x int"), known).collect()] == ["b"]


# Graphs and policies


def test_arrival_depends_on_time_and_closures(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (3, 4), (4, 5)], "src long, dst long")
    f = [(n, b, s, False) for n, s in ((1, 100.0), (2, 700.0), (3, 600.0), (4, 50.0)) for b in (0, 1)] + [(5, 0, 10.0, False), (5, 1, 900.0, False)]
    forecast = spark.createDataFrame([x if x[:2] != (3, 0) else (3, 0, 600.0, True) for x in f], "node long, bucket long, seconds double, closed boolean")
    start = spark.createDataFrame([(1, 0.0)], "node long, depart_s double")
    got = {r["node"]: (r["arrive_s"], r["beyond"]) for r in G.earliest_arrival(arcs, start, forecast, 600, 2).collect()}
    assert got == {1: (100.0, False), 2: (800.0, False), 4: (850.0, False), 5: (1750.0, False)}
    late = {r["node"]: r["beyond"] for r in G.earliest_arrival(arcs, start.withColumn("depart_s", F.lit(1150.0)), forecast, 600, 2).collect()}
    assert late == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_footprints_and_loads(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (9, 1), (3, 8), (4, 3)], "src long, dst long")
    near = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    assert {tuple(r) for r in G.footprint_subgraph(arcs, near).collect()} == {(1, True, False), (2, False, False), (3, True, True)}
    weighted = spark.createDataFrame([(1, 2, 5000.0), (2, 3, 5000.0), (1, 3, 20_000.0), (1, 4, 5000.0)], "src long, dst long, metres double")
    got = {r["node"]: r["load"] for r in G.route_loads(weighted, spark.createDataFrame([(1,)], "node long"), 5).collect()}
    one_, e, ee = 1.0, 0.36787944117144233, 0.1353352832366127
    total = one_ + 2 * e + ee
    assert got == pytest.approx({1: 1.0, 2: (e + ee) / total, 3: ee / total, 4: e / total})


def test_choices_see_those_before_them(spark):
    rows = [("b", 1, 0, 1, [10], 100.0), ("b", 1, 0, 2, [11], 101.0), ("b", 2, 1, 1, [10], 100.0), ("b", 2, 1, 2, [11], 101.0), ("c", 3, 0, 1, [10], 100.0), ("c", 3, 0, 2, [], 130.0)]
    c = spark.createDataFrame(rows, "batch string, request int, place int, candidate int, segs array<long>, eta double")
    load = spark.createDataFrame([(10, 1.0)], "seg long, load double")
    got = {(r["batch"], r["request"]): r["candidate"] for r in P.assign_in_order(c, load, 1.0, 1.0).collect()}
    assert got == {("b", 1): 2, ("b", 2): 1, ("c", 3): 1}
    assert {r["candidate"] for r in P.assign_in_order(c, load.limit(0), 0.0, 1.0).collect()} == {1}


def test_residual_model_beats_its_base(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("x"), F.lit(5.0).alias("base"), (5.0 + (F.col("id") % 10 >= 5).cast("double") * 4).alias("target"))
    model, error = P.residual_model(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["x"], grid=((2, 0.3),), rounds=8)
    assert error < 1.0
    out = P.residual_predictions(rows.withColumn("x", F.when(F.col("id") > 0, F.col("x"))), model, ["x"], F.lit(0.0), F.lit(8.0)).collect()
    assert max(r["predicted"] for r in out) == 8.0 and next(r for r in out if r["id"] == 0)["predicted"] == 5.0


def test_levels_digests_and_members(spark):
    levels = spark.createDataFrame([(0.5, 0.5), (1.0, 2.0)], "level double, ratio double")
    assert E.level_at_one(levels).first()[0] == pytest.approx(0.7071, abs=1e-3)
    rows = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("q", 1, 2), ("q", 1, 1), ("q", 2, 5), ("p", 2, 6)], "policy string, block int, x int")
    bad = Q.unequal_digests(Q.content_digest(rows, "block", "policy"), "block", "policy").collect()
    assert [r["block"] for r in bad] == [2]
    share = E.observed_share(spark.createDataFrame([(1, 1, True), (1, 2, False)], "bucket int, seg int, observed boolean")).first()["share"]
    assert share == 0.5


# Streams


def run_stream(spark, tmp_path, batches, schema, job, name):
    """The rows that a job gives over batches, one file each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = job(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    # Timeouts by processing time keep a query running batches, so it is stopped two batches after it has read all rows.
    total, last, until = sum(map(len, batches)), None, time.time() + 100
    while time.time() < until:
        done = [p for p in q.recentProgress if p["batchId"] >= 0]
        if sum(p["numInputRows"] for p in done) >= total:
            last = done[-1]["batchId"] if last is None else last
            if done[-1]["batchId"] >= last + 2 or (not q.status["isTriggerActive"] and not q.status["isDataAvailable"]):
                break
        time.sleep(0.3)
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_changes_over_batches(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[(1, 1, 5), (1, 2, 5), (2, 1, 7)], [(1, 3, 5), (1, 4, 6)]], "id long, seq long, hash long", jobs.stream_change_only, "changes")
    assert sorted(got) == [(1, 1, 5), (1, 4, 6), (2, 1, 7)]


def test_vehicle_speeds_over_batches(spark, tmp_path):
    rows = [[(1, "a", 0, 0.0, 0.0), (1, "a", 60, 0.0, K * 600)], [(1, "a", 120, 0.0, K * 1200), (1, "b", 150, 0.0, K * 1300), (1, "b", 900, 0.0, 0.0)]]
    got = run_stream(spark, tmp_path, rows, "vehicle long, line string, t long, lon double, lat double", jobs.stream_vehicle_speeds, "speeds")
    assert [x[1:3] for x in sorted(got)] == [(60, 60), (120, 60)] and all(x[3] == pytest.approx(10.0, rel=0.01) for x in got)


def test_ratios_over_batches(spark, tmp_path):
    rows = [[("k", 0, "relative", 0.5), ("k", 10, "absolute", 30.0)], [("k", 43_000, "absolute", 20.0), ("k", 50_000, "absolute", 20.0), ("z", 1, "absolute", 9.0)]]
    got = run_stream(spark, tmp_path, rows, "key string, t long, style string, value double", jobs.stream_asof_ratio, "ratios")
    assert sorted((k, t, f) for k, t, _, f in got if f) == [("k", 10, 60.0), ("k", 43_000, 40.0)] and len(got) == 4


def test_assignments_move_expire_and_refuse(spark, tmp_path):
    t = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).replace(tzinfo=None)
    rows = [[("a", t(0), "propose", 0), ("b", t(0), "propose", 0), ("a", t(5), "propose", 0), ("a", t(10), "accept", 1)], [("a", t(20), "start", 1), ("a", t(21), "start", 2), ("b", t(100), "accept", 1), ("c", t(100), "accept", 1)], [("z", t(90_000), "propose", 0)], [("z", t(90_001), "propose", 0)]]
    got = run_stream(spark, tmp_path, rows, "assignment string, ts timestamp, command string, version int", lambda df: jobs.assignment_lifecycle(df.withWatermark("ts", "1 second")), "assignments")
    results = {(a, s - 1_700_000_000, r): (state, v) for a, s, state, v, r in got}
    assert results["a", 0, "done"] == ("provisional", 1) and results["a", 5, "same"] == ("provisional", 1) and results["a", 10, "done"] == ("accepted", 2)
    assert results["a", 20, "stale"] == ("accepted", 2) and results["a", 21, "done"] == ("active", 3) and results["b", 100, "refused"] == ("expired", 2) and results["c", 100, "unknown"] == (None, 0)
    assert ("a", 21 + 1800, "timeout") in results


def test_one_map_for_each_issue(spark, tmp_path):
    made = []
    rows = spark.createDataFrame([(datetime.fromtimestamp(1_700_000_000 + k, timezone.utc).replace(tzinfo=None),) for k in range(0, 2000, 50)], "ts timestamp")
    trigger = jobs.forecast_trigger(str(tmp_path / "runs"), "m", lambda df, issue: made.append(issue) or spark.createDataFrame([(issue,)], "issued long"), str(tmp_path / "maps"), lambda: 1_700_001_500)
    trigger(rows, 0)
    trigger(rows, 1)
    assert T.claimed(spark, str(tmp_path / "maps-claims" / f"m-{made[0]}"), "another") == spark.sparkContext.applicationId
    assert T.claimed(spark, str(tmp_path / "maps-claims" / "m-0"), "another") == "another"
    jobs.forecast_trigger(str(tmp_path / "other-runs"), "m", lambda df, issue: 1 / 0, str(tmp_path / "maps2"), lambda: 0)(rows, 0)  # nothing has closed yet
    (tmp_path / "maps3-claims").mkdir()
    (tmp_path / "maps3-claims" / f"m-{made[0]}").write_text("another")
    jobs.forecast_trigger(str(tmp_path / "runs3"), "m", lambda df, issue: 1 / 0, str(tmp_path / "maps3"), lambda: 1_700_001_500)(rows, 0)  # claimed by another
    assert len(made) == 1 and T.read_published(spark, str(tmp_path / "maps"), str(tmp_path / "runs")).count() == 1
    live = spark.createDataFrame([("a", 1, 10.0), ("b", 4, 20.0)], "assignment string, version int, arrive_s double")
    timed = spark.createDataFrame([("a", 15.0, 0), ("b", 99.0, 2)], "assignment string, arrive_s double, missing int")
    assert {tuple(r) for r in jobs.retime_live(live, timed).collect()} == {("a", 2, 15.0, False), ("b", 5, 20.0, True)}
    a, b = jobs.trip_window(F.lit(1000), F.lit(2000))
    assert tuple(one(spark, a, b)) == (-2700, 5700)


def test_fills_splits_and_draws(spark):
    assert W.hash_draw(spark.range(2000), "s", "id", 0.25).count() == pytest.approx(500, abs=80)
    counts = spark.createDataFrame([(1, 2, 5, 3)], "k int, t long, arrived long, running long")
    got = [(r["t"], r["arrived"], r["running"]) for r in W.fill_totals(counts, "k", 5, ["arrived"], ["running"]).orderBy("t").collect()]
    assert got == [(0, 0, 0), (1, 0, 0), (2, 5, 3), (3, 5, 0), (4, 5, 0)]


def test_nearest_by_positions_equals_all_pairs(spark, monkeypatch):
    """Points and places of one position search once: no pair of rows reaches a shuffle, and ranks are those of all pairs."""
    points = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 3 / 1000.0).alias("lon"), (F.col("id") % 2 / 1000.0).alias("lat"))
    places = spark.range(400).select(F.col("id").alias("place_id"), (F.col("id") % 4 / 1000.0).alias("plon"), F.lit(0.0).alias("plat"))
    want = J.nearest_within(points, places, 250.0).filter("rank <= 3").collect()
    found = J.nearest_within(points, places, 250.0, 3)
    assert sorted(found.collect()) == sorted(want) and len(want) == 9000
    met, pairs = [], J.near_pairs
    monkeypatch.setattr(J, "near_pairs", lambda p, q, r: met.append((p.count(), q.count())) or pairs(p, q, r))
    J.nearest_within(points, places, 250.0, 3)
    assert met == [(6, 12)]


def test_halves_go_up_whatever_the_sum(spark):
    """0.1 + 0.2 style noise around a half: sums in another order give the same rows."""
    rows = [(1, 0, w * 900.0, r) for w, r in ((1, 0.1), (1, 0.7), (1, 0.025))]
    for turned in (rows, rows[::-1]):
        found = E.road_occupancy(spark.createDataFrame(turned, "seg int, t long, car_s double, relative double").coalesce(1), 3600).first()
        assert found["speed"] == 0.3  # 0.275 is half way
    f = spark.createDataFrame([(1, 0, x, 1.0) for x in (1.001, 1.009)], "seg int, t long, free_flow double, metres double")
    assert R.latest_free_flow(f).first()["free_flow"] == 1.01  # 1.005 is below it as a double


def test_records_are_not_sent_whole(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 0), (2, 2, "a", 0.001, 0.0, 5)], "id long, source long, category string, lon double, lat double, t long")
    found = J.cross_source_pairs(rows, 500.0, 60)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in found.collect()] == [(1, 2, "a")]


def test_cover_of_single_representatives(spark):
    cover = spark.createDataFrame([(1, 0, 0.5), (1, 10, 0.2), (2, 0, 0.7), (3, 0, 0.1)], "seg long, bucket long, cover double")
    by = spark.createDataFrame([(7, 1), (8, 1), (8, 2), (3, 2), (9, None), (7, 1)], "seg long, represented_by long")
    want = [(1, 0, 0.5), (1, 10, 0.2), (2, 0, 0.7), (3, 0, 0.7), (7, 0, 0.5), (7, 10, 0.2), (8, 0, 0.7), (8, 10, 0.2)]
    assert sorted(map(tuple, EX.cover_by_representatives(cover, by).collect())) == want
    assert EX.cover_by_representatives(cover, by)._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_cases_meet_by_slots(spark, monkeypatch):
    met, pairs = [], M.near_pairs
    monkeypatch.setattr(M, "near_pairs", lambda p, q, r, *keys: met.append(keys) or pairs(p, q, r, *keys))
    c = spark.createDataFrame([(1, 0.0, 0.0, 100, 40_000), (2, 0.0, 0.0, 5, 3)], "closure long, lon double, lat double, c_start long, c_end long")
    e = spark.createDataFrame([(5, 0.0, 0.001, 39_000, 50_000), (4, 0.0, 0.0, 40_001, 50_000), (6, 0.0, 0.002, 0, 10)], "event long, plon double, plat double, e_start long, e_end long")
    found = M.closure_event_cases(c, e, 500.0, 10_800)
    assert sorted((r["closure"], r["event"]) for r in found.collect()) == [(1, 5), (2, 6)] and met == [("__slot",)]


def test_points_of_one_place_search_once(spark, monkeypatch):
    met, pairs = [], ST.near_pairs
    monkeypatch.setattr(ST, "near_pairs", lambda p, q, r: met.append(p.count()) or pairs(p, q, r))
    p = spark.range(40).select(F.col("id").alias("edge"), F.col("id").alias("point_id"), F.col("id").alias("event"), (F.col("id") % 4).alias("route"), F.col("id").alias("pos"), (F.col("id") % 2 / 1000.0).alias("lon"), F.lit(0.0).alias("lat"), F.lit("A").alias("name"))
    q = spark.createDataFrame([(1, 0.0, 0.0, "A", 30), (2, 0.001, 0.0, None, 20)], "street long, plon double, plat double, sname string, posted long")
    q = q.select("*", F.col("street").alias("place_id"), F.col("street").alias("road"), F.col("street").alias("condition"))
    assert {(r["edge"] % 2, r["street"], r["limit"]) for r in ST.link_streets(p, q, 150.0).collect()} == {(0, 1, 30), (1, 2, 20)}
    assert ST.segments_near(p, q, 150.0, 5.0).count() == 40 and ST.event_road_pairs(p, q, 50.0, 10.0, (500,)).count() == 40
    assert sorted(map(tuple, ST.conditions_along(p, q, 50.0, 0.5).collect())) == [(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 2, 1.0)]
    assert met == [2, 2, 2, 2]
    twice = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 0, 0.00001, 0.0), (0, 1, 0.0, 0.0), (0, 2, 0.5, 0.0), (0, None, 0.0, 0.0)], "route long, pos long, lon double, lat double")
    assert [tuple(r) for r in ST.conditions_along(twice, q, 50.0, 0.5).collect()] == [(0, 1, 2 / 3)]


def test_names_at_one_place_search_once(spark, monkeypatch):
    """events of one name and position, and venues of one name and position, are one row of the pairs."""
    met, pairs = [], M.near_pairs
    monkeypatch.setattr(M, "near_pairs", lambda p, q, r: met.append((p.count(), q.count())) or pairs(p, q, r))
    e = spark.range(60).select(F.col("id").alias("event"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("At the A"), F.col("id") % 3)).alias("name"), (F.col("id") % 2 / 100.0).alias("lon"), F.lit(0.0).alias("lat"))
    v = spark.range(50).select((50 - F.col("id")).alias("venue"), F.when(F.col("id") % 2 == 0, "a1").alias("venue_name"), (F.col("id") % 2 * 0.0002).alias("plon"), F.lit(0.0).alias("plat"))
    found = {(r["event"], r["venue"], r["named"]) for r in M.match_venue(e, v).collect()}
    assert found == {(k, 2, k % 3 == 1) for k in range(0, 60, 2)} and met == [(6, 2)]


def test_riders_are_counted_by_position(spark):
    """the same counts as of all pairs, though no row of a trip meets one of a place."""
    t = spark.range(400).select(F.col("id").alias("trip"), (F.col("id") % 3 / 100.0).alias("lon"), (F.col("id") % 4 / 100.0).alias("lat"), (F.col("id") * 7 % 90).alias("depart_s"), F.when(F.col("id") % 5 > 0, F.col("id") % 5 == 1).alias("arrived"))
    p = spark.range(60).select(F.col("id").alias("place"), (F.col("id") % 5 / 100.0).alias("plon"), (F.col("id") % 3 / 100.0).alias("plat"), F.when(F.col("id") != 59, F.col("id") * 11 % 100).alias("at_s"))
    rows, want = t.filter("not coalesce(arrived, false)").collect(), {}
    for r in p.collect():
        want[r["place"]] = sum(r["at_s"] is not None and abs(x["lat"] - r["plat"]) <= 1500 / 111_132 and abs(x["lon"] - r["plon"]) <= 1500 / 111_320 and abs(x["depart_s"] - r["at_s"]) <= 10 for x in rows)
    found = P.demand_to_place(t, p, 1500.0, 10)
    assert {r["place"]: r["riders"] for r in found.collect()} == want and sum(want.values()) > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and not any("depart_s" in line for line in joins)


def test_points_of_one_place_meet_pieces_once(spark, monkeypatch):
    """positions search, and pieces between the same ends are one where only the least owner counts."""
    met, near = [], X.near_pieces
    monkeypatch.setattr(X, "near_pieces", lambda p, q, r: met.append((p.count(), q.count())) or near(p, q, r))
    lines = spark.range(6).select(F.col("id").alias("owner"), F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(100 * K), F.lit(0.0))).alias("coords"))
    points = spark.range(30).select(F.col("id").alias("point"), (F.col("id") % 2 * 50 * K + 10 * K).alias("lon"), F.lit(0.0).alias("lat"), F.lit(90.0).alias("heading"))
    ends = X.snap_ends(points, X.pieces_of(lines), 20.0).collect()
    assert met == [(2, 6)] and sorted((r["point"], r["owner"], r["rank"]) for r in ends) == [(p, o, o + 1) for p in range(30) for o in range(6)]
    assert {(r["point"] % 2, round(r["share"], 4)) for r in ends} == {(0, 0.1), (1, 0.6)}
    assert sorted((r["point"], r["owner"]) for r in X.nearest_heading(points, X.pieces_of(lines), 20.0, 45.0).collect()) == [(p, 0) for p in range(30)] and met[1] == (2, 1)
