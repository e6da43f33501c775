"""Quantiles against numpy, choices in order against a plain loop over whole batches, requests with stops."""

import datetime
import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import matching as M
from roadweave.operators import pressure as PR
from roadweave.operators import quantiles as QT
from roadweave.plans import policy_queries
from roadweave.plans.queries import ORACLE_SQL, QUERIES

SHARES = {"low": 0.0, "median": 0.5, "p95": 0.95, "high": 1.0}


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    return {
        "long tail": np.exp(rng.normal(0, 4, 500)).tolist(), "signs": rng.normal(0, 1, 301).tolist(), "ties": [5.0] * 400 + [6.0], "zeros": [0.0, -0.0, 0.0, 1.0], "one": [-7.25],
        "tiny and huge": [5e-324, 1.7e308, -1.7e308], None: [3.0, 1.0], "nothing": [None, float("nan"), float("inf")], "holes": [None, 2.0, float("nan"), 4.0, -float("inf")],
    }


def finite(values):
    return np.array([v for v in values if v is not None and np.isfinite(v)])


def test_exact_quantiles_are_those_of_numpy(spark, groups):
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in QT.exact_quantiles(rows, ["k"], F.col("v"), SHARES).collect()}
    assert set(got) == set(groups) - {"nothing"}
    for k in got:
        want = finite(groups[k])
        assert got[k]["values"] == len(want)
        if k != "tiny and huge":
            assert [got[k][n] for n in SHARES] == pytest.approx([np.quantile(want, q) for q in SHARES.values()])
    every = QT.exact_quantiles(rows.filter("k = 'signs'"), [], F.col("v"), SHARES).collect()
    assert [every[0][n] for n in SHARES] == pytest.approx([np.quantile(groups["signs"], q) for q in SHARES.values()])
    assert QT.exact_quantiles(rows.limit(0), ["k"], F.col("v"), SHARES).count() == 0


@pytest.mark.parametrize("error", [0.001, 0.02])
def test_sketches_keep_their_error_and_merge(spark, groups, error):
    rows = spark.createDataFrame([(k, i % 3, v) for k, vs in groups.items() for i, v in enumerate(vs)], "k string, part int, v double")
    sketch = QT.merged(*(QT.quantile_sketch(rows.filter(F.col("part") == p), ["k"], F.col("v"), error) for p in range(3)))
    got = {r["k"]: r for r in QT.sketch_quantiles(sketch, ["k"], SHARES, error).collect()}
    assert set(got) == set(groups) - {"nothing"}
    for k, r in got.items():
        want = np.sort(finite(groups[k]))
        for name, q in SHARES.items():
            exact = want[max(1, int(np.ceil(len(want) * q))) - 1]
            assert abs(r[name] - exact) <= abs(exact) * error * (1 + 1e-6) + 5e-324


def test_an_error_has_bounds():
    for error in (0.0, 1.0, 0.0001):
        with pytest.raises(ValueError):
            QT.grid_step(error)


def plain_choices(candidates, cells, load, coef, weight, tie_s, seed):
    """Batch by batch, request by request, over the whole batch's load."""
    chosen, by_batch = {}, defaultdict(lambda: defaultdict(list))
    for batch, request, place, candidate, eta, allowed in candidates:
        by_batch[batch][place, request].append((candidate, eta, allowed))
    for requests in by_batch.values():
        extra = defaultdict(float)
        for (_, request), options in sorted(requests.items()):
            costs = {}
            for candidate, eta, allowed in options:
                if allowed:
                    before = sum(coef.get(s, 0) * (load.get((s, b), 0) + extra[s, b]) ** 2 for s, b in cells[request, candidate])
                    after = sum(coef.get(s, 0) * (load.get((s, b), 0) + extra[s, b] + w) ** 2 for (s, b), w in cells[request, candidate].items())
                    costs[candidate] = eta + weight * (after - before)
            if not costs:
                chosen[request] = None
                continue
            near = [c for c in costs if costs[c] <= min(costs.values()) + tie_s]
            chosen[request] = min(near, key=lambda c: hashlib.sha1(f"{seed}|{request}|{c}".encode()).hexdigest())
            for cell, w in cells[request, chosen[request]].items():
                extra[cell] += w
    return chosen


@pytest.mark.parametrize(("segs", "weight", "tie_s"), [(6, 25.0, 0.0), (80, 40.0, 0.5), (6, 0.0, 0.5), (300, 40.0, 5.0)])
def test_choices_in_order_equal_a_plain_loop(spark, segs, weight, tie_s):
    rng = random.Random(segs)
    candidates, cells = [], defaultdict(dict)
    for request in range(60):
        place = rng.randrange(8)  # ties of place go by request
        for candidate in range(rng.randrange(1, 5)):
            candidates.append((f"b{request % 3}", request, place, candidate, float(rng.randrange(90, 120)), rng.random() < 0.8))
            for _ in range(rng.randrange(4)):
                cells[request, candidate][rng.randrange(segs), rng.randrange(3)] = rng.choice([0.25, 0.5, 1.0])
    load = {(s, b): rng.random() * 3 for s in range(0, segs, 2) for b in range(3)}
    coef = {s: rng.random() for s in range(segs) if s % 5}
    c = spark.createDataFrame(candidates, "batch string, request long, place int, candidate int, eta double, allowed boolean")
    x = spark.createDataFrame([(r, k, s, b, w) for (r, k), v in cells.items() for (s, b), w in v.items()], "request long, candidate int, seg int, bin int, share double")
    l = spark.createDataFrame([(s, b, v) for (s, b), v in load.items()], "seg int, bin int, load double")
    r = spark.createDataFrame(list(coef.items()), "seg int, coef double")
    got = {row["request"]: row["candidate"] for row in PR.assign_timed(c, x, l, r, weight, tie_s, seed=4).collect()}
    assert got == plain_choices(candidates, cells, load, coef, weight, tie_s, 4)
    # One request a batch sees the load alone, as score_timed does.
    alone = c.withColumn("batch", F.col("request").cast("string"))
    best = {row["request"]: (row["candidate"], row["reason"]) for row in PR.score_timed(c, x, l, r, weight, tie_s, seed=4).filter("best").collect()}
    first = {row["request"]: (row["candidate"], row["reason"]) for row in PR.assign_timed(alone, x, l, r, weight, tie_s, seed=4).collect()}
    assert best == {k: v for k, v in first.items() if v[1] != PR.NO_CANDIDATE}


def test_choices_of_nothing_and_of_nulls(spark):
    c = spark.createDataFrame([("b", 1, None, 1, 10.0, None), ("b", 2, 0, 1, None, True), ("b", 3, 0, 1, 5.0, True), (None, 4, 0, 2, 1.0, True)], "batch string, request long, place int, candidate int, eta double, allowed boolean")
    x = spark.createDataFrame([], "request long, candidate int, seg int, bin int, share double")
    l, r = spark.createDataFrame([], "seg int, bin int, load double"), spark.createDataFrame([], "seg int, coef double")
    got = {row["request"]: (row["batch"], row["candidate"], row["reason"]) for row in PR.assign_timed(c, x, l, r, 1.0).collect()}
    assert got == {1: ("b", None, PR.NO_CANDIDATE), 2: ("b", None, PR.NO_CANDIDATE), 3: ("b", 1, PR.FASTEST), 4: (None, 2, PR.FASTEST)}
    assert PR.assign_timed(c.limit(0), x, l, r, 1.0).count() == 0


def test_cells_spread_by_the_kernel_and_roads_weigh_by_time(spark):
    e = spark.createDataFrame([("r", 1, 310.0), ("r", 1, 599.0), ("r", 2, None), ("r", 2, 0.0)], "request string, seg int, entry_s double")
    got = {(x["seg"], x["bin"]): x["share"] for x in PR.timed_cells(e, "request", kernel=(1.0, 2.0, 1.0)).collect()}
    assert got == {(1, 0): 0.5, (1, 1): 1.0, (1, 2): 0.5, (2, -1): 0.25, (2, 0): 0.5, (2, 1): 0.25}
    roads = spark.createDataFrame([(1, 2.0, 30.0), (2, None, 60.0), (3, -1.0, 60.0)], "seg int, lanes double, free_s double")
    got = PR.road_weights(roads, F.lit(5.0), F.lit(1.0), F.lit(2.0), 30.0).orderBy("seg").collect()
    assert [x["coef"] for x in got] == pytest.approx([0.02, 0.16, 0.16]) and [x["lanes_assumed"] for x in got] == [False, True, True]


def test_requests_with_stops(spark):
    roads = spark.createDataFrame([(1, -122.40, 37.70), (2, -122.41, 37.70), (3, -122.42, 37.70)], "place_id int, plon double, plat double")
    at = {1: -122.40, 2: -122.41, 3: -122.42, "off": -122.424, "away": -122.60, None: None}
    rows = [("ok", 1, 2, None), ("stop", 1, 2, 3), ("stop at the end", 1, 2, 2), ("off", 1, "off", None), ("away", "away", 1, None), ("same", 3, 3, None), ("far stop", 1, 2, "away"), ("no place", None, 1, None)]
    q = spark.createDataFrame([(n, *(v for e in ends for v in (at[e], None if e is None else 37.70))) for n, *ends in rows], "request string, o_lon double, o_lat double, d_lon double, d_lat double, s_lon double, s_lat double")
    trips, totals = M.snap_trips(q, roads, 250.0, 1000.0)
    got = {r["request"]: (r["outcome"], r["origin"], r["dest"], r["stop"]) for r in trips.collect()}
    assert got == {
        "ok": ("ok", 1, 2, None), "stop": ("ok", 1, 2, 3), "stop at the end": ("ok", 1, 2, None), "off": ("far", 1, 3, None), "away": ("far", None, 1, None), "same": ("same_road", 3, 3, None),
        "far stop": ("far", 1, 2, None), "no place": ("far", None, 1, None),
    }
    t = totals.first()
    assert (t["requests"], t["trips"], t["far"], t["same_road"]) == (8, 3, 4, 1)
    ends = [0.0] * 13 + [max(r["dest_m"] for r in trips.collect())]
    assert t["p95_m"] == pytest.approx(np.percentile(ends, 95))
    none = M.snap_trips(q.limit(0), roads)[1].first()
    assert (none["requests"], none["p95_m"]) == (0, None)


def test_rows_of_one_candidate_go_by_time(spark):
    """A candidate that comes twice is chosen in its quicker row, which is also the fastest, in any order of rows."""
    rows = [(1, 1, 10.25, True), (1, 1, 10.0, True), (1, 1, 10.0, False)]
    none = spark.createDataFrame([], "request int, candidate int, seg int, bin long, share double"), spark.createDataFrame([], "seg int, bin long, load double"), spark.createDataFrame([], "seg int, coef double")
    for turned in (rows, rows[::-1]):
        c = spark.createDataFrame(turned, "request int, candidate int, eta double, allowed boolean").coalesce(1)
        best = PR.score_timed(c, *none, 60.0).filter("best").collect()
        assert [(r["eta"], r["reason"]) for r in best] == [(10.0, "fastest_candidate,seeded_tie_break")]


def test_times_are_rounded_as_in_the_sql(spark, tmp_path):
    """59404.5 / 100 is 594.04 as a double times 100, so both candidates take as long and the smaller is the fastest."""
    con, day = duckdb.connect(), datetime.datetime(2024, 1, 1)
    lines = [(k, 1, 1, n, 10.0, p, day) for k in range(4) for n, p in ((1, 59404.5), (2, 59404.0))]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"),
        ("orders", [(k, 1, day) for k in range(4)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), ("part", [(1,)], "p_partkey long"), ("supplier", [(1,)], "s_suppkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    key = lambda r: (r[0], r[1], r[3], r[4])
    got = {key(r) for r in QUERIES["score_timed"](spark, str(tmp_path)).collect()}
    assert got == {key(r) for r in con.execute(ORACLE_SQL["score_timed"]).fetchall()}
    assert {r["eta"] for r in policy_queries.choices(spark, str(tmp_path)).collect()} == {594.04}


def test_requests_of_a_set_pass_one_by_one(spark):
    """in the order of their rows, with what their set brought alone, and a candidate of two rows presses once. 40 sets of 3 requests on one cell."""
    rows = [("b", 3 * s + k, k if s % 2 else None, c, 10.0 + c, True) for s in range(40) for k in range(3) for c in (1, 1, 2)]
    c = spark.createDataFrame(rows, "batch string, request long, place int, candidate int, eta double, allowed boolean")
    x = spark.createDataFrame([(3 * s + k, 1, s, 0, 1.0) for s in range(40) for k in range(3)], "request long, candidate int, seg int, bin int, share double")
    load, roads = spark.createDataFrame([], "seg int, bin int, load double"), spark.createDataFrame([(s, 0.4) for s in range(40)], "seg int, coef double")
    out = PR.assign_timed(c, x, load, roads, 1.0, 0.0)
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    # The first pays 0.4 to pass, the second 1.2 and so goes round, as the third does.
    assert {(r["request"], r["candidate"], round(r["growth"], 6)) for r in out.collect()} == {(3 * s + k, 1 if k == 0 else 2, 0.4 if k == 0 else 0.0) for s in range(40) for k in range(3)}
