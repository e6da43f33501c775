"""Every query against its SQL in DuckDB on the smallest tables, and streams against batches."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from roadweave.functions import scalars as S
from roadweave.operators import graph as G
from roadweave.operators import matching as M
from roadweave.operators import routing as R
from roadweave.operators import scoring as P
from roadweave.operators import streets as X
from roadweave.operators import windows as W
from roadweave.plans import detail_queries, experiment_queries, fact_queries, feed_queries, lenses, policy_queries, queries, road_queries  # noqa: F401
from roadweave.sources import tables as T
from roadweave.streaming import jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), oracle.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).replace({"None": "nan", "<NA>": "nan"}).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_missing_stays_missing(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (1, 2, None), (1, 3, None)], "seg int, t int, v double")
    assert [r["filled"] for r in W.ffill_limited(df, "seg", "t", "v").orderBy("t").collect()] == [5.0, 5.0, 5.0, None]


def test_offset_is_needed(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("x",)], "s string")
    assert [r[0] is None for r in df.select(S.parse_zoned(F.col("s"))).collect()] == [False, True, True]


def test_incomplete_pull_archives_nothing(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert not any(r["archived"] for r in T.archive_missing(df, df.filter("id = 1"), "id", False).collect())
    assert [r["archived"] for r in T.archive_missing(df, df.filter("id = 1"), "id", True).orderBy("id").collect()] == [False, True]


def test_published_runs_need_a_marker(spark, tmp_path):
    table, runs = str(tmp_path / "t"), str(tmp_path / "r")
    T.publish(spark.range(3), table, runs, "a")
    spark.range(5).withColumn("run_id", F.lit("b")).write.mode("append").partitionBy("run_id").parquet(table)
    assert T.read_published(spark, table, runs).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = lenses.readings(spark, DATA).select("seg", "source", "ts", "speed", "weight")
    rows.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_buckets(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("buckets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = rows.agg(F.max("ts")).first()[0]
    got = {(r["bucket"], r["seg"], r["source"]): round(r["speed"], 6) for r in spark.table("buckets").collect()}
    want = {(r["bucket"], r["seg"], r["source"]): round(r["speed"], 6) for r in queries.buckets(spark, DATA).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert all((closed - k[0]).total_seconds() <= 1800 for k in want.keys() - got.keys())


def test_components_of_cycles_loops_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 9), (9, 8), (5, 5), (None, 4), (12, 11), (11, 10), (10, 3)], "src long, dst long")
    assert {r["node"]: r["component"] for r in G.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7, 10: 1, 11: 1, 12: 1}
    assert G.connected_components(edges.limit(0)).count() == 0


def test_nearest_forecast_prefers_the_earlier_and_keeps_unmatched(spark):
    cells = spark.createDataFrame([("a", 0, 1, 10), ("a", 1, 1, 100), ("b", 0, 2, 5)], "route string, pos int, seg int, t int")
    preds = spark.createDataFrame([(1, 5, 2.0), (1, 15, 8.0), (1, 99, 1.0)], "seg int, t int, delay double")
    got = {r["route"]: (r["delay"], r["matched"], r["cells"]) for r in M.nearest_forecast(cells, preds, 20).collect()}
    assert got == {"a": (3.0, 2, 2), "b": (None, 0, 1)}
    assert [r["delay"] for r in M.nearest_forecast(cells, preds.limit(0), 20).orderBy("route").collect()] == [None, None]


def test_choices_have_one_problem_each(spark):
    candidates = spark.createDataFrame([(r, c, e) for r in range(1, 6) for c, e in ((1, 100.0), (2, 110.0), (3, 200.0))], "request int, candidate int, eta double")
    choices = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (4, 1), (4, 2)], "request int, candidate int")
    assert {r["request"]: r["problem"] for r in P.validate_choices(candidates, choices).collect()} == {1: None, 2: "detour", 3: "unknown", 4: "several", 5: "missing"}


def test_impact_without_recovery_or_without_a_side(spark):
    cells = spark.createDataFrame([(1, 0, 9.0, 1.0), (1, 1, 5.0, 1.0), (2, 0, 9.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, None, 1.0)], "seg int, bucket int, event double, control double")
    assert {r["seg"]: (r["peak"], r["recovered"]) for r in P.pair_impact(cells).collect()} == {1: (8.0, None), 2: (8.0, 1)}


def test_links_prefer_a_shared_name_and_fall_back(spark):
    edges = spark.createDataFrame([(1, -122.4, 37.7, "Oak"), (2, -122.0, 37.0, "Elm"), (3, None, 37.7, "Oak")], "edge int, lon double, lat double, name string")
    streets = spark.createDataFrame([(7, -122.4, 37.7001, "Elm", 30), (8, -122.4, 37.70015, "Oak", 0), (8, -122.4, 37.70015, "Oak", 35), (8, -122.4, 37.701, "Oak", 99)], "street int, plon double, plat double, sname string, posted int")
    got = lambda **k: {r["edge"]: (r["street"], r["limit"]) for r in X.link_streets(edges, streets, 25.0, **k).collect()}
    assert got() == {1: (7, 30), 2: (None, None), 3: (None, None)}
    assert got(bonus_m=10.0, default=25) == {1: (8, 35), 2: (None, 25), 3: (None, 25)}


def test_turns_that_do_not_meet_forbid_nothing(spark):
    edges = spark.createDataFrame([(1, "a", "n"), (2, "n", "b"), (3, "n", "c"), (4, "c", "d")], "seg int, src string, dst string")
    rel = spark.createDataFrame([(1, "n", 2, "only_straight_on"), (1, "n", 4, "no_left_turn"), (1, "n", 2, "no_u_turn"), (1, "n", 2, None)], "from_seg int, node string, to_seg int, kind string")
    assert {tuple(r) for r in X.turn_prohibitions(rel, edges).collect()} == {(1, 3), (1, 2)}


def test_time_route_crosses_buckets_and_counts_missing(spark):
    cells = spark.createDataFrame([("r", 1, 1, 10.0), ("r", 2, 1, 10.0), ("r", 3, 2, 5.0)], "route string, pos int, seg int, length double")
    leave = spark.createDataFrame([("r", 5), ("empty", 3)], "route string, depart_s long")
    forecast = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 1, 9.0), (2, 0, None)], "seg int, bucket long, pace double")
    got = {r["route"]: (r["roads"], r["arrive_s"], r["missing"]) for r in R.time_route(cells, leave, forecast, 10).collect()}
    assert got == {"r": (3, 35.0, 1), "empty": (0, 3.0, 0)}


def test_top_candidates_drop_what_follows_the_fastest(spark):
    rows = [(1, "a", 1, 50.0, 10.0), (1, "a", 2, 50.0, 10.0), (1, "b", 1, 95.0, 20.0), (1, "b", 3, 5.0, 1.0), (1, "c", 4, 80.0, 25.0), (1, "d", 5, 80.0, 99.0)]
    cells = spark.createDataFrame(rows, "request int, candidate string, seg int, length double, eta double")
    assert [(r["candidate"], r["rank"]) for r in R.top_candidates(cells).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    assert R.top_candidates(cells.limit(0)).count() == 0


def test_warning_scores_without_positives(spark):
    s = spark.createDataFrame([("a", 0.9, True), ("a", 0.5, None), ("a", 0.1, False), ("b", 0.3, False), ("b", None, True)], "g string, score double, label boolean")
    got = {r["g"]: (r["threshold"], r["f1"], r["recall_threshold"], r["average_precision"]) for r in P.warning_scores(s, "g").collect()}
    assert got == {"a": (0.9, 1.0, 0.9, 1.0), "b": (0.3, 0.0, None, None)}


def test_largest_scc_of_two(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 5), (None, 1), (6, 3)], "src int, dst int")
    assert {r["node"] for r in G.largest_scc(arcs).collect()} == {3, 4, 5}
    assert G.largest_scc(arcs.filter("src = 3")).count() == 0
