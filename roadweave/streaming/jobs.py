"""Structured Streaming jobs: final buckets behind a watermark, and speeds, changes, ratios and assignments with keyed state.

State is small for each key and expires: a key that is silent for longer than its state is good for is forgotten.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadweave.operators import windows as W
from roadweave.operators.navigation import fixes_on_routes
from roadweave.sources import tables as T


def stream_buckets(readings: DataFrame, late: str = "5 minutes", bucket: str = "10 minutes") -> DataFrame:
    """Weighted mean speed per bucket, seg and source; in append mode a bucket comes out once, after it closed and late has passed."""
    agg = readings.withWatermark("ts", late).groupBy(F.window("ts", bucket), "seg", "source").agg((F.sum(F.col("speed") * F.col("weight")) / F.sum("weight")).alias("speed"), F.count("*").alias("n"))
    return agg.select(F.col("window.start").alias("bucket"), "seg", "source", "speed", "n")


def gathered(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The rows of one key in a batch, in order."""
    return pd.concat(list(frames)).sort_values(list(order), kind="stable")


def stream_change_only(rows: DataFrame, forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """id, seq and hash of rows whose hash differs from the last one seen of their id. rows: id long, seq long, hash long."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for x in gathered(frames, "seq").itertuples():
            if x.hash != last:
                out.append((key[0], x.seq, x.hash))
            last = x.hash
        state.update((last,))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["id", "seq", "hash"]).astype("int64")

    return rows.groupBy("id").applyInPandasWithState(run, "id long, seq long, hash long", "hash long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_vehicle_speeds(fixes: DataFrame, max_gap_s: int = 180, max_hop_m: float = 1500.0, forget_ms: int = 3_600_000) -> DataFrame:
    """vehicle, t, gap_s, mps between consecutive fixes of a vehicle on one line, also over batches; longer gaps, jumps and changes of line only
    seed. fixes: vehicle long, line string, t long, lon double, lat double."""

    def hop(a: tuple, b: tuple) -> float:
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(math.sqrt(min(1.0, h)))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = tuple(state.get) if state.exists else None, []
        for x in gathered(frames, "t").itertuples():
            if last is not None and x.t <= last[0]:
                continue
            if last is not None and x.line is not None and x.line == last[1] and x.t - last[0] <= max_gap_s:
                m = hop(last[2:], (x.lon, x.lat))
                if m <= max_hop_m:
                    out.append((key[0], x.t, x.t - last[0], m / (x.t - last[0])))
            last = (x.t, x.line, x.lon, x.lat)
        state.update(last)
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["vehicle", "t", "gap_s", "mps"])

    return fixes.groupBy("vehicle").applyInPandasWithState(run, "vehicle long, t long, gap_s long, mps double", "t long, line string, lon double, lat double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_nav_progress(fixes: DataFrame, routes: DataFrame, forget_ms: int = 3_600_000) -> DataFrame:
    """The rows of navigation.nav_progress over a stream of fixes: what a fix shows is worked out by columns; only the last trusted progress of a
    trip is state, and is forgotten when no fix came for forget_ms. Fixes that are late within a batch are put in order; over batches they
    come as they come. trip string, t long; see fixes_on_routes."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x = gathered(frames, "t")
        held = x["step"].isna()
        if state.exists:
            past = pd.DataFrame([tuple(state.get)], columns=NAV_STATE)
            x = pd.concat([past, x], ignore_index=True)
        x[NAV_STATE] = x[NAV_STATE].astype("float64").ffill()
        x = x.iloc[len(x) - len(held) :].assign(held=held.to_numpy(), trip=key[0])
        last = x.iloc[-1]
        if pd.notna(last["step"]):
            state.update(tuple(float(last[c]) for c in NAV_STATE))
        if state.exists:
            state.setTimeoutDuration(forget_ms)
        yield x.assign(step=x["step"].astype("Int32"))[["trip", "t", "arrived", "held", *NAV_STATE]]

    seen = fixes_on_routes(fixes, routes).select("trip", "t", "arrived", "seen.*")
    return seen.groupBy("trip").applyInPandasWithState(run, "trip string, t long, arrived boolean, held boolean, step int, to_next_m double, left_m double, left_s double", "step double, to_next_m double, left_m double, left_s double", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: What a trusted fix shows, and a trip's state holds.
NAV_STATE = ["step", "to_next_m", "left_m", "left_s"]


def stream_asof_ratio(lines: DataFrame, most_s: int = 12 * 3600, least: float = 0.05) -> DataFrame:
    """key, t, value, free_flow of absolute readings: over the line's latest relative one that is at most most_s old, and null without one. Event time
    rules the age; state goes when no reading came for most_s. lines: key string, t long, style string, value double."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = tuple(state.get) if state.exists else None, []
        x = gathered(frames, "t")
        for r in pd.concat([x[x["style"] == "relative"], x[x["style"] != "relative"]]).sort_values("t", kind="stable").itertuples():
            if r.style == "relative":
                last = (r.t, r.value) if last is None or r.t >= last[0] else last
            else:
                fresh = last is not None and 0 <= r.t - last[0] <= most_s and last[1] >= least
                out.append((key[0], r.t, r.value, r.value / last[1] if fresh else None))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(most_s * 1000)
        yield pd.DataFrame(out, columns=["key", "t", "value", "free_flow"])

    return lines.groupBy("key").applyInPandasWithState(run, "key string, t long, value double, free_flow double", "t long, share double", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Seconds that each state of an assignment lasts without a command.
LASTS = {"provisional": 60, "accepted": 900, "active": 1800}
#: What a command makes of a state.
MOVES = {("provisional", "accept"): "accepted", ("accepted", "start"): "active", ("active", "complete"): "completed", ("provisional", "cancel"): "cancelled", ("accepted", "cancel"): "cancelled", ("active", "cancel"): "cancelled"}


def next_state(state: str | None, version: int, until: int, command: str, wanted: int, t: int) -> tuple[str | None, int, int, str]:
    """State, version, end and result after a command at t. An assignment whose time is over has expired; a repeated command changes nothing; one of
    another version, or that doesn't fit, is refused."""
    if state in LASTS and t >= until:
        state, version = "expired", version + 1
    if command == "propose":
        return (state, version, until, "same") if state else ("provisional", 1, t + LASTS["provisional"], "done")
    if state is None:
        return state, version, until, "unknown"
    to = MOVES.get((state, command))
    if to is None:
        again = {"accept": "accepted", "start": "active", "complete": "completed", "cancel": "cancelled"}.get(command) == state
        return state, version, until, "same" if again else "refused"
    if wanted != version:
        return state, version, until, "stale"
    return to, version + 1, t + LASTS.get(to, 0), "done"


def assignment_lifecycle(commands: DataFrame) -> DataFrame:
    """assignment, t, state, version, result for each command, and a row expired where time runs out (by the watermark). commands: assignment string,
    ts timestamp, command string, version int, with a watermark on ts."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, version, until = tuple(state.get) if state.exists else (None, 0, 0)
        out = []
        if state.hasTimedOut:
            if now in LASTS:
                out.append((key[0], until, "expired", version + 1, "timeout"))
            state.remove()
        else:
            for x in gathered(frames, "ts").itertuples():
                t = int(x.ts.timestamp())
                now, version, until, result = next_state(now, version, until, x.command, int(x.version), t)
                out.append((key[0], t, now, version, result))
            if now is not None:
                state.update((now, version, until))
                state.setTimeoutTimestamp(max((until if now in LASTS else until + 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["assignment", "t", "state", "version", "result"])

    return commands.groupBy("assignment").applyInPandasWithState(run, "assignment string, t long, state string, version int, result string", "state string, version int, until long", "append", GroupStateTimeout.EventTimeTimeout)


def forecast_trigger(runs: str, model: str, make: Callable[[DataFrame, int], DataFrame], table: str, now_s: Callable[[], int], stored: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: when a batch completes a bucket, makes and publishes the map of that issue, once for a model and issue.

    stored gives the readings that are counted, those of the batch if it is left out: a bucket that came in several batches counts whole if
    they are kept in a table. An issue is claimed before its map is made, by a file that only one of several streams can create; a stream
    that is started again from its checkpoint keeps its claims, and makes the map of one whose run has no marker. The first run starts
    from nothing: the folders need not exist.
    """

    def batch(readings: DataFrame, batch_id: int) -> None:
        spark = readings.sparkSession
        counts = (stored(readings) if stored else readings).groupBy((F.floor(F.unix_timestamp("ts") / 600) * 600).alias("time")).agg(F.count("*").alias("n"))
        issue = W.choose_issue(counts, F.lit(now_s())).first()[0]
        if issue is None:
            return
        run_id = f"{model}-{int(issue)}"
        if T.exists(spark, runs) and not spark.read.schema("run_id string").parquet(runs).filter(F.col("run_id") == run_id).isEmpty():
            return
        owner = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or spark.sparkContext.applicationId
        if T.claimed(spark, f"{table}-claims/{run_id}", owner) == owner:
            T.publish(make(readings, int(issue)), table, runs, run_id)

    return batch


def retime_live(live: DataFrame, timed: DataFrame) -> DataFrame:
    """Live assignments with the arrival of the new forecast for what is left of them, and untimed where it gives none. live: assignment, version,
    arrive_s; timed: assignment, arrive_s, missing (roads without a forecast)."""
    new = timed.select("assignment", F.when(F.col("missing") == 0, F.col("arrive_s")).alias("new_s"))
    return live.join(new, "assignment", "left").select("assignment", (F.col("version") + 1).alias("version"), F.coalesce("new_s", "arrive_s").alias("arrive_s"), F.col("new_s").isNull().alias("untimed"))


def live_events(events: DataFrame, t_s, default_s: int = 10_800) -> DataFrame:
    """Events that are not over at t_s; without an end they last default_s. events: start_s, end_s."""
    return events.filter(F.col("start_s").isNotNull() & (F.lit(t_s) < F.coalesce("end_s", F.col("start_s") + default_s)))


def trip_window(from_s, to_s, lead_s: int = 3600, tail_s: int = 3600, round_s: int = 300):
    """The time in which events matter for a trip: padded by crowds that leave and arrive, and rounded outwards to five minutes."""
    return F.floor((from_s - tail_s) / round_s) * round_s, F.ceil((to_s + lead_s) / round_s) * round_s
