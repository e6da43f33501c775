"""Navigation along a route: where fixes stand on it, what is left, and arrival; fixes that can't be trusted hold what was last known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres of a degree; metres from the end that count as arrived; metres beyond which a fix is vague for arrival, and for progress; metres off
#: the line (or the fix's accuracy, if more) that are off the route.
DEGREE_M, ARRIVED_M, SURE_M, VAGUE_M, OFF_ROUTE_M = 111_320.0, 40.0, 50.0, 100.0, 60.0


def flat_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a plane that touches the first point's latitude."""
    return F.hypot((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1) * DEGREE_M


def in_layers(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The lists' numbers, longest first, where each begins among their elements, its size, and how many lists have an element 0, 1, ..."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    return order, lists.offsets.to_numpy()[:-1][order], sizes, np.searchsorted(-sizes, -np.arange(sizes.max(initial=0))).tolist()


def numbers(x: pa.Array) -> np.ndarray:
    """Doubles, not a number where null."""
    return x.cast(pa.float64()).to_numpy(zero_copy_only=False)


def on_lines(lon: np.ndarray, lat: np.ndarray, coords: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """along, off, length: metres along each fix's line (array of lon, lat) to its point nearest to the fix, the first of those equal to a hundredth of
    a millimetre, metres off it, and its length, on a plane at the fix. Length is 0 for a line of fewer than two points, and not a number for
    one of a point without lon or lat. Pieces are gone through in order, the first ones of all lines at once, then the second ones, ..."""
    order, first, sizes, more = in_layers(coords)
    points, at = numbers(coords.values.values), coords.values.offsets.to_numpy()
    x, y = (np.full(len(at) - 1, np.nan) for _ in range(2))
    whole = np.diff(at) >= 2
    x[whole], y[whole] = points[at[:-1][whole]], points[at[:-1][whole] + 1]
    lon, lat, k = lon[order], lat[order], np.cos(np.radians(lat[order]))
    run, along, off = np.zeros(len(lon)), np.zeros(len(lon)), np.full(len(lon), np.inf)
    for j, n in enumerate(more[1:], 1):
        i = first[:n] + j
        ax, ay = x[i - 1], y[i - 1]
        bx, by, px, py = (x[i] - ax) * k[:n], y[i] - ay, (lon[:n] - ax) * k[:n], lat[:n] - ay
        square, length = bx * bx + by * by, np.hypot(bx, by) * DEGREE_M
        t = np.where(square > 0, np.clip((px * bx + py * by) / square, 0.0, 1.0), 0.0)
        here = np.floor(np.hypot(px - t * bx, py - t * by) * DEGREE_M * 1e5 + 0.5) / 1e5
        nearer = here < off[:n]
        along[:n] = np.where(nearer, run[:n] + t * length, along[:n])
        off[:n] = np.where(nearer, here, off[:n])
        run[:n] += length
    back = np.argsort(order)
    return along[back], off[back], run[back]


def on_steps(share: np.ndarray, steps: pa.ListArray) -> tuple[np.ndarray, ...]:
    """step (from 0), to_next_m, left_m and left_s at a share of each route's steps (array of metres, seconds), metres not a number where a step's are."""
    order, first, sizes, more = in_layers(steps)
    metres, seconds = (np.append(numbers(steps.values.field(c)), np.nan) for c in ("metres", "seconds"))
    total, start, later, step = np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order)), np.zeros(len(order), np.int32)
    for i, n in enumerate(more):
        total[:n] += metres[first[:n] + i]
    at = share[order] * total
    for i, n in enumerate(more[1:]):
        end = start[:n] + metres[first[:n] + i]
        past = (step[:n] == i) & (end <= at[:n])
        step[:n] += past
        start[:n] = np.where(past, end, start[:n])
    for i, n in enumerate(more):
        later[:n] += np.where(step[:n] < i, seconds[first[:n] + i], 0.0)
    own = np.where(sizes > 0, first + step, len(metres) - 1)
    to_next = np.maximum(0.0, start + metres[own] - at)
    rest = seconds[own] * to_next / metres[own]
    back = np.argsort(order)
    return tuple(c[back] for c in (step, to_next, np.maximum(0.0, total - at), later + np.where(np.isnan(rest), 0.0, rest)))


def shown(lon: pa.Array, lat: pa.Array, accuracy: pa.Array, coords: pa.Array, steps: pa.Array) -> pa.Array:
    """What a fix shows on its route, null where it can't be trusted."""
    accuracy = numbers(accuracy)
    with np.errstate(all="ignore"):
        along, off, length = on_lines(numbers(lon), numbers(lat), coords)
        step, to_next, left, seconds = on_steps(along / length, steps)
        fine = (accuracy <= VAGUE_M) & (off <= np.maximum(OFF_ROUTE_M, accuracy)) & (length > 0) & np.isfinite(left) & ~np.isnan(to_next)
    columns = [pa.array(step), pa.array(to_next), pa.array(left), pa.array(seconds, mask=np.isnan(seconds))]
    fine &= pc.fill_null(pc.greater(pc.list_value_length(steps), 0), False).to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays(columns, names=["step", "to_next_m", "left_m", "left_s"], mask=pa.array(~fine))


def fixes_on_routes(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """trip, t, arrived and seen (step, to_next_m, left_m, left_s), null for a fix that is too vague, off its route, or on a route without steps or
    length, or of which a coordinate or a step's metres aren't known. fixes: trip, route, t, lon, lat, accuracy; routes: route, coords array<array<double>> (lon, lat), steps array<struct<metres,
    seconds>>, end_lon, end_lat (null: the line's last point). A fix meets its own route alone, batches of them in
    Arrow; fixes may be a stream."""
    both = fixes.join(routes, "route")
    last = F.get("coords", F.size("coords") - 1)
    off_end = flat_m(F.col("lon"), F.col("lat"), F.coalesce("end_lon", F.get(last, 0)), F.coalesce("end_lat", F.get(last, 1)))
    arrived = F.coalesce((F.col("accuracy") <= SURE_M) & (off_end <= ARRIVED_M), F.lit(False))
    seen = F.arrow_udf(shown, "step int, to_next_m double, left_m double, left_s double")
    return both.select("trip", "t", arrived.alias("arrived"), seen("lon", "lat", "accuracy", "coords", "steps").alias("seen"))


def nav_progress(fixes: DataFrame, routes: DataFrame) -> DataFrame:
    """trip, t, arrived, held, step, to_next_m, left_m, left_s for each fix: what it shows, or, held, what the trip's last trusted fix showed (null
    before the first). See fixes_on_routes."""
    seen = fixes_on_routes(fixes, routes)
    known = F.last("seen", ignorenulls=True).over(Window.partitionBy("trip").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return seen.withColumn("known", known).select("trip", "t", "arrived", F.col("seen").isNull().alias("held"), "known.step", "known.to_next_m", "known.left_m", "known.left_s")
