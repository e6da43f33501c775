"""Operators over ordered rows of a key: latest, fills, lags, sessions, labels, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import haversine_m, unit_draw
from roadweave.operators.graph import cut

#: Amplitude, and minutes around a declared start and end, of the rule for events.
RULE_ARRIVAL, RULE_DEPARTURE = (0.3, -60, 120), (0.5, -30, 90)


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def dedupe_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """First row of each key, with the number of rows it stands for."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("copies", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy(ordinal)))
    return out.filter("__n = 1").drop("__n")


def change_only(df: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Rows whose content differs from that of the row before, the first included."""
    past = F.lag("__hash").over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__hash", F.xxhash64(content)).withColumn("__past", past).filter("__past is null or __past <> __hash").drop("__hash", "__past")


def collapse_repeats(df: DataFrame, key: str, order: list[str], value: str, day: Column | None = None) -> DataFrame:
    """Rows whose value differs from that of the row before of their key. With day, a non-decreasing function of the order that is never null,
    rows are compared within each (key, day), and only a day's first row is held against the last value of the day before that has rows: a
    key of very many rows is as many groups as it has days, and one row a key and day is all that is compared across them."""
    if day is None:
        past = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
        return df.withColumn("__past", past).filter(F.col("__past").isNull() | (F.col("__past") != F.col(value))).drop("__past")
    mine = Window.partitionBy("__key", "__day")
    own = df.withColumns({"__key": F.col(key), "__day": day}).withColumns({"__past": F.lag(value).over(mine.orderBy(*order)), "__n": F.row_number().over(mine.orderBy(*order))})
    lasts = df.select(F.col(key).alias("__key"), day.alias("__day"), F.struct(*order, value).alias("x")).groupBy("__key", "__day").agg(F.max("x").getField(value).alias("__last"))
    lasts = lasts.select("__key", "__day", F.lag("__last").over(Window.partitionBy("__key").orderBy("__day")).alias("__before"))
    both = own.join(lasts.withColumnsRenamed({"__key": "__key2", "__day": "__day2"}), F.col("__key").eqNullSafe(F.col("__key2")) & (F.col("__day") == F.col("__day2")))
    past = F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__past"))
    return both.filter(past.isNull() | (past != F.col(value))).select(*df.columns)


def hour_spine(buckets: DataFrame, value: str, step_s: int = 3600) -> DataFrame:
    """seg, t and the mean of value for each step from a segment's first to its last; null where nothing was seen."""
    seen = buckets.groupBy("seg", (F.floor(F.unix_timestamp("bucket") / step_s) * step_s).alias("t")).agg(F.avg(value).alias(value))
    spine = seen.groupBy("seg").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("seg", F.explode(F.sequence("a", "b", F.lit(step_s).cast("long"))).alias("t"))
    return spine.join(seen, ["seg", "t"], "left")


def ffill_limited(df: DataFrame, key: str, order: str, value: str, k: int = 2) -> DataFrame:
    """Adds filled (at most k steps old, never from the future), was_filled, filled_at (the step it is from) and missing. Needs a dense spine."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-k, 0)
    out = df.withColumn("filled", F.last(value, ignorenulls=True).over(w)).withColumn("was_filled", F.col(value).isNull() & F.col("filled").isNotNull())
    return out.withColumn("filled_at", F.last(F.when(F.col(value).isNotNull(), F.col(order)), ignorenulls=True).over(w)).withColumn("missing", F.col("filled").isNull())


def persistence_times(df: DataFrame, key: str, order: str, slowest: float = 0.5, most: float = 1800.0) -> DataFrame:
    """df with seconds over the road as of now, and basis: 0 from a speed at most two steps old, 1 from a level at most three steps old, 2 free
    flow. Speeds have a floor and seconds a cap. Needs a dense spine and columns speed (metres a second), level (congestion ratio), length, free_flow."""
    last = lambda c, k: F.last(c, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(-k, 0))
    d = df.withColumn("__speed", last("speed", 2)).withColumn("__level", last("level", 3))
    by = lambda v: F.col("length") / F.greatest(v, F.lit(slowest))
    seconds = F.when(F.col("__speed").isNotNull(), by(F.col("__speed"))).when(F.col("__level").isNotNull(), by(F.col("free_flow") * (1 - F.col("__level")))).otherwise(F.col("length") / F.col("free_flow"))
    basis = F.when(F.col("__speed").isNotNull(), 0).when(F.col("__level").isNotNull(), 1).otherwise(2)
    return d.withColumn("seconds", F.least(seconds, F.lit(most))).withColumn("basis", basis).drop("__speed", "__level")


def newest_within(df: DataFrame, keys: list[str], t: str, at: Column, max_age_s: int, *ties: Column) -> DataFrame:
    """The newest row of each key that isn't of the future of `at` nor older than max_age_s then."""
    return latest_per(df.filter((F.col(t) <= at) & (F.col(t) > at - max_age_s)), keys, F.desc(t), *ties)


def capped_by_class(df: DataFrame, kind: str, most: int, *order: Column) -> DataFrame:
    """The first `most` rows of each class in the given order: the list's own length, so that one class doesn't crowd out another."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def persistence(df: DataFrame, free_flow: Column) -> Column:
    """The filled speed, else free flow; nothing else is known."""
    return F.coalesce(F.col("filled"), free_flow)


def vehicle_speeds(fixes: DataFrame, max_gap_s: int = 180, max_hop_m: float = 1500.0) -> DataFrame:
    """Metres a second between consecutive fixes of a vehicle, where neither gap nor hop is too large. fixes: vehicle, t, lon, lat, id."""
    w = Window.partitionBy("vehicle").orderBy("t", "id")
    past = lambda c: F.lag(c).over(w)
    moved = fixes.withColumn("gap_s", F.col("t") - past("t")).withColumn("hop_m", haversine_m(past("lon"), past("lat"), F.col("lon"), F.col("lat")))
    return moved.filter((F.col("gap_s") > 0) & (F.col("gap_s") <= max_gap_s) & (F.col("hop_m") <= max_hop_m)).select("id", "vehicle", "gap_s", "hop_m", (F.col("hop_m") / F.col("gap_s")).alias("mps"))


def poll_gaps(df: DataFrame, key: str, t: str, factor: float = 2.5) -> DataFrame:
    """Median interval of a key's polls, and how many are over factor times that."""
    gaps = df.withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))).filter("gap is not null")
    typical = gaps.groupBy(key).agg(F.percentile("gap", F.lit(0.5)).alias("typical_s"))
    return gaps.join(typical, key).groupBy(key).agg(F.max("typical_s").alias("typical_s"), F.count_if(F.col("gap") > factor * F.col("typical_s")).alias("gaps"))


def lag_features(df: DataFrame, key: str, order: str, value: str, lags: list[int]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    for k in lags:
        df = df.withColumn(f"lag_{k}", F.lag(value, k).over(w))
    return df.withColumn("trend", F.col(f"lag_{lags[0]}") - F.col(f"lag_{lags[-1]}"))


def tolerant_label(df: DataFrame, key: str, order: str, label: str, k: int) -> DataFrame:
    """Positive anywhere within k steps."""
    return df.withColumn("tolerant", F.max(label).over(Window.partitionBy(key).orderBy(order).rowsBetween(-k, k)))


def steady(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Holds now and in the two steps before."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("steady", F.col(flag) & F.coalesce(F.lag(flag, 1).over(w), F.lit(False)) & F.coalesce(F.lag(flag, 2).over(w), F.lit(False)))


def choose_issue(counts: DataFrame, now_s: Column, bucket_s: int = 600, back: int = 6, share: float = 0.5) -> DataFrame:
    """issued_at: the end of the newest bucket that has closed by now_s and holds at least share of the median of the back closed buckets before
    it; the first bucket is held against none. counts: time (a bucket's start in seconds), n."""
    w = Window.orderBy("time").rowsBetween(-back, -1)
    # One row a bucket of one map: a short series.
    closed = counts.filter(F.col("time") + bucket_s <= now_s).withColumn("typical", F.percentile("n", F.lit(0.5)).over(w))
    return closed.filter(F.col("typical").isNull() | (F.col("n") >= share * F.col("typical"))).agg((F.max("time") + bucket_s).alias("issued_at"))


def window_origins(df: DataFrame, key: str, order: str, ok: str, history: int, horizon: int) -> DataFrame:
    """Rows whose history steps (own included) and horizon steps ahead all exist and are ok."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - history, horizon)
    return df.withColumn("__n", F.count("*").over(w)).withColumn("__ok", F.min(F.col(ok).cast("int")).over(w)).filter((F.col("__n") == history + horizon) & (F.col("__ok") == 1)).drop("__n", "__ok")


def segment_arrivals(route: DataFrame, *ties: str) -> DataFrame:
    """share of a route's length before each segment; ties order rows of one pos. route: route, pos, seg, length."""
    w = Window.partitionBy("route")
    before = F.coalesce(F.sum("length").over(w.orderBy("pos", *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return route.withColumn("share", before / F.sum("length").over(w))


def group_split(df: DataFrame, group: str, salt: str, test: int, validation: int) -> DataFrame:
    """df with split: groups in the order of sha256 of salt:group, the first `test` of them test, the next validation, all others train. Only
    the held-out groups, test + validation many, are ranked together, by a top-k."""
    key = F.sha2(F.concat_ws(":", F.lit(salt), F.col(group).cast("string")), 256)
    first = df.select(F.col(group).alias("__group")).distinct().withColumn("__key", F.sha2(F.concat_ws(":", F.lit(salt), F.col("__group").cast("string")), 256)).orderBy("__key").limit(test + validation)
    held = first.agg(F.array_sort(F.collect_list("__key")).alias("__held"))  # one row of test + validation keys
    at = F.array_position("__held", key)
    return df.join(F.broadcast(held)).withColumn("split", F.when(at == 0, "train").when(at <= test, "test").otherwise("validation")).drop("__held")


def hash_draw(df: DataFrame, salt: str, key: str, share: float) -> DataFrame:
    """Rows whose draw, a hash of salt and key in [0, 1), is under the share: the operator is a sample."""
    return df.filter(unit_draw(F.lit(salt), F.col(key)) < share)


def balanced_sample(windows: DataFrame, per_family: int, salt: str, targets: tuple[tuple[str, float], ...] = (("pre_start", 0.5), ("pre_end", 0.25), ("other", 0.25))) -> DataFrame:
    """family, window, with_event, phase, draw: per_family draws of each family, half of event windows (the odd one too) and half of controls,
    and in each half by the targets; the share of a phase without windows goes to the others in proportion. Places go down to whole numbers,
    then one more each to the largest targets. Windows come in the order of a hash, again from the first where a phase has too few.
    windows: family, window, with_event, phase."""
    half = F.when(F.col("with_event"), per_family - per_family // 2).otherwise(per_family // 2)
    phases = F.create_map(*(F.lit(x) for pair in targets for x in pair))
    order = F.create_map(*(F.lit(x) for k, (name, _) in enumerate(targets) for x in (name, k)))
    have = windows.filter(F.col("phase").isin(*(n for n, _ in targets))).groupBy("family", "with_event", "phase").agg(F.count("*").alias("have"))
    half_of = Window.partitionBy("family", "with_event")
    have = have.withColumn("target", F.element_at(phases, F.col("phase"))).withColumn("quota", F.col("target") / F.sum("target").over(half_of)).withColumn("n", half)
    have = have.withColumn("whole", F.floor(F.col("n") * F.col("quota") + 1e-9))
    place = F.row_number().over(half_of.orderBy(F.desc("quota"), F.element_at(order, F.col("phase"))))
    have = have.withColumn("take", F.col("whole") + F.when(place <= F.col("n") - F.sum("whole").over(half_of), 1).otherwise(0)).filter("take > 0")
    mixed = F.sha1(F.concat_ws(":", F.lit(salt), F.col("window").cast("string")))
    ranked = windows.withColumn("rank", F.row_number().over(Window.partitionBy("family", "with_event", "phase").orderBy(mixed, "window")))
    times = F.when(F.col("rank") <= F.col("take"), F.floor((F.col("take") - F.col("rank")) / F.col("have")) + 1).otherwise(0)
    out = ranked.join(have.select("family", "with_event", "phase", "have", "take"), ["family", "with_event", "phase"]).withColumn("draw", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return out.select("family", "window", "with_event", "phase", "draw")


def attendance_weights(df: DataFrame, attendance: Column, is_event: Column) -> DataFrame:
    """exp(half of log attendance over its mean) within 0.5 and 2 for events, 1 for controls."""
    log = F.when(is_event & (attendance > 0), F.log(attendance))
    mean = df.agg(F.avg(log).alias("mean_log"))
    w = F.when(log.isNotNull(), F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.exp((log - F.col("mean_log")) / 2)))).otherwise(1.0)
    return df.join(F.broadcast(mean)).withColumn("weight", w).drop("mean_log")  # one row


def top_per(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def phase_of(issued: Column, start: Column, end: Column, lead_s: float) -> Column:
    """pre_start or pre_end where a window is issued within lead_s before, the start first; other elsewhere and without a schedule."""
    ahead = lambda t: F.coalesce((issued >= t - lead_s) & (issued < t), F.lit(False))
    return F.when(ahead(start), "pre_start").when(ahead(end), "pre_end").otherwise("other")


def lead_category(issued: Column, start: Column, end: Column, bands_min: list[int]) -> Column:
    """start_a_b or end_a_b: the band of minutes that a window leads the start by, else the end; other elsewhere."""
    out = F.lit("other")
    for name, t in (("end", end), ("start", start)):  # the start is asked first
        lead = (t - issued) / 60.0
        for lo, hi in zip(bands_min, bands_min[1:]):
            out = F.when(F.coalesce((lead > lo) & (lead <= hi), F.lit(False)), f"{name}_{lo}_{hi}").otherwise(out)
    return out


def clear_roads(df: DataFrame, key: str, order: str, strict: bool = False, most: float = 0.3) -> DataFrame:
    """df with clear: seen, open and under `most` congestion in the bucket before, and in the one before that where strict. Needs a dense
    spine and columns observed, closed, ratio."""
    w = Window.partitionBy(key).orderBy(order)
    ok = F.col("observed") & F.col("ratio").isNotNull() & ~F.col("closed") & (F.col("ratio") < most)
    before = lambda k: F.coalesce(F.lag("__ok", k).over(w), F.lit(False))
    return df.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("clear", before(1) & before(2) if strict else before(1)).drop("__ok")


def training_windows(cells: DataFrame, origins: DataFrame, horizons: int, step_s: int) -> DataFrame:
    """run, seg, origin, horizon, target, labelled: for each origin and horizon the value then, labelled where it was measured on an open road in
    the demand phase. cells: run, seg, t, value, observed, closed, phase; origins: run, seg, t."""
    ahead = origins.select("run", "seg", F.col("t").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(horizons))).alias("horizon")).withColumn("t", F.col("origin") + F.col("horizon") * step_s)
    ok = F.col("observed") & ~F.col("closed") & F.col("value").isNotNull() & ~F.isnan(F.coalesce(F.col("value"), F.lit(0.0))) & (F.col("phase") == "demand")
    return ahead.join(cells, ["run", "seg", "t"], "left").select("run", "seg", "origin", "horizon", F.col("value").alias("target"), F.coalesce(ok, F.lit(False)).alias("labelled"))


def event_rule(base: Column, target_s: Column, start_s: Column, end_s: Column, metres: Column, most: float = 1800.0) -> Column:
    """Persistence, lengthened near a declared event: by up to 0.3 from 60 minutes before to 120 after its start and by up to 0.5 from 30 before
    to 90 after its end, fading over 400 m and nothing beyond 1000."""
    inside = lambda t, a, b: F.coalesce(((target_s - t) / 60).between(a, b), F.lit(False))
    amp = F.greatest(F.when(inside(start_s, *RULE_ARRIVAL[1:]), RULE_ARRIVAL[0]).otherwise(0.0), F.when(inside(end_s, *RULE_DEPARTURE[1:]), RULE_DEPARTURE[0]).otherwise(0.0))
    near = F.when(metres <= 1000.0, F.exp(-metres / 400.0)).otherwise(0.0)
    return F.least(base * (1 + amp * near), F.lit(most))


def rank_event_cases(edges: DataFrame, lo: float, hi: float, margin_s: float = 3600.0, most: int = 24) -> DataFrame:
    """case, rank: public events, and other cases with an edge within margin_s of the window; events first, then the nearest in time, `most` of
    them at most. edges: case, kind, t (starts and ends of a case, a row each)."""
    gap = F.when(F.col("t").between(lo, hi), 0.0).otherwise(F.least(F.abs(F.col("t") - lo), F.abs(F.col("t") - hi)))
    cases = edges.groupBy("case", "kind").agg(F.min(gap).alias("gap"))
    cases = cases.filter((F.col("kind") == "public_event") | (F.col("gap") <= margin_s)).withColumn("later", F.col("kind") != "public_event")
    top = cases.orderBy("later", F.coalesce("gap", F.lit(float("inf"))), "case").limit(most)
    return top.select("case", F.row_number().over(Window.orderBy("later", F.coalesce("gap", F.lit(float("inf"))), "case")).alias("rank"))


def fill_totals(counts: DataFrame, key: str, seconds: int, carried: list[str], ended: list[str]) -> DataFrame:
    """key, t, and all counts for each second from 0 to seconds - 1: the last known before the run's last second, and after it the last of
    `carried`, 0 of `ended`; 0 before the first. counts: key, t, carried, ended."""
    spine = counts.groupBy(key).agg(F.max("t").alias("__end")).select(key, "__end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seconds - 1).cast("long"))).alias("t"))
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0))
    return spine.join(counts, [key, "t"], "left").select(key, "t", *(known(c).alias(c) for c in carried), *(F.when(F.col("t") > F.col("__end"), 0).otherwise(known(c)).alias(c) for c in ended))


def balanced_patches(points: DataFrame, size: int) -> DataFrame:
    """id, patch: compact patches of at most size points, by cutting at exact ranks along the longer side, parts in proportion. points: id, x, y.

    A round a level, log2 of the number of patches. A level knows its patches' boxes and counts (one row a patch, by partial aggregates), deals
    rows to ranges of (patch, place along the cut), numbers them within each range, and adds the rows of the ranges before (one count a range
    and patch): no task holds a patch. Each level is written to the checkpoint folder.
    """
    n = points.count()
    parts = max(1, -(-n // size))
    out = cut(points.select("id", "x", "y", F.lit(0).alias("patch"), F.lit(parts).alias("parts")))
    while parts > 1:
        boxes = out.groupBy("patch").agg(F.count("*").alias("n"), (F.max("y") - F.min("y") > F.max("x") - F.min("x")).alias("wide"))
        row = out.join(boxes, "patch").withColumns({"a": F.when(F.col("wide"), F.col("y")).otherwise(F.col("x")), "b": F.when(F.col("wide"), F.col("x")).otherwise(F.col("y")), "left": F.floor(F.col("parts") / 2).cast("int")})
        dealt = cut(row.repartitionByRange("patch", "a", "b", "id").sortWithinPartitions("patch", "a", "b", "id").withColumn("range", F.spark_partition_id()))
        before = dealt.groupBy("patch", "range").agg(F.count("*").alias("rows"))
        before = before.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("patch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        within = F.row_number().over(Window.partitionBy("range", "patch").orderBy("a", "b", "id"))
        ranked = dealt.withColumn("within", within).join(before.select("patch", "range", "before"), ["patch", "range"])
        whole, first = F.col("parts") == 1, F.col("before") + F.col("within") <= F.floor(F.col("n") * F.col("left") / F.col("parts"))
        out = cut(ranked.select("id", "x", "y", F.when(whole | first, F.col("patch")).otherwise(F.col("patch") + F.col("left")).alias("patch"), F.when(whole, 1).when(first, F.col("left")).otherwise(F.col("parts") - F.col("left")).alias("parts")))
        parts = -(-parts // 2)
    return out.select("id", "patch")


def subsample_cells(cells: DataFrame, salt: str, shares: dict[str, float]) -> DataFrame:
    """Rows of each stratum whose draw is under its share (1: all); other strata go. cells: id, stratum. The operator is a sample."""
    share = F.try_element_at(F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, float(v)))), F.col("stratum"))
    return cells.filter(unit_draw(F.lit(salt), F.col("id")) < share)
