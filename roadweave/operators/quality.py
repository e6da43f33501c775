"""Data-quality checks: each gives findings, check, level (PASS, WARN, FAIL) and figures, from one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(condition).cast("double"), F.count("*")), F.lit(0.0))


def geometry_findings(rows: DataFrame, *keys: str, least: float = 0.95, poor: float = 0.5, outside: float = 0.01) -> DataFrame:
    """keys, located (share of rows with a place), geometry, inside (share of those in the area), in_area. rows: keys, has_place, in_area."""
    in_area = F.try_divide(F.count_if(F.col("has_place") & F.col("in_area")).cast("double"), F.count_if(F.col("has_place")))
    out = rows.groupBy(*keys).agg(share(F.col("has_place")).alias("located"), in_area.alias("inside"))
    return out.withColumn("geometry", F.when(F.col("located") >= least, "PASS").when(F.col("located") >= poor, "WARN").otherwise("FAIL")).withColumn("in_area", F.when(F.col("inside").isNull(), None).when(1 - F.col("inside") > outside, "WARN").otherwise("PASS"))


def time_findings(rows: DataFrame, start: str, end: str, now: Column, *keys: str) -> DataFrame:
    """keys, unparsed, empty, inverted, active, level of spans given as text."""
    at = lambda c: F.try_to_timestamp(F.col(c))
    bad = lambda c: (F.col(c) != "") & at(c).isNull()
    out = rows.groupBy(*keys).agg(
        F.count_if(bad(start) | bad(end)).alias("unparsed"), F.count_if((F.coalesce(F.col(start), F.lit("")) == "")).alias("empty"), F.count_if(at(end) < at(start)).alias("inverted"), F.count_if((at(start) <= now) & (at(end) >= now)).alias("active"),
    )
    return out.withColumn("level", F.when((F.col("unparsed") > 0) | (F.col("inverted") > 0), "WARN").otherwise("PASS"))


def freshness(rows: DataFrame, t: str, now_s: int, warn_s: int, fail_s: int, *keys: str) -> DataFrame:
    """keys, age_s of the newest row and its level; FAIL without one."""
    out = rows.groupBy(*keys).agg((F.lit(now_s) - F.max(t)).alias("age_s"))
    return out.withColumn("level", F.when(F.col("age_s").isNull() | (F.col("age_s") > fail_s), "FAIL").when(F.col("age_s") > warn_s, "WARN").otherwise("PASS"))


def join_coverage(rows: DataFrame, segments: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """distinct, segments, nodes, level: how many distinct keys name a street segment, else an intersection; WARN under 95 %."""
    keys = rows.filter(F.col(key).isNotNull()).select(key).distinct()
    s, n = segments.select(key).distinct().withColumn("s", F.lit(1)), nodes.select(key).distinct().withColumn("n", F.lit(1))
    out = keys.join(s, key, "left").join(n, key, "left").agg(F.count("*").alias("distinct"), F.count("s").alias("segments"), F.count_if(F.col("s").isNull() & F.col("n").isNotNull()).alias("nodes"))
    return out.withColumn("level", F.when(F.col("segments") + F.col("nodes") >= 0.95 * F.col("distinct"), "PASS").otherwise("WARN"))


def speed_limit_findings(rows: DataFrame, limit: str, *keys: str, sentinel: int = 99) -> DataFrame:
    """keys, posted (share), odd (limits that aren't of fives up to 65), sentinels, unposted, level."""
    mph = F.coalesce(F.col(limit).cast("double").cast("int"), F.lit(0))
    posted = (mph > 0) & (mph != sentinel)
    out = rows.groupBy(*keys).agg(share(posted).alias("posted"), F.count_if(posted & ((mph % 5 != 0) | (mph > 65))).alias("odd"), F.count_if(mph == sentinel).alias("sentinels"), F.count_if(mph == 0).alias("unposted"))
    return out.withColumn("level", F.when(F.col("odd") > 0, "WARN").otherwise("PASS"))


def top_values(rows: DataFrame, column: str, k: int = 6) -> DataFrame:
    """The k most frequent values of a column, the least among equals: a top-k report."""
    return rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(k)


def fleet_findings(fixes: DataFrame, speeds: DataFrame, most_mps: float = 35.0, outliers: float = 0.01) -> DataFrame:
    """polls, median_fleet, in_service, speeds, implausible, level. fixes: t, vehicle, line; speeds: mps."""
    fleet = fixes.groupBy("t").agg(F.count("*").alias("n"), F.count("line").alias("serving")).agg(F.count("*").alias("polls"), F.percentile("n", F.lit(0.5)).alias("median_fleet"), F.try_divide(F.sum("serving").cast("double"), F.sum("n")).alias("in_service"))
    s = speeds.agg(F.count("mps").alias("speeds"), F.count_if(F.col("mps") > most_mps).alias("implausible"))
    level = F.when((F.col("speeds") == 0) | (F.col("implausible") > outliers * F.col("speeds")), "WARN").otherwise("PASS")
    return fleet.join(s).withColumn("level", level)  # one row each


def poll_findings(polls: DataFrame, *keys: str) -> DataFrame:
    """keys, ok (share), success (level), misfits (replies whose arrays differ in length), bad_speeds, typical (median of live over usual time), values
    (level). polls: keys, ok, speeds, metres, coords arrays, duration, usual."""
    rows = polls.withColumn("good", F.coalesce(F.col("ok"), F.lit(False)))
    n = F.coalesce(F.size("speeds"), F.lit(-1))
    misfit = F.col("good") & ((n <= 0) | (F.coalesce(F.size("metres"), F.lit(-1)) != n) | ((F.coalesce(F.size("coords"), F.lit(0)) > 0) & (F.size("coords") != n + 1)))
    bad = F.when(F.col("good"), F.size(F.filter(F.coalesce("speeds", F.array().cast("array<double>")), lambda v: ~v.between(0, 40)))).otherwise(0)
    out = rows.groupBy(*keys).agg(share(F.col("good")).alias("ok"), F.count_if(misfit).alias("misfits"), F.sum(bad).alias("bad_speeds"), F.percentile(F.when(F.col("good") & (F.col("usual") > 0), F.col("duration") / F.col("usual")), F.lit(0.5)).alias("typical"))
    return out.withColumn("success", F.when(F.col("ok") == 1, "PASS").when(F.col("ok") >= 0.9, "WARN").otherwise("FAIL")).withColumn("values", F.when((F.col("misfits") > 0) | (F.col("bad_speeds") > 0), "WARN").otherwise("PASS"))


def export_audit(cells: DataFrame, cover: DataFrame, step_s: int) -> DataFrame:
    """run and its problems: buckets that aren't consecutive, buckets without all roads, masks that disagree with nulls, values on closed roads, roads closed
    without a schedule. cells: run, seg, t, observed, closed, travel_time; cover: seg, bucket, cover (see closure_cover)."""
    c = cells.join(cover.select("seg", F.col("bucket").alias("t"), "cover"), ["seg", "t"], "left")
    of_bucket = c.groupBy("run", "t").agg(
        F.count_distinct("seg").alias("roads"), F.count("*").alias("rows"), F.count_if(F.col("observed") != F.col("travel_time").isNotNull()).alias("mask"), F.count_if(F.col("observed") & F.col("closed")).alias("closed_seen"),
        F.count_if(F.col("closed") & (F.coalesce("cover", F.lit(0.0)) <= 0)).alias("unscheduled"),
    )
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("run").orderBy("t"))
    g = of_bucket.withColumn("gap", gap).groupBy("run").agg(F.count("*").alias("buckets"), F.count_if(F.col("gap") != step_s).alias("gaps"), (F.max("roads") != F.min("roads")).alias("ragged"), F.count_if(F.col("rows") != F.col("roads")).alias("repeats"), *(F.sum(x).alias(x) for x in ("mask", "closed_seen", "unscheduled")))
    named = [("gaps", F.col("gaps") > 0), ("ragged", F.col("ragged")), ("repeats", F.col("repeats") > 0), ("mask", F.col("mask") > 0), ("closed_seen", F.col("closed_seen") > 0), ("unscheduled", F.col("unscheduled") > 0)]
    return g.select("run", "buckets", F.filter(F.array(*(F.when(c, n) for n, c in named)), lambda x: x.isNotNull()).alias("problems"))


def content_digest(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, rows and digest of their rows in whatever order: two sums of hashes of all columns, so no group is gathered."""
    cols = [F.col(c) for c in sorted(rows.columns) if c not in keys]
    a, b = F.xxhash64(*cols).cast("decimal(38,0)"), F.xxhash64(F.lit("again"), *cols).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.concat_ws(":", F.sum(a).cast("string"), F.sum(b).cast("string")).alias("digest"))


def unequal_digests(digests: DataFrame, within: str, between: str) -> DataFrame:
    """Groups within which the digests of what stands between aren't all equal, and how many there are."""
    return digests.groupBy(within).agg(F.count_distinct("digest").alias("digests"), F.count_distinct(between).alias("members")).filter("digests > 1")


def split_leaks(rows: DataFrame, group: str) -> DataFrame:
    """Groups with rows in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def member_findings(rows: DataFrame, required: list[str], roles: str, *keys: str) -> DataFrame:
    """keys, complete (share of rows whose roles hold all required) and level."""
    has = F.size(F.array_except(F.array(*map(F.lit, required)), F.col(roles))) == 0
    out = rows.groupBy(*keys).agg(share(F.coalesce(has, F.lit(False))).alias("complete"))
    return out.withColumn("level", F.when(F.col("complete") >= 0.95, "PASS").otherwise("WARN"))


def attribute_shares(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """keys and for each column the share of rows that have it."""
    return rows.groupBy(*keys).agg(*(share(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns))


def missing_and_unexpected(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """key, side: what is wanted and missing, and what is there unasked; nulls on neither side."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    gone = b.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
    return gone.unionByName(a.join(b, key, "left_anti").withColumn("side", F.lit("unexpected"))).filter(F.col(key).isNotNull())
