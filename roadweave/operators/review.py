"""Review of matched closures: a table of rules over evidence of overlap, names, directions and drivable roads; each row gets a decision, its
reason, and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.lines import near_pieces, pieces_of, sample_lines, turn

#: Metres from a line that lie on it; degrees that run along it; shares of a closure's line that one road, or another road, must carry.
ON_LINE_M, ALONG_DEG, SHORT_COVER, ALONG_COVER = 12.0, 30.0, 0.8, 0.2


def roads_along(closures: DataFrame, edges: DataFrame, step_m: float = 5.0) -> DataFrame:
    """closure, edge, cover: the share of a closure's samples that lie on each edge and run its way or the other. closures: closure, coords;
    edges: edge, coords. Only edges with a sample on them come."""
    samples = sample_lines(closures.withColumnRenamed("closure", "owner"), step_m)
    total = samples.groupBy(F.col("owner").alias("closure")).agg(F.count("*").alias("total"))
    near = near_pieces(samples.select(F.struct("owner", "k").alias("point"), "lon", "lat", F.col("heading").alias("__way")), pieces_of(edges.withColumnRenamed("edge", "owner")), ON_LINE_M)
    angle = turn(F.col("__way"), F.col("heading"))
    on = near.filter(F.least(angle, 180 - angle) <= ALONG_DEG).groupBy(F.col("point.owner").alias("closure"), F.col("owner").alias("edge")).agg(F.count_distinct("point").alias("on"))
    return on.join(total, "closure").select("closure", "edge", (F.col("on") / F.col("total")).alias("cover"))


def uncovered(closures: DataFrame, matched: DataFrame, edges: DataFrame, step_m: float = 2.0) -> DataFrame:
    """closure, rest_m, under: metres of a closure's line that no edge matched to it covers, and whether a drivable edge runs along some of that."""
    samples = sample_lines(closures.withColumnRenamed("closure", "owner"), step_m)
    points = samples.select(F.struct("owner", "k").alias("point"), "lon", "lat", F.col("heading").alias("__way"), F.col("owner").alias("closure"))
    near = near_pieces(points, pieces_of(edges.withColumnRenamed("edge", "owner")), ON_LINE_M).withColumnRenamed("owner", "edge")
    angle = turn(F.col("__way"), F.col("heading"))
    near = near.join(matched.select("closure", "edge", F.lit(True).alias("own")).distinct(), ["closure", "edge"], "left")
    seen = near.groupBy("closure", "point").agg(F.bool_or(F.coalesce("own", F.lit(False))).alias("covered"), F.bool_or(F.least(angle, 180 - angle) <= ALONG_DEG).alias("along"))
    rest = points.select("closure", "point").join(seen, ["closure", "point"], "left").filter("not coalesce(covered, false)")
    return rest.groupBy("closure").agg((F.count("*") * step_m).alias("rest_m"), F.bool_or(F.coalesce("along", F.lit(False))).alias("under"))


def review_closures(rows: DataFrame, matched: DataFrame, rest: DataFrame, along: DataFrame) -> DataFrame:
    """closure, decision, reason, confidence, flags, edges.

    rows: closure, permit, impact, match (matched, ambiguous, unmatched), flags array<string>, has_line; matched: closure, edge, overlap,
    name_match, edge_name (null: unnamed); rest: see uncovered; along: closure, edge, cover, same_name (see roads_along). The first rule that
    holds decides; evidence that is missing holds for no rule that accepts.
    """
    m = matched.groupBy("closure").agg(
        F.array_sort(F.collect_set("edge")).alias("own"), F.bool_and("name_match").alias("named"),
        F.bool_and(F.col("name_match") | (F.col("edge_name").isNull() & (F.col("overlap") >= 0.9))).alias("named_or_links"),
    )
    a = along.groupBy("closure").agg(
        F.array_sort(F.collect_set(F.when(F.col("same_name") & (F.col("cover") >= SHORT_COVER), F.col("edge")))).alias("whole"),
        F.bool_or(F.col("cover") > ALONG_COVER).alias("drivable"),
    )
    c = rows.join(m, "closure", "left").join(rest, "closure", "left").join(a, "closure", "left")
    no = lambda x, otherwise=False: F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(otherwise))
    none = F.array().cast(m.schema["own"].dataType)
    left = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: ~f.startswith("direction_"))
    free, links = F.size(left) == 0, no("named_or_links")
    ambiguous, unmatched = F.col("match") == "ambiguous", F.col("match") == "unmatched"
    only = lambda flag: (F.size(left) == 1) & F.array_contains(left, flag)
    whole = F.coalesce("whole", none)
    rules = [
        (no(F.col("permit") != "Permitted", True), "reject", F.concat(F.lit("permit status "), F.coalesce("permit", F.lit("unknown"))), "high", F.coalesce("own", none), None),
        (no(F.col("impact") != "all-lanes-closed", True), "partial_restriction", F.concat(F.coalesce("impact", F.lit("unknown")), F.lit(": not all lanes")), "high", F.coalesce("own", none), None),
        (F.col("match") == "matched", "accept", F.lit("overlap, name and direction agree"), "high", F.coalesce("own", none), None),
        (ambiguous & free, "accept", F.lit("all lanes closed, so both directions are"), "high", F.coalesce("own", none), None),
        (ambiguous & only("name_mismatch") & links, "accept", F.lit("edges of no name lie on the line almost wholly"), "medium", F.coalesce("own", none), None),
        (ambiguous & only("partial_coverage") & no("named") & ~no("under", True), "accept", F.concat(F.col("rest_m").cast("long").cast("string"), F.lit(" m of the line have no drivable road")), "medium", F.coalesce("own", none), "remainder_not_in_drive_graph"),
        (ambiguous, "needs_review", F.concat(F.lit("flags "), F.array_join(F.array_sort("flags"), ", ")), "low", F.coalesce("own", none), None),
        (unmatched & ~no("has_line"), "needs_review", F.lit("no line"), "low", none, None),
        (unmatched & (F.size(whole) > 0), "accept", F.lit("shorter than an edge of its street, which is closed whole"), "medium", whole, "edge_longer_than_closure"),
        (unmatched & ~no("drivable"), "no_drivable_road", F.lit("no drivable road runs along the line"), "medium", none, None),
        (F.lit(True), "needs_review", F.lit("no edge of its street under the line"), "low", none, None),
    ]

    def chosen(k: int, lift=lambda x: x) -> Column:
        out = None
        for rule in rules:
            value = lift(rule[k])
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out

    more = chosen(5, lambda flag: F.array(F.lit(flag)) if flag else F.array().cast("array<string>"))
    flags = F.array_sort(F.array_union(F.coalesce("flags", F.array().cast("array<string>")), more))
    return c.select("closure", chosen(1, F.lit).alias("decision"), chosen(2).alias("reason"), chosen(3, F.lit).alias("confidence"), flags.alias("flags"), chosen(4).alias("edges"))


def reviewed_cases(reviewed: DataFrame, rows: DataFrame) -> DataFrame:
    """case, status, rows, full, accepted: verified where all full closures of a case are accepted with edges, partial where some are. rows: closure, case."""
    full = F.col("decision").isin("accept", "needs_review")
    c = reviewed.join(rows.select("closure", "case"), "closure").groupBy("case").agg(F.count("*").alias("rows"), F.count_if(full).alias("full"), F.count_if(F.col("decision") == "accept").alias("accepted"), F.bool_or((F.col("decision") == "accept") & (F.size("edges") > 0)).alias("placed"))
    status = F.when((F.col("full") > 0) & (F.col("accepted") == F.col("full")) & F.col("placed"), "verified").when(F.col("accepted") > 0, "partial").otherwise("unverified")
    return c.select("case", status.alias("status"), "rows", "full", "accepted")
