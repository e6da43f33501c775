"""Lines against roads: pieces near a point that run its way, provider lines snapped to roads, closures matched to the roads that they close."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import haversine_m
from roadweave.operators.joins import cells_around, own_cell

#: Metres of a degree; a city is a plane.
LAT_M = 111_132.0


def lon_m(lat: Column) -> Column:
    return 111_320.0 * F.cos(F.radians(lat))


def pieces_of(lines: DataFrame, owner: str = "owner") -> DataFrame:
    """owner, piece, ax, ay, bx, by, heading of each straight piece of a line; pieces without length are left out. lines: owner, coords
    array<array<double>> (lon, lat)."""
    n = F.size("coords") - 1
    ends = F.arrays_zip(F.slice("coords", 1, n).alias("a"), F.slice("coords", 2, n).alias("b"))
    p = lines.filter(n > 0).select(owner, F.posexplode(ends).alias("piece", "x"))
    p = p.select(owner, "piece", F.get("x.a", 0).alias("ax"), F.get("x.a", 1).alias("ay"), F.get("x.b", 0).alias("bx"), F.get("x.b", 1).alias("by")).filter("ax <> bx or ay <> by")
    return p.withColumn("heading", heading(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


def heading(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees clockwise from north, on a plane."""
    return F.pmod(F.degrees(F.atan2((bx - ax) * lon_m((ay + by) / 2), (by - ay) * LAT_M)) + 360.0, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The angle between two headings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def off_piece(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres of a point from a piece."""
    k = lon_m(y)
    px, py, qx, qy = (ax - x) * k, (ay - y) * LAT_M, (bx - x) * k, (by - y) * LAT_M
    dx, dy = qx - px, qy - py
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(px * dx + py * dy) / (dx * dx + dy * dy)))
    return F.hypot(px + t * dx, py + t * dy)


def near_pieces(points: DataFrame, pieces: DataFrame, radius_m: float, step_m: float = 50.0) -> DataFrame:
    """Each point with the pieces within the radius, and metres. points: point, lon, lat, ...; pieces: see pieces_of. A piece is dealt to the
    cells of samples every step_m along it, with a radius that reaches between them; a pair comes up in the first cell that both have alone."""
    reach = radius_m + step_m
    length = F.hypot((F.col("bx") - F.col("ax")) * lon_m(F.col("ay")), (F.col("by") - F.col("ay")) * LAT_M)
    n = F.greatest(F.lit(1), F.ceil(length / step_m).cast("int"))
    at = F.transform(F.sequence(F.lit(0), n), lambda k: own_cell(F.col("ax") + k / n * (F.col("bx") - F.col("ax")), F.col("ay") + k / n * (F.col("by") - F.col("ay")), reach))
    q = pieces.withColumn("__cells", F.array_distinct(at)).withColumn("__cell", F.explode("__cells"))
    p = points.withColumn("__around", cells_around(F.col("lon"), F.col("lat"), reach)).withColumn("__cell", F.explode("__around"))
    both = p.join(q, "__cell").filter(F.get(F.array_intersect("__cells", "__around"), 0) == F.col("__cell"))
    both = both.withColumn("metres", off_piece(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return both.filter(F.col("metres") <= radius_m).drop("__cell", "__cells", "__around")


def nearest_lines(points: DataFrame, pieces: DataFrame, radius_m: float) -> DataFrame:
    """point, owner, metres, rank: the owners of pieces within the radius, nearest first, one row an owner."""
    least = near_pieces(points.select("point", "lon", "lat"), pieces, radius_m).groupBy("point", "owner").agg(F.min("metres").alias("metres"))
    return least.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("metres", "owner")))


def nearest_heading(points: DataFrame, pieces: DataFrame, radius_m: float, most_angle: float) -> DataFrame:
    """point, owner, metres of the nearest piece that runs within most_angle of the point's heading. points: point, lon, lat, heading."""
    found = on_headings(points.select("point", "lon", "lat", "heading"), pieces, radius_m, most_angle)
    return found.groupBy("point").agg(F.min(F.struct("metres", "owner")).alias("x")).select("point", "x.owner", "x.metres")


def on_headings(points: DataFrame, pieces: DataFrame, radius_m: float, most_angle: float) -> DataFrame:
    """points that have a piece within the radius and most_angle of their heading, with owner and metres of the nearest. points: lon, lat, heading,
    ... Points of one position and heading search once, and of pieces between the same ends only that of the least owner is met."""
    one = pieces.groupBy("ax", "ay", "bx", "by").agg(F.min("owner").alias("owner"), F.first("heading").alias("heading"))
    spots = points.select("lon", "lat", F.col("heading").alias("__way")).distinct()
    near = near_pieces(spots, one, radius_m).filter(turn(F.col("__way"), F.col("heading")) <= most_angle)
    best = near.groupBy("lon", "lat", F.col("__way").alias("heading")).agg(F.min(F.struct("metres", "owner")).alias("x")).select("lon", "lat", "heading", "x.owner", "x.metres")
    return points.join(best, ["lon", "lat", "heading"])


def prune_detours(path: list[tuple[str, float]], ends: dict[str, tuple[str, str]]) -> list[tuple[str, float]]:
    """A path without its side steps: a road goes if its neighbours join each other without it and it doesn't lie between them. ends: road -> its
    nodes. One pass: roads are stacked, and a new one first takes away those on top that it makes a side step; what is below was settled
    before. A road that is kept anywhere keeps all its rows."""
    stack: list[str] = []
    for road, _ in path:
        if stack and stack[-1] == road:
            continue
        enters = ends[road][0]
        while len(stack) > 1 and ends[stack[-2]][1] == enters and ends[stack[-1]] != (enters, enters):
            stack.pop()
        stack.append(road)
    kept = set(stack)
    return [row for row in path if row[0] in kept]


def snap_lines(lines: DataFrame, pieces: DataFrame, roads: DataFrame, radius_m: float = 20.0, most_angle: float = 45.0) -> DataFrame:
    """key, place, seg, metres: the roads along each line and how much of it runs on each. A piece of the line goes to the nearest road that runs
    its way; those of one road in a row are one; detours are pruned, line by line. lines: key, coords; pieces: of roads, their owner the road;
    roads: seg, u, v. A line's matches are one group: as many as it has pieces."""
    p = pieces_of(lines.withColumnRenamed("key", "owner")).withColumnRenamed("owner", "key")
    mid = p.select(F.struct("key", "piece").alias("point"), ((F.col("ax") + F.col("bx")) / 2).alias("lon"), ((F.col("ay") + F.col("by")) / 2).alias("lat"), "heading")
    length = F.hypot((F.col("bx") - F.col("ax")) * lon_m((F.col("ay") + F.col("by")) / 2), (F.col("by") - F.col("ay")) * LAT_M)
    hits = nearest_heading(mid, pieces, radius_m, most_angle).select("point.key", "point.piece", F.col("owner").alias("seg"))
    rows = hits.join(p.select("key", "piece", length.alias("metres")), ["key", "piece"]).join(roads.select("seg", "u", "v"), "seg")
    w = Window.partitionBy("key").orderBy("piece")
    fresh = rows.withColumn("run", F.sum(F.when(F.lag("seg").over(w) == F.col("seg"), 0).otherwise(1)).over(w))
    runs = fresh.groupBy("key", "run", "seg", "u", "v").agg(F.sum("metres").alias("metres"))

    def prune(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("run", kind="stable")
        kept = prune_detours(list(zip(x["seg"], x["metres"], strict=True)), {s: (u, v) for s, u, v in zip(x["seg"], x["u"], x["v"], strict=True)})
        return pd.DataFrame({"key": x["key"].iloc[0], "place": range(len(kept)), "seg": [s for s, _ in kept], "metres": [m for _, m in kept]})

    types = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    return runs.groupBy("key").applyInPandas(prune, f"key {types['key']}, place int, seg {types['seg']}, metres double")


def sample_lines(lines: DataFrame, step_m: float, owner: str = "owner") -> DataFrame:
    """owner, k, lon, lat, heading: points every step_m along a line or closer, at the middle of equal shares of each piece."""
    p = pieces_of(lines, owner)
    length = F.hypot((F.col("bx") - F.col("ax")) * lon_m((F.col("ay") + F.col("by")) / 2), (F.col("by") - F.col("ay")) * LAT_M)
    n = F.greatest(F.lit(1), F.ceil(length / step_m).cast("int"))
    p = p.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = (F.col("k") + 0.5) / F.col("n")
    return p.select(owner, F.struct("piece", "k").alias("k"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("lon"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("lat"), "heading")


def covering_lines(edges: DataFrame, lines: DataFrame, step_m: float = 10.0, radius_m: float = 15.0, most_angle: float = 45.0, least: float = 0.5, reverse: bool = False) -> DataFrame:
    """owner, line, share, way: for each edge the line that covers most of its samples, at least that share. With reverse a line that runs the other
    way is taken where it covers a quarter more than any that runs the same way. edges, lines: owner, coords."""
    samples = sample_lines(edges, step_m)
    total = samples.groupBy("owner").agg(F.count("*").alias("total"))
    pieces = pieces_of(lines)
    near = near_pieces(samples.select(F.struct("owner", "k").alias("point"), "lon", "lat", F.col("heading").alias("__way")), pieces, radius_m)
    nearest = near.groupBy("point", F.col("owner").alias("line")).agg(F.min_by(turn(F.col("__way"), F.col("heading")), "metres").alias("angle"))
    shares = nearest.groupBy(F.col("point.owner").alias("owner"), "line").agg(F.count_if(F.col("angle") <= most_angle).alias("same"), F.count_if(F.col("angle") >= 180 - most_angle).alias("back")).join(total, "owner")
    best = shares.groupBy("owner", "total").agg(F.max(F.struct("same", "line")).alias("s"), F.max(F.struct("back", "line")).alias("b"))
    turned = F.lit(reverse) & (F.col("b.back") > F.col("s.same") + 0.25 * F.col("total"))
    share = F.when(turned, F.col("b.back")).otherwise(F.col("s.same")) / F.col("total")
    return best.select("owner", F.when(turned, F.col("b.line")).otherwise(F.col("s.line")).alias("line"), share.alias("share"), F.when(turned, "undirected_line").otherwise("same_direction").alias("way")).filter(F.col("share") >= least)


def match_closures(closures: DataFrame, edges: DataFrame, step_m: float = 5.0, radius_m: float = 12.0, most_angle: float = 30.0, least: float = 0.5) -> DataFrame:
    """closure, edge, overlap, name_match: edges along a closure's line, in either direction, with at least that share of their samples on it and
    the closure's street. An edge without a name must lie on it almost wholly (0.9) and be 10 m long. closures: closure, coords, street;
    edges: edge, coords, name, length; names normalized."""
    samples = sample_lines(edges.withColumnRenamed("edge", "owner"), step_m)
    total = samples.groupBy("owner").agg(F.count("*").alias("total"))
    pieces = pieces_of(closures.withColumnRenamed("closure", "owner"))
    near = near_pieces(samples.select(F.struct("owner", "k").alias("point"), "lon", "lat", F.col("heading").alias("__way")), pieces, radius_m)
    nearest = near.groupBy("point", F.col("owner").alias("closure")).agg(F.min_by(turn(F.col("__way"), F.col("heading")), "metres").alias("angle"))
    along = F.least(F.col("angle"), 180 - F.col("angle")) <= most_angle
    shares = nearest.filter(along).groupBy(F.col("point.owner").alias("edge"), "closure").agg(F.count("*").alias("on")).join(total.withColumnRenamed("owner", "edge"), "edge")
    shares = shares.withColumn("overlap", F.col("on") / F.col("total")).filter(F.col("overlap") >= least)
    named = shares.join(edges.select("edge", "name", "length"), "edge").join(closures.select("closure", "street"), "closure").withColumn("name_match", F.coalesce(F.col("name") == F.col("street"), F.lit(False)))
    return named.filter(F.col("name_match") | (F.col("name").isNull() & (F.col("overlap") >= 0.9) & (F.col("length") >= 10))).select("closure", "edge", "overlap", "name_match")


def closure_coverage(closures: DataFrame, matched: DataFrame, edges: DataFrame, step_m: float = 5.0, radius_m: float = 12.0) -> DataFrame:
    """closure, covered, flags, status: the share of a closure's samples near an edge matched to it; matched without a flag, ambiguous with one,
    unmatched without an edge. closures: closure, coords, direction."""
    samples = sample_lines(closures.withColumnRenamed("closure", "owner"), step_m)
    total = samples.groupBy(F.col("owner").alias("closure")).agg(F.count("*").alias("total"))
    pieces = pieces_of(edges.withColumnRenamed("edge", "owner")).withColumnRenamed("owner", "edge")
    near = near_pieces(samples.select(F.struct("owner", "k").alias("point"), "lon", "lat", F.col("owner").alias("closure")), pieces, radius_m)
    hit = near.join(matched.select("closure", "edge"), ["closure", "edge"]).groupBy("closure").agg(F.count_distinct("point").alias("on"))
    names = matched.groupBy("closure").agg(F.bool_and("name_match").alias("names"))
    c = closures.select("closure", "direction").join(total, "closure", "left").join(hit, "closure", "left").join(names, "closure", "left")
    covered = F.coalesce(F.round(F.try_divide("on", "total"), 2), F.lit(0.0))
    flags = F.filter(F.array(F.when(covered < 0.8, "partial_coverage"), F.when(~F.col("names"), "name_mismatch"), F.when(F.coalesce(F.col("direction") != "both", F.lit(True)), "direction_treated_as_both")), lambda x: x.isNotNull())
    found = F.col("names").isNotNull()
    return c.select("closure", covered.alias("covered"), F.when(found, flags).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(~found, "unmatched").when(F.size(flags) == 0, "matched").otherwise("ambiguous").alias("status"))


def closed_edges(matched: DataFrame, closures: DataFrame) -> DataFrame:
    """edge, restriction, closures: full where any of its closures closes all lanes. closures: closure, impact."""
    m = matched.join(closures.select("closure", "impact"), "closure")
    return m.groupBy("edge").agg(F.when(F.bool_or(F.col("impact") == "all-lanes-closed"), "full").otherwise("partial").alias("restriction"), F.count_distinct("closure").alias("closures"))


def edges_of_line(lines: DataFrame, midpoints: DataFrame, radius_m: float = 15.0, most: int = 200) -> DataFrame:
    """key, edge of the edges whose middle lies on the line, the nearest `most` (the feature's own cap). lines: key, coords; midpoints: edge, lon, lat."""
    pieces = pieces_of(lines.withColumnRenamed("key", "owner"))
    near = near_pieces(midpoints.withColumnRenamed("edge", "point").select("point", "lon", "lat"), pieces, radius_m)
    least = near.groupBy(F.col("owner").alias("key"), F.col("point").alias("edge")).agg(F.min("metres").alias("metres"))
    return least.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("metres", "edge"))).filter(F.col("n") <= most).select("key", "edge")


def enrich_from_streets(records: DataFrame, streets: DataFrame, nodes: DataFrame, radius_m: float = 25.0) -> DataFrame:
    """records with match (segment, intersection, unknown), borrowed coordinates where they have none, and for a record with a place but no number
    the nearest street. records: id, cnn, lon, lat; streets: cnn, coords; nodes: cnn, nlon, nlat."""
    middle = F.get("coords", F.floor(F.size("coords") / 2).cast("int"))
    s = streets.select("cnn", F.get(middle, 0).alias("slon"), F.get(middle, 1).alias("slat"), F.lit(True).alias("is_street"))
    r = records.join(s, "cnn", "left").join(nodes.select("cnn", "nlon", "nlat", F.lit(True).alias("is_node")), "cnn", "left")
    lost = records.filter("cnn is null and lon is not null").select(F.col("id").alias("point"), "lon", "lat")
    near = nearest_lines(lost, pieces_of(streets.withColumnRenamed("cnn", "owner")), radius_m).filter("rank = 1").select(F.col("point").alias("id"), F.col("owner").alias("near_cnn"))
    r = r.join(near, "id", "left")
    match = F.when(F.col("is_street") | F.col("near_cnn").isNotNull(), "segment").when(F.col("is_node"), "intersection").otherwise("unknown")
    return r.select("id", F.coalesce("cnn", "near_cnn").alias("cnn"), F.coalesce("lon", "slon", "nlon").alias("lon"), F.coalesce("lat", "slat", "nlat").alias("lat"), match.alias("match"))




#: Seconds and metres between two fixes at most; a hop under so many metres is none.
GAP_S, HOP_M, STOPPED_M = 180, 1500.0, 5.0


def service_speeds(fixes: DataFrame, pieces: DataFrame, since_s: int | None = None, radius_m: float = 20.0, most_angle: float = 45.0) -> DataFrame:
    """id, vehicle, seg, t, mps: the speed of a vehicle in service between two fixes, on the road that it ran along.

    Both fixes must be of one line, at most GAP_S and HOP_M apart. A move is on the nearest road to its middle that runs its way; a vehicle that
    hardly moved is on the road that its bearing points along, and without one nowhere. Fixes before since_s only start a move. A fix
    without a vehicle or place is left out. fixes: id (once each), vehicle, line, t, lon, lat, bearing; pieces: of roads, their owner the road.
    """
    w = Window.partitionBy("vehicle").orderBy("t", "id")
    f = fixes.filter("vehicle is not null and t is not null and lon is not null and lat is not null")
    f = f.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("line", "t", "lon", "lat"))).filter("line = p_line")
    f = f.filter(F.col("t") >= since_s) if since_s is not None else f
    gap = F.col("t") - F.col("p_t")
    f = f.withColumn("gap", gap).withColumn("hop", haversine_m(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat"))).filter((F.col("gap") > 0) & (F.col("gap") <= GAP_S) & (F.col("hop") <= HOP_M))
    moved = F.col("hop") >= STOPPED_M
    middle = lambda c: F.when(moved, (F.col(f"p_{c}") + F.col(c)) / 2).otherwise(F.col(c)).alias(c)
    way = F.when(moved, heading(F.col("p_lon"), F.col("p_lat"), F.col("lon"), F.col("lat"))).otherwise(F.col("bearing"))
    moves = f.select("id", "vehicle", "t", (F.col("hop") / F.col("gap")).alias("mps"), middle("lon"), middle("lat"), way.alias("heading")).filter("heading is not null")
    return on_headings(moves, pieces, radius_m, most_angle).select("id", "vehicle", F.col("owner").alias("seg"), "t", "mps")


def piece_share(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far along a piece its nearest place to a point is, 0 to 1."""
    dx, dy = (bx - ax) * lon_m(y), (by - ay) * LAT_M
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * lon_m(y) * dx + (y - ay) * LAT_M * dy) / (dx * dx + dy * dy)))


def snap_ends(points: DataFrame, pieces: DataFrame, radius_m: float = 75.0, tie_m: float = 3.0) -> DataFrame:
    """point, owner, metres, share, rank: a point's nearest road within the radius and all that are at most tie_m farther, as both directions of a
    street are; share is how far along the road (0 to 1) its nearest place is. Roads as near to a millimetre go by owner. A point without a road has no row.
    points: point (once each), lon, lat; pieces: see pieces_of. Points of one position search and rank roads once."""
    length = F.hypot((F.col("bx") - F.col("ax")) * lon_m((F.col("ay") + F.col("by")) / 2), (F.col("by") - F.col("ay")) * LAT_M)
    road = Window.partitionBy("owner")
    measured = pieces.withColumn("long", length).withColumn("before", F.sum("long").over(road.orderBy("piece")) - F.col("long")).withColumn("all", F.sum("long").over(road))
    near = near_pieces(points.select("lon", "lat").distinct(), measured, radius_m)
    along = (F.col("before") + piece_share(*(F.col(c) for c in ("lon", "lat", "ax", "ay", "bx", "by"))) * F.col("long")) / F.col("all")
    roads = near.groupBy("lon", "lat", "owner").agg(F.min(F.struct("metres", "piece", along.alias("share"))).alias("x")).select("lon", "lat", "owner", "x.metres", "x.share")
    spot = Window.partitionBy("lon", "lat")
    tied = roads.withColumn("least", F.min("metres").over(spot)).filter(F.col("metres") <= F.col("least") + tie_m).drop("least")
    ranked = tied.withColumn("rank", F.row_number().over(spot.orderBy(F.round("metres", 3), "owner")))
    return points.select("point", "lon", "lat").join(ranked, ["lon", "lat"]).drop("lon", "lat")
