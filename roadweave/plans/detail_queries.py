"""Registered queries of navigation, the review of closures, footprints with hops, the feature table and street names; added to those of
plans.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import scalars as S
from roadweave.operators import features as FT
from roadweave.operators import navigation as NV
from roadweave.operators import review as RV
from roadweave.operators import routing as R
from roadweave.operators import scoring as P
from roadweave.operators import streets as X
from roadweave.operators import windows as W
from roadweave.operators.joins import in_parts, sent_if_few
from roadweave.plans import lenses as L
from roadweave.plans.queries import HAV, buckets, query
from roadweave.plans.road_queries import candidates
from roadweave.sources import normalizers as N


def rounded(df, digits: int, *names: str):
    return df.withColumns({c: F.round(c, digits) for c in names})


def nudged(df, *names: str):
    """Rounded to five digits, with what keeps both sides off the border between two of them."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in names})


def vertices(spark, d):
    """The places of an order's lines in order, each a step of the route: route, j (from 1), plon, plat, metres, seconds, part. Dealt to parts by
    route."""
    own = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = L.table(spark, d, "lineitem").select(*own)
    l = in_parts(lines.join(sent_if_few(L.places(spark, d)), F.col("l_suppkey") == F.col("place_id")).select(*own, "plon", "plat"), lines.count(), "l_orderkey")
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return l.select(F.col("l_orderkey").alias("route"), j.alias("j"), "plon", "plat", (F.col("l_quantity") * 10).alias("metres"), (F.col("l_extendedprice") / 100).alias("seconds"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))


@query(
    """, v AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS j, plon, plat, l_quantity * 10 AS metres, l_extendedprice / 100 AS seconds, l_partkey AS part, l_quantity AS quantity FROM lineitem JOIN places ON l_suppkey = place_id),
    s AS (SELECT *, sum(metres) OVER w - metres AS start, sum(metres) OVER w AS stop, sum(metres) OVER p AS total, count(*) OVER p AS n, sum(seconds) OVER p - sum(seconds) OVER w AS later FROM v WINDOW w AS (PARTITION BY route ORDER BY j ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY route)),
    f AS (SELECT route, j AS t, n, total, plon + ((part % 21) - 10) * 1e-4 AS lon, plat + ((part % 17) - 8) * 1e-4 AS lat, quantity * 2.4 AS accuracy FROM s),
    e AS (SELECT route, plon AS elon, plat AS elat FROM s WHERE j = n),
    d AS (SELECT f.route, f.t, a.j, cos(radians(f.lat)) AS k, (b.plon - a.plon) * cos(radians(f.lat)) AS bx, b.plat - a.plat AS by_, (f.lon - a.plon) * cos(radians(f.lat)) AS px, f.lat - a.plat AS py FROM f JOIN v a ON a.route = f.route JOIN v b ON b.route = a.route AND b.j = a.j + 1),
    g AS (SELECT *, sqrt(bx * bx + by_ * by_) * 111320.0 AS seg, CASE WHEN bx * bx + by_ * by_ > 0 THEN greatest(0, least(1, (px * bx + py * by_) / (bx * bx + by_ * by_))) ELSE 0 END AS q FROM d),
    h AS (SELECT *, round(sqrt((px - q * bx) * (px - q * bx) + (py - q * by_) * (py - q * by_)) * 111320.0, 5) AS off, sum(seg) OVER (PARTITION BY route, t ORDER BY j ROWS UNBOUNDED PRECEDING) - seg + q * seg AS along, sum(seg) OVER (PARTITION BY route, t) AS length FROM g),
    o AS (SELECT route, t, off, along, length FROM h QUALIFY row_number() OVER (PARTITION BY route, t ORDER BY off, j) = 1),
    m AS (SELECT f.*, o.along / o.length * f.total AS at FROM f JOIN o USING (route, t) WHERE f.accuracy <= 100 AND o.off <= greatest(60.0, f.accuracy) AND o.length > 0),
    x AS (SELECT m.route, m.t, c.j - 1 AS step, greatest(0, c.stop - m.at) AS to_next_m, greatest(0, m.total - m.at) AS left_m, c.later + c.seconds * greatest(0, c.stop - m.at) / c.metres AS left_s FROM m JOIN s c ON c.route = m.route AND c.start <= m.at AND (m.at < c.stop OR c.j = c.n)),
    y AS (SELECT f.route, f.t, f.accuracy <= 50 AND sqrt(((elon - lon) * cos(radians(lat))) ** 2 + (elat - lat) ** 2) * 111320.0 <= 40 AS arrived, x.step IS NULL AS held, struct_pack(step, to_next_m, left_m, left_s) AS seen, x.step AS has FROM f JOIN e USING (route) LEFT JOIN x USING (route, t)),
    z AS (SELECT route, t, arrived, held, last_value(CASE WHEN has IS NOT NULL THEN seen END IGNORE NULLS) OVER (PARTITION BY route ORDER BY t ROWS UNBOUNDED PRECEDING) AS known FROM y)
    SELECT route AS trip, t::BIGINT AS t, arrived, held, known.step::DOUBLE AS step, round(known.to_next_m, 2) AS to_next_m, round(known.left_m, 2) AS left_m, round(known.left_s, 4) + 0.0 AS left_s FROM z""".lstrip(),
    "places",
)
def nav_progress(spark, d):
    """A fix near each vertex of each route, some vague, some off it."""
    v = vertices(spark, d)
    part = F.col("part")
    fixes = v.select(F.col("route").alias("trip"), "route", F.col("j").cast("long").alias("t"), (F.col("plon") + ((part % 21) - 10) * 1e-4).alias("lon"), (F.col("plat") + ((part % 17) - 8) * 1e-4).alias("lat"), (F.col("quantity") * 2.4).alias("accuracy"))
    none = F.lit(None).cast("double")
    rows = v.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("j", "plon", "plat", "metres", "seconds"))).alias("x"))
    routes = rows.select("route", F.transform("x", lambda p: F.array(p["plon"], p["plat"])).alias("coords"), F.transform("x", lambda p: F.struct(p["metres"].alias("metres"), p["seconds"].alias("seconds"))).alias("steps"), none.alias("end_lon"), none.alias("end_lat"))
    return rounded(rounded(NV.nav_progress(fixes, routes).withColumn("step", F.col("step").cast("double")), 2, "to_next_m", "left_m"), 4, "left_s")


REVIEW = """r AS (SELECT o_orderkey AS closure, o_custkey % 200 AS cas, CASE WHEN o_orderkey % 13 = 0 THEN 'Cancelled' ELSE 'Permitted' END AS permit, CASE WHEN o_orderkey % 11 = 0 THEN 'one-lane' ELSE 'all-lanes-closed' END AS impact, CASE o_orderkey % 4 WHEN 0 THEN 'matched' WHEN 3 THEN 'unmatched' ELSE 'ambiguous' END AS match,
        CASE o_orderkey % 6 WHEN 0 THEN ['direction_treated_as_both'] WHEN 1 THEN ['name_mismatch'] WHEN 2 THEN ['partial_coverage'] WHEN 3 THEN ['name_mismatch', 'partial_coverage'] WHEN 5 THEN ['direction_treated_as_both', 'name_mismatch'] ELSE [] END AS flags, o_orderkey % 7 <> 0 AS has_line FROM orders),
    m AS (SELECT l_orderkey AS closure, list_sort(list(DISTINCT l_suppkey)) AS own, bool_and(l_partkey % 3 > 0) AS named, bool_and(l_partkey % 3 > 0 OR (l_partkey % 2 = 0 AND l_quantity >= 20)) AS links FROM lineitem GROUP BY 1),
    s AS (SELECT o_orderkey AS closure, o_orderkey % 50 AS rest_m, o_orderkey % 2 = 0 AND o_custkey % 2 = 0 AS under FROM orders WHERE o_orderkey % 3 <> 1),
    a AS (SELECT l_orderkey AS closure, list_sort(list(DISTINCT l_partkey) FILTER (WHERE l_linenumber % 3 = 0 AND l_quantity >= 40)) AS whole, bool_or(l_quantity > 10) AS drivable FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
    c AS (SELECT r.*, coalesce(own, []) AS own, coalesce(named, FALSE) AS named, coalesce(links, FALSE) AS links, rest_m, coalesce(under, TRUE) AS under, coalesce(whole, []) AS whole, coalesce(drivable, FALSE) AS drivable, list_filter(flags, lambda f: NOT starts_with(f, 'direction_')) AS rest FROM r LEFT JOIN m USING (closure) LEFT JOIN s USING (closure) LEFT JOIN a USING (closure)),
    n AS (SELECT *, CASE WHEN permit <> 'Permitted' THEN 1 WHEN impact <> 'all-lanes-closed' THEN 2 WHEN match = 'matched' THEN 3 WHEN match = 'ambiguous' THEN CASE WHEN len(rest) = 0 THEN 4 WHEN rest = ['name_mismatch'] AND links THEN 5 WHEN rest = ['partial_coverage'] AND named AND NOT under THEN 6 ELSE 7 END WHEN NOT has_line THEN 8 WHEN len(whole) > 0 THEN 9 WHEN NOT drivable THEN 10 ELSE 11 END AS rule FROM c),
    d AS (SELECT closure, cas, CASE rule WHEN 1 THEN 'reject' WHEN 2 THEN 'partial_restriction' WHEN 7 THEN 'needs_review' WHEN 8 THEN 'needs_review' WHEN 10 THEN 'no_drivable_road' WHEN 11 THEN 'needs_review' ELSE 'accept' END AS decision,
        CASE rule WHEN 1 THEN 'permit status ' || permit WHEN 2 THEN impact || ': not all lanes' WHEN 3 THEN 'overlap, name and direction agree' WHEN 4 THEN 'all lanes closed, so both directions are' WHEN 5 THEN 'edges of no name lie on the line almost wholly' WHEN 6 THEN rest_m || ' m of the line have no drivable road' WHEN 7 THEN 'flags ' || array_to_string(list_sort(flags), ', ')
            WHEN 8 THEN 'no line' WHEN 9 THEN 'shorter than an edge of its street, which is closed whole' WHEN 10 THEN 'no drivable road runs along the line' ELSE 'no edge of its street under the line' END AS reason,
        CASE WHEN rule <= 4 THEN 'high' WHEN rule IN (5, 6, 9, 10) THEN 'medium' ELSE 'low' END AS confidence, list_sort(CASE rule WHEN 6 THEN list_append(flags, 'remainder_not_in_drive_graph') WHEN 9 THEN list_append(flags, 'edge_longer_than_closure') ELSE flags END) AS flags, CASE WHEN rule = 9 THEN whole WHEN rule IN (8, 10, 11) THEN [] ELSE own END AS edges FROM n)"""


def reviewed(spark, d):
    o, l = L.table(spark, d, "orders"), L.table(spark, d, "lineitem")
    k = F.col("o_orderkey")
    of = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    flags = F.when(k % 6 == 0, of("direction_treated_as_both")).when(k % 6 == 1, of("name_mismatch")).when(k % 6 == 2, of("partial_coverage")).when(k % 6 == 3, of("name_mismatch", "partial_coverage")).when(k % 6 == 5, of("direction_treated_as_both", "name_mismatch")).otherwise(of())
    match = F.when(k % 4 == 0, "matched").when(k % 4 == 3, "unmatched").otherwise("ambiguous")
    rows = o.select(k.alias("closure"), (F.col("o_custkey") % 200).alias("case"), F.when(k % 13 == 0, "Cancelled").otherwise("Permitted").alias("permit"), F.when(k % 11 == 0, "one-lane").otherwise("all-lanes-closed").alias("impact"), match.alias("match"), flags.alias("flags"), (k % 7 != 0).alias("has_line"))
    matched = l.select(F.col("l_orderkey").alias("closure"), F.col("l_suppkey").alias("edge"), (F.col("l_quantity") / 20 * 0.9).alias("overlap"), (F.col("l_partkey") % 3 > 0).alias("name_match"), F.when(F.col("l_partkey") % 2 > 0, "named").alias("edge_name"))
    rest = o.filter(k % 3 != 1).select(k.alias("closure"), (k % 50).alias("rest_m"), ((k % 2 == 0) & (F.col("o_custkey") % 2 == 0)).alias("under"))  # lines without a remainder have no row
    along = l.filter("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("closure"), F.col("l_partkey").alias("edge"), (F.col("l_quantity") / 50).alias("cover"), (F.col("l_linenumber") % 3 == 0).alias("same_name"))
    return rows, RV.review_closures(rows, matched, rest, along)


@query(f"WITH {REVIEW} SELECT closure, decision, reason, confidence, array_to_string(flags, ',') AS flags, array_to_string(edges, ',') AS edges FROM d")
def review_closures(spark, d):
    _, out = reviewed(spark, d)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("flags", "edges")})


@query(f"WITH {REVIEW}, f AS (SELECT cas, count(*) AS rows, count_if(decision IN ('accept', 'needs_review')) AS full_, count_if(decision = 'accept') AS accepted, bool_or(decision = 'accept' AND len(edges) > 0) AS placed FROM d GROUP BY cas) SELECT cas AS \"case\", CASE WHEN full_ > 0 AND accepted = full_ AND placed THEN 'verified' WHEN accepted > 0 THEN 'partial' ELSE 'unverified' END AS status, rows, full_::BIGINT AS \"full\", accepted::BIGINT AS accepted FROM f")
def reviewed_cases(spark, d):
    rows, out = reviewed(spark, d)
    return RV.reviewed_cases(out, rows)


@query(
    f""", own AS (SELECT s_nationkey AS cas, s_suppkey AS road, s_suppkey * 100 AS begin_s, s_suppkey * 100 + 3600 AS end_s FROM supplier),
    n AS (SELECT o.cas, q.place_id AS road, min({HAV.format(a="a.p", b="q.p")}) AS m FROM own o JOIN places a ON a.place_id = o.road JOIN places q ON abs(a.plat - q.plat) < 0.05 GROUP BY 1, 2 HAVING m <= 3000),
    down AS (WITH RECURSIVE h AS (SELECT cas, road AS node, 0 AS hops FROM own UNION SELECT h.cas, a.dst, h.hops + 1 FROM h JOIN arcs a ON a.src = h.node WHERE h.hops < 2) SELECT cas, node AS road, min(hops) AS hops FROM h GROUP BY 1, 2),
    up AS (WITH RECURSIVE h AS (SELECT cas, road AS node, 0 AS hops FROM own UNION SELECT h.cas, a.src, h.hops + 1 FROM h JOIN arcs a ON a.dst = h.node WHERE h.hops < 2) SELECT cas, node AS road, min(hops) AS hops FROM h GROUP BY 1, 2)
    SELECT n.cas AS "case", n.road, begin_s IS NOT NULL AS inside, round(exp(-m / 500), 6) AS near_500, round(exp(-m / 2000), 6) AS near_2000, round(coalesce((3 - up.hops) / 3.0, 0), 6) AS up, round(coalesce((3 - down.hops) / 3.0, 0), 6) AS down, begin_s::DOUBLE AS begin_s, end_s::DOUBLE AS end_s
    FROM n LEFT JOIN own USING (cas, road) LEFT JOIN up USING (cas, road) LEFT JOIN down USING (cas, road)""".lstrip(),
    "places", "arcs",
)
def footprint_pairs(spark, d):
    """The suppliers of a nation as the footprint of a case."""
    k = F.col("s_suppkey")
    own = L.table(spark, d, "supplier").select(F.col("s_nationkey").alias("case"), k.alias("road"), (k * 100.0).alias("begin_s"), (k * 100.0 + 3600).alias("end_s"))
    roads = L.places(spark, d).select(F.col("place_id").alias("road"), F.col("plon").alias("lon"), F.col("plat").alias("lat"))
    return rounded(X.footprint_pairs(own, roads, L.arcs(spark, d), 3000.0, (500, 2000), 2), 6, "near_500", "near_2000", "up", "down")


@query(
    """, c AS (SELECT seg, t, speed, CASE WHEN (seg + (t // 3600)) % 5 < 4 THEN (seg + (t // 3600)) % 5 END AS cat, ((seg * 7 + (t // 3600)) % 11 = 0)::INT AS closed FROM spine),
    w AS (SELECT *, last_value(speed IGNORE NULLS) OVER s2 AS sp, (t - last_value(CASE WHEN speed IS NOT NULL THEN t END IGNORE NULLS) OVER s2) / 3600.0 AS sp_age, last_value(cat IGNORE NULLS) OVER s3 AS ct, (t - last_value(CASE WHEN cat IS NOT NULL THEN t END IGNORE NULLS) OVER s3) / 3600.0 AS ct_age,
        lag(speed, 1) OVER o AS l1, lag(speed, 2) OVER o AS l2, lag(speed, 3) OVER o AS l3, coalesce(lead(closed, 2) OVER o, last_value(closed) OVER (PARTITION BY seg ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS closed_then
        FROM c WINDOW o AS (PARTITION BY seg ORDER BY t), s2 AS (PARTITION BY seg ORDER BY t ROWS 2 PRECEDING), s3 AS (PARTITION BY seg ORDER BY t ROWS 3 PRECEDING)),
    x AS (SELECT *, lag(sp, 3) OVER (PARTITION BY seg ORDER BY t) AS sp3, 50.0 + seg % 40 * 10 AS len_, 8.0 + seg % 7 AS ff, CASE ct WHEN 0 THEN 0.1 WHEN 1 THEN 0.4 WHEN 2 THEN 0.65 WHEN 3 THEN 0.85 END AS ratio, CASE WHEN seg % 2 = 0 THEN t - t % 86400 + 36000 END AS es, CASE WHEN seg % 2 = 0 THEN t - t % 86400 + 46800 END AS ee FROM w),
    segs AS (SELECT DISTINCT seg FROM c), arc AS (SELECT seg AS src, (seg * 3 + 1) % 150 AS dst FROM segs UNION SELECT seg, (seg + 7) % 150 FROM segs), near AS (SELECT seg, (seg + k) % 150 AS other FROM segs, range(3) r(k)),
    up AS (SELECT a.dst AS seg, x.t, avg(sp / ff) AS sp, avg(ratio) AS cat FROM arc a JOIN x ON x.seg = a.src GROUP BY 1, 2), down AS (SELECT a.src AS seg, x.t, avg(sp / ff) AS sp, avg(ratio) AS cat FROM arc a JOIN x ON x.seg = a.dst GROUP BY 1, 2),
    cl AS (SELECT n.other AS seg, x.t, sum(closed_then) AS target, sum(closed) AS origin FROM near n JOIN x ON x.seg = n.seg GROUP BY 1, 2),
    ar AS (SELECT t, avg(CASE WHEN seg <= 30 THEN sp / ff END) AS sp, avg(CASE WHEN seg <= 30 THEN sp3 / ff END) AS sp3, avg(CASE WHEN seg <= 30 THEN ratio END) AS cat, sum(closed_then) AS closed FROM x GROUP BY t),
    p AS (SELECT x.*, t + 3600 AS origin_s, t + 2 * 3600 + 1800 AS target_s, least(CASE WHEN sp IS NOT NULL THEN len_ / greatest(sp, 0.5) WHEN ct IS NOT NULL THEN len_ / greatest(ff * (1 - ratio), 0.5) ELSE len_ / ff END, 1800) AS base FROM x)
    SELECT seg, p.t, 120.0 AS horizon_min, (origin_s % 86400) / 60.0 AS tod_origin_min, (target_s % 86400) / 60.0 AS tod_target_min, len_ AS length_m, 1.0 + seg % 3 AS lanes, ff AS free_flow_mps, (seg % 6)::DOUBLE AS road_rank, (seg % 2)::DOUBLE AS oneway, (seg % 3 = 0)::INT::DOUBLE AS signal_at_end, (seg % 4 > 0)::INT::DOUBLE AS tomtom_covered, seg * 10.0 AS dist_to_footprint_m, round((seg % 21 - 10) / 10.0 + 1e-9, 5) AS heading_to_event_cos,
        (SELECT count(*) FROM arc WHERE dst = seg)::DOUBLE AS degree_in, (SELECT count(*) FROM arc WHERE src = seg)::DOUBLE AS degree_out, round(base / (len_ / ff) + 1e-9, 5) AS base_tt_ratio, CASE WHEN p.sp IS NOT NULL THEN 0.0 WHEN ct IS NOT NULL THEN 1.0 ELSE 2.0 END AS base_source, sp_age AS tt_obs_age, round(speed / ff + 1e-9, 5) AS speed_ratio_l0, round(l1 / ff + 1e-9, 5) AS speed_ratio_l1, round(l2 / ff + 1e-9, 5) AS speed_ratio_l2, round(l3 / ff + 1e-9, 5) AS speed_ratio_l3, round((p.sp - p.sp3) / ff + 1e-9, 5) AS speed_trend, ratio AS cat_ratio_l0, ct_age AS cat_age,
        round(up.sp + 1e-9, 5) AS up_speed_ratio, round(down.sp + 1e-9, 5) AS down_speed_ratio, round(up.cat + 1e-9, 5) AS up_cat_ratio, round(down.cat + 1e-9, 5) AS down_cat_ratio, round(ar.sp + 1e-9, 5) AS area_speed_ratio, round(ar.sp3 + 1e-9, 5) AS area_speed_ratio_l3, round(ar.cat + 1e-9, 5) AS area_cat_ratio, (es IS NOT NULL)::INT::DOUBLE AS event_declared, (target_s - es) / 60.0 AS min_from_declared_start, (ee - target_s) / 60.0 AS min_to_declared_end,
        coalesce((target_s - es) / 60.0 BETWEEN -60 AND 120, FALSE)::INT::DOUBLE AS in_arrival_window, coalesce((target_s - ee) / 60.0 BETWEEN -30 AND 90, FALSE)::INT::DOUBLE AS in_departure_window, CASE WHEN seg % 3 > 0 THEN seg * 5.0 END AS event_vehicle_estimate, coalesce(cl.target, 0)::DOUBLE AS closed_within_300m_target, coalesce(cl.origin, 0)::DOUBLE AS closed_within_300m_origin, ar.closed::DOUBLE AS closures_active_target
    FROM p LEFT JOIN up USING (seg, t) LEFT JOIN down USING (seg, t) LEFT JOIN cl USING (seg, t) JOIN ar USING (t)""".lstrip(),
    "readings", "buckets", "spine",
)
def feature_table(spark, d):
    """Hourly cells of the readings, with roads and arcs made of their numbers."""
    s, hour = F.col("seg"), F.floor(F.col("t") / 3600)
    cells = W.hour_spine(buckets(spark, d), "speed").select("seg", "t", "speed", F.when((s + hour) % 5 < 4, (s + hour) % 5).alias("category"), ((s * 7 + hour) % 11 == 0).alias("closed"))
    segs = cells.select("seg").distinct()
    roads = segs.select("seg", (50.0 + s % 40 * 10).alias("length_m"), (1 + s % 3).alias("lanes"), (8.0 + s % 7).alias("free_flow_mps"), (s % 6).alias("road_rank"), (s % 2).alias("oneway"), (s % 3 == 0).alias("signal_at_end"), (s % 4 > 0).alias("tomtom_covered"), (s * 10.0).alias("dist_to_footprint_m"), ((s % 21 - 10) / 10.0).alias("heading_to_event_cos"), (s <= 30).alias("in_area"))
    arcs = segs.select(s.alias("src"), F.explode(F.array((s * 3 + 1) % 150, (s + 7) % 150)).alias("dst"))
    near = segs.select("seg", F.explode(F.array(*((s + k) % 150 for k in range(3)))).alias("other"))
    day = F.col("t") - F.col("t") % 86_400
    declared = lambda at: F.when(s % 2 == 0, day + at)
    out = FT.feature_table(cells, roads, arcs, near, 2, 3600, declared(36_000), declared(46_800), F.when(s % 3 > 0, s * 5.0))
    return nudged(out, "heading_to_event_cos", "base_tt_ratio", *(c for c in FT.FEATURES if "ratio" in c and c != "cat_ratio_l0"), "speed_trend")


@query(
    """WITH n AS (SELECT p_partkey AS part, p_partkey % 40 AS k FROM part), x AS (SELECT part, CASE part % 5 WHEN 0 THEN k || 'th Street' WHEN 1 THEN 'O''Farrell Street' WHEN 2 THEN 'Sea Cliff Ave.' WHEN 3 THEN 'Third St' ELSE 'Avenue ' || k END AS a, CASE part % 7 WHEN 0 THEN k || 'TH ST' WHEN 1 THEN 'OFARRELL ST' WHEN 2 THEN 'SEACLIFF AVE' WHEN 3 THEN '03RD ST' WHEN 4 THEN 'AVENUE ' || k WHEN 5 THEN NULL ELSE 'Third Street' END AS b FROM n),
    y AS (SELECT part, b, list_filter(string_split(regexp_replace(upper(a), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '') AS a, list_filter(string_split(regexp_replace(upper(coalesce(b, '')), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda w: w <> '') AS c FROM x),
    z AS (SELECT part, b, CASE WHEN list_contains(['STREET', 'ST', 'AVENUE', 'AVE'], a[-1]) THEN a[:-2] ELSE a END AS a, CASE WHEN list_contains(['STREET', 'ST', 'AVENUE', 'AVE'], c[-1]) THEN c[:-2] ELSE c END AS c FROM y),
    t AS (SELECT part, array_to_string(list_transform(a, lambda w: CASE WHEN w = 'THIRD' THEN '03RD' WHEN regexp_full_match(w, '[0-9]TH') THEN '0' || w ELSE w END), ' ') AS a, array_to_string(list_transform(c, lambda w: CASE WHEN w = 'THIRD' THEN '03RD' WHEN regexp_full_match(w, '[0-9]TH') THEN '0' || w ELSE w END), ' ') AS c FROM z)
    SELECT part, a AS name, c AS other, a = c AS same, replace(a, ' ', '') = replace(c, ' ', '') AS same_compact FROM t"""
)
def same_streets(spark, d):
    """Names as maps and as permits write them."""
    p = L.table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 40).cast("string").alias("k"))
    m, n = F.col("part") % 5, F.col("part") % 7
    a = F.when(m == 0, F.concat("k", F.lit("th Street"))).when(m == 1, "O'Farrell Street").when(m == 2, "Sea Cliff Ave.").when(m == 3, "Third St").otherwise(F.concat(F.lit("Avenue "), "k"))
    b = F.when(n == 0, F.concat("k", F.lit("TH ST"))).when(n == 1, "OFARRELL ST").when(n == 2, "SEACLIFF AVE").when(n == 3, "03RD ST").when(n == 4, F.concat(F.lit("AVENUE "), "k")).when(n == 6, "Third Street")
    return p.select("part", S.norm_street(a).alias("name"), S.norm_street(b).alias("other"), S.same_street(a, b, False).alias("same"), S.same_street(a, b).alias("same_compact"))


IMPACT = """x AS (SELECT seg % 5 AS pair, t - t % 86400 AS bucket, seg, round(avg(CASE WHEN source = 'click' THEN speed END), 6) AS event, round(avg(CASE WHEN source = 'view' THEN speed END), 6) AS control FROM readings GROUP BY 1, 2, 3)"""


def run_cells(spark, d):
    side = lambda s: F.round(F.avg(F.when(F.col("source") == s, F.col("speed"))), 6)
    return L.readings(spark, d).groupBy((F.col("seg") % 5).alias("pair"), (F.col("t") - F.col("t") % 86_400).alias("bucket"), "seg").agg(side("click").alias("event"), side("view").alias("control"))


@query(
    f""", {IMPACT}, s AS (SELECT pair, bucket, sum(coalesce(event, 0) - coalesce(control, 0)) AS diff FROM x GROUP BY 1, 2), p AS (SELECT pair, bucket AS peak_bucket, diff AS peak FROM s QUALIFY row_number() OVER (PARTITION BY pair ORDER BY diff DESC, bucket) = 1)
    SELECT p.pair, peak_bucket, round(peak, 3) AS peak, (min(bucket) FILTER (WHERE bucket >= greatest(peak_bucket, 1704844800 + p.pair * 86400) AND diff < 0.1 * greatest(peak, 1)))::DOUBLE AS recovered FROM p JOIN s USING (pair) GROUP BY 1, 2, 3""".lstrip(),
    "readings",
)
def run_impact(spark, d):
    cells = run_cells(spark, d)
    ends = cells.select("pair", (F.lit(1_704_844_800) + F.col("pair") * 86_400).alias("end_bucket")).distinct()
    return P.run_impact(cells, ends).withColumns({"peak": F.round("peak", 3), "recovered": F.col("recovered").cast("double")})


@query(
    """, v AS (SELECT seg % 5 AS pair, seg, count_if(source = 'click') AS event, count_if(source = 'view') AS control, bool_or(event_id % 97 = 0) AS shut FROM readings GROUP BY 1, 2) SELECT pair, seg, event::BIGINT AS event, control::BIGINT AS control FROM v WHERE NOT shut AND event - control >= 1 AND event >= 1.5 * greatest(control, 1)""".lstrip(),
    "readings",
)
def detour_roads(spark, d):
    r = L.readings(spark, d)
    v = r.groupBy((F.col("seg") % 5).alias("pair"), "seg", (F.col("t") - F.col("t") % 86_400).alias("bucket")).agg(F.count_if(F.col("source") == "click").alias("event"), F.count_if(F.col("source") == "view").alias("control"), F.bool_or(F.col("event_id") % 97 == 0).alias("closed"))
    return P.detour_roads(v, hours=0.5, more=2.0)


@query(
    """, c AS (SELECT route // 8 AS request, route AS candidate, seg % 7 AS seg, sum(cost) AS eta FROM trips GROUP BY 1, 2, 3), t AS (SELECT request, candidate, sum(eta) AS total, min(candidate) OVER (PARTITION BY request) AS first FROM c GROUP BY 1, 2),
    s AS (SELECT a.request, a.candidate, b.candidate AS other, sum(a.eta) AS shared FROM c a JOIN c b ON a.request = b.request AND a.seg = b.seg GROUP BY 1, 2, 3)
    SELECT t.request, t.candidate, round(coalesce(max(shared / total) FILTER (WHERE other <> t.candidate), 0), 6) AS most, round(coalesce(max(shared / total) FILTER (WHERE other = first), 0), 6) AS with_first FROM t LEFT JOIN s ON s.request = t.request AND s.candidate = t.candidate GROUP BY 1, 2""".lstrip(),
    "trips",
)
def candidate_overlaps(spark, d):
    return rounded(R.candidate_overlaps(candidates(spark, d)), 6, "most", "with_first")


@query("SELECT floor(epoch(o_orderdate))::BIGINT AS start_s, floor(epoch(o_orderdate))::BIGINT + (o_orderkey % 5) * 86400 AS end_s, count(*) AS rows, array_to_string(list_sort(list(DISTINCT o_custkey % 150)), ',') AS cnns FROM orders GROUP BY 1, 2")
def closure_occurrences(spark, d):
    k = F.col("o_orderkey")
    rows = L.table(spark, d, "orders").select(L.seconds("o_orderdate").alias("start_s"), (L.seconds("o_orderdate") + (k % 5) * 86_400).alias("end_s"), (F.col("o_custkey") % 150).alias("cnn"))
    return N.closure_occurrences(rows).withColumn("cnns", F.array_join(F.col("cnns").cast("array<string>"), ","))


CHECKED = """WITH RECURSIVE v AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS j, count(*) OVER (PARTITION BY l_orderkey) AS n, l_suppkey AS seg, l_partkey % 3 AS class, l_quantity * 10 AS metres FROM lineitem),
    u AS (SELECT *, lag(seg) OVER (PARTITION BY route ORDER BY j) AS src FROM v),
    w AS (SELECT route, 0::BIGINT AS j, ((route % 40) * 60.0 - 120)::DOUBLE AS clk, 0.0::DOUBLE AS metres, NULL::VARCHAR AS reason, NULL::BIGINT AS seg, FALSE AS free, FALSE AS part FROM v WHERE v.j = 1
        UNION ALL SELECT route, j, CASE WHEN why IS NULL THEN done ELSE clk END, CASE WHEN why IS NULL THEN so_far + own * share ELSE so_far END, why, seg, free OR (why IS NULL AND j = 1 AND known IS NULL), part OR (why IS NULL AND j > 1 AND seg % 10 = 1 AND clk < 1200 AND done > 600) FROM (
            SELECT *, CASE WHEN NOT legal THEN 'illegal_connection' WHEN slot < 0 THEN 'before_issue_time' WHEN slot >= 6 THEN 'beyond_horizon' WHEN done IS NULL THEN 'not_enterable' WHEN j > 1 AND seg % 10 = 0 AND clk < 1200 AND done > 600 THEN 'closure' END AS why FROM (
                SELECT *, clk + coalesce(known, CASE WHEN j = 1 THEN 45.0 END) * share AS done FROM (
                    SELECT u.route, u.j, w.clk, w.metres AS so_far, u.metres AS own, u.seg, w.free, w.part, floor(w.clk / 300) AS slot, coalesce((u.src * 31 + u.seg) % 29 <> 0, TRUE) AS legal, CASE WHEN (u.seg + floor(w.clk / 300)) % 17 <> 0 AND floor(w.clk / 300) BETWEEN 0 AND 5 THEN 60.0 + (u.seg * 7 + floor(w.clk / 300) * 13) % 50 END AS known,
                    greatest(CASE WHEN u.j = u.n THEN 0.75 ELSE 1.0 END - CASE WHEN u.j = 1 THEN 0.25 ELSE 0.0 END, 0.0) AS share FROM w JOIN u ON u.route = w.route AND u.j = w.j + 1 WHERE w.reason IS NULL)))),
    z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY route ORDER BY j DESC) = 1), y AS (SELECT *, CASE WHEN reason IS NULL AND clk > 1800 THEN 'beyond_horizon' ELSE reason END AS why FROM z)"""


def checked(spark, d):
    seg = F.col("seg")
    lines = L.table(spark, d, "lineitem")
    lines = in_parts(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), lines.count(), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cells = lines.select(F.col("l_orderkey").alias("route"), F.row_number().over(order).alias("pos"), F.col("l_suppkey").alias("seg"), (F.col("l_partkey") % 3).alias("class"), (F.col("l_quantity") * 10).alias("metres"), F.lit(45.0).alias("free_s"))
    routes = cells.select("route").distinct().select("route", ((F.col("route") % 40) * 60.0 - 120).alias("depart_s"), F.lit(0.25).alias("first_share"), F.lit(0.75).alias("last_share"))
    segs = L.places(spark, d).select(F.col("place_id").alias("seg"))
    forecast = segs.select("seg", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bucket")).withColumn("seconds", F.when((seg + F.col("bucket")) % 17 != 0, 60.0 + (seg * 7 + F.col("bucket") * 13) % 50))
    closures = segs.filter("seg % 10 < 2").select("seg", F.lit(600).alias("begin_s"), F.lit(1200).alias("end_s"), F.when(seg % 10 == 0, "full").otherwise("lane").alias("kind"))
    w = Window.partitionBy("route").orderBy("pos")
    arcs = cells.select(F.lag("seg").over(w).alias("src"), F.col("seg").alias("dst")).filter((F.col("src") * 31 + F.col("dst")) % 29 != 0).distinct()
    return R.time_checked(routes, cells, forecast, closures, arcs, 0, 300, 6)


@query(f"{CHECKED} SELECT route, CASE WHEN why IS NULL THEN round(clk, 4) END AS arrive_s, why AS reason, (CASE WHEN why IS NOT NULL THEN seg END)::DOUBLE AS seg, CASE WHEN why IS NOT NULL THEN round(clk, 4) END AS at_s, CASE WHEN why IS NULL THEN round(metres, 4) END AS metres, array_to_string(list_filter([CASE WHEN free THEN 'origin_cost_free_flow' END, CASE WHEN part THEN 'partial_restriction_on_route' END], lambda f: f IS NOT NULL), ',') AS flags FROM y")
def time_checked(spark, d):
    """Routes that are refused at illegal turns, closures, roads without a forecast, and outside its horizon."""
    return rounded(checked(spark, d)[0].withColumn("seg", F.col("seg").cast("double")), 4, "arrive_s", "at_s", "metres")
