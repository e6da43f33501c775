"""Raw rows of six road feeds and of an event feed to common records; shapes to plain coordinates; the registry that unites the feeds.

A record: source, source_id, kind (closure, incident), lon, lat and coords (null: no shape), valid_from, valid_to, observed_at, is_closure,
category, cnn, location_status, text fields in attributes, and errors. Rows that a feed's rule leaves out are gone; rows that break it stay,
with errors, for quarantine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.events import event_kind, map_category, map_status
from roadweave.functions.scalars import LOCAL_ZONE, dispatch_time, epoch_any, errors_of, id_key, incident_category, local_or_utc, street_title, truthy

#: Boxes of the bay and of the city (least and greatest longitude and latitude), the dispatch center of the bay, and the
#: categories of calls that are about traffic.
BAY_BOX, CITY_BOX = (-123.7, 36.8, -121.2, 38.9), (-122.53, 37.69, -122.35, 37.84)
BAY_CENTER, TRAFFIC_CALLS = "GGCC", ("collision", "hazard", "closure")

POSITIONS = "array<array<double>>"


def valid_position(lon: Column, lat: Column) -> Column:
    """A place on earth that is not the placeholder 0, 0."""
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0)), F.lit(False))


def positions_of(geojson: Column) -> Column:
    """Positions of a GeoJSON shape of any depth, in order, to 7 decimals and without heights; null for no shape. {latitude, longitude} is a point."""
    inside = F.regexp_extract(geojson, '"coordinates"\\s*:\\s*(\\[.*\\])', 1)
    found = F.regexp_extract_all(inside, F.lit("\\[\\s*(-?[0-9.eE+-]+)\\s*,\\s*(-?[0-9.eE+-]+)[^\\[\\]]*\\]"), 0)
    pair = lambda x, k: F.round(F.get(F.split(F.regexp_replace(x, "[\\[\\]\\s]", ""), ","), k).try_cast("double"), 7)
    shape = F.transform(found, lambda x: F.array(pair(x, 0), pair(x, 1)))
    lon, lat = (F.get_json_object(geojson, f"$.{k}").try_cast("double") for k in ("longitude", "latitude"))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array(F.array(F.round(lon, 7), F.round(lat, 7)))).when(F.size(shape) > 0, shape)


def geometry_errors(geojson: Column) -> Column:
    """What is wrong with a shape; empty for none and for a sound one."""
    kind, shape = F.get_json_object(geojson, "$.type"), positions_of(geojson)
    has = geojson.isNotNull() & (geojson != "")
    coordinates = F.get_json_object(geojson, "$.coordinates")
    some = has & F.coalesce(~coordinates.isin("[]", "null"), F.lit(False))
    rings = F.regexp_extract_all(F.regexp_replace(coordinates, "\\s", ""), F.lit("\\[(\\[-?[0-9.eE+,-]+\\](?:,\\[-?[0-9.eE+,-]+\\])*)\\]"), 1)
    open_ring = F.exists(rings, lambda r: (F.size(F.split(r, "\\],\\[")) < 4) | (F.regexp_extract(r, "^\\[([^\\]]*)\\]", 1) != F.regexp_extract(r, "\\[([^\\[]*)\\]$", 1)))
    short_line = F.exists(rings, lambda r: F.size(F.split(r, "\\],\\[")) < 2)
    known = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    return errors_of(
        ("unsupported type", has & kind.isNotNull() & ~kind.isin(*known)),
        ("no coordinates", has & coordinates.isNull() & F.get_json_object(geojson, "$.latitude").isNull()),
        ("invalid coordinate", has & F.exists(F.coalesce(shape, F.array().cast(POSITIONS)), lambda p: ~valid_position(F.get(p, 0), F.get(p, 1)))),
        ("malformed coordinates", some & shape.isNull()),
        ("line of one position", some & kind.isin("LineString", "MultiLineString") & short_line),
        ("open ring", some & kind.isin("Polygon", "MultiPolygon") & open_ring),
    )


def centroid(shape: Column) -> tuple[Column, Column]:
    """Mean of a shape's positions."""
    mean = lambda k: F.aggregate(shape, F.lit(0.0), lambda a, p: a + F.get(p, k)) / F.size(shape)
    return F.when(F.size(shape) > 0, mean(0)), F.when(F.size(shape) > 0, mean(1))


def middle_vertex(shape: Column) -> tuple[Column, Column]:
    """The vertex in the middle of a line, the point itself; null where it is no place on earth."""
    at = F.get(shape, F.floor(F.size(shape) / 2).cast("int"))
    lon, lat = F.get(at, 0), F.get(at, 1)
    fine = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(fine, lon), F.when(fine, lat)


def inside_box(shape: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether every position lies in the box; false without one."""
    return F.coalesce((F.size(shape) > 0) & F.forall(shape, lambda p: F.get(p, 0).between(box[0], box[2]) & F.get(p, 1).between(box[1], box[3])), F.lit(False))


def local_time(name: str) -> Column:
    """The column as UTC: floating local time, unless its name ends in _utc."""
    return local_or_utc(F.try_to_timestamp(F.regexp_replace(F.col(name), "Z$", "")), name.endswith("_utc"))


def record(df: DataFrame, source: str, kind: str, source_id: Column, **given: Column) -> DataFrame:
    """A record of each row, from the columns given and nulls."""
    none = lambda t: F.lit(None).cast(t)
    shape = given.get("coords", none(POSITIONS))
    lon, lat = centroid(shape)
    attributes = given.get("attributes", none("map<string,string>"))
    out = df.select(
        F.lit(source).alias("source"), source_id.cast("string").alias("source_id"), F.lit(kind).alias("kind"), lon.alias("lon"), lat.alias("lat"), shape.alias("coords"),
        *(given.get(c, none("timestamp")).alias(c) for c in ("valid_from", "valid_to", "observed_at")), given.get("is_closure", F.lit(False)).alias("is_closure"),
        given.get("category", none("string")).cast("string").alias("category"), given.get("cnn", none("string")).alias("cnn"), given.get("location_status", F.lit("exact")).alias("location_status"), attributes.alias("attributes"), given.get("broken", F.array().cast("array<string>")).alias("broken"),
    )
    return out.withColumn("errors", F.concat("broken", record_errors())).drop("broken")


def record_errors() -> Column:
    """What a record lacks, by its kind."""
    placed = F.col("coords").isNotNull() | F.col("cnn").isNotNull()
    closure, incident = F.col("kind") == "closure", F.col("kind") == "incident"
    return errors_of(
        ("unknown kind", ~closure & ~incident), ("missing source id", F.coalesce(F.col("source_id") == "", F.lit(True))),
        ("ends before it starts", F.col("valid_to") < F.col("valid_from")), ("closure without a time", closure & F.col("valid_from").isNull() & F.col("valid_to").isNull()),
        ("closure without a place", closure & ~placed), ("incident without a time", incident & F.col("observed_at").isNull()),
        ("incident without a place", incident & ~placed & ~F.col("location_status").isin("withheld", "unlocated")),
    )


def texts(**columns: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, c in columns.items() for x in (F.lit(k), c.cast("string")))), lambda _, v: v.isNotNull())


def street_closures(df: DataFrame) -> DataFrame:
    """object_id, type, case_name, street, from_st, to_st, status, cnn, start_utc, end_utc, shape (GeoJSON)."""
    return record(
        df, "street_closures", "closure", F.col("object_id"), coords=positions_of(F.col("shape")), cnn=id_key(F.col("cnn")), valid_from=local_time("start_utc"), valid_to=local_time("end_utc"), is_closure=F.lit(True), category=F.col("type"),
        attributes=texts(name=F.col("case_name"), street=F.col("street"), from_street=F.col("from_st"), to_street=F.col("to_st"), status=F.col("status"), is_special_event=F.col("type") == "Special Event"),
    )


def street_use_permits(df: DataFrame) -> DataFrame:
    """permit_number, permit_type, status, streetname, cnn, permit_start_date, permit_end_date, shape. The road stays open."""
    return record(
        df, "street_use_permits", "closure", F.col("permit_number"), coords=positions_of(F.col("shape")), cnn=id_key(F.col("cnn")), valid_from=local_time("permit_start_date"), valid_to=local_time("permit_end_date"), category=F.lit("street_use_permit"),
        attributes=texts(permit_type=F.col("permit_type"), status=F.col("status"), street=F.col("streetname")),
    )


def excavation_permits(df: DataFrame) -> DataFrame:
    """permit_number, status, cnn, effective_date, expiration_date. No shape: it comes from the street of the number."""
    return record(df, "excavation_permits", "closure", F.col("permit_number"), cnn=id_key(F.col("cnn")), valid_from=local_time("effective_date"), valid_to=local_time("expiration_date"), category=F.lit("excavation"), attributes=texts(status=F.col("status")))


def police_dispatch(df: DataFrame) -> DataFrame:
    """id, call_type_final_desc, call_type_original_desc, received_datetime, close_datetime, intersection_name, intersection_point (GeoJSON),
    sensitive_call. Only traffic calls; a sensitive call's place is withheld."""
    call = F.coalesce(F.when(F.col("call_type_final_desc") != "", F.col("call_type_final_desc")), F.col("call_type_original_desc"))
    shape, category = positions_of(F.col("intersection_point")), incident_category(call)
    status = F.when(shape.isNotNull(), "exact").when(truthy(F.col("sensitive_call")), "withheld").otherwise("unlocated")
    got = local_time("received_datetime")
    return record(
        df.filter(category.isin(*TRAFFIC_CALLS)), "police_dispatch", "incident", F.col("id"), coords=shape, observed_at=got, valid_from=got, valid_to=local_time("close_datetime"), is_closure=category == "closure", category=category, location_status=status,
        attributes=texts(call_type=call, location_text=F.col("intersection_name")),
    )


def lane_closures(df: DataFrame) -> DataFrame:
    """index, closure_id, begin_lon, begin_lat, end_lon, end_lat, route, start_epoch, end_epoch, end_indefinite, lanes_closed, type_of_closure. Only of
    the bay. One index is one window of a closure; an indefinite end is none."""
    number = lambda c: F.col(c).try_cast("double")
    begin, end = (F.array(F.round(number(f"{p}_lon"), 7), F.round(number(f"{p}_lat"), 7)) for p in ("begin", "end"))
    has = lambda p: valid_position(number(f"{p}_lon"), number(f"{p}_lat"))
    shape = F.when(has("begin") & has("end") & (begin != end), F.array(begin, end)).when(has("begin"), F.array(begin))
    full = (F.col("type_of_closure") == "Full") | (F.trim(F.get(F.split("lanes_closed", ","), 0)) == "All")
    key = F.coalesce(F.when(F.col("index") != "", F.col("index")), F.col("closure_id"))
    return record(
        df.filter(shape.isNull() | inside_box(shape, BAY_BOX)), "lane_closures", "closure", key, coords=shape, valid_from=epoch_any(F.col("start_epoch")), valid_to=F.when(~truthy(F.col("end_indefinite")), epoch_any(F.col("end_epoch"))),
        is_closure=F.coalesce(full, F.lit(False)), category=F.lit("lane_closure"), broken=errors_of(("no begin coordinates", shape.isNull())), attributes=texts(route=F.col("route"), lanes_closed=F.col("lanes_closed"), type_of_closure=F.col("type_of_closure")),
    )


def highway_incidents(df: DataFrame) -> DataFrame:
    """log_id, log_time, log_type, location, area, center, dispatch, latlon (millionths, west positive). Only of the bay; one without a place stays
    where the bay's center has it."""
    found = F.col("latlon").rlike("^[1-9][0-9]*:[0-9]+$")
    part = lambda k: F.get(F.split("latlon", ":"), k).try_cast("double") / 1e6
    shape = F.when(found, F.array(F.array(F.round(-part(1), 7), F.round(part(0), 7))))
    ours = F.coalesce((F.col("center") == BAY_CENTER) | (F.col("dispatch") == BAY_CENTER), F.lit(False))
    seen, category = dispatch_time(F.col("log_time")), incident_category(F.col("log_type"))
    keep = F.when(shape.isNotNull(), inside_box(shape, BAY_BOX)).otherwise(ours)
    return record(
        df.filter(keep), "highway_incidents", "incident", F.col("log_id"), coords=shape, observed_at=seen, valid_from=seen, is_closure=category == "closure", category=category, location_status=F.when(shape.isNotNull(), "exact").otherwise("unlocated"),
        attributes=texts(call_type=F.col("log_type"), location_text=F.col("location"), area=F.col("area")),
    )


#: A feed's name and its normalizer; add to it to add a feed.
NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (street_closures, street_use_permits, excavation_permits, police_dispatch, lane_closures, highway_incidents)}


def all_records(feeds: dict[str, DataFrame]) -> DataFrame:
    """The records of all feeds; of repeats of a source and id the one with the earliest start, then the least text."""
    rows = reduce(DataFrame.unionByName, [NORMALIZERS[name](df) for name, df in feeds.items()])
    w = Window.partitionBy("source", "source_id").orderBy(F.col("valid_from").asc_nulls_last(), F.xxhash64(*(F.col(c) for c in ("kind", "lon", "lat", "valid_to", "category"))))
    return rows.withColumn("__n", F.when(F.col("source_id").isNull(), 1).otherwise(F.row_number().over(w))).filter("__n = 1").drop("__n")


def run_report(raw: DataFrame, records: DataFrame) -> DataFrame:
    """source, raw, kept, rejected, located, withheld: one row a source. raw: source."""
    counts = records.groupBy("source").agg(F.count("*").alias("kept"), F.count_if(F.size("errors") > 0).alias("rejected"), F.count_if(F.col("lon").isNotNull()).alias("located"), F.count_if(F.col("location_status") == "withheld").alias("withheld"))
    return raw.groupBy("source").agg(F.count("*").alias("raw")).join(counts, "source", "left").na.fill(0)


def restriction_of(source: Column, lanes: Column, kind: Column) -> Column:
    """full, or lane for a lane closure that leaves some open."""
    all_lanes = (F.lower(F.coalesce(lanes, F.lit(""))) == "all") | (F.lower(F.coalesce(kind, F.lit(""))) == "full")
    return F.when((source == "lane_closures") & ~all_lanes, "lane").otherwise("full")


def normalize_events(df: DataFrame) -> DataFrame:
    """Event rows with a reason where they are skipped (no_location, outside, no_start; null: an event): event, title, category, status, start, end,
    end_is_predicted, all_day, reason. df: id, title, lon, lat, zone, start, end, predicted_end, category, labels, state, deleted_reason.
    Times are UTC where the row has a zone, else local."""
    local = F.coalesce(F.col("zone") == "", F.lit(True))
    at = lambda c: F.when(local, F.to_utc_timestamp(F.try_to_timestamp(F.col(c)), LOCAL_ZONE)).otherwise(F.try_to_timestamp(F.col(c)))
    t = df.withColumn("s", at("start")).withColumn("e", at("end")).withColumn("p", at("predicted_end"))
    guessed = (F.col("e").isNull() | (F.col("e") <= F.col("s"))) & (F.col("p") > F.col("s"))
    end = F.when(guessed, F.col("p")).when(F.col("e") > F.col("s"), F.col("e"))
    lon, lat = F.col("lon"), F.col("lat")
    box = lon.between(CITY_BOX[0], CITY_BOX[2]) & lat.between(CITY_BOX[1], CITY_BOX[3])
    reason = F.when(lon.isNull() | lat.isNull(), "no_location").when(~box, "outside").when(F.col("s").isNull(), "no_start")
    long = F.coalesce(F.unix_timestamp(end) - F.unix_timestamp("s") >= 23 * 3600, F.lit(False))
    key = F.concat(F.lit("evt_"), F.substring(F.sha1(F.concat(F.lit("provider:"), F.col("id").cast("string"))), 1, 16))
    return t.select(
        key.alias("event"), "title", map_category(F.col("category"), F.col("labels")).alias("category"), map_status(F.col("state"), F.col("deleted_reason")).alias("status"), F.col("s").alias("start"), end.alias("end"),
        F.coalesce(guessed, F.lit(False)).alias("end_is_predicted"), (local | long).alias("all_day"), reason.alias("reason"),
    )


def event_view(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Public fields of listed events: event, name, kind, venue, start, end, closures. events: event, title, category, venue_id, venue_name, start,
    end, status, closure_ids; venues: venue_id, name. Events without a title or a start aren't listed."""
    listed = events.filter("title is not null and title <> '' and start is not null and coalesce(status, 'active') not in ('cancelled', 'postponed', 'archived', 'deleted')")
    v = venues.select("venue_id", F.col("name").alias("__venue"))
    out = listed.join(v, "venue_id", "left")
    return out.select("event", F.col("title").alias("name"), event_kind(F.col("category"), F.col("title")).alias("kind"), F.coalesce("venue_name", "__venue").alias("venue"), "start", "end", F.coalesce("closure_ids", F.array().cast("array<string>")).alias("closures"))


def lookup_events(events: DataFrame, ids: DataFrame, venues: DataFrame) -> DataFrame:
    """The public fields of listed events with the ids asked for; ids of no listed event give none. ids: event."""
    return event_view(events.join(ids.select("event").distinct(), "event", "left_semi"), venues)


def condition_view(records: DataFrame) -> DataFrame:
    """Public fields of placed records: id, kind, is_closure, description, street, lon, lat, start, end. Withheld and unlocated ones aren't shown."""
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    shown = records.filter("lon is not null and location_status not in ('withheld', 'unlocated')")
    return shown.select(
        F.concat_ws(":", "source", "source_id").alias("id"), "kind", "is_closure", F.coalesce(a("name"), a("type_of_work"), a("permit_type"), a("call_type"), F.col("category")).alias("description"),
        street_title(F.coalesce(a("street"), a("location_text"), a("route"))).alias("street"), "lon", "lat", F.col("valid_from").alias("start"), F.col("valid_to").alias("end"),
    )


def closure_events(closures: DataFrame) -> DataFrame:
    """event, name, venue, lon, lat, start, end, blocks, closures: special-event closures of one case and start as one event. closures: source,
    source_id, case_id, name, street, from_street, to_street, lon, lat, start, end. Cases without a name or a place give none."""
    street = F.when(F.col("from_street").isNotNull(), F.concat(F.col("street"), F.lit(" between "), F.col("from_street"), F.lit(" and "), F.col("to_street"))).otherwise(F.col("street"))
    rows = closures.filter("case_id is not null and start is not null").withColumn("__where", street)
    key = F.concat_ws(":", "source", "source_id")
    g = rows.groupBy("source", "case_id", "start").agg(F.min_by("name", "source_id").alias("name"), F.min_by("__where", "source_id").alias("where"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.max("end").alias("end"), F.count("*").alias("blocks"), F.array_sort(F.collect_set(key)).alias("closures"))
    more = F.when(F.col("blocks") > 1, F.concat(F.lit(" (+"), (F.col("blocks") - 1).cast("string"), F.lit(" more blocks)"))).otherwise("")
    event = F.concat(F.col("source"), F.lit(":"), F.col("case_id").cast("string"), F.lit("@"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return g.filter("name is not null and lon is not null").select(event.alias("event"), "name", F.concat(street_title(F.col("where")), more).alias("venue"), "lon", "lat", "start", "end", "blocks", "closures")


def listed_events(*sources: DataFrame, box: tuple[float, float, float, float] = CITY_BOX, most: int = 2000) -> DataFrame:
    """Events of all sources inside the box, soonest first, `most` of them (the list's own length). Each: event, lon, lat, start, ..."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return rows.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).orderBy("start", "event").limit(most)


def closure_occurrences(rows: DataFrame) -> DataFrame:
    """start_s, end_s, rows, cnns: the rows of each exact span and their distinct streets, sorted. rows: start_s, end_s, cnn."""
    return rows.groupBy("start_s", "end_s").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("cnn")).alias("cnns"))


def local_time_issues(rows: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """id, side, utc, local_as_utc of starts and ends whose local time, by the rules of the zone, isn't the time given in UTC, which is the one that
    counts and is never rewritten. rows: id, start_utc, end_utc (timestamps), start_local, end_local (local texts without an offset). Sides that
    lack either are no issue; a local time that can't be read is one, with a null."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_utc").alias("utc"), F.to_utc_timestamp(F.try_to_timestamp(f"{s}_local"), zone).alias("local_as_utc"), F.col(f"{s}_local").alias("given"))
    both = rows.select("id", F.explode(F.array(side("start"), side("end"))).alias("x")).select("id", "x.*").filter("utc is not null and given is not null")
    return both.filter(~F.col("utc").eqNullSafe(F.col("local_as_utc"))).drop("given")
