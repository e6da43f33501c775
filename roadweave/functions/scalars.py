"""Column expressions: time buckets, geometry, names, categories, traffic arithmetic. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

EARTH_M = 6_371_008.8
LOCAL_ZONE = "America/Los_Angeles"


def bucket10(ts: Column, minutes: int = 10) -> Column:
    """Start of the UTC bucket that holds ts."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / step) * step)


def parse_zoned(text: Column) -> Column:
    """An ISO time with an offset; null where the offset is missing or the text isn't a time."""
    return F.when(text.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def local_or_utc(ts: Column, is_utc: bool) -> Column:
    return ts if is_utc else F.to_utc_timestamp(ts, LOCAL_ZONE)


def epoch_any(value: Column) -> Column:
    """Epoch seconds or milliseconds as text; blank and 0 are null."""
    n = value.try_cast("double")
    return F.when(n > 0, F.timestamp_millis(F.when(n > 1e11, n).otherwise(n * 1000).cast("long")))


def calendar_features(ts: Column, zone: str = LOCAL_ZONE) -> dict[str, Column]:
    """sin and cos of the local time of day and day of week (Monday first)."""
    t = F.from_utc_timestamp(ts, zone)
    day = (F.hour(t) * 60 + F.minute(t)) / F.lit(1440.0) * F.lit(6.283185307179586)
    week = F.weekday(t) / F.lit(7.0) * F.lit(6.283185307179586)
    return {"tod_sin": F.sin(day), "tod_cos": F.cos(day), "dow_sin": F.sin(week), "dow_cos": F.cos(week)}


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_diff(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def point_segment_m(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance in metres of a point from a straight piece, on a local plane."""
    k = F.lit(EARTH_M * 0.017453292519943295)
    c = F.cos(F.radians(y))
    px, py, qx, qy = (ax - x) * k * c, (ay - y) * k, (bx - x) * k * c, (by - y) * k
    dx, dy = qx - px, qy - py
    t = F.when(dx * dx + dy * dy > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(px * dx + py * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
    return F.hypot(px + t * dx, py + t * dy)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web-mercator tile."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.floor((lon + 180.0) / 360.0 * n), F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n)


#: Parts of a call's text by incident category; the first category that matches wins.
INCIDENT_RULES = (
    ("other", ("TRAFFIC STOP",)),
    ("collision", ("COLLISION", "COLLN", "ACCIDENT", "HIT AND RUN", "HIT & RUN", "HIT/RUN", "1179", "1180", "1181", "1182", "1183", "20001", "20002")),
    ("closure", ("ROAD CLOSURE", "SIGALERT", "SIG ALERT", "1184")),
    ("hazard", ("HAZARD", "DEBRIS", "OBSTRUCTION", "BLOCKED", "STALL", "DISABLED", "ANIMAL", "FLOOD", "SPILL", "1125", "1126")),
    ("fire", ("FIRE",)),
)


def first_match(rules: list[tuple[Column, str]], otherwise: Column | str) -> Column:
    """The value of the first condition that holds."""
    head, *rest = rules
    return reduce(lambda c, r: c.when(*r), rest, F.when(*head)).otherwise(otherwise)


def incident_category(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return first_match([(upper.rlike("|".join(parts)), name) for name, parts in INCIDENT_RULES], "other")


def norm_name(name: Column) -> Column:
    """Lower case without a leading "the" and white space behind it; only letters and digits between single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "^the\\s+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


#: Kinds of streets, as they end a name, and the first ordinals.
STREET_KINDS = {"STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "PLACE": "PL", "TERRACE": "TER", "COURT": "CT", "LANE": "LN", "WAY": "WAY", "ALLEY": "ALY", "HIGHWAY": "HWY"}
ORDINALS = {"FIRST": "01ST", "SECOND": "02ND", "THIRD": "03RD", "FOURTH": "04TH", "FIFTH": "05TH", "SIXTH": "06TH", "SEVENTH": "07TH", "EIGHTH": "08TH", "NINTH": "09TH"}


def norm_street(name: Column) -> Column:
    """A street's identity: upper case words of letters and digits without the kind at the end, ordinals with two digits; empty for null."""
    words = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9 ]", " "), " +"), lambda w: w != "")
    kinds = [*STREET_KINDS, *STREET_KINDS.values()]
    words = F.when(F.get(words, F.size(words) - 1).isin(*kinds), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    ordinal = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    two = lambda w: F.when(w.rlike("^[0-9]+(ST|ND|RD|TH)$"), F.concat(F.lpad(F.regexp_replace(F.regexp_extract(w, "^[0-9]+", 0), "^0+(?=[0-9])", ""), 2, "0"), F.substring(w, -2, 2))).otherwise(w)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(ordinal, w), two(w))), " ")


def same_street(a: Column, b: Column, compact: bool = True) -> Column:
    """Whether two names mean one street; compact leaves spaces out, which an apostrophe may stand for."""
    bare = lambda c: F.replace(norm_street(c), F.lit(" "), F.lit("")) if compact else norm_street(c)
    return bare(a) == bare(b)


def street_title(text: Column) -> Column:
    """Words capitalized but for between and and; null for an empty text."""
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    return F.when(text != "", F.array_join(F.transform(words, lambda w: F.when(w.isin("between", "and"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))), " "))


#: Shortened words of addresses, and words that name no street.
ADDRESS_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "HIGHWAY": "HWY", "FREEWAY": "FWY", "INTERSTATE": "I", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "OFFRAMP": "OFR", "ONRAMP": "ONR", "US101": "101", "I280": "280", "I80": "80", "SR1": "1",
}
STREET_STOP_WORDS = ("AT", "AND", "THE", "OF", "ON", "TO", "FROM", "NEAR", "BLOCK", "SAN", "FRANCISCO", "SF", "CA", "SB", "NB", "EB", "WB", "N", "S", "E", "W", "ST", "AVE", "BLVD", "DR", "RD")


def location_tokens(*texts: Column) -> Column:
    """Distinct sorted tokens of addresses, upper case and shortened: no stop words, no numbers of more than three digits."""
    words = F.regexp_extract_all(F.upper(F.concat_ws(" ", *texts)), F.lit("[A-Z0-9]+"), 0)
    short = F.create_map(*(F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair))
    words = F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STREET_STOP_WORDS) & ~w.rlike("^[0-9]{4,}$"))))


def id_key(value: Column) -> Column:
    """A whole number as text, whatever its decimals; null for what is no number."""
    return value.try_cast("double").cast("long").cast("string")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("true", "1", "y", "yes", "t")


def first_of_list(text: Column) -> Column:
    """The first entry of a list written as "['a', 'b']", without quotes; other texts as they are; null for an empty list."""
    inner = F.filter(F.transform(F.split(F.substring(text, 2, F.length(text) - 2), ","), F.trim), lambda x: x != "")
    return F.when(text.rlike("^\\[.*\\]$"), F.regexp_replace(F.get(inner, 0), "^['\"]+|['\"]+$", "")).otherwise(text)


def maxspeed_mph(text: Column) -> Column:
    """The lowest limit in a text; numbers without mph are kilometres an hour, to a tenth of a mile."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*(mph)?"), 1).alias("n"), F.regexp_extract_all(text, F.lit("([0-9]+(?:\\.[0-9]+)?)\\s*(mph)?"), 2).alias("u"))
    return F.array_min(F.transform(found, lambda x: F.when(x["u"] == "mph", x["n"].cast("double")).otherwise(F.round(x["n"].cast("double") / 1.609344, 1))))


#: Miles an hour on roads without a limit, by class, and on all others.
CLASS_MPH, UNPOSTED_MPH = {"motorway": 55.0, "motorway_link": 35.0, "trunk": 40.0, "trunk_link": 30.0}, 25.0


def free_flow_fallback(posted: Column, maxspeed: Column, road_class: Column) -> tuple[Column, Column]:
    """Free flow where none is measured, and where it comes from: posted, maxspeed, class or default. Zero counts as none."""
    by_class = first_match([(road_class == k, F.lit(v)) for k, v in CLASS_MPH.items()], F.lit(None).cast("double"))
    value = F.coalesce(F.when(posted > 0, posted.cast("double")), F.when(maxspeed > 0, maxspeed.cast("double")), by_class, F.lit(UNPOSTED_MPH))
    return value, first_match([(posted > 0, "posted"), (maxspeed > 0, "maxspeed"), (by_class.isNotNull(), "class")], "default")


def sum_once(c: Column | str) -> Column:
    """The sum of doubles, rounded once and so the same in any order: each is cut into a whole number of 2^-22 and a rest, which add up without
    rounding, as for a thousand values of 0.0001 or more and sums below 2^31. Beyond that an order may show in the last digit."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double") * 4_194_304.0
    whole = F.rint(x)
    return (F.sum(whole) + F.sum(F.nanvl(x - whole, F.lit(0.0)))) / 4_194_304.0


def measured_travel_time(speed: Column, sampled_s: Column, length: Column, least_s: float = 5.0, slowest: float = 0.5, most: float = 1800.0) -> Column:
    """Seconds over a road where it was seen for long enough; null elsewhere, never free flow. Speed in metres a second."""
    return F.when(speed.isNotNull() & (F.coalesce(sampled_s, F.lit(0.0)) >= least_s), F.least(length / F.greatest(speed, F.lit(slowest)), F.lit(most)))


def local_seconds_to_utc(date: Column, seconds: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC of the clock that shows seconds after the local midnight of a date; in the hour that a change of clocks skips, the later one."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(date) * 86400 + seconds.cast("long")), zone)


def local_day_bounds(text: Column, pattern: str = "MM/dd/yyyy", zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """UTC of a local day's start and of the next one's; null for blank and for what is no day."""
    day = F.try_to_timestamp(F.trim(text), F.lit(pattern)).cast("date")
    return local_seconds_to_utc(day, F.lit(0), zone), local_seconds_to_utc(F.date_add(day, 1), F.lit(0), zone)


def dispatch_time(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC of a local "Sep 25 2026 5:59PM", whatever the blanks between."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(F.trim(text), "\\s+", " "), F.lit("MMM d yyyy h:mma")), zone)


def typical_buckets(t: Column, now: Column, weeks: int = 4, zone: str = LOCAL_ZONE) -> Column:
    """Starts of the ten-minute buckets at the same local weekday and clock in the `weeks` last weeks that are before now, newest first."""
    local = F.from_utc_timestamp(t, zone)
    ahead = F.greatest(F.lit(0), F.ceil((F.unix_timestamp(t) - F.unix_timestamp(now)) / 604800.0)).cast("int")
    starts = F.transform(F.sequence(F.lit(1), ahead + weeks + 1), lambda k: bucket10(F.to_utc_timestamp(local - F.make_dt_interval(k * 7), zone)))
    return F.slice(F.filter(starts, lambda x: x <= now), 1, weeks)


def stable_key(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, length)


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash; the same parts give the same number."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def congestion_ratio(speed: Column, free_flow: Column) -> Column:
    """1 - speed / free flow, within 0 and 1; null without a speed or a free flow."""
    return F.when((free_flow > 0) & speed.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - speed / free_flow)))


def z_transform(tt: Column, free_flow_tt: Column, floor: float = 0.1) -> Column:
    return F.log(F.greatest(tt, F.lit(floor)) / F.greatest(free_flow_tt, F.lit(floor)))


def from_z(z: Column, length: Column, free_flow: Column, fastest: float = 1.3, slowest: float = 0.5, most: float = 1800.0) -> dict[str, Column]:
    """Travel time, speed (metres a second) and congestion ratio of a z, within physical bounds."""
    least = length / (free_flow * fastest)
    tt = F.greatest(least, F.least(length / free_flow * F.exp(z), length / slowest, F.lit(most)))
    speed = length / tt
    return {"travel_time": tt, "speed": speed, "ratio": congestion_ratio(speed, free_flow)}


def redact(text: Column) -> Column:
    """Masks user and password before an address's host, and the values of key-like names."""
    no_user = F.regexp_replace(text, "(?i)\\b([a-z][a-z0-9+.-]*://)[^/\\s:@]*:[^@\\s]*@", "$1***@")
    return F.regexp_replace(no_user, "(?i)\\b(token|app_token|access_token|api_key|apikey|key|password|pwd)=[^&\\s\"']+", "$1=***")


def redact_nested(value: Column, kind: DataType) -> Column:
    """redact on every text inside a value of this type: fields of structs, elements of arrays, values of maps."""
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact_nested(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: redact_nested(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(redact_nested(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def settle_reward(offered: Column, arrived: Column, same_route: Column, claimed: Column, drive_s: Column, expected_s: Column) -> Column:
    """State of a finished trip's reward."""
    return first_match([(~offered, "no_offer"), (~arrived, "not_arrived"), (~same_route, "wrong_route"), (claimed, "taken"), (drive_s < expected_s / 2, "too_soon")], "payable")


def errors_of(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules)), lambda x: x.isNotNull())
