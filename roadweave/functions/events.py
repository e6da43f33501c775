"""Column expressions about public events: kind, size, crowd, tier, windows of arrival and departure, importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.scalars import first_match

#: Crowd factor by category; seconds that an event adds by tier; hours after which an event without an end is over.
TYPE_FACTOR = {"concert": 1.0, "sports": 1.0, "festival": 1.0, "parade": 1.0, "community": 0.9, "performing_arts": 0.7, "conference": 0.6, "holiday": 0.5}
OTHER_FACTOR, DEFAULT_CROWD = 0.7, 3000.0
TIER_SECONDS = {"high": 600.0, "medium": 300.0, "low": 120.0}
DEFAULT_HOURS = {"sports": 3, "concert": 3}
#: Kinds by category, and by name where no category tells, in this order; a kind's typical crowd for one closed block.
KIND_BY_CATEGORY = {
    "music": ("concert", "concerts", "music", "performing_arts"), "sports": ("sports", "sport"), "festival": ("festival", "festivals"), "community": ("community",),
    "conference": ("conference", "conferences", "expo", "expos"), "parade": ("parade",), "market": ("market",),
}
KIND_BY_NAME = (
    ("music", r"\bmusic\b|concert|symphony|opera|\bjazz\b|\bdj\b"),
    ("sports", r"\bsports?\b|\bgame\b|tournament|marathon|\brace\b|\bbike\b|\b\d+k\b|cornhole|giants|warriors|49ers"),
    ("parade", r"parade|fleet week|procession|blessing|sunday streets"),
    ("market", r"market"),
    ("community", r"block part|trick.?or.?treat|treat or treat|halloween|street party|barbe?cue|\bbbq\b|picnic|feast|wedding"),
    ("festival", r"festival|\bfest\b|\bfesta\b|oktoberfest|street fair|\bfair\b|fiesta|carnival|celebration"),
    ("conference", r"conference|summit|dreamforce|unboxed|corporate|convention|\bexpo\b|\bgala\b"),
)
KIND_CROWD = {"music": 12_000.0, "sports": 5_000.0, "festival": 8_000.0, "parade": 8_000.0, "conference": 5_000.0, "market": 1_500.0, "community": 150.0, "other": 500.0}
#: A provider's categories in our words, and its reasons of deletion as a status.
PROVIDER_CATEGORY = {
    "concerts": "concert", "sports": "sports", "festivals": "festival", "performing-arts": "performing_arts", "conferences": "conference", "expos": "conference", "community": "community",
    "public-holidays": "holiday",
}
PROVIDER_STATUS = {"cancelled": "cancelled", "postponed": "postponed"}


def event_kind(category: Column, name: Column) -> Column:
    """The category's kind where it has one, else that of the first pattern in the name."""
    low, text = F.lower(F.coalesce(category, F.lit(""))), F.coalesce(name, F.lit(""))
    by_category = [(low.isin(*categories), kind) for kind, categories in KIND_BY_CATEGORY.items()]
    return first_match(by_category + [(text.rlike(f"(?i){pattern}"), kind) for kind, pattern in KIND_BY_NAME], "other")


def map_category(category: Column, labels: Column) -> Column:
    """A provider's category in our words; the label parade goes before it."""
    parade = F.coalesce(F.array_contains(labels, "parade"), F.lit(False))
    return first_match([(parade, "parade")] + [(category == k, v) for k, v in PROVIDER_CATEGORY.items()], "other")


def map_status(state: Column, reason: Column) -> Column:
    """active, cancelled, postponed or archived; no state counts as active."""
    live = F.coalesce(state, F.lit("active")).isin("active", "predicted")
    return first_match([(live, "active")] + [(reason == k, v) for k, v in PROVIDER_STATUS.items()], "archived")


def event_crowd(attendance: Column, capacity: Column, category: Column) -> Column:
    """Attendance, else capacity, else a default (zero counts as unknown), times the category's factor."""
    some = lambda c: F.when(c != 0, c.cast("double"))
    factor = first_match([(category == k, F.lit(v)) for k, v in TYPE_FACTOR.items()], F.lit(OTHER_FACTOR))
    return F.coalesce(some(attendance), some(capacity), F.lit(DEFAULT_CROWD)) * factor


#: Estimated attendance by a pattern in the name, the first that matches: likely (None: by closed blocks), least and most.
ATTENDANCE_RULES = (
    (r"block part(y|ies)", 300, 100, 800),
    (r"preschool|nursery|school|church|parish|anniversar", 500, 200, 1_500),
    (r"trick.?or.?treat|treat or treat|halloween", 3_000, 1_000, 10_000),
    (r"night market", 10_000, 5_000, 15_000),
    (r"farmers'? market|market", 2_000, 500, 5_000),
    (r"sunday streets", 15_000, 5_000, 25_000),
    (r"triathlon|marathon|race|\brun\b|walk", 5_000, 2_000, 10_000),
    (r"parade", 20_000, 5_000, 50_000),
    (r"street fair|festival|fest\b|fair\b|street party|celebration", None, 2_000, 50_000),
)
PER_BLOCK, OTHER_ATTENDANCE = 500, (300, 10_000)


def attendance_estimate(name: Column, blocks: Column, published: Column) -> dict[str, Column]:
    """attendance, low, high and basis: the published figure where there is one, else by the name, else 500 for each closed block within bounds."""
    text, by_blocks = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(blocks, F.lit(0)) * PER_BLOCK
    within = lambda lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), by_blocks)).cast("long")
    pick = lambda of, otherwise: first_match([(text.rlike(r[0]), of(r)) for r in ATTENDANCE_RULES], otherwise)
    lo, hi = OTHER_ATTENDANCE
    point = pick(lambda r: F.lit(r[1]).cast("long") if r[1] else within(r[2], r[3]), within(lo, hi))
    known = pick(lambda r: F.lit("category"), F.lit("default"))
    return {
        "attendance": F.coalesce(published.cast("long"), point), "low": F.coalesce(published.cast("long"), pick(lambda r: F.lit(r[2]).cast("long"), F.lit(lo).cast("long"))),
        "high": F.coalesce(published.cast("long"), pick(lambda r: F.lit(r[3]).cast("long"), F.lit(hi).cast("long"))), "basis": F.when(published.isNotNull(), "published").otherwise(known),
    }


def event_tier(crowd: Column, high: float = 15_000, medium: float = 5_000) -> Column:
    return F.when(crowd >= high, "high").when(crowd >= medium, "medium").otherwise("low")


def tier_seconds(tier: Column) -> Column:
    return first_match([(tier == k, F.lit(v)) for k, v in TIER_SECONDS.items()], F.lit(TIER_SECONDS["low"]))


def crowd_windows(start_s: Column, end_s: Column, all_day: Column, category: Column) -> Column:
    """[from, to] in seconds, when a crowd is out: the whole span of an all-day or long event, else around its start and around its end."""
    whole = F.coalesce(all_day, F.lit(False)) | F.coalesce(end_s - start_s >= 5 * 3600, F.lit(False))
    end = F.coalesce(end_s, start_s + first_match([(category == k, F.lit(v * 3600)) for k, v in DEFAULT_HOURS.items()], F.lit(2 * 3600)))
    span = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    return F.when(whole, F.array(span(start_s, F.coalesce(end_s, start_s + 6 * 3600)))).otherwise(F.array(span(start_s - 5400, start_s + 900), span(end - 900, end + 3600)))


def gap_to(t: Column, window: Column) -> Column:
    return F.when(t.between(window["a"], window["b"]), F.lit(0.0)).otherwise(F.least(F.abs(t - window["a"]), F.abs(t - window["b"])))


def time_factor(t: Column, windows: Column, ramp_s: float = 1800.0) -> Column:
    """1 inside a window, fading to 0 over half an hour around it."""
    return F.greatest(F.lit(0.0), F.array_max(F.transform(windows, lambda w: 1 - gap_to(t, w) / ramp_s)))


def crowd_phase(t: Column, windows: Column) -> Column:
    """arriving or leaving, by the nearer window; out where there is one only."""
    gap = lambda k: gap_to(t, F.get(windows, k))
    return F.when(F.size(windows) == 1, "out").when(gap(0) <= gap(1), "arriving").otherwise("leaving")


def distance_factor(metres: Column, near: float = 200.0, far: float = 700.0) -> Column:
    """1 up to near, fading to 0 at far."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (far - metres) / (far - near)))


def event_impact(kind: Column, blocks: Column) -> tuple[Column, Column]:
    """Crowd, growing with the closed blocks a bit less than in proportion, and the radius that it slows."""
    crowd = first_match([(kind == k, F.lit(v)) for k, v in KIND_CROWD.items()], F.lit(KIND_CROWD["other"])) * F.pow(F.greatest(F.coalesce(blocks, F.lit(0)), F.lit(1)).cast("double"), F.lit(0.75))
    return crowd, F.least(F.lit(1200.0), F.greatest(F.lit(150.0), 100 + 120 * F.sqrt(crowd / 1000)))


def event_importance(closure_ids: Column, source: Column, floor_source: str) -> tuple[Column, Column, Column]:
    """Tier, score (0 to 1) and basis from the distinct closed blocks, else from a source that lists nothing small."""
    n = F.size(F.array_distinct(F.filter(F.coalesce(closure_ids, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))).cast("double")
    floor = F.coalesce(source == floor_source, F.lit(False))
    tier = first_match([(n >= 6, "major"), ((n >= 2) | floor, "medium")], "minor")
    score = first_match([(n >= 6, 0.75 + 0.25 * F.least(F.lit(1.0), F.log(n / 6) / F.log(F.lit(10.0)))), (n >= 2, 0.45 + 0.25 * (n - 2) / 4), (floor, F.lit(0.45)), (n == 1, F.lit(0.2))], F.lit(0.1))
    return tier, score, first_match([(n >= 2, "closure_extent"), (floor, "source_rank_floor"), (n == 1, "closure_extent")], "none")


def heat_weight(blocks: Column) -> Column:
    """1 for an event, and a quarter for each closed block after the first, up to 2 more."""
    return 1 + F.least(F.lit(2.0), 0.25 * F.greatest(F.lit(0), blocks - 1))
