"""Column expressions for cleaning match tables. All native, none raises on a null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of the equatorial earth radius, classes and cut-offs of the analysis.
EARTH_RADIUS_M = 6378137.0
FULL_TIME = 90
NO_GOAL = 999
SHORT_KM = 100.0
TOP_POSITIONS = 6
SAFE_POSITIONS = 17
CUTOFF_DATE = "2020-03-13"
PERIODS = ["Pre", "Post"]
RESULTS = ["Loss/Draw", "Win"]
DISTANCES = ["Short", "Long"]
LOCATIONS = ["Away", "Home"]
ABILITIES = ["Not Top 6", "Top 6"]
COMBINATIONS = [
    "Top 6 (Home) vs Top 6",
    "Top 6 (Away) vs Top 6",
    "Top 6 (Home) vs Not Top 6",
    "Top 6 (Away) vs Not Top 6",
    "Not Top 6 (Home) vs Top 6",
    "Not Top 6 (Away) vs Top 6",
    "Not Top 6 (Home) vs Not Top 6",
    "Not Top 6 (Away) vs Not Top 6",
]


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice whose result is null when the condition is null."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def day_month_year(text: Column) -> Column:
    """Date from d/m/y text with a four- or two-digit year; null when neither fits."""
    four = F.try_to_date(text, "d/M/yyyy")
    two = F.try_to_date(text, "d/M/yy")
    return F.when(text.rlike(r"/\d{4}$"), four).otherwise(two)


def period_flag(date: Column, cutoff: str = CUTOFF_DATE) -> Column:
    return if_else(date > F.to_date(F.lit(cutoff)), F.lit("Post"), F.lit("Pre"))


def not_listed(col: Column, names: Sequence[str]) -> Column:
    """True unless the value is in the list; a null is not in it."""
    return ~F.coalesce(col.isin(list(names)), F.lit(False))


def outcome_class(code: Column, win: str = "H") -> Column:
    """Win for the winning code, Loss/Draw for all else, nulls too."""
    return F.when(code == win, "Win").otherwise("Loss/Draw")


def indicator(cond: Column) -> Column:
    return if_else(cond, F.lit(1), F.lit(0))


def distance_class(km: Column, cut: float = SHORT_KM) -> Column:
    return F.when(km <= cut, "Short").when(km > cut, "Long").otherwise("Missing")


def strength_class(position: Column, top: int = TOP_POSITIONS) -> Column:
    return if_else(position <= top, F.lit("Top 6"), F.lit("Not Top 6"))


def on_list(col: Column, levels: Sequence[str]) -> Column:
    """The value when it is one of the levels, else null."""
    return F.when(col.isin(list(levels)), col)


def event_flag(time: Column) -> Column:
    return F.when(time.isNull(), 0).otherwise(1)


def censor_fill(time: Column, horizon: int = FULL_TIME) -> Column:
    return F.coalesce(time, F.lit(horizon))


def sentinel_fill(time: Column, sentinel: int = NO_GOAL) -> Column:
    return F.coalesce(time, F.lit(sentinel))


def combination_label(ref_ability: Column, loc: Column, adv_ability: Column) -> Column:
    """"Top 6 (Home) vs Not Top 6"; a missing part is written NA."""
    part = lambda c: F.coalesce(c, F.lit("NA"))
    return F.concat(part(ref_ability), F.lit(" ("), part(loc), F.lit(") vs "), part(adv_ability))


def censored_label(time: Column, event: Column) -> Column:
    """Time as text, with a plus sign when censored."""
    return F.concat(time.cast("string"), F.when(event == 0, "+").otherwise(""))


def _at_most_one(col: Column) -> Column:
    """Rounding guard; unlike ``least`` it keeps a null."""
    return F.when(col > 1, 1.0).otherwise(col)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in kilometres of two points in degrees."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M / 1000) * F.asin(F.sqrt(_at_most_one(chord)))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere, as three coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def chord_km(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Great-circle distance of two unit vectors: the same angle as the haversine form, from half the chord.

    The sines and cosines are worked out once per place instead of once per row.
    """
    square = sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0.0))
    return F.lit(2 * EARTH_RADIUS_M / 1000) * F.asin(F.sqrt(_at_most_one(square / 4)))


def log_odds(wins: Column, played: Column) -> Column:
    """log(wins / (played - wins)): plus infinity without a loss, minus infinity without a win."""
    lost = played - wins
    return (
        F.when(lost == 0, F.lit(math.inf))
        .when(wins == 0, F.lit(-math.inf))
        .otherwise(F.ln(wins.cast("double") / F.nullif(lost, F.lit(0))))
    )


def report(col: Column, digits: int) -> Column:
    """Rounding for display: exact halves go to the even digit."""
    finite = col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(math.inf))
    return F.when(finite, F.bround(col, digits)).otherwise(col)
