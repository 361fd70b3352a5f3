"""The two analysis frames, from cleaned results, standings and venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import columns as C
from touchline.operators.joins import attach_distance, attach_sides, drop_either_side, keep_keys
from touchline.operators.reshape import two_sided
from touchline.operators.terms import Cat, Num

# Teams that came up, left out because last season's table does not hold them.
PROMOTED_2019 = ["Aston Villa", "Norwich", "Sheffield United"]
PROMOTED_2020 = ["Leeds", "West Brom", "Fulham"]

FINAL_MODEL = (Num("home_pts"), Num("away_pts"), Cat("distance", C.DISTANCES))
# Published coefficients of the final model (intercept, home points, away points, long distance).
FINAL_COEFFICIENTS = [-2.471221, 0.046378, -0.016334, 0.663690]


def outcome_frame(
    results: DataFrame,
    standings: DataFrame,
    venues: DataFrame,
    promoted: Sequence[str],
    cutoff: str = C.CUTOFF_DATE,
    short_km: float = C.SHORT_KM,
    venues_of_home_teams: bool = True,
    grouped: bool = False,
) -> DataFrame:
    """One row per match: result, period, strength of both sides, distance class.

    ``grouped`` counts equal matches (same teams, period, result) first, in column ``n``: every later column
    follows from those four, so the lookups run on a few thousand rows instead of on every match. The operators
    take the count as ``weight``.

    ``venues_of_home_teams`` keeps only venues of teams that play at home at least once (one more pass over
    the results); it matters only for a team that never does.
    """
    kept = drop_either_side(results, promoted)
    if venues_of_home_teams:
        venues = keep_keys(venues, "team", kept, "home")
    cleaned = kept.select(
        "home",
        "away",
        C.outcome_class(F.col("ftr")).alias("result"),
        C.period_flag(F.col("date"), cutoff).alias("period"),
    )
    if grouped:
        cleaned = cleaned.groupBy("home", "away", "result", "period").agg(F.count(F.lit(1)).alias("n"))
    cleaned = cleaned.withColumn("result_bin", C.indicator(F.col("result") == "Win"))
    strong = attach_sides(cleaned, standings)
    placed = attach_distance(strong, venues)
    return placed.withColumn("distance", C.distance_class(F.col("distance_km"), short_km))


def duration_frame(
    goals: DataFrame,
    standings: DataFrame,
    promoted: Sequence[str],
    cutoff: str = C.CUTOFF_DATE,
    horizon: int = C.FULL_TIME,
    top: int = C.TOP_POSITIONS,
    grouped: bool = False,
) -> DataFrame:
    """Two rows per match: minutes to the side's first goal, censored at full time, with both strengths.

    ``grouped`` counts equal side rows first, in column ``n``, and looks the strengths up once per group. It
    pays when the frame is stored for several analyses; a single curve or fit groups to fewer rows by itself.

    The exclusion of promoted sides looks at both teams, so it runs on the matches, before rows double.
    """
    kept = drop_either_side(goals, promoted).select(
        "home", "away", "fhg", "fag", C.period_flag(F.col("date"), cutoff).alias("period")
    )
    sides = two_sided(kept, keep=["period"]).select(
        "ref",
        "adv",
        "loc",
        "period",
        C.event_flag(F.col("time")).alias("cens"),
        C.censor_fill(F.col("time"), horizon).alias("goaltime"),
    )
    if grouped:
        sides = sides.groupBy(*sides.columns).agg(F.count(F.lit(1)).alias("n"))
    strong = attach_sides(sides, standings.select("team", "position", "pts"), sides={"ref": "ref_", "adv": "adv_"})
    return strong.withColumns(
        {
            "ref_ability": C.strength_class(F.col("ref_position"), top),
            "adv_ability": C.strength_class(F.col("adv_position"), top),
        }
    )
