"""CSV readers for the three inputs: match results (with or without goal minutes), standings and venues.

Columns are taken by header name and cast to declared types; nothing is inferred. An unreadable cell becomes
null. Only the named columns reach the scan. Lines holding commas alone come out as all-null rows, and the
position filter of the standings drops them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import SAFE_POSITIONS, day_month_year

# New column name -> (header in the file, type).
RESULT_COLUMNS = {
    "date": ("Date", "string"),
    "home": ("HomeTeam", "string"),
    "away": ("AwayTeam", "string"),
    "ftr": ("FTR", "string"),
}
GOAL_COLUMNS = {**RESULT_COLUMNS, "fhg": ("FHG", "int"), "fag": ("FAG", "int")}
STANDING_COLUMNS = {
    "team": ("Team", "string"),
    "position": ("Position", "int"),
    "pts": ("Pts", "int"),
    "gd": ("GD", "int"),
    "gf": ("F", "int"),
    "ga": ("A", "int"),
}
VENUE_COLUMNS = {"team": ("Team", "string"), "lat": ("Latitude", "double"), "long": ("Longitude", "double")}


def _raw(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    raw = spark.read.options(header=True, nullValue="NA", encoding="UTF-8").csv(path)
    missing = [old for old, _ in columns.values() if old not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return raw


def _unreadable(old: str, kind: str) -> Column:
    """True for a cell that holds something, but not a value of its type."""
    cell = F.col(f"`{old}`")
    return F.coalesce(cell.isNotNull() & (F.trim(cell) != "") & cell.try_cast(kind).isNull(), F.lit(False))


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], strict: bool = True) -> DataFrame:
    """Read, rename and prune in one step. ``NA`` and empty cells are null.

    A cell that cannot be read as its type stops the query, since null has a meaning of its own (no goal); with
    ``strict`` off it becomes null, and ``unreadable_cells`` counts how many do.
    """
    out = []
    for new, (old, kind) in columns.items():
        value = F.col(f"`{old}`").try_cast(kind)
        if strict and kind != "string":
            told = F.concat(F.lit(f"column {old} is no {kind}: "), F.col(f"`{old}`"))
            value = F.when(_unreadable(old, kind), F.raise_error(told).cast(kind)).otherwise(value)
        out.append(value.alias(new))
    return _raw(spark, path, columns).select(*out)


def unreadable_cells(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row: per column the number of cells that cannot be read as its type."""
    counts = [F.count_if(_unreadable(old, kind)).alias(new) for new, (old, kind) in columns.items()]
    return _raw(spark, path, columns).agg(*counts)


def read_results(spark: SparkSession, path: str, goals: bool = False, strict: bool = True) -> DataFrame:
    """Match results, one row per match, with a real date."""
    df = read_csv(spark, path, GOAL_COLUMNS if goals else RESULT_COLUMNS, strict)
    return df.withColumn("date", day_month_year(F.col("date")))


def read_standings(spark: SparkSession, path: str, safe_positions: int = SAFE_POSITIONS) -> DataFrame:
    """Teams that stayed up, with their strength measures."""
    return read_csv(spark, path, STANDING_COLUMNS).where(F.col("position") <= safe_positions)


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, VENUE_COLUMNS)
