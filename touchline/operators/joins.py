"""Lookups by key. Every join is an equi join.

A lookup side is broadcast only when both its row count and the bytes that Spark expects of it are under a bound. A
larger lookup goes through a shuffle join: Spark's adaptive execution splits partitions that a hot key makes too
large, so only what is hot is copied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.columns import chord_km, great_circle_km, not_listed, unit_vector
from touchline.operators.staging import stage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def _fits(small: DataFrame, limit: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """True when a lookup is within both bounds. Bytes are summed over its rows as text, and only if they are few."""
    if small.limit(limit + 1).count() > limit:
        return False
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in small.columns), F.lit(0))
    return (small.agg(F.sum(width)).first()[0] or 0) <= most_bytes


def _joined(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str, small: bool) -> DataFrame:
    return df.join(F.broadcast(lookup) if small else lookup, list(keys), how)


def keyed_join(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join on equally named keys; ``how`` is left, inner, left_semi or left_anti."""
    return _joined(df, lookup, keys, how, _fits(lookup, broadcast_rows, broadcast_bytes))


def attach_sides(
    df: DataFrame,
    lookup: DataFrame,
    key: str = "team",
    sides: Mapping[str, str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join one lookup once per side, its columns prefixed: home -> home_pts, away -> away_pts.

    Lookup keys must be unique and not null; a side without a row gets nulls. The lookup's size is checked once.
    """
    sides = sides or {"home": "home_", "away": "away_"}
    small = _fits(lookup, broadcast_rows, broadcast_bytes)
    out = df
    for side, prefix in sides.items():
        named = lookup.select(
            F.col(key).alias(side), *[F.col(c).alias(prefix + c) for c in lookup.columns if c != key]
        )
        out = _joined(out, named, [side], "left", small)
    return out.select(*df.columns, *[c for c in out.columns if c not in df.columns])


def unmatched_keys(df: DataFrame, lookup: DataFrame, side: str, key: str = "team") -> DataFrame:
    """Keys of one side without a lookup row, with their row counts (names must agree exactly)."""
    per_key = df.groupBy(side).agg(F.count(F.lit(1)).alias("rows"))
    return keyed_join(per_key, lookup.select(F.col(key).alias(side)), [side], "left_anti")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def keep_keys(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key occurs in the other table."""
    # stored, since the size check and the join both read it
    wanted = stage(other.select(F.col(other_key).alias(key)).distinct())
    return keyed_join(df, wanted, [key], "left_semi")


def drop_keys(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key does not occur in the other table; a null key stays."""
    unwanted = stage(other.select(F.col(other_key).alias(key)).distinct())
    return keyed_join(df, unwanted, [key], "left_anti")


def drop_either_side(df: DataFrame, names: Sequence[str], sides: Sequence[str] = ("home", "away")) -> DataFrame:
    """Rows where no side is in a short list of names; null sides stay."""
    for side in sides:
        df = df.where(not_listed(F.col(side), names))
    return df


def pair_distances(pairs: DataFrame, venues: DataFrame, sides: tuple[str, str] = ("home", "away")) -> DataFrame:
    """Distinct pairs with the distance between their venues in km; null when a venue is unknown.

    Grouping the pairs first leaves one row per pair however often it meets.
    """
    a, b = sides
    places = venues.select("team", "lat", "long")
    distinct = pairs.select(a, b).distinct()
    placed = attach_sides(distinct, places, "team", {a: "_a_", b: "_b_"})
    km = great_circle_km(F.col("_a_lat"), F.col("_a_long"), F.col("_b_lat"), F.col("_b_long"))
    return placed.select(a, b, km.alias("distance_km"))


def attach_pair(df: DataFrame, pairs: DataFrame, sides: Sequence[str] = ("home", "away")) -> DataFrame:
    """Left join on the two-column key. Repeated pairs are reduced to one row so that no match multiplies."""
    out = keyed_join(df, stage(pairs.dropDuplicates(list(sides))), list(sides), "left")
    return out.select(*df.columns, *[c for c in pairs.columns if c not in df.columns])


def attach_distance(df: DataFrame, venues: DataFrame, sides: tuple[str, str] = ("home", "away")) -> DataFrame:
    """Add ``distance_km`` straight from the two venue lookups: no pair table, no second pass over the rows."""
    a, b = sides
    axes = ["_x", "_y", "_z"]
    places = venues.select("team", *[c.alias(n) for n, c in zip(axes, unit_vector(F.col("lat"), F.col("long")))])
    placed = attach_sides(df, places, "team", {a: "_a", b: "_b"})
    km = chord_km([F.col("_a" + n) for n in axes], [F.col("_b" + n) for n in axes])
    return placed.select(*df.columns, km.alias("distance_km"))
