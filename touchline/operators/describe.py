"""Descriptive tables: shares, rates, frequencies, correlations, trends, histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.columns import NO_GOAL, log_odds, sentinel_fill
from touchline.operators.staging import stage


def rows_of(weight: str | None) -> Column:
    """How many rows a row stands for: one, or the count column of a grouped frame."""
    return F.lit(1) if weight is None else F.col(weight)


def class_shares(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """Count and share of each class. Classes are counted once and stored; their total is one number."""
    counts = stage(df.groupBy(col).agg(F.sum(rows_of(weight)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    return counts.select(col, "n", (F.col("n") / F.lit(total)).alias("share"))


def rate_table(df: DataFrame, keys: Sequence[str], win: Column, weight: str | None = None) -> DataFrame:
    """Wins, games, win rate and log odds per key; keys without a win are left out. One aggregate."""
    n = rows_of(weight)
    table = df.groupBy(*keys).agg(F.sum(F.when(win, n).otherwise(0)).alias("wins"), F.sum(n).alias("games_played"))
    return table.where("wins > 0").select(
        *keys,
        "wins",
        "games_played",
        (F.col("wins") / F.col("games_played")).alias("win_rate"),
        log_odds(F.col("wins"), F.col("games_played")).alias("win_logit"),
    )


def level_counts(df: DataFrame, col: str, levels: Sequence, weight: str | None = None) -> DataFrame:
    """Frequency of every listed level, zero counts included, values off the list left out, with percent."""
    known = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(levels)], f"level_no int, {col} {_kind(df, col)}")
    counts = df.where(F.col(col).isin(list(levels))).groupBy(col).agg(F.sum(rows_of(weight)).alias("n"))
    # `known` is the caller's level list: its size is the length of a Python list
    filled = F.broadcast(known).join(counts, col, "left").select(col, "level_no", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return filled.select(
        col, "level_no", F.col("n").cast("bigint").alias("n"), F.when(total > 0, 100 * F.col("n") / total).alias("percent")
    )


def _kind(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, minimum and maximum of each column, long form, one pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")))
    return df.agg(F.array(*aggs).alias("_all")).select(F.inline("_all"))


def mean_by(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations as (row, col, value), all pairs in one aggregate. A null anywhere makes it null.

    Rows with a null in any column are not dropped silently: as in a plain matrix correlation, the pairs that
    touch such a column have no value. A constant column has no spread to divide by: its pairs are NaN.
    """
    pairs = list(combinations(cols, 2))
    aggs = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    at = {c: i for i, c in enumerate(cols)}
    cells = []
    for a in cols:
        for b in cols:
            if a == b:
                value = F.lit(1.0)
            else:
                i = pairs.index((a, b)) if (a, b) in pairs else pairs.index((b, a))
                spread = F.col(f"s{at[a]}") * F.col(f"s{at[b]}")
                r = F.when(spread != 0, F.col(f"c{i}") / spread).when(F.col("_rows") > 1, F.lit(math.nan))
                value = F.when((F.col(f"n{at[a]}") == 0) & (F.col(f"n{at[b]}") == 0), r)
            cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), value.alias("value")))
    return df.agg(*aggs, *nulls, F.count(F.lit(1)).alias("_rows")).select(F.inline(F.array(*cells)))


def trend_line(table: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of one point per row; infinite values are left out and counted."""
    yy = F.col(y).cast("double")
    usable = F.col(x).isNotNull() & yy.isNotNull() & ~F.isnan(yy) & (F.abs(yy) != F.lit(math.inf))
    xv = F.when(usable, F.col(x).cast("double"))
    yv = F.when(usable, yy)
    return table.agg(
        F.regr_slope(yv, xv).alias("slope"),
        F.regr_intercept(yv, xv).alias("intercept"),
        F.count_if(usable).alias("points"),
        F.count_if(~usable).alias("left_out"),
    )


# The widest raw bin width, in its power of ten, for which each round unit is taken (else 10).
ROUND_UNITS = [(1.4, 1.0), (2.8, 2.0), (7.0, 5.0)]


def round_breaks(low: float, high: float, bins: int) -> list[float]:
    """Equally spaced round cut points (1, 2 or 5 times a power of ten) covering low..high in about ``bins`` bins."""
    if high == low:
        return [low - 0.5, low + 0.5]
    raw = (high - low) / bins
    base = 10.0 ** math.floor(math.log10(raw))
    unit = next((u for limit, u in ROUND_UNITS if raw / base <= limit), 10.0)
    width = unit * base
    first = math.floor(low / width + 1e-7)
    last = math.ceil(high / width - 1e-7)
    return [i * width for i in range(first, last + 1)]


def histogram(df: DataFrame, col: str, bins: int = 15, weight: str | None = None) -> DataFrame:
    """Counts on round equal bins, right-closed, the lowest value in the first bin, empty bins shown.

    The rows are read once, into counts per distinct value; range and bins come from those. Nulls and NaN are in no bin.
    """
    values = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).groupBy(F.col(col).cast("double").alias("v"))
    counted = stage(values.agg(F.sum(rows_of(weight)).alias("n")))  # one row per distinct value
    x = F.col("v")
    low, high = counted.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    cuts = round_breaks(low, high, bins)
    width = cuts[1] - cuts[0]
    number = F.greatest(F.ceil((x - F.lit(cuts[0])) / F.lit(width) - F.lit(1e-7)), F.lit(1)).cast("int")
    counts = counted.groupBy(number.alias("bin")).agg(F.sum("n").alias("n"))
    frame = spark.createDataFrame(
        [(i + 1, cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)], "bin int, lower double, upper double"
    )
    # `frame` has one row per bin, about `bins` of them
    return F.broadcast(frame).join(counts, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def first_event_outcome(
    df: DataFrame, home_time: str = "fhg", away_time: str = "fag", result: str = "ftr", sentinel: int = NO_GOAL
) -> DataFrame:
    """What became of the side that scored first: Win, Draw or Loss counts. Goalless and same-minute matches go."""
    never = sentinel
    home, away = (F.coalesce(F.col(c), F.lit(never)) for c in (home_time, away_time))
    leader = F.when(home < away, "H").otherwise("A")
    ends = F.coalesce(F.col(result), F.lit(""))
    # what the result says of the leader; anything but the two sides' letters and a draw has no name
    fate = F.when(ends == leader, "Win").when(ends == "D", "Draw").when(ends.isin("H", "A"), "Loss").otherwise("")
    return df.where(home != away).groupBy(fate.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
