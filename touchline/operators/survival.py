"""Right-censored times: event table, Kaplan-Meier curve, summaries, cumulative hazard, rank tests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.tails import Z95, chi_square_upper
from touchline.operators.describe import rows_of
from touchline.operators.newton import solve, symmetric, triangle
from touchline.operators.ordered import BUCKET, Order, Step
from touchline.operators.staging import stage

#: A test holds groups x groups numbers on the driver.
MAX_GROUPS = 1_000
#: Up to so many groups, the counts of all stand side by side in a row per time; more are worked off in blocks of times.
WIDE_GROUPS = 40
TIMES_AT_ONCE = 1_024
# Fixed value: a survival within this distance of one half counts as one half.
HALF_TOLERANCE = 1.4901161193847656e-08


def time_counts(df: DataFrame, time: str, event: str, strata: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows and events per stratum and distinct time. Rows with a null in a used column are left out.

    Equal times merge before the shuffle, so a time that holds most rows (full time) is no hot spot.
    """
    n = rows_of(weight)
    return (
        df.select(*strata, F.col(time).cast("double").alias("time"), n.alias("_n"), (F.col(event).cast("int") * n).alias("_e"))
        .dropna()
        .groupBy(*strata, "time")
        .agg(F.sum("_n").alias("n_all"), F.sum("_e").alias("n_event"))
    )


@dataclass(frozen=True)
class EventTable:
    """Rows and events per stratum and time, stored, with the layout used for running sums."""

    counts: DataFrame
    order: Order


def event_table(
    df: DataFrame, time: str, event: str, strata: Sequence[str] = (), small_rows: int | None = None, weight: str | None = None
) -> EventTable:
    counts = stage(time_counts(df, time, event, strata, weight))
    return EventTable(counts, Order.of(counts, "time", strata, small_rows))


CURVE_COLUMNS = ["time", "n_risk", "n_event", "n_censor", "survival", "std_err", "lower", "upper", "cum_hazard"]
AT_RISK = Step({"n_risk": "n_all"}, descending=True)
_ALIVE = "n_event < n_risk"
#: Sums along the times, from those at risk. After the step, log and Greenwood sums of ended curves are not used.
HAZARD = {
    "_log": f"CASE WHEN {_ALIVE} THEN log1p(-n_event / n_risk) END",
    "_ended": f"CASE WHEN {_ALIVE} THEN 0 ELSE 1 END",
    "_green": f"CASE WHEN {_ALIVE} THEN n_event / (double(n_risk) * (n_risk - n_event)) END",
    "cum_hazard": "n_event / n_risk",
}
_SURVIVAL = "CASE WHEN _ended = 0 THEN exp(_log) ELSE 0D END"


def _curve(run: DataFrame) -> DataFrame:
    """Survival, error and limits from the sums of the steps."""
    alive = F.col("_ended") == 0
    s = F.expr(_SURVIVAL)
    spread = F.when(alive, F.sqrt("_green"))
    return run.select(
        "*",
        (F.col("n_all") - F.col("n_event")).alias("n_censor"),
        s.alias("survival"),
        (s * spread).alias("std_err"),
        F.when(alive, F.exp(F.col("_log") - Z95 * spread)).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), F.exp(F.col("_log") + Z95 * spread))).alias("upper"),
    )


def kaplan_meier(
    df: DataFrame, time: str, event: str, strata: Sequence[str] = (), small_rows: int | None = None, weight: str | None = None
) -> DataFrame:
    """Survival curve per stratum at every distinct time, with standard error and log-scale 95% limits.

    Where the curve has reached zero its error and limits are undefined (null).
    """
    events = event_table(df, time, event, strata, small_rows, weight)
    return _curve(events.order.scan(events.counts, AT_RISK, Step(HAZARD))).select(*strata, *CURVE_COLUMNS)


def cumulative_hazard(curve: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Cumulative hazard with log time and log hazard; the logs are null where the value is not above zero."""
    positive = lambda c: F.when(F.col(c) > 0, F.ln(c))
    return curve.select(
        *strata, "time", positive("time").alias("log_time"), "cum_hazard", positive("cum_hazard").alias("log_cum_hazard")
    )


MEDIANS = {"median": "survival", "lower_median": "lower", "upper_median": "upper"}


def _median_parts() -> list[Column]:
    """Aggregates over a curve: its first point at or below one half, and the first time clearly below it."""
    parts = []
    for name, c in MEDIANS.items():
        reached = F.col(c) < 0.5 + HALF_TOLERANCE
        parts.append(F.min_by(F.struct("time", c), F.when(reached, F.col("time"))).alias(f"_first_{name}"))
        parts.append(F.min(F.when(F.col(c) < 0.5 - HALF_TOLERANCE, F.col("time"))).alias(f"_below_{name}"))
    return parts


def _median_columns() -> list[Column]:
    """First time at or below one half; on a flat step at exactly one half, the middle of the step."""
    done = []
    for name, c in MEDIANS.items():
        at, value, after = F.col(f"_first_{name}.time"), F.col(f"_first_{name}.{c}"), F.col(f"_below_{name}")
        on_half = (F.abs(value - 0.5) < HALF_TOLERANCE) & after.isNotNull()
        done.append(F.when(on_half, (at + after) / 2).otherwise(at).alias(name))
    return done


def median_survival(curve: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Median per stratum with limits read off the limit curves; null where a curve stays above one half."""
    return curve.groupBy(*strata).agg(*_median_parts()).select(*strata, *_median_columns())


def curve_summary(
    df: DataFrame,
    time: str,
    event: str,
    strata: Sequence[str] = (),
    end: float | None = None,
    small_rows: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Records, events, restricted mean with error, median with limits, per stratum.

    The mean is the area under the curve up to a common end: ``end`` or the largest time of all strata.
    """
    events = event_table(df, time, event, strata, small_rows, weight)
    groups = list(strata)
    if end is None:
        end = events.counts.agg(F.max("time")).first()[0]
    stop = F.lit(float(end) if end is not None else None).cast("double")
    until = f"double('{float(end)!r}')" if end is not None else "double(NULL)"
    # area of the step that starts at a time, and its sum over the times from there on
    area = f"CASE WHEN time < {until} THEN ({_SURVIVAL}) * (least(coalesce(_next, {until}), {until}) - time) ELSE 0D END"
    steps = [AT_RISK, Step(HAZARD, following="_next"), Step({"_right": area}, descending=True)]
    behind = _curve(events.order.scan(events.counts, *steps)).withColumn("_area", F.expr(area))
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    noise = F.when((n > d) & (F.col("time") <= stop), d / (n * (n - d)) * F.col("_right") * F.col("_right")).otherwise(0.0)
    sums = behind.groupBy(*groups).agg(
        F.max("n_risk").alias("records"),
        F.sum("n_event").alias("events"),
        (F.least(F.min("time"), stop) + F.sum("_area")).alias("rmean"),
        F.sqrt(F.sum(noise)).alias("se_rmean"),
        *_median_parts(),
    )
    return sums.select(
        *groups, "records", F.col("records").alias("n_start"), "events", "rmean", "se_rmean", *_median_columns()
    )


@dataclass
class RankTest:
    """Weighted comparison of survival between groups."""

    group: str
    levels: list
    n: np.ndarray
    observed: np.ndarray
    expected: np.ndarray
    variance: np.ndarray
    chi_square: float
    df: int
    p: float

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (str(level), int(n), float(o), float(e), self.chi_square, self.df, self.p)
            for level, n, o, e in zip(self.levels, self.n, self.observed, self.expected)
        ]
        return spark.createDataFrame(
            rows, f"{self.group} string, n bigint, observed double, expected double, chi_square double, df int, p double"
        )

    def group_table(self, spark: SparkSession) -> DataFrame:
        """Each group beside all others: its gap to the expected events in standard errors, for tests of many groups."""
        error = np.sqrt(np.diag(self.variance))
        rows = [
            (str(level), int(n), float(o), float(e), float(s), float((o - e) / s) if s > 0 else None)
            for level, n, o, e, s in zip(self.levels, self.n, self.observed, self.expected, error)
        ]
        return spark.createDataFrame(rows, f"{self.group} string, n bigint, observed double, expected double, std_error double, z double")


Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _weighted(order: Order, table: DataFrame, at_risk: Step, rho: float) -> DataFrame:
    """Adds the sums at risk and the weight ``w`` of each time to a table with d events among n_all rows per time."""
    if not rho:
        return order.scan(table, at_risk).selectExpr("*", "1D AS w")
    # survival just before: the running product up to here without this time's own factor
    own = "CASE WHEN n > d THEN log1p(-d / n) END"
    risk = order.scan(table, at_risk, Step({"_log": own}))
    return risk.selectExpr("*", f"exp({float(rho)}D * (coalesce(_log, 0) - coalesce({own}, 0))) AS w")


def _wide_sums(
    df: DataFrame, time: str, event: str, group: str, levels: Sequence, rho: float, small_rows: int | None, weight: str | None
) -> Sums:
    """Sizes, observed, expected and variance of the groups, from one row per time that has two counts of each group."""
    k = len(levels)
    counts = time_counts(df.where(F.col(group).isin(list(levels))), time, event, [group], weight)
    wide = counts.groupBy("time").agg(
        F.sum("n_all").alias("n_all"),
        F.sum("n_event").alias("d"),
        *[F.sum(F.when(F.col(group) == v, F.col("n_all")).otherwise(0)).alias(f"c{i}") for i, v in enumerate(levels)],
        *[F.sum(F.when(F.col(group) == v, F.col("n_event")).otherwise(0)).alias(f"d{i}") for i, v in enumerate(levels)],
    )
    table = stage(wide)
    order = Order.of(table, "time", small_rows=small_rows)
    at_risk = Step({"n": "n_all", **{f"n{i}": f"c{i}" for i in range(k)}}, descending=True)
    risk = _weighted(order, table, at_risk, rho)
    common = "CASE WHEN n > 1 THEN w * w * d * (n - d) / (n - 1) ELSE 0 END"
    sums = [f"sum(c{i}) AS N{i}" for i in range(k)]
    sums += [f"sum(w * d{i}) AS O{i}" for i in range(k)]
    sums += [f"sum(w * d * (n{i} / n)) AS E{i}" for i in range(k)]
    sums += [f"sum({common} * (n{i} / n) * ({1 if i == j else 0} - n{j} / n)) AS V{i}_{j}" for i, j in triangle(k)]
    row = risk.selectExpr(*sums).first()
    sizes = np.array([row[f"N{i}"] or 0 for i in range(k)], dtype=float)
    seen = np.array([row[f"O{i}"] or 0.0 for i in range(k)])
    expected = np.array([row[f"E{i}"] or 0.0 for i in range(k)])
    var = symmetric([row[f"V{i}_{j}"] or 0.0 for i, j in triangle(k)], k)
    return sizes, seen, expected, var


def _block_sums(k: int):
    """Sums of one range of times, latest first; those at risk after the range come beside it.

    Rows i, j, value: j is -1 for observed, -2 for expected, else the column of the variance (i <= j).
    """

    def work(rows: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time", ascending=False)
        at = np.zeros(k)
        at[after["i"].to_numpy(dtype=int)] = after["later"].to_numpy(dtype=float)
        seen, expected, var = np.zeros(k), np.zeros(k), np.zeros((k, k))
        for start in range(0, len(rows), TIMES_AT_ONCE):
            part = rows.iloc[start : start + TIMES_AT_ONCE]
            n, d, w = (part[c].to_numpy(dtype=float) for c in ("n", "d", "w"))
            line = np.repeat(np.arange(len(part)), [len(x) for x in part["who"]])
            who = np.concatenate(part["who"].to_list()).astype(int)
            risk = np.zeros((len(part), k))
            risk[line, who] = np.concatenate(part["c"].to_list())
            risk = np.cumsum(risk, axis=0) + at
            at = risk[-1]
            np.add.at(seen, who, w[line] * np.concatenate(part["e"].to_list()))
            share = risk / n[:, None]
            expected += (w * d) @ share
            common = np.where(n > 1, w * w * d * (n - d) / np.maximum(n - 1, 1), 0.0)
            var[np.diag_indices(k)] += common @ share
            var -= (share * common[:, None]).T @ share
        low, high = np.triu_indices(k)
        every = np.arange(k)
        return pd.DataFrame(
            {
                "i": np.concatenate([every, every, low]),
                "j": np.concatenate([np.full(k, -1), np.full(k, -2), high]),
                "value": np.concatenate([seen, expected, var[low, high]]),
            }
        )

    return work


def _long_sums(
    df: DataFrame, time: str, event: str, group: str, levels: Sequence, rho: float, small_rows: int | None, weight: str | None
) -> Sums:
    """The same for many groups: one cell per (time, group) that has rows, in ranges of times of a bounded number of cells.

    A range needs to know how many of each group are at risk after it, one small table of ranges and groups. Inside
    it, matrices of ``TIMES_AT_ONCE`` times and all groups give its part of the sums.
    """
    k = len(levels)
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    numbered = spark.createDataFrame(list(zip(levels, range(k))), f"`{group}` {kind}, _i int")
    own = df.join(F.broadcast(numbered), group)
    cells = stage(time_counts(own, time, event, ["_i"], weight))
    order = Order.of(cells, "time", small_rows=small_rows)
    placed = order.assign(cells)
    if order.cuts is None:
        placed = placed.withColumn(BUCKET, F.lit(0))
    held = F.collect_list(F.struct("_i", "n_all", "n_event"))
    times = placed.groupBy(BUCKET, "time").agg(F.sum("n_all").alias("n_all"), F.sum("n_event").alias("d"), held.alias("_held"))
    lists = [F.col(f"_held.{f}").alias(a) for f, a in (("_i", "who"), ("n_all", "c"), ("n_event", "e"))]
    table = stage(times.select(BUCKET, "time", "n_all", "d", *lists))
    risk = _weighted(order, table, Step({"n": "n_all"}, descending=True), rho).select(BUCKET, "time", "n", "d", "w", "who", "c", "e")
    totals = stage(placed.groupBy(BUCKET, "_i").agg(F.sum("n_all").alias("_n")))
    grid = totals.select(BUCKET).distinct().select(BUCKET, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"))
    before = f"OVER (PARTITION BY _i ORDER BY {BUCKET} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = grid.join(totals, [BUCKET, "_i"], "left").selectExpr(BUCKET, "_i AS i", f"coalesce(sum(_n) {before}, 0) AS later")
    parts = risk.groupBy(BUCKET).cogroup(after.groupBy(BUCKET)).applyInPandas(_block_sums(k), "i int, j int, value double")
    seen, expected, var = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if j == -1:
            seen[i] = value
        elif j == -2:
            expected[i] = value
        else:
            var[i, j] = var[j, i] = value
    sizes = np.zeros(k)
    for i, n in totals.groupBy("_i").agg(F.sum("_n")).collect():
        sizes[i] = n
    return sizes, seen, expected, var


def rank_test(
    df: DataFrame,
    time: str,
    event: str,
    group: str,
    levels: Sequence | None = None,
    rho: float = 0.0,
    small_rows: int | None = None,
    weight: str | None = None,
) -> RankTest:
    """Test of equal curves; the weight is the pooled survival just before each time to the power ``rho``.

    rho=0 is the log-rank test, rho=1 the Wilcoxon-type test. k + k(k+1)/2 sums come to the driver. A level of
    ``levels`` without rows has zeros; rows of other levels are left out.
    """
    if levels is None:
        found = df.where(F.col(group).isNotNull()).select(group).distinct().limit(MAX_GROUPS + 1).collect()
        levels = sorted(r[0] for r in found)
    k = len(levels)
    if k > MAX_GROUPS or k < 2:
        raise ValueError(f"needs 2 to {MAX_GROUPS} groups")
    sums = _wide_sums if k <= WIDE_GROUPS else _long_sums
    sizes, seen, expected, var = sums(df, time, event, group, levels, rho, small_rows, weight)
    used = [i for i in range(k) if expected[i] > 0]
    free = used[1:]
    gap = (seen - expected)[free]
    stat = float(gap @ solve(var[np.ix_(free, free)], gap)) if free else 0.0
    return RankTest(group, list(levels), sizes, seen, expected, var, stat, len(free), chi_square_upper(stat, len(free)) if free else 1.0)
