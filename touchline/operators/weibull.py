"""Weibull regression of a right-censored time on the log-time scale."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.tails import Z95, chi_square_upper, normal_two_sided
from touchline.operators.describe import rows_of
from touchline.operators.logit import INTERCEPT, NestedTest
from touchline.operators.newton import Point, batches, climb_all, symmetric, triangle
from touchline.operators.staging import staged
from touchline.operators.terms import Term, back_transform, cell_table, design, linear_sql, number, present, read_scales, scale_sums, standardised, transformed, x, x_sql

LOG_SCALE = "Log(scale)"


@dataclass
class WeibullFit:
    """Coefficients on log time (intercept first, log scale last) and their covariance."""

    terms: tuple[Term, ...]
    labels: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    loglik_null: float
    n: int
    events: int
    n_dropped: int
    passes: int
    converged: bool

    @property
    def scale(self) -> float:
        return math.exp(self.coef[-1])

    @property
    def rank(self) -> int:
        """Parameters that were estimated; a column that repeats earlier ones has NaN instead."""
        return int(np.isfinite(self.coef).sum())

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def model_test(self) -> NestedTest:
        """Likelihood-ratio test against the model without covariates."""
        stat, df = 2 * (self.loglik - self.loglik_null), self.rank - 2
        return NestedTest(stat, df, chi_square_upper(stat, df) if df else math.nan)

    def coef_table(self, spark: SparkSession) -> DataFrame:
        """One row per parameter; ``dropped`` marks a column that repeats earlier ones and was left out."""
        rows = [
            (label, float(b), float(s), float(b / s), normal_two_sided(b / s), bool(np.isnan(b)), self.converged)
            for label, b, s in zip(self.labels, self.coef, self.std_error)
        ]
        return spark.createDataFrame(
            rows, "term string, estimate double, std_error double, z double, p double, dropped boolean, converged boolean"
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        t = self.model_test
        return spark.createDataFrame(
            [(self.n, self.events, self.n_dropped, self.scale, self.loglik, self.loglik_null, t.chi_square, t.df, t.p, self.passes, self.converged)],
            "n bigint, events bigint, n_dropped bigint, scale double, loglik double, loglik_null double, "
            "chi_square double, df int, p double, passes int, converged boolean",
        )

    def ratios(self, spark: SparkSession) -> DataFrame:
        """lambda and gamma of the hazard form, then hazard and event-time ratio per slope, with 95% limits.

        Errors of lambda, gamma and the hazard slopes come by the delta method from the covariance of the
        coefficients and the log scale.
        """
        s, p = self.scale, len(self.coef)
        rows = []

        def transformed(value: float, grad: Mapping[int, float]) -> tuple[float, float]:
            own = list(grad)
            g = np.array([grad[i] for i in own])
            return value, math.sqrt(g @ self.cov[np.ix_(own, own)] @ g)

        mu = self.coef[0]
        lam = math.exp(-mu / s)
        rows.append(("lambda", *transformed(lam, {0: -lam / s, p - 1: lam * mu / s}), None, None, None, None, None, None))
        rows.append(("gamma", *transformed(1 / s, {p - 1: -1 / s}), None, None, None, None, None, None))
        for j in range(1, p - 1):
            b, own = self.coef[j], self.std_error[j]
            slope, err = transformed(-b / s, {j: -1 / s, p - 1: b / s})
            rows.append(
                (self.labels[j], slope, err)
                + tuple(math.exp(slope + k * err) for k in (0, -Z95, Z95))
                + tuple(math.exp(b + k * own) for k in (0, -Z95, Z95))
            )
        rows = [tuple(r[:1]) + tuple(None if v is None else float(v) for v in r[1:]) for r in rows]
        return spark.createDataFrame(
            rows,
            "term string, estimate double, std_error double, hazard_ratio double, hr_lower double, hr_upper double, "
            "time_ratio double, tr_lower double, tr_upper double",
        )


def _evaluate(cells: DataFrame, asked: Sequence[tuple[list[str], np.ndarray]]) -> list[Point]:
    """In g = 1/scale and theta = coefficient/scale, z = g log t - x'theta is linear and the log-likelihood
    sum d (z + log g - log t) - n e^z is concave, so Newton steps from any start are safe.

    Parameter order: theta (intercept first), g.
    """
    out: list[Point | None] = [None] * len(asked)
    sizes = [3 + len(b) + len(triangle(len(b))) for _, b in asked]
    for group in batches(sizes):
        if any(asked[i][1][-1] <= 0 for i in group):
            # outside the parameter space: the loop halves the step
            for i in group:
                p = len(asked[i][1])
                if asked[i][1][-1] <= 0:
                    out[i] = Point(-math.inf, np.zeros(p), np.eye(p))
            group = [i for i in group if out[i] is None]
            if not group:
                continue
        columns = {i: ["1D", *[x_sql(c) for c in asked[i][0]]] for i in group}
        timed = cells.selectExpr("*", "ln(time) AS _lt")
        with_z = timed.selectExpr(
            "*", *[f"{number(asked[i][1][-1])} * _lt - ({linear_sql(asked[i][1][:-1], columns[i])}) AS _z{i}" for i in group]
        )
        with_a = with_z.selectExpr("*", *[f"n * exp(_z{i}) AS _a{i}" for i in group])
        sums = []
        for i in group:
            dirs = [*[f"(-{c})" for c in columns[i]], "_lt"]
            sums.append(f"sum(d * (_z{i} + {number(math.log(asked[i][1][-1]))} - _lt) - _a{i}) AS l{i}")
            sums.append(f"sum(CASE WHEN _z{i} IS NOT NULL THEN d END) AS d{i}")
            sums += [f"sum((d - _a{i}) * {c}) AS u{i}_{j}" for j, c in enumerate(dirs)]
            sums += [f"sum(_a{i} * {dirs[j]} * {dirs[k]}) AS i{i}_{j}_{k}" for j, k in triangle(len(dirs))]
        row = with_a.selectExpr(*sums).first()
        for i in group:
            g, p, d = asked[i][1][-1], len(asked[i][1]), row[f"d{i}"]
            score = np.array([row[f"u{i}_{j}"] for j in range(p)], dtype=float)
            info = symmetric([row[f"i{i}_{j}_{k}"] for j, k in triangle(p)], p)
            score[-1] += d / g
            info[-1, -1] += d / g**2
            out[i] = Point(row[f"l{i}"], score, info)
    return out


def fit_weibulls(
    df: DataFrame, time: str, event: str, models: Mapping[str, Sequence[Term]], weight: str | None = None
) -> dict[str, WeibullFit]:
    """Fit several Weibull models in shared passes. Times must be above zero.

    Rows are grouped by design row and time first. The model without covariates is fitted along, on the rows
    of each model, for the overall test.
    """
    names = list(models)
    known = df.where(present(F.col(time)) & present(F.col(event)))
    n = rows_of(weight)
    sums = [("n", n), ("d", F.col(event).cast("int") * n)]
    grouped = cell_table(known, list(models.values()), [("time", F.col(time).cast("double"))], sums)
    with staged(grouped) as cells:
        labels = [[label for label, _ in design(models[m])] for m in names]
        every = list(dict.fromkeys(c for cols in labels for c in cols))
        counted = []
        for i, cols in enumerate(labels):
            use = F.lit(True)
            for c in cols:
                use = use & x(c).isNotNull()
            counted += [
                F.sum(F.when(use, F.col("n"))).alias(f"n{i}"),
                F.sum(F.when(use, F.col("d"))).alias(f"d{i}"),
                F.sum(F.when(use, F.col("n") * F.col("time"))).alias(f"t{i}"),
            ]
        counts = cells.agg(
            F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("time") <= 0, F.col("n"))), F.lit(0.0)).alias("bad"), *counted, *scale_sums(every)
        ).first()
        if counts["bad"]:
            raise ValueError(f"{int(counts['bad'])} rows with a time at or below zero")
        for i, m in enumerate(names):
            if not counts[f"d{i}"]:
                raise ValueError(f"model {m!r} has no event")

        # a null in a model's columns must also leave its null model: keep its columns in the complete-row test
        nulls = {}
        for i, cols in enumerate(labels):
            key = tuple(sorted(c for c in cols))
            nulls.setdefault(key, i)
        jobs = [(labels[i], None) for i in range(len(names))] + [([], key) for key in nulls]
        flags = {}
        scales = read_scales(counts, every)
        table = standardised(cells, scales)
        for key in nulls:
            use = F.lit(True)
            for c in key:
                use = use & x(c).isNotNull()
            flags[key] = f"complete{len(flags)}"
            table = table.withColumn("x_" + flags[key], F.when(use, F.lit(0.0)))

        def evaluate(asked):
            # the null model gets a column that is 0 on complete rows and null elsewhere, at coefficient 0
            wanted = []
            for i, b in asked:
                cols, key = jobs[i]
                wanted.append((cols, b) if key is None else ([flags[key]], np.array([b[0], 0.0, b[1]])))
            points = _evaluate(table, wanted)
            for k, (i, b) in enumerate(asked):
                if jobs[i][1] is not None:
                    pt, keep = points[k], [0, 2]
                    points[k] = Point(pt.loglik, pt.score[keep], pt.info[np.ix_(keep, keep)])
            return points

        starts = []
        for cols, key in jobs:
            i = nulls[key] if key is not None else next(q for q in range(len(names)) if labels[q] is cols)
            level = math.log(counts[f"t{i}"] / counts[f"d{i}"])
            starts.append(np.array([level, *[0.0] * len(cols), 1.0]))
        runs = climb_all(evaluate, starts)
    null_loglik = {key: runs[len(names) + k].best.loglik for k, key in enumerate(nulls)}
    fits = {}
    for i, m in enumerate(names):
        wide = np.eye(len(labels[i]) + 2)
        wide[:-1, :-1] = back_transform(labels[i], scales)
        found, spread = transformed(wide, runs[i].estimates(), runs[i].covariance())
        theta, g = found[:-1], found[-1]
        p = len(theta) + 1
        # coefficient = theta / g, log scale = -log g
        jac = np.zeros((p, p))
        jac[:-1, :-1] = np.eye(p - 1) / g
        jac[:-1, -1] = -np.nan_to_num(theta) / g**2
        jac[-1, -1] = -1 / g
        covariance = jac @ np.nan_to_num(spread) @ jac.T
        repeated = ~np.isfinite(found)
        covariance[repeated, :] = covariance[:, repeated] = np.nan
        n = int(counts[f"n{i}"])
        fits[m] = WeibullFit(
            tuple(models[m]),
            [INTERCEPT, *labels[i], LOG_SCALE],
            np.array([*(theta / g), -math.log(g)]),
            covariance,
            runs[i].best.loglik,
            null_loglik[tuple(sorted(labels[i]))],
            n,
            int(counts[f"d{i}"]),
            int(counts["all"]) - n,
            runs[i].passes,
            runs[i].converged,
        )
    return fits


def fit_weibull(df: DataFrame, time: str, event: str, terms: Sequence[Term], weight: str | None = None) -> WeibullFit:
    return fit_weibulls(df, time, event, {"model": terms}, weight)["model"]


def nested_weibull_test(small: WeibullFit, large: WeibullFit) -> NestedTest:
    if small.n != large.n:
        raise ValueError("the two fits use different rows")
    stat, df = 2 * (large.loglik - small.loglik), large.rank - small.rank
    return NestedTest(stat, df, chi_square_upper(stat, df))
