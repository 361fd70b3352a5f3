"""Cox regression with Efron's treatment of tied times, its tests and its residuals.

Rows that agree in design row and time are grouped once and stored by range of times. Each pass reads them twice in
place: for the totals of the ranges, which carry the later times' risk-set sums into each range, and for one row per
distinct time, whose sums are accumulated from the latest time backwards and reduced to one row. Neither shuffles.

Efron's correction needs, for d tied events, sums over l = 0..d-1 of functions of S - (l/d) E. Since
S1 - uE1 = (S1 - m S) + m (S - uE) with m = E1/E, every vector and matrix in them reduces to three numbers per
time: H0 = sum log(S - uE), H1 = sum 1/(S - uE), H2 = sum 1/(S - uE)^2, u = l/d. Those have closed forms for
large d, so a minute with a billion goals costs the same as a minute with two.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.tails import Z95, chi_square_upper, normal_two_sided
from touchline.operators.describe import rows_of
from touchline.operators.joins import keyed_join
from touchline.operators.logit import NestedTest
from touchline.operators.newton import Point, climb_all, solve, symmetric, triangle
from touchline.operators.ordered import BUCKET, Order, Step
from touchline.operators.staging import stage, stage_by
from touchline.operators.terms import Term, cell_table, design, linear_sql, number, present, x, x_sql

DIRECT_TERMS = 24
#: Cells that one task can hold: without ranges of times they are read together.
FEW_CELLS = 100_000


@dataclass
class CoxFit:
    terms: tuple[Term, ...]
    labels: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    loglik_null: float
    score_null: np.ndarray
    info_null: np.ndarray
    means: np.ndarray
    n: int
    events: int
    n_dropped: int
    passes: int
    converged: bool
    cells: DataFrame = field(repr=False)
    order: Order = field(repr=False)

    @property
    def rank(self) -> int:
        """Coefficients that were estimated; a column that repeats earlier ones has NaN instead."""
        return int(np.isfinite(self.coef).sum())

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def coef_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for label, b, s in zip(self.labels, self.coef, self.std_error):
            rows.append(
                (label, float(b), float(s), float(b / s), normal_two_sided(b / s))
                + tuple(math.exp(b + k * s) for k in (0, -Z95, Z95))
                + (bool(np.isnan(b)), self.converged)
            )
        return spark.createDataFrame(
            rows,
            "term string, estimate double, std_error double, z double, p double, "
            "hazard_ratio double, hr_lower double, hr_upper double, dropped boolean, converged boolean",
        )

    def tests(self) -> dict[str, NestedTest]:
        """Likelihood-ratio, Wald and score test of all coefficients being zero."""
        own = np.flatnonzero(np.isfinite(self.coef))
        df, b, u = len(own), self.coef[own], self.score_null[own]
        stats = {
            "likelihood_ratio": 2 * (self.loglik - self.loglik_null),
            "wald": float(b @ solve(self.cov[np.ix_(own, own)], b)),
            "score": float(u @ solve(self.info_null[np.ix_(own, own)], u)),
        }
        return {k: NestedTest(v, df, chi_square_upper(v, df)) for k, v in stats.items()}

    def tests_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(k, float(t.chi_square), t.df, t.p) for k, t in self.tests().items()], "test string, chi_square double, df int, p double"
        )

    @cached_property
    def at_fit(self) -> DataFrame:
        """Time table at the fitted coefficients with g = 1 - pooled survival just before the time, stored once for the
        test and the residuals. A column that repeats earlier ones adds nothing to the risk."""
        own = "CASE WHEN n > d THEN log1p(-d / n) END"
        logs = _time_table(self.cells, self.labels, self.means, np.nan_to_num(self.coef), self.order, Step({"_log": own}))
        return stage(logs.selectExpr("*", f"1D - exp(coalesce(_log, 0D) - coalesce({own}, 0D)) AS g"))

    def risk_score(self) -> Column:
        """Linear predictor, centred at the covariate means, over rows with the model's columns."""
        total = F.lit(0.0)
        for b, m, (_, c) in zip(np.nan_to_num(self.coef), self.means, design(self.terms)):
            total = total + F.lit(float(b)) * (c - F.lit(float(m)))
        return total


def _tie_sums() -> dict[str, str]:
    """SQL for H0, H1, H2 of one time with d tied events, risk sum s and event sum e.

    The last DIRECT_TERMS values, near the small end of s - (l/d)e, are added one by one. The rest is an
    integral with end-point corrections (Euler-Maclaurin), exact to rounding at that distance from zero: with
    the step h = e/d, _a = s/h and _b = s/h - k are its two ends in units of the step, k the number of terms.
    """
    tail = f"sequence(greatest(_d - {DIRECT_TERMS}, 0), _d - 1)"

    def direct(value: str) -> str:
        return f"aggregate({tail}, 0D, (t, l) -> t + {value})"

    def ends(f: str) -> str:
        return f"({f.replace('v', '_a')} - {f.replace('v', '_b')})"

    def inverse(power: int) -> str:
        return ends("1D / (" + " * ".join(["v"] * power) + ")")

    log_part = (
        f"(_d - {DIRECT_TERMS}) * ln(_h) + {ends('v * ln(v)')} - {ends('v')} + {ends('ln(v)')} / 2 + {inverse(1)} / 12"
        f" - {inverse(3)} / 360 + {inverse(5)} / 1260"
    )
    inv_part = f"{ends('ln(v)')} + {inverse(1)} / 2 - {inverse(2)} / 12 + {inverse(4)} / 120 - {inverse(6)} / 252"
    sq_part = f"-{inverse(1)} + {inverse(2)} / 2 - {inverse(3)} / 6 + {inverse(5)} / 30 - {inverse(7)} / 42"
    long = f"CASE WHEN _d > {DIRECT_TERMS} THEN {{}} ELSE 0D END"
    return {
        "h0": long.format(log_part) + " + " + direct("ln(s - l * _h)"),
        "h1": long.format(f"({inv_part}) / _h") + " + " + direct("1D / (s - l * _h)"),
        "h2": long.format(f"({sq_part}) / (_h * _h)") + " + " + direct("1D / ((s - l * _h) * (s - l * _h))"),
    }


def _time_table(cells: DataFrame, labels: Sequence[str], means: np.ndarray, b: np.ndarray, order: Order, *steps: Step) -> DataFrame:
    """One row per event time: risk-set sums s, s_j, s_j_k (time at or after), event sums e, e_j, e_j_k, plain
    event sums c_j and l, event count d, and the Efron numbers h0, h1, h2. ``steps`` go along all times after that."""
    p = len(labels)
    groups = ["time"] if order.cuts is None else [BUCKET, "time"]
    named = cells.selectExpr(
        *groups, "n", "d", *[f"{x_sql(c)} - {number(m)} AS x{j}" for j, (c, m) in enumerate(zip(labels, means))]
    )
    eta = linear_sql(b, [f"x{j}" for j in range(p)])
    weighed = named.selectExpr("*", f"{eta} AS _eta").selectExpr("*", "n * exp(_eta) AS _nr", "d * exp(_eta) AS _dr")
    sums = {"_s": "_nr", "e": "_dr", "d": "d", "_n": "n", "l": "d * _eta"}
    for j in range(p):
        sums |= {f"_s_{j}": f"_nr * x{j}", f"e_{j}": f"_dr * x{j}", f"c_{j}": f"d * x{j}"}
    for j, k in triangle(p):
        sums |= {f"_s_{j}_{k}": f"_nr * x{j} * x{k}", f"e_{j}_{k}": f"_dr * x{j} * x{k}"}
    per_time = weighed.groupBy(*groups).agg(*[F.expr(f"sum({e}) AS {n}") for n, e in sums.items()])
    risk = {"s": "_s", "n": "_n"} | {f"s_{j}": f"_s_{j}" for j in range(p)} | {f"s_{j}_{k}": f"_s_{j}_{k}" for j, k in triangle(p)}
    summed = order.scan(per_time, Step(risk, descending=True), *steps)
    stepped = summed.where("d > 0").selectExpr("*", "bigint(d) AS _d", "e / d AS _h", "s * d / e AS _a")
    ended = stepped.selectExpr("*", f"_a - (_d - {DIRECT_TERMS}) AS _b")
    return ended.selectExpr("*", *[f"{e} AS {n}" for n, e in _tie_sums().items()])


def _mean_sum(j: int) -> str:
    """Sum over the tied events of the mean of covariate j in the (reduced) risk set."""
    return f"(e_{j} / e * d + (s_{j} - e_{j} / e * s) * h1)"


def _spread_sum(j: int, k: int) -> str:
    """Sum over the tied events of the covariance of covariates j and k in the (reduced) risk set."""
    mj, mk, mjk = f"(e_{j} / e)", f"(e_{k} / e)", f"(e_{j}_{k} / e)"
    cj, ck = f"(s_{j} - {mj} * s)", f"(s_{k} - {mk} * s)"
    second = f"{mjk} * d + (s_{j}_{k} - {mjk} * s) * h1"
    return f"({second} - ({mj} * {mk} * d + ({mj} * {ck} + {mk} * {cj}) * h1 + {cj} * {ck} * h2))"


def _evaluate(cells: DataFrame, labels: Sequence[str], means: np.ndarray, b: np.ndarray, order: Order) -> Point:
    p = len(labels)
    table = _time_table(cells, labels, means, b, order)
    row = table.selectExpr(
        "sum(l - h0) AS l",
        *[f"sum(c_{j} - {_mean_sum(j)}) AS u{j}" for j in range(p)],
        *[f"sum({_spread_sum(j, k)}) AS i{j}_{k}" for j, k in triangle(p)],
    ).first()
    return Point(
        float(row["l"]),
        np.array([row[f"u{j}"] for j in range(p)], dtype=float),
        symmetric([row[f"i{j}_{k}"] for j, k in triangle(p)], p),
    )


def fit_coxes(
    df: DataFrame,
    time: str,
    event: str,
    models: Mapping[str, Sequence[Term]],
    small_rows: int | None = None,
    weight: str | None = None,
) -> dict[str, CoxFit]:
    """Fit several Cox models on one grouped table. Each model uses the rows complete in its own columns."""
    names = list(models)
    known = df.where(present(F.col(time)) & present(F.col(event)))
    n = rows_of(weight)
    sums = [("n", n), ("d", F.col(event).cast("int") * n)]
    cells = stage(cell_table(known, list(models.values()), [("time", F.col(time).cast("double"))], sums))
    order = Order.of(cells.select("time").distinct(), "time", small_rows=small_rows)
    if order.cuts is not None:
        cells = stage_by(order.assign(cells), BUCKET, len(order.cuts) + 1)
    elif cells.count() <= FEW_CELLS:
        cells = cells.coalesce(1)
    labels = [[label for label, _ in design(models[m])] for m in names]
    if any(not cols for cols in labels):
        raise ValueError("a Cox model needs at least one term")
    complete = []
    for cols in labels:
        use = F.lit(True)
        for c in cols:
            use = use & x(c).isNotNull()
        complete.append(use)
    counted = []
    for i, use in enumerate(complete):
        counted += [F.sum(F.when(use, F.col("n"))).alias(f"n{i}"), F.sum(F.when(use, F.col("d"))).alias(f"d{i}")]
        counted += [
            (F.sum(F.when(use, F.col("n") * x(c))) / F.sum(F.when(use, F.col("n")))).alias(f"m{i}_{j}") for j, c in enumerate(labels[i])
        ]
    counts = cells.agg(F.sum("n").alias("all"), *counted).first()
    for i, m in enumerate(names):
        if not counts[f"d{i}"]:
            raise ValueError(f"model {m!r} has no event")
    means = [np.array([counts[f"m{i}_{j}"] for j in range(len(labels[i]))]) for i in range(len(names))]
    usable = [cells.where(use) for use in complete]

    def evaluate(asked):
        return [_evaluate(usable[i], labels[i], means[i], b, order) for i, b in asked]

    fits = {}
    for i, run in enumerate(climb_all(evaluate, [np.zeros(len(c)) for c in labels])):
        n = int(counts[f"n{i}"])
        fits[names[i]] = CoxFit(
            tuple(models[names[i]]), labels[i], run.estimates(), run.covariance(), run.best.loglik, run.first.loglik,
            run.first.score, run.first.info, means[i], n, int(counts[f"d{i}"]), int(counts["all"]) - n, run.passes,
            run.converged, usable[i], order,
        )
    return fits


def fit_cox(
    df: DataFrame, time: str, event: str, terms: Sequence[Term], small_rows: int | None = None, weight: str | None = None
) -> CoxFit:
    return fit_coxes(df, time, event, {"model": terms}, small_rows, weight)["model"]


def nested_cox_test(small: CoxFit, large: CoxFit) -> NestedTest:
    if small.n != large.n:
        raise ValueError("the two fits use different rows")
    stat, df = 2 * (large.loglik - small.loglik), large.rank - small.rank
    return NestedTest(stat, df, chi_square_upper(stat, df))


@dataclass
class ProportionalTest:
    labels: list[str]
    tests: dict[str, NestedTest]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(k, float(t.chi_square), t.df, t.p) for k, t in self.tests.items()], "term string, chi_square double, df int, p double"
        )


def _whole_model(fit: CoxFit, allow_dropped: bool) -> None:
    if fit.rank < len(fit.coef) and not allow_dropped:
        raise ValueError("a column repeats earlier ones: drop its term first")


def proportional_hazards_test(fit: CoxFit, allow_dropped: bool = False) -> ProportionalTest:
    """Score test of a coefficient that changes with g(time), for each term and for all together.

    With ``allow_dropped`` columns that repeat earlier ones are not tested, and a term without any other has NaN on no
    degrees of freedom; else they are an error.
    """
    _whole_model(fit, allow_dropped)
    p, kept = len(fit.labels), np.flatnonzero(np.isfinite(fit.coef))
    table = fit.at_fit
    centre = table.selectExpr("sum(g * d) / sum(d)").first()[0]
    table = table.selectExpr("*", f"g - {number(centre)} AS _c")
    sums = [f"sum(_c * (c_{j} - {_mean_sum(j)})) AS u{j}" for j in range(p)]
    for j, k in triangle(p):
        v = _spread_sum(j, k)
        sums += [f"sum({v}) AS a{j}_{k}", f"sum(_c * {v}) AS b{j}_{k}", f"sum(_c * _c * {v}) AS c{j}_{k}"]
    row = table.selectExpr(*sums).first()
    u = np.array([row[f"u{j}"] for j in range(p)], dtype=float)
    xx, xg, gg = (symmetric([row[f"{m}{j}_{k}"] for j, k in triangle(p)], p) for m in "abc")

    def test(own: list[int]) -> NestedTest:
        if not own:
            return NestedTest(math.nan, 0, math.nan)
        reduced = gg[np.ix_(own, own)] - xg[np.ix_(own, kept)] @ solve(xx[np.ix_(kept, kept)], xg[np.ix_(kept, own)])
        stat = float(u[own] @ solve(reduced, u[own]))
        return NestedTest(stat, len(own), chi_square_upper(stat, len(own)))

    tests, start = {}, 0
    for term in fit.terms:
        width = len(design([term]))
        own = list(range(start, start + width))
        name = fit.labels[start] if width == 1 else getattr(term, "name", ":".join(fit.labels[i] for i in own))
        tests[name] = test([j for j in own if j in kept])
        start += width
    tests["GLOBAL"] = test(kept.tolist())
    return ProportionalTest(fit.labels, tests)


def schoenfeld_residuals(fit: CoxFit, allow_dropped: bool = False) -> DataFrame:
    """Per group of equal events (same time and covariates; ``rows`` of them): transformed time, residual per
    coefficient, scaled residual, and scaled residual plus coefficient (the time-varying coefficient drawn
    against g). With ``allow_dropped`` a column that repeats earlier ones has plain residuals and NaN as the others;
    else it is an error."""
    _whole_model(fit, allow_dropped)
    p = len(fit.labels)
    table = fit.at_fit.selectExpr("time", "g", *[f"{_mean_sum(j)} / d AS _m{j}" for j in range(p)])
    events = fit.cells.where("d > 0").select(
        "time", F.col("d").cast("bigint").alias("rows"), *[(x(c) - F.lit(float(m))).alias(f"_x{j}") for j, (c, m) in enumerate(zip(fit.labels, fit.means))]
    )
    both = keyed_join(events, table, ["time"], "inner")
    raw = both.select("time", "g", "rows", *[(F.col(f"_x{j}") - F.col(f"_m{j}")).alias(f"residual_{c}") for j, c in enumerate(fit.labels)])
    scale, kept = fit.cov * fit.events, np.flatnonzero(np.isfinite(fit.coef))
    scaled = []
    for j, c in enumerate(fit.labels):
        value = F.lit(0.0) if j in kept else F.lit(math.nan)
        for k in kept:
            value = value + F.lit(float(scale[j, k])) * F.col(f"`residual_{fit.labels[k]}`")
        scaled += [value.alias(f"scaled_{c}"), (value + F.lit(float(fit.coef[j]))).alias(f"beta_{c}")]
    return raw.select("*", *scaled)
