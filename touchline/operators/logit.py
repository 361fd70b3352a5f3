"""Logistic model of a binary outcome: fit, compare, intervals, scores, residuals, checks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.columns import if_else
from touchline.functions.tails import CHI2_95_1DF, chi_square_upper, normal_two_sided
from touchline.operators.describe import rows_of
from touchline.operators.newton import Point, batches, climb_all, solve, symmetric, triangle
from touchline.operators.ordered import equal_count_cuts, quantiles, with_bins
from touchline.operators.staging import stage, staged
from touchline.operators.terms import MAX_COEFFICIENTS, MAX_WIDE, Scale, Term, back_transform, cell_table, design, linear_sql, present, read_scales, scale_sums, slot, standardised, transformed, x, x_sql

INTERCEPT = "(Intercept)"


@dataclass
class LogitFit:
    terms: tuple[Term, ...]
    labels: list[str]
    coef: np.ndarray
    cov: np.ndarray
    loglik: float
    n: int
    wins: int
    n_dropped: int
    passes: int
    converged: bool
    scales: Mapping[str, Scale] = field(default_factory=dict, repr=False)

    @property
    def deviance(self) -> float:
        return -2.0 * self.loglik

    @property
    def null_deviance(self) -> float:
        rate = self.wins / self.n
        parts = [k * math.log(q) for k, q in ((self.wins, rate), (self.n - self.wins, 1 - rate)) if k]
        return -2.0 * sum(parts)

    @property
    def rank(self) -> int:
        """Coefficients that were estimated; a column that repeats earlier ones has NaN instead."""
        return int(np.isfinite(self.coef).sum())

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.rank

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def p_values(self) -> list[float]:
        return [normal_two_sided(z) for z in self.coef / self.std_error]

    def coef_table(self, spark: SparkSession) -> DataFrame:
        """One row per coefficient; ``dropped`` marks a column that repeats earlier ones and was left out."""
        rows = [
            (label, float(b), float(s), float(b / s), p, math.exp(b), bool(np.isnan(b)), self.converged)
            for label, b, s, p in zip(self.labels, self.coef, self.std_error, self.p_values)
        ]
        return spark.createDataFrame(
            rows,
            "term string, estimate double, std_error double, z double, p double, odds_ratio double, dropped boolean, converged boolean",
        )

    def summary(self, spark: SparkSession) -> DataFrame:
        row = (self.n, self.n_dropped, self.null_deviance, self.n - 1, self.deviance, self.df_residual, self.aic, self.passes, self.converged)
        return spark.createDataFrame(
            [row],
            "n bigint, n_dropped bigint, null_deviance double, null_df bigint, deviance double, residual_df bigint, aic double, "
            "passes int, converged boolean",
        )

    def linear(self) -> Column:
        """Linear predictor as a column expression over rows that carry the model's columns."""
        return linear_predictor(np.nan_to_num(self.coef), [F.lit(1.0), *[c for _, c in design(self.terms, MAX_WIDE)]])

    def score(self) -> Column:
        """Win probability; null when a used column is null or off its level list."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.linear()))


def fixed_logit(terms: Sequence[Term], coef: Sequence[float], cov: np.ndarray | None = None) -> LogitFit:
    """A model with given coefficients, for scoring (published coefficients, a model fitted elsewhere)."""
    p = len(coef)
    labels = [INTERCEPT, *[label for label, _ in design(terms, MAX_WIDE)]]
    if len(labels) != p:
        raise ValueError(f"{p} coefficients for {labels}")
    cov = np.full((p, p), np.nan) if cov is None else cov
    return LogitFit(tuple(terms), labels, np.array(coef, float), cov, math.nan, 0, 0, 0, 0, True)


def linear_predictor(coef: Sequence[float], columns: Sequence[Column]) -> Column:
    total = F.lit(float(coef[0])) * columns[0]
    for b, c in zip(coef[1:], columns[1:]):
        total = total + F.lit(float(b)) * c
    return total


def _block_sums(b: np.ndarray):
    """Per task: likelihood, score and upper triangle of the information of its cells, as rows (spot, value)."""
    low, high = np.triu_indices(len(b))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loglik, score, info = 0.0, np.zeros(len(b)), np.zeros((len(b), len(b)))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), np.vstack(batch["x"].to_list())])
                n, wins = batch["n"].to_numpy(), batch["wins"].to_numpy()
                eta = x @ b
                mu = np.exp(-np.logaddexp(0, -eta))
                loglik += float(wins @ eta - n @ np.logaddexp(0, eta))
                score += x.T @ (wins - n * mu)
                info += (x * (n * mu * (1 - mu))[:, None]).T @ x
        values = np.concatenate([[loglik], score, info[low, high]])
        yield pd.DataFrame({"spot": np.arange(len(values)), "value": values})

    return work


def _evaluate_wide(cells: DataFrame, labels: Sequence[str], b: np.ndarray) -> Point:
    """One coefficient vector of many entries: tasks add up matrices, which are summed entry by entry."""
    p = len(b)
    known = cells.select("n", "wins", F.array(*[x(c) for c in labels]).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    sums = known.mapInPandas(_block_sums(b), "spot int, value double").groupBy("spot").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + p + len(triangle(p)))
    for spot, value in sums.collect():
        values[spot] = value
    return Point(float(values[0]), values[1 : 1 + p], symmetric(values[1 + p :], p))


def _evaluate(cells: DataFrame, asked: Sequence[tuple[list[str], np.ndarray]]) -> list[Point]:
    """Likelihood, score and information of several coefficient vectors, as few passes over the cells as fit.

    A cell with a null in a model's columns gives null terms there, which the sums skip.
    """
    wide = [len(b) > MAX_COEFFICIENTS + 1 for _, b in asked]
    out: list[Point | None] = [_evaluate_wide(cells, names, b) if w else None for w, (names, b) in zip(wide, asked)]
    narrow = [i for i, w in enumerate(wide) if not w]
    sizes = [1 + len(b) + len(triangle(len(b))) for b in (asked[i][1] for i in narrow)]
    for group in ([narrow[i] for i in found] for found in batches(sizes)):
        columns = {i: ["1D", *[x_sql(c) for c in asked[i][0]]] for i in group}
        with_eta = cells.selectExpr("*", *[f"{linear_sql(asked[i][1], columns[i])} AS _eta{i}" for i in group])
        with_mu = with_eta.selectExpr("*", *[f"1D / (1D + exp(-_eta{i})) AS _mu{i}" for i in group])
        with_gap = with_mu.selectExpr(
            "*", *[f"wins - n * _mu{i} AS _g{i}" for i in group], *[f"n * _mu{i} * (1D - _mu{i}) AS _w{i}" for i in group]
        )
        sums = []
        for i in group:
            softplus = f"(greatest(_eta{i}, 0D) + log1p(exp(-abs(_eta{i}))))"
            sums.append(f"sum(wins * _eta{i} - n * {softplus}) AS l{i}")
            sums += [f"sum(_g{i} * {c}) AS u{i}_{j}" for j, c in enumerate(columns[i])]
            sums += [f"sum(_w{i} * {columns[i][j]} * {columns[i][k]}) AS i{i}_{j}_{k}" for j, k in triangle(len(columns[i]))]
        row = with_gap.selectExpr(*sums).first()
        for i in group:
            p = len(asked[i][1])
            nan = lambda v: math.nan if v is None else v
            out[i] = Point(
                nan(row[f"l{i}"]),
                np.array([nan(row[f"u{i}_{j}"]) for j in range(p)]),
                symmetric([nan(row[f"i{i}_{j}_{k}"]) for j, k in triangle(p)], p),
            )
    return out


def _outcome_cells(df: DataFrame, win: Column, models: Sequence[Sequence[Term]], weight: str | None) -> DataFrame:
    n = rows_of(weight)
    flag = if_else(win, n, F.lit(0))
    known = df.where(flag.isNotNull())
    return cell_table(known, models, [], [("n", n), ("wins", flag)])


def fit_logits(
    df: DataFrame, win: Column, models: Mapping[str, Sequence[Term]], same_rows: bool = False, weight: str | None = None
) -> dict[str, LogitFit]:
    """Fit every candidate model; one pass over the compact cell table serves all of them per Newton step.

    ``win`` is the condition for success. Each model uses the rows that are complete in its own columns, or,
    with ``same_rows``, those complete in the columns of all; rows with an unknown outcome are in none.
    ``weight`` names the count column of a grouped frame.
    """
    with staged(_outcome_cells(df, win, list(models.values()), weight)) as cells:
        if not same_rows:
            return _fit_cells(cells, models)
        fits = _fit_cells(cells.dropna(), models)
        total = int(cells.agg(F.sum("n")).first()[0])
        for fit in fits.values():
            fit.n_dropped = total - fit.n
        return fits


def _fit_cells(cells: DataFrame, models: Mapping[str, Sequence[Term]]) -> dict[str, LogitFit]:
    names = list(models)
    labels = [[label for label, _ in design(models[m], MAX_WIDE)] for m in names]
    counted = []
    for i, cols in enumerate(labels):
        complete = F.lit(True)
        for c in cols:
            complete = complete & x(c).isNotNull()
        counted += [F.sum(F.when(complete, F.col("n"))).alias(f"n{i}"), F.sum(F.when(complete, F.col("wins"))).alias(f"w{i}")]
    every = list(dict.fromkeys(c for cols in labels for c in cols))
    counts = cells.agg(F.sum("n").alias("all"), *counted, *scale_sums(every)).first()
    for i, m in enumerate(names):
        if not counts[f"n{i}"]:
            raise ValueError(f"model {m!r} has no complete row")
    scales = read_scales(counts, every)
    even = standardised(cells, scales)

    def evaluate(asked):
        return _evaluate(even, [(labels[i], b) for i, b in asked])

    starts = []
    for i in range(len(names)):
        rate = min(max(counts[f"w{i}"] / counts[f"n{i}"], 1e-6), 1 - 1e-6)
        starts.append(np.array([math.log(rate / (1 - rate))] + [0.0] * len(labels[i])))
    fits = {}
    for i, run in enumerate(climb_all(evaluate, starts)):
        n = int(counts[f"n{i}"])
        coef, cov = transformed(back_transform(labels[i], scales), run.estimates(), run.covariance())
        fits[names[i]] = LogitFit(
            tuple(models[names[i]]),
            [INTERCEPT, *labels[i]],
            coef,
            cov,
            run.best.loglik,
            n,
            int(counts[f"w{i}"]),
            int(counts["all"]) - n,
            run.passes,
            run.converged,
            scales,
        )
    return fits


def fit_logit(df: DataFrame, win: Column, terms: Sequence[Term], weight: str | None = None) -> LogitFit:
    return fit_logits(df, win, {"model": terms}, weight=weight)["model"]


def compare_models(fits: Mapping[str, LogitFit], spark: SparkSession, level: float = 0.05) -> DataFrame:
    """Models by AIC, those whose fit did not converge last, with a flag for all slopes significant."""
    rows = [
        (name, f.rank, f.n, f.deviance, f.aic, all(p < level for p in f.p_values[1:]), f.converged)
        for name, f in sorted(fits.items(), key=lambda kv: (not kv[1].converged, kv[1].aic))
    ]
    return spark.createDataFrame(
        rows, "model string, coefficients int, n bigint, deviance double, aic double, all_significant boolean, converged boolean"
    )


@dataclass
class NestedTest:
    chi_square: float
    df: int
    p: float


def nested_test(small: LogitFit, large: LogitFit) -> NestedTest:
    """Likelihood-ratio test of two nested fits on the same rows."""
    if small.n != large.n:
        raise ValueError("the two fits use different rows")
    stat, df = small.deviance - large.deviance, large.rank - small.rank
    return NestedTest(stat, df, chi_square_upper(stat, df))


def choose_forward(
    df: DataFrame,
    win: Column,
    steps: Sequence[Mapping[str, Sequence[Term]]],
    level: float = 0.05,
    weight: str | None = None,
) -> tuple[str, dict[str, LogitFit]]:
    """Walk through rounds of candidates. A candidate replaces the current best when its fit converged, its AIC is
    lower, all its slopes are significant and, where the current best is nested in it, the likelihood-ratio test improves.

    All rounds are fitted together, in shared passes, on the rows complete in every candidate. The start is the
    model without terms, named "null".
    """
    candidates = {"null": []} | {name: terms for step in steps for name, terms in step.items()}
    fits = fit_logits(df, win, candidates, same_rows=True, weight=weight)
    best = "null"
    for step in steps:
        for name in sorted(step, key=lambda m: fits[m].aic):
            fit, held = fits[name], fits[best]
            nested = set(held.labels) < set(fit.labels)
            better = fit.converged and fit.aic < held.aic and all(p < level for p in fit.p_values[1:])
            if better and (not nested or nested_test(held, fit).p < level):
                best = name
                break
    return best, fits


def profile_intervals(
    df: DataFrame, win: Column, terms: Sequence[Term], max_passes: int = 40, weight: str | None = None, allow_dropped: bool = False
) -> tuple[LogitFit, DataFrame]:
    """Profile-likelihood 95% limits of every coefficient, with odds ratios.

    All 2p limits advance together: each solves "log-likelihood has dropped by half the chi-square point and
    the other coefficients are at their best" by Newton steps, and one pass over the cells evaluates them all.
    With ``allow_dropped`` a column that repeats earlier ones has NaN throughout, and the limits are those of the model
    without it on the same rows; else it is an error.
    """
    spark = df.sparkSession
    with staged(_outcome_cells(df, win, [terms], weight)) as cells:
        fit = _fit_cells(cells, {"model": terms})["model"]
        if not fit.converged or (fit.rank < len(fit.coef) and not allow_dropped):
            raise ValueError("no unique finite maximum: profile limits do not exist")
        own = np.flatnonzero(np.isfinite(fit.coef))
        coef, cov = fit.coef[own], fit.cov[np.ix_(own, own)]
        p, labels = len(own), [fit.labels[j] for j in own[1:]]
        used = F.lit(True)
        for c in fit.labels[1:]:
            used = used & x(c).isNotNull()
        # slopes are profiled on centred columns; the intercept needs the columns' own zero, so it keeps it
        zero = {c: Scale(0.0, s.spread) for c, s in fit.scales.items()}
        both = cells.where(used).select(
            "n",
            "wins",
            *[((x(c) - F.lit(fit.scales[c].mean)) / F.lit(fit.scales[c].spread)).alias(slot("mid " + c)) for c in labels],
            *[(x(c) / F.lit(fit.scales[c].spread)).alias(slot("own " + c)) for c in labels],
        )
        maps = {False: back_transform(labels, zero), True: back_transform(labels, fit.scales)}
        names = {False: ["own " + c for c in labels], True: ["mid " + c for c in labels]}
        best = {c: np.linalg.solve(m, coef) for c, m in maps.items()}
        spread = {c: np.linalg.inv(m) @ cov @ np.linalg.inv(m).T for c, m in maps.items()}
        target = fit.loglik - CHI2_95_1DF / 2
        jobs = [(j, side) for j in range(p) for side in (-1.0, 1.0)]
        # start: the normal-theory limit, the other coefficients moved along with it
        at = []
        for j, side in jobs:
            b, v = best[j > 0], spread[j > 0]
            at.append(b + side * math.sqrt(CHI2_95_1DF / v[j, j]) * v[:, j])
        open_jobs = set(range(len(jobs)))
        for _ in range(max_passes):
            order = sorted(open_jobs)
            if not order:
                break
            points = _evaluate(both, [(names[jobs[k][0] > 0], at[k]) for k in order])
            for k, point in zip(order, points):
                j, side = jobs[k]
                move = _profile_step(point, j, side, target)
                at[k] = at[k] + move
                if np.all(np.abs(move) <= 1e-10 * (1 + np.abs(at[k]))):
                    open_jobs.discard(k)
        limit = {(j, side): math.nan for j in range(len(fit.coef)) for side in (-1.0, 1.0)}
        for k, (j, side) in enumerate(jobs):
            if k not in open_jobs:
                limit[int(own[j]), side] = float(at[k][j] * maps[j > 0][j, j])
    rows = [
        (fit.labels[j], float(fit.coef[j]), limit[j, -1.0], limit[j, 1.0])
        + tuple(math.exp(v) for v in (fit.coef[j], limit[j, -1.0], limit[j, 1.0]))
        for j in range(len(fit.coef))
    ]
    return fit, spark.createDataFrame(
        rows,
        "term string, estimate double, lower double, upper double, odds_ratio double, or_lower double, or_upper double",
    )


def _profile_step(point: Point, j: int, side: float, target: float) -> np.ndarray:
    """One step towards the limit of coefficient j on one side.

    With the quadratic model of the log-likelihood at this point, the others follow coefficient j along
    a + b*t; t solves the scalar quadratic for the target height. Where it has no root, step to the best height.
    """
    p = len(point.score)
    others = [k for k in range(p) if k != j]
    info, score = point.info, point.score
    a, b = np.zeros(p), np.zeros(p)
    b[j] = 1.0
    if others:
        block = info[np.ix_(others, others)]
        a[others] = solve(block, score[others])
        b[others] = -solve(block, info[others, j])
    # height along the line: l + score.(a+bt) - (a+bt)'info(a+bt)/2 = target
    c0 = point.loglik + score @ a - a @ info @ a / 2 - target
    c1 = score @ b - a @ info @ b
    c2 = -(b @ info @ b) / 2
    root = c1 * c1 - 4 * c2 * c0
    if root < 0:
        t = -c1 / (2 * c2)
    else:
        pair = [(-c1 + s * math.sqrt(root)) / (2 * c2) for s in (-1.0, 1.0)]
        t = max(pair) if side > 0 else min(pair)
    return a + b * t


def effect_grid(fit: LogitFit, grid: DataFrame) -> DataFrame:
    """Fitted probability for every row of a grid of covariate values."""
    return grid.withColumn("fitted", fit.score())


def with_residuals(df: DataFrame, win: Column, fit: LogitFit) -> DataFrame:
    """Score, Pearson residual, leverage, standardised residual and Cook's distance per complete row.

    The covariance enters as literals: a pure projection, no join and no shuffle.
    """
    cols = [F.lit(1.0), *[c for _, c in design(fit.terms, MAX_WIDE)]]
    p = len(cols)
    named = df.select("*", *[c.alias(f"_x{j}") for j, c in enumerate(cols)], if_else(win, F.lit(1.0), F.lit(0.0)).alias("_y"))
    at = [F.col(f"_x{j}") for j in range(p)]
    scored = named.select("*", (F.lit(1.0) / (F.lit(1.0) + F.exp(-linear_predictor(np.nan_to_num(fit.coef), at)))).alias("score"))
    cov = np.nan_to_num(fit.cov)
    # one sum per row of the matrix: a flat sum of all entries would be too deep a tree in a wide model
    rows = [([cov[j, k] * (1 if j == k else 2) for k in range(j, p)], [f"_x{k}" for k in range(j, p)]) for j in range(p)]
    spread = F.expr(" + ".join(f"_x{j} * ({linear_sql(*row)})" for j, row in enumerate(rows)))
    mu = F.col("score")
    out = scored.where(present(mu) & F.col("_y").isNotNull()).select(
        *df.columns, "score", ((F.col("_y") - mu) / F.sqrt(mu * (1 - mu))).alias("pearson"), (mu * (1 - mu) * spread).alias("leverage")
    )
    left = 1 - F.col("leverage")
    return out.select(
        "*",
        (F.col("pearson") / F.sqrt(left)).alias("std_pearson"),
        (F.pow(F.col("pearson") / left, 2) * F.col("leverage") / fit.rank).alias("cooks_distance"),
    )


def calibration(df: DataFrame, win: Column, score: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Equal-count score bins with observed win rate and mean predicted score.

    Scores are counted per distinct value first: the quantiles and the bin sums read that compact table.
    """
    n = rows_of(weight)
    scored = df.select(F.col(score).alias("score"), n.alias("n"), if_else(win, n, F.lit(0)).alias("y")).dropna()
    counts = scored.groupBy("score").agg(F.sum("n").alias("n"), F.sum("y").alias("wins"))
    kept = stage(counts)
    binned, _ = with_bins(kept, "score", quantiles(kept, equal_count_cuts(bins), "score"), "bin")
    return (
        binned.groupBy("bin")
        .agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum(F.col("n") * F.col("score")).alias("expected"))
        .select(
            "bin",
            "n",
            "wins",
            "expected",
            (F.col("wins") / F.col("n")).alias("observed_rate"),
            (F.col("expected") / F.col("n")).alias("predicted_rate"),
        )
    )


@dataclass
class GroupedFitTest:
    chi_square: float
    df: int
    p: float
    groups: int


def hosmer_lemeshow(
    df: DataFrame, win: Column, score: str, groups: int = 10, weight: str | None = None
) -> GroupedFitTest:
    """Observed against expected wins and losses over equal-count score groups; equal cuts are merged."""
    rows = calibration(df, win, score, groups, weight).collect()  # at most `groups` rows
    stat = 0.0
    for r in rows:
        lost, expected_lost = r["n"] - r["wins"], r["n"] - r["expected"]
        stat += (r["wins"] - r["expected"]) ** 2 / r["expected"] + (lost - expected_lost) ** 2 / expected_lost
    return GroupedFitTest(stat, groups - 2, chi_square_upper(stat, groups - 2), len(rows))


def variance_inflation(fit: LogitFit, allow_dropped: bool = False) -> dict[str, float]:
    """Variance inflation per term; for a term of several columns the generalised form.

    With ``allow_dropped`` columns that repeat earlier ones are left out, the others are judged without them and a term
    left without a column has NaN; else they are an error.
    """
    if len(fit.terms) < 2 or (fit.rank < len(fit.coef) and not allow_dropped):
        raise ValueError("needs at least two terms and no repeated column")
    held = np.flatnonzero(np.isfinite(fit.coef[1:])) + 1
    place = {int(j): k for k, j in enumerate(held)}
    cov = fit.cov[np.ix_(held, held)]
    scale = np.sqrt(np.diag(cov))
    corr = cov / np.outer(scale, scale)
    whole, out, start = np.linalg.det(corr), {}, 1
    for term in fit.terms:
        labels = [label for label, _ in design([term], MAX_WIDE)]
        own = [place[j] for j in range(start, start + len(labels)) if j in place]
        rest = [k for k in range(len(corr)) if k not in own]
        value = np.linalg.det(corr[np.ix_(own, own)]) * np.linalg.det(corr[np.ix_(rest, rest)]) / whole if own else math.nan
        out[labels[0] if len(labels) == 1 else getattr(term, "name", ":".join(labels))] = float(value)
        start += len(labels)
    return out
