"""Model terms and the numeric design columns they stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COEFFICIENTS = 40
#: Logistic models may be wider: past ``MAX_COEFFICIENTS`` their sums are matrices of blocks instead of one column an entry.
MAX_WIDE = 300


@dataclass(frozen=True)
class Num:
    """A numeric column, used as it is."""

    name: str


@dataclass(frozen=True)
class Cat:
    """A class column with ordered levels; the first is the baseline, a value off the list counts as missing."""

    name: str
    levels: tuple[str, ...]

    def __init__(self, name: str, levels: Sequence[str]):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "levels", tuple(levels))


@dataclass(frozen=True)
class Inter:
    """Product of two terms (their own columns are separate terms)."""

    first: Num | Cat
    second: Num | Cat


Term = Num | Cat | Inter


def term_columns(term: Term) -> list[tuple[str, Column]]:
    """Labelled design columns of one term; null where the row cannot be used."""
    if isinstance(term, Num):
        return [(term.name, F.col(term.name).cast("double"))]
    if isinstance(term, Cat):
        source = F.col(term.name)
        return [
            (term.name + level, F.when(source.isin(list(term.levels)), (source == level).cast("double")))
            for level in term.levels[1:]
        ]
    return [
        (f"{la}:{lb}", ca * cb) for la, ca in term_columns(term.first) for lb, cb in term_columns(term.second)
    ]


def _term_value(term: Num | Cat) -> Column:
    """What all design columns of a term follow from: its number or its level; null where the row cannot be used."""
    if isinstance(term, Num):
        value = F.col(term.name).cast("double")
        return F.when(present(value), value)
    return F.when(F.col(term.name).isin(list(term.levels)), F.col(term.name))


def _value_columns(term: Num | Cat, value: Column) -> list[tuple[str, Column]]:
    """``term_columns`` of a term from its ``_term_value``."""
    if isinstance(term, Num):
        return [(term.name, value)]
    return [(term.name + level, F.when(value.isNotNull(), (value == level).cast("double"))) for level in term.levels[1:]]


def design(terms: Sequence[Term], limit: int = MAX_COEFFICIENTS) -> list[tuple[str, Column]]:
    out = [pair for t in terms for pair in term_columns(t)]
    if len(out) > limit:
        raise ValueError(f"{len(out)} coefficients; the limit is {limit}")
    labels = [label for label, _ in out]
    if len(set(labels)) != len(labels):
        raise ValueError(f"repeated design columns in {labels}")
    return out


def base_terms(terms: Sequence[Term]) -> list[Term]:
    """The terms without interactions, plus the parts of the interactions, each once."""
    seen: dict[Term, None] = {}
    for t in terms:
        for part in (t.first, t.second) if isinstance(t, Inter) else (t,):
            seen[part] = None
    return list(seen)


def present(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def slot(label: str) -> str:
    """Column name of a design column inside a cell table."""
    return "x_" + label


def cell_table(
    df: DataFrame, models: Sequence[Sequence[Term]], keys: Sequence[tuple[str, Column]], sums: Sequence[tuple[str, Column]]
) -> DataFrame:
    """Group rows that look alike to every model: one row per distinct design row (and extra keys).

    Exact: the likelihoods need only these counts. The partial aggregate merges equal rows before the one
    shuffle, so a hot cell costs one row per task. Rows are grouped by one value a term; the design columns of a class
    and the interactions follow from those values afterwards, once per cell. NaN counts as missing, like null: a fit
    leaves such rows out and counts them.
    """
    terms = [t for t in dict.fromkeys(t for m in models for t in base_terms(m)) if term_columns(t)]
    flat = df.select(
        *[_term_value(t).alias(f"_t_{i}") for i, t in enumerate(terms)],
        *[c.alias(n) for n, c in keys],
        *[c.alias("_s_" + n) for n, c in sums],
    )
    groups = [f"_t_{i}" for i in range(len(terms))] + [n for n, _ in keys]
    counted = flat.groupBy(*groups).agg(*[F.sum("_s_" + n).cast("double").alias(n) for n, _ in sums])
    parts = {label: c for i, t in enumerate(terms) for label, c in _value_columns(t, F.col(f"_t_{i}"))}
    cells = counted.select(*[c.alias(slot(label)) for label, c in parts.items()], *[n for n, _ in keys], *[n for n, _ in sums])
    products = {}
    for m in models:
        for t in m:
            if isinstance(t, Inter):
                for la, _ in term_columns(t.first):
                    for lb, _ in term_columns(t.second):
                        products[f"{la}:{lb}"] = F.col(f"`{slot(la)}`") * F.col(f"`{slot(lb)}`")
    return cells.select("*", *[c.alias(slot(label)) for label, c in products.items()])


def x(label: str) -> Column:
    return F.col(f"`{slot(label)}`")


def x_sql(label: str) -> str:
    """The same as SQL text. The sums of a likelihood pass run to hundreds of terms: one parsed text per sum is
    far cheaper to build than a tree of column objects."""
    return f"`{slot(label)}`"


def number(value: float) -> str:
    """A double as SQL text, all digits kept."""
    return f"({float(value)!r}D)"


def linear_sql(coef: Sequence[float], columns: Sequence[str]) -> str:
    return " + ".join(f"{number(b)} * {c}" for b, c in zip(coef, columns)) or "0D"


@dataclass(frozen=True)
class Scale:
    """Centre and spread of a design column over the rows that have it."""

    mean: float
    spread: float


def scale_sums(labels: Sequence[str]) -> list[Column]:
    """Aggregates over a cell table (count column n) from which ``read_scales`` takes the scales."""
    out = []
    for k, label in enumerate(labels):
        held = F.when(x(label).isNotNull(), F.col("n"))
        out += [F.sum(held * x(label)).alias(f"_s{k}"), F.sum(held).alias(f"_c{k}"), F.min(x(label)).alias(f"_l{k}"), F.max(x(label)).alias(f"_h{k}")]
    return out


def read_scales(row, labels: Sequence[str]) -> dict[str, Scale]:
    """Scales from a row of ``scale_sums``: the range is the spread, and a constant column is centred to exact zeros."""
    out = {}
    for k, label in enumerate(labels):
        low, high = row[f"_l{k}"], row[f"_h{k}"]
        if low is None or not high > low:
            out[label] = Scale(0.0 if low is None else float(low), 1.0)
        else:
            out[label] = Scale(float(row[f"_s{k}"] / row[f"_c{k}"]), float(high - low))
    return out


def standardised(cells: DataFrame, scales: Mapping[str, Scale]) -> DataFrame:
    """Cells whose design columns are centred and divided by their spread: fits in them don't depend on units."""
    new = {slot(label): (x(label) - F.lit(s.mean)) / F.lit(s.spread) for label, s in scales.items()}
    return cells.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in cells.columns])


def back_transform(labels: Sequence[str], scales: Mapping[str, Scale]) -> np.ndarray:
    """Matrix from coefficients on standardised columns (intercept first) to those on the columns as given."""
    out = np.eye(1 + len(labels))
    for j, label in enumerate(labels, start=1):
        out[j, j] = 1 / scales[label].spread
        out[0, j] = -scales[label].mean / scales[label].spread
    return out


def transformed(matrix: np.ndarray, estimates: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and covariance under a linear map; what was left out of the fit (NaN) stays out."""
    gone = ~np.isfinite(estimates)
    values = matrix @ np.nan_to_num(estimates)
    spread = matrix @ np.nan_to_num(covariance) @ matrix.T
    values[gone] = np.nan
    spread[gone, :] = spread[:, gone] = np.nan
    return values, spread
