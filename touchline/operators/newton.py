"""The climbing loop shared by the likelihood fits. Only p x p matrices live here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

MAX_PASSES = 30
DECREMENT = 1e-12
SUMS_PER_PASS = 120


@dataclass
class Point:
    """Log-likelihood, gradient and negative Hessian at one parameter vector."""

    loglik: float
    score: np.ndarray
    info: np.ndarray


@dataclass
class Climb:
    """State of one maximisation."""

    params: np.ndarray
    best: Point | None = None
    at: np.ndarray | None = None
    first: Point | None = None
    passes: int = 0
    done: bool = False
    converged: bool = False
    step: np.ndarray | None = field(default=None, repr=False)
    free: np.ndarray | None = None

    def estimates(self) -> np.ndarray:
        """Parameters with NaN for columns that repeat earlier ones."""
        return np.where(self.free, self.params, np.nan)

    def covariance(self) -> np.ndarray:
        out = np.full(self.best.info.shape, np.nan)
        own = np.flatnonzero(self.free)
        out[np.ix_(own, own)] = invert(self.best.info[np.ix_(own, own)])
        return out


Evaluate = Callable[[Sequence[tuple[int, np.ndarray]]], Sequence[Point]]


def climb_all(evaluate: Evaluate, starts: Sequence[np.ndarray], max_passes: int = MAX_PASSES) -> list[Climb]:
    """Newton steps with halving for several models at once: each round is one evaluation of all open ones.

    Stops when the expected gain (score' info^-1 score) is negligible, then takes that last step.
    """
    runs = [Climb(np.array(s, dtype=float)) for s in starts]
    while True:
        open_runs = [i for i, r in enumerate(runs) if not r.done]
        if not open_runs:
            return runs
        points = evaluate([(i, runs[i].params) for i in open_runs])
        for i, point in zip(open_runs, points):
            _advance(runs[i], point, max_passes)


def _advance(run: Climb, point: Point, max_passes: int) -> None:
    run.passes += 1
    if run.first is None:
        run.first = point
    usable = np.isfinite(point.loglik) and np.all(np.isfinite(point.info)) and np.all(np.isfinite(point.score))
    worse = run.best is not None and (not usable or point.loglik < run.best.loglik - 1e-9 * (1 + abs(run.best.loglik)))
    if worse:
        run.step = run.step / 2
        run.params = run.at + run.step
        run.done = run.passes >= max_passes
        return
    if not usable:
        run.best, run.at, run.done = point, run.params, True
        run.free = np.ones(len(run.params), dtype=bool)
        return
    run.best, run.at = point, run.params
    if run.free is None:
        run.free = independent(point.info)
    own = np.flatnonzero(run.free)
    run.step = np.zeros(len(run.params))
    run.step[own] = solve(point.info[np.ix_(own, own)], point.score[own])
    gain = float(point.score @ run.step)
    run.params = run.at + run.step
    if gain < DECREMENT:
        run.done = run.converged = True
    elif run.passes >= max_passes:
        run.done = True


REPEATED = 1e-13


def independent(info: np.ndarray) -> np.ndarray:
    """Columns that add something to the ones before them; the rest (constant, repeated) are left out of a fit."""
    scale = np.sqrt(np.maximum(np.diag(info), 1e-300))
    scaled = info / np.outer(scale, scale)
    kept: list[int] = []
    free = np.zeros(len(info), dtype=bool)
    for j in range(len(info)):
        if not info[j, j] > 0:
            continue
        left = scaled[j, j]
        if kept:
            left -= scaled[j, kept] @ np.linalg.solve(scaled[np.ix_(kept, kept)], scaled[kept, j])
        if left > REPEATED:
            kept.append(j)
            free[j] = True
    return free


def solve(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Symmetric solve, scaled to a unit diagonal; falls back to the least-norm answer when singular."""
    if rhs.size == 0:
        return np.array(rhs, dtype=float)
    scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    scaled = matrix / np.outer(scale, scale)
    try:
        inner = np.linalg.solve(scaled, (rhs.T / scale).T)
    except np.linalg.LinAlgError:
        inner = np.linalg.lstsq(scaled, (rhs.T / scale).T, rcond=None)[0]
    return (inner.T / scale).T


def invert(matrix: np.ndarray) -> np.ndarray:
    return solve(matrix, np.eye(len(matrix))) if len(matrix) else matrix


def triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def symmetric(values: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(triangle(p), values):
        out[i, j] = out[j, i] = v
    return out


def batches(sizes: Sequence[int], limit: int = SUMS_PER_PASS) -> list[list[int]]:
    """Consecutive positions whose sizes add up to at most ``limit`` (one oversized item stands alone)."""
    out: list[list[int]] = []
    room = 0
    for i, size in enumerate(sizes):
        if not out or size > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= size
    return out
