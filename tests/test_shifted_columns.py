"""Fits don't depend on where a covariate's zero lies or on its unit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import logit, weibull
from touchline.operators.terms import Inter, Num


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x, z = rng.normal(0, 1, 800).round(2), rng.normal(0, 1, 800).round(2)
    win = rng.random(800) < 1 / (1 + np.exp(-(0.3 + 0.8 * x - 0.4 * z)))
    time = np.exp(1.0 - 0.5 * x + 0.3 * z) * rng.exponential(1, 800) ** 0.7 + 0.01
    event = rng.random(800) < 0.8
    rows = [(float(a), float(b), bool(w), float(t), int(e)) for a, b, w, t, e in zip(x, z, win, time.round(2), event)]
    df = spark.createDataFrame(rows, "x double, z double, win boolean, time double, event int")
    return df.where("time > 0").cache()


@pytest.mark.parametrize("shift", [1e4, 1e6, 1e8])
def test_logit_slopes_keep_their_values(table, shift):
    plain = logit.fit_logit(table, F.col("win"), [Num("x"), Num("z")])
    moved = logit.fit_logit(table.withColumn("x", F.col("x") + shift), F.col("win"), [Num("x"), Num("z")])
    assert moved.converged and moved.rank == 3
    assert moved.coef[1:] == pytest.approx(plain.coef[1:], rel=1e-6)
    assert moved.std_error[1:] == pytest.approx(plain.std_error[1:], rel=1e-6)
    assert moved.loglik == pytest.approx(plain.loglik, rel=1e-9)
    assert moved.coef[0] == pytest.approx(plain.coef[0] - shift * plain.coef[1], rel=1e-6)


@pytest.mark.parametrize("shift", [1e4, 1e6, 1e8])
def test_weibull_slopes_keep_their_values(table, shift):
    plain = weibull.fit_weibull(table, "time", "event", [Num("x"), Num("z")])
    moved = weibull.fit_weibull(table.withColumn("x", F.col("x") + shift), "time", "event", [Num("x"), Num("z")])
    assert moved.converged and moved.rank == 4
    assert moved.coef[1:] == pytest.approx(plain.coef[1:], rel=1e-6)
    assert moved.std_error[1:] == pytest.approx(plain.std_error[1:], rel=1e-6)


def test_repeats_are_named(spark, table):
    df = table.withColumns({"twice": F.col("x") * 2 + 1e7, "same": F.lit(2020.0)})
    for fit in (
        logit.fit_logit(df, F.col("win"), [Num("x"), Num("twice"), Num("same"), Num("z")]),
        weibull.fit_weibull(df, "time", "event", [Num("x"), Num("twice"), Num("same"), Num("z")]),
    ):
        rows = {r["term"]: r for r in fit.coef_table(spark).collect()}
        assert {t for t, r in rows.items() if r["dropped"]} == {"twice", "same"} and all(r["converged"] for r in rows.values())


def test_profile_limits_follow_the_shift(table):
    _, plain = logit.profile_intervals(table, F.col("win"), [Num("x"), Num("z"), Inter(Num("x"), Num("z"))])
    _, moved = logit.profile_intervals(table.withColumn("z", F.col("z") * 1000), F.col("win"), [Num("x"), Num("z"), Inter(Num("x"), Num("z"))])
    a, b = ({r["term"]: r for r in t.collect()} for t in (plain, moved))
    for term, unit in (("(Intercept)", 1), ("x", 1), ("z", 1000), ("x:z", 1000)):
        for c in ("estimate", "lower", "upper"):
            assert b[term][c] * unit == pytest.approx(a[term][c], rel=1e-6)
    _, far = logit.profile_intervals(table.withColumn("x", F.col("x") + 1e7), F.col("win"), [Num("x"), Num("z")])
    _, near = logit.profile_intervals(table, F.col("win"), [Num("x"), Num("z")])
    a, b = ({r["term"]: r for r in t.collect()} for t in (near, far))
    for c in ("lower", "upper"):
        assert b["x"][c] == pytest.approx(a["x"][c], rel=1e-5) and b["z"][c] == pytest.approx(a["z"][c], rel=1e-5)


def test_unconverged_fits_are_never_chosen(spark):
    rows = [(float(i), i >= 10, float(i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, win boolean, z double")
    best, fits = logit.choose_forward(df, F.col("win"), [{"split": [Num("x")], "z": [Num("z")]}])
    assert not fits["split"].converged and best == "null"
    table = logit.compare_models(fits, spark).collect()
    assert table[-1]["model"] == "split" and not table[-1]["converged"]
