"""Logistic model and classifier measures against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions.tails import CHI2_95_1DF
from touchline.operators import evaluate, logit
from touchline.operators.terms import Cat, Inter, Num, design

WIN = "result"


def is_win():
    return F.col("result") == "Win"


def numpy_logit(x, y, offset=0.0):
    def height(b):
        eta = x @ b + offset
        return float(np.sum(y * eta - np.logaddexp(0, eta)))

    b = np.zeros(x.shape[1])
    for _ in range(200):
        mu = 1 / (1 + np.exp(-np.clip(x @ b + offset, -500, 500)))
        info = x.T @ (x * (mu * (1 - mu))[:, None]) + 1e-12 * np.eye(len(b))
        step = np.linalg.solve(info, x.T @ (y - mu))
        while height(b + step) < height(b) - 1e-9 and np.abs(step).max() > 1e-14:
            step = step / 2
        b = b + step
    return b, np.linalg.inv(info), height(b)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 600
    h, a = rng.integers(20, 99, n), rng.integers(20, 99, n)
    far = rng.random(n) < 0.7
    p = 1 / (1 + np.exp(-(-1.5 + 0.045 * h - 0.02 * a + 0.6 * far)))
    return h, a, far, rng.random(n) < p


@pytest.fixture(scope="module")
def frame(spark, data):
    h, a, far, y = data
    rows = [(int(p), int(q), "Long" if f else "Short", "Win" if w else "Loss/Draw") for p, q, f, w in zip(h, a, far, y)]
    rows += [(None, 50, "Long", "Win"), (50, 50, "Missing", "Win"), (60, 40, "Long", None)]
    return spark.createDataFrame(rows, "home_pts int, away_pts int, distance string, result string")


DIST = Cat("distance", ["Short", "Long"])
TERMS = [Num("home_pts"), Num("away_pts"), DIST]


@pytest.fixture(scope="module")
def fits(frame):
    return logit.fit_logits(
        frame, is_win(), {"null": [], "home": [Num("home_pts")], "final": TERMS, "inter": [*TERMS, Inter(Num("home_pts"), DIST)]}
    )


def test_fit_against_numpy(data, fits):
    h, a, far, y = data
    x = np.column_stack([np.ones(len(h)), h, a, far]).astype(float)
    b, cov, ll = numpy_logit(x, y.astype(float))
    fit = fits["final"]
    assert fit.converged and fit.n == 600 and fit.n_dropped == 2
    assert fit.coef == pytest.approx(b, rel=1e-9) and fit.cov == pytest.approx(cov, rel=1e-6)
    assert fit.aic == pytest.approx(-2 * ll + 8)
    inter = numpy_logit(np.column_stack([x, h * far]), y.astype(float))
    assert fits["inter"].coef == pytest.approx(inter[0], rel=1e-8)
    assert fits["inter"].labels[-1] == "home_pts:distanceLong"


def test_saturated_by_hand(spark):
    rows = [("Short", "Win")] * 10 + [("Short", "Loss/Draw")] * 30 + [("Long", "Win")] * 30 + [("Long", "Loss/Draw")] * 30
    fit = logit.fit_logit(spark.createDataFrame(rows, "distance string, result string"), is_win(), [DIST])
    assert fit.coef == pytest.approx([math.log(1 / 3), math.log(3)], abs=1e-9)
    assert fit.std_error == pytest.approx([0.365148, 0.447214], abs=1e-6)


def test_nested_test_and_choice(spark, frame, fits):
    t = logit.nested_test(fits["final"], fits["inter"])
    assert t.df == 1 and t.chi_square == pytest.approx(2 * (fits["inter"].loglik - fits["final"].loglik))
    with pytest.raises(ValueError):
        logit.nested_test(fits["home"], fits["final"])  # the smaller model has one more complete row
    table = logit.compare_models(fits, spark).collect()
    assert [r.aic for r in table] == sorted(r.aic for r in table)
    best, _ = logit.choose_forward(
        frame,
        is_win(),
        [
            {"home": [Num("home_pts")], "away": [Num("away_pts")], "distance": [DIST]},
            {"points": TERMS[:2], "home_distance": [TERMS[0], DIST]},
            {"final": TERMS},
            {"inter": [*TERMS, Inter(Num("home_pts"), DIST)]},
        ],
    )
    assert best == "final"


def test_repeated_columns_get_no_coefficient(spark, frame, fits):
    twice = frame.withColumns({"copy": F.col("home_pts") * 2, "flat": F.lit(1.0)})
    fit = logit.fit_logit(twice, is_win(), [Num("home_pts"), Num("copy"), Num("away_pts"), Num("flat"), DIST])
    assert fit.rank == 4 and math.isnan(fit.coef[2]) and math.isnan(fit.coef[4])
    assert fit.coef[[0, 1, 3, 5]] == pytest.approx(fits["final"].coef, rel=1e-7)
    assert fit.aic == pytest.approx(fits["final"].aic)
    a, b = twice.where("home_pts = 50 AND away_pts = 50").select(fit.score(), fits["final"].score()).first() or (0, 0)
    assert a == b or a == pytest.approx(b)
    with pytest.raises(ValueError):
        logit.variance_inflation(fit)


def test_separated_classes_are_flagged(spark):
    df = spark.createDataFrame([(i, "Win" if i >= 10 else "Loss/Draw") for i in range(20)], "v int, result string")
    assert not logit.fit_logit(df, is_win(), [Num("v")]).converged


def test_profile_limits_drop_the_likelihood_by_the_right_amount(spark, data, frame):
    h, a, far, y = data
    fit, table = logit.profile_intervals(frame, is_win(), TERMS)
    x = np.column_stack([np.ones(len(h)), h, a, far]).astype(float)
    for j, r in enumerate(table.collect()):
        assert r.lower < r.estimate < r.upper
        for limit in (r.lower, r.upper):
            rest = np.delete(x, j, axis=1)
            ll = numpy_logit(rest, y.astype(float), offset=x[:, j] * limit)[2]
            assert 2 * (fit.loglik - ll) == pytest.approx(CHI2_95_1DF, rel=1e-7)
        assert r.or_upper == pytest.approx(math.exp(r.upper))


def test_residuals_and_leverage(data, frame, fits):
    h, a, far, y = data
    fit = fits["final"]
    out = logit.with_residuals(frame, is_win(), fit).collect()
    assert len(out) == 600
    assert sum(r.leverage for r in out) == pytest.approx(4.0, rel=1e-6)
    x = np.column_stack([np.ones(len(h)), h, a, far]).astype(float)
    mu = 1 / (1 + np.exp(-(x @ fit.coef)))
    lev = mu * (1 - mu) * np.einsum("ij,jk,ik->i", x, fit.cov, x)
    pear = (y - mu) / np.sqrt(mu * (1 - mu))
    want = sorted(zip(mu, pear, lev, pear / np.sqrt(1 - lev), (pear / (1 - lev)) ** 2 * lev / 4))
    got = sorted((r.score, r.pearson, r.leverage, r.std_pearson, r.cooks_distance) for r in out)
    assert np.array(got) == pytest.approx(np.array(want), rel=1e-8)


def test_calibration_and_grouped_test(data, frame, fits):
    h, a, far, y = data
    fit = fits["final"]
    scored = frame.withColumn("score", fit.score())
    x = np.column_stack([np.ones(len(h)), h, a, far]).astype(float)
    mu = 1 / (1 + np.exp(-(x @ fit.coef)))
    cuts = np.unique(np.quantile(mu, np.arange(11) / 10))
    group = np.clip(np.searchsorted(cuts, mu, side="left"), 1, 10)
    stat = 0.0
    for r in logit.calibration(scored, is_win(), "score").collect():
        own = group == r.bin
        assert (r.n, r.wins) == (own.sum(), y[own].sum()) and r.expected == pytest.approx(mu[own].sum())
        stat += (y[own].sum() - mu[own].sum()) ** 2 * (1 / mu[own].sum() + 1 / (1 - mu[own]).sum())
    test = logit.hosmer_lemeshow(scored, is_win(), "score")
    assert test.chi_square == pytest.approx(stat) and test.df == 8 and test.groups == 10


def test_variance_inflation_is_inverse_correlation(fits):
    cov = fits["final"].cov[1:, 1:]
    s = np.sqrt(np.diag(cov))
    # for single columns the factor is the diagonal of the inverse of the coefficient correlations
    want = np.diag(np.linalg.inv(cov / np.outer(s, s)))
    assert list(logit.variance_inflation(fits["final"]).values()) == pytest.approx(list(want))


def test_design_guards():
    with pytest.raises(ValueError):
        design([Num("a"), Num("a")])
    with pytest.raises(ValueError):
        design([Cat("c", [str(i) for i in range(60)])])
    assert len(design([Cat("c", [str(i) for i in range(60)])], 300)) == 59


def scored(spark, pos, neg):
    return spark.createDataFrame([(v, "Win") for v in pos] + [(v, "Loss/Draw") for v in neg], "score double, result string")


@pytest.mark.parametrize("small", [None, 2])
def test_roc_by_hand(spark, small):
    ranked = evaluate.rank_scores(scored(spark, [0.9, 0.6, 0.4], [0.6, 0.2]), is_win(), "score", small_rows=small)
    assert evaluate.area_under_roc(ranked).first().auc == pytest.approx(0.75)
    got = [tuple(r) for r in evaluate.roc_table(ranked).orderBy("threshold").collect()]
    want = [(-math.inf, 1, 0), (0.3, 1, 0.5), (0.5, 2 / 3, 0.5), (0.75, 1 / 3, 1), (math.inf, 0, 1)]
    for g, w in zip(got, want):
        assert g == pytest.approx(w)
    best = [tuple(r) for r in evaluate.best_thresholds(ranked).collect()]
    assert len(best) == 1 and best[0] == pytest.approx((0.3, 1, 0.5))


def test_roc_ties_of_best_and_reversed_direction(spark):
    ranked = evaluate.rank_scores(scored(spark, [1.0, 3.0], [2.0, 0.0]), is_win(), "score")
    assert sorted(r.threshold for r in evaluate.best_thresholds(ranked).collect()) == [0.5, 2.5]
    low = evaluate.rank_scores(scored(spark, [0.1, 0.2], [0.8, 0.9, 0.15]), is_win(), "score")
    assert not low.higher_wins
    assert evaluate.area_under_roc(low).first().auc == pytest.approx(5 / 6)
    curve = {round(r.threshold, 4): (r.sensitivity, r.specificity) for r in evaluate.roc_table(low).collect()}
    assert curve[0.5] == pytest.approx((1.0, 2 / 3))
    with pytest.raises(ValueError):
        evaluate.rank_scores(scored(spark, [1.0], []), is_win(), "score")


def test_roc_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    pos, neg = np.round(rng.normal(1, 1, 300), 1), np.round(rng.normal(0, 1, 200), 1)
    ranked = evaluate.rank_scores(scored(spark, pos.tolist(), neg.tolist()), is_win(), "score", small_rows=5)
    pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert evaluate.area_under_roc(ranked).first().auc == pytest.approx(pairs, rel=1e-12)


def test_confusion_by_hand(spark):
    rows = [("Win", "Win")] * 30 + [("Loss/Draw", "Win")] * 10 + [("Win", "Loss/Draw")] * 20 + [("Loss/Draw", "Loss/Draw")] * 40 + [(None, "Win")]
    c = evaluate.confusion(spark.createDataFrame(rows, "p string, a string"), F.col("p"), F.col("a"))
    assert (c.true_pos, c.false_neg, c.false_pos, c.true_neg) == (30, 10, 20, 40)
    assert (c.accuracy, c.sensitivity, c.pos_pred_value, c.neg_pred_value) == (0.70, 0.75, 0.60, 0.80)
    assert c.specificity == pytest.approx(2 / 3) and c.no_information_rate == 0.6
    assert c.kappa == pytest.approx(0.40) and c.mcnemar == pytest.approx(2.70)
    assert c.accuracy_lower == pytest.approx(0.6001853, abs=1e-6) and c.accuracy_upper == pytest.approx(0.7875936, abs=1e-6)
    assert c.accuracy_p == pytest.approx(sum(math.comb(100, k) * 0.6**k * 0.4 ** (100 - k) for k in range(70, 101)))


def test_classify_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (None,)], "s double")
    assert [r[0] for r in df.select(evaluate.classify(F.col("s"), 0.5)).collect()] == ["Loss/Draw", "Win", None]


def test_wide_factor_beside_numpy(spark):
    rng = np.random.default_rng(6)
    c, v = rng.integers(0, 60, 6000), rng.normal(size=6000)
    y = rng.random(6000) < 1 / (1 + np.exp(-(0.3 * v + 0.02 * c - 0.5)))
    rows = [(f"c{a:02d}", float(b), bool(w)) for a, b, w in zip(c, v, y)]
    df = spark.createDataFrame([*rows, (None, 1.0, True), ("c01", float("nan"), False)], "c string, v double, y boolean")
    fit = logit.fit_logit(df, F.col("y"), [Cat("c", [f"c{i:02d}" for i in range(60)]), Num("v")])
    x = np.column_stack([np.ones(6000), *[(c == i).astype(float) for i in range(1, 60)], v])
    b = np.zeros(61)
    for _ in range(20):
        mu = 1 / (1 + np.exp(-x @ b))
        info = (x * (mu * (1 - mu))[:, None]).T @ x
        b += np.linalg.solve(info, x.T @ (y - mu))
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    np.testing.assert_allclose(fit.std_error, np.sqrt(np.diag(np.linalg.inv(info))), atol=1e-7)
    assert fit.n == 6000 and fit.n_dropped == 2 and fit.converged
    lever = logit.with_residuals(df, F.col("y"), fit).agg(F.sum("leverage")).first()[0]
    assert lever == pytest.approx(61, rel=1e-6)


def test_profile_limits_beside_a_constant_column(spark, frame):
    flat = frame.withColumn("flat", F.when(F.col("home_pts") < 90, 45))
    terms = [Num("flat"), *TERMS]
    with pytest.raises(ValueError):
        logit.profile_intervals(flat, is_win(), terms)
    _, got = logit.profile_intervals(flat, is_win(), terms, allow_dropped=True)
    got = {r.term: tuple(r)[1:] for r in got.collect()}
    assert all(math.isnan(v) for v in got.pop("flat"))
    # the constant column's nulls still take their rows out
    _, want = logit.profile_intervals(flat.where("home_pts < 90"), is_win(), TERMS)
    assert got == {r.term: pytest.approx(tuple(r)[1:], rel=1e-7) for r in want.collect()}


def test_variance_inflation_beside_repeated_columns(frame, fits):
    twice = frame.withColumns({"copy": F.col("home_pts") * 2, "flat": F.lit(1.0)})
    fit = logit.fit_logit(twice, is_win(), [Num("home_pts"), Num("copy"), Num("away_pts"), Num("flat"), DIST])
    got = logit.variance_inflation(fit, allow_dropped=True)
    assert math.isnan(got.pop("copy")) and math.isnan(got.pop("flat"))
    assert got == {k: pytest.approx(v, rel=1e-6) for k, v in logit.variance_inflation(fits["final"]).items()}
