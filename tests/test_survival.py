"""Time-to-event operators against hand tables and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import concordance as concord
from touchline.operators import cox, survival, weibull
from touchline.operators.terms import Cat, Num


def timed(spark, rows):
    return spark.createDataFrame(rows, "t int, e int")


@pytest.mark.parametrize("small", [None, 1])
def test_curve_by_hand(spark, small):
    df = timed(spark, [(2, 1), (3, 1), (3, 1), (5, 0), (6, 1)])
    got = survival.kaplan_meier(df, "t", "e", small_rows=small).orderBy("time").collect()
    assert [r.time for r in got] == [2, 3, 5, 6]
    assert [r.n_risk for r in got] == [5, 4, 2, 1]
    assert [r.survival for r in got] == pytest.approx([0.8, 0.4, 0.4, 0.0])
    assert [r.cum_hazard for r in got] == pytest.approx([0.2, 0.7, 0.7, 1.7])
    assert got[-1].lower is None and got[-1].std_err is None
    assert got[0].std_err == pytest.approx(math.sqrt(0.8 * 0.2 / 5)) and got[0].upper == 1.0
    s = survival.curve_summary(df, "t", "e", small_rows=small).first()
    assert (s.records, s.events, s.median) == (5, 4, 3.0)
    assert s.rmean == pytest.approx(2 + 0.8 + 0.4 * 3)
    # each event time t with area A to its right adds A^2 d / (n (n - d))
    assert s.se_rmean == pytest.approx(math.sqrt(2.0**2 * 1 / (5 * 4) + 1.2**2 * 2 / (4 * 2)))


def test_flat_step_at_one_half(spark):
    df = timed(spark, [(1, 1), (2, 1), (3, 1), (4, 1)])
    curve = survival.kaplan_meier(df, "t", "e")
    assert survival.median_survival(curve).first()["median"] == 2.5


def test_all_censored(spark):
    df = timed(spark, [(1, 0), (2, 0)])
    curve = survival.kaplan_meier(df, "t", "e")
    assert {r.survival for r in curve.collect()} == {1.0}
    assert survival.curve_summary(df, "t", "e").first()["median"] is None
    assert [r.log_cum_hazard for r in survival.cumulative_hazard(curve).collect()] == [None, None]
    with_x = df.withColumn("x", F.lit(1.0))
    with pytest.raises(ValueError):
        cox.fit_cox(with_x, "t", "e", [Num("x")])
    with pytest.raises(ValueError):
        weibull.fit_weibull(with_x, "t", "e", [Num("x")])


def test_empty(spark):
    df = timed(spark, []).withColumn("g", F.lit("a"))
    assert survival.kaplan_meier(df, "t", "e", ["g"]).count() == 0
    assert survival.curve_summary(df, "t", "e", ["g"]).count() == 0


def test_restricted_mean_with_a_common_end_and_nulls_left_out(spark):
    rows = [("a", 2, 1), ("a", 4, 0), ("b", 3, 1), ("b", 10, 1), (None, 5, 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, t int, e int")
    got = {r.g: r for r in survival.curve_summary(df, "t", "e", ["g"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].rmean == pytest.approx(2 + 0.5 * 8) and got["b"].rmean == pytest.approx(3 + 0.5 * 7)
    short = {r.g: r for r in survival.curve_summary(df, "t", "e", ["g"], end=3.5).collect()}
    assert short["a"].rmean == pytest.approx(2 + 0.5 * 1.5) and short["b"].rmean == pytest.approx(3 + 0.5 * 0.5)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(21)
    n = 220
    x = rng.integers(20, 99, n).astype(float)
    z = rng.random(n) < 0.5
    latent = 55 * rng.weibull(1.2, n) * np.exp(-(0.01 * (x - 60) + 0.3 * z) / 1.2)
    t = np.clip(np.ceil(latent), 1, 60)
    e = (latent < 60).astype(int)
    e[:25] = 0
    return t, e, x, z


@pytest.fixture(scope="module")
def frame(spark, sample):
    t, e, x, z = sample
    rows = [(int(a), int(b), float(c), "Home" if d else "Away") for a, b, c, d in zip(t, e, x, z)]
    return spark.createDataFrame(rows + [(5, 1, None, "Home"), (5, 1, 30.0, "Neutral")], "t int, e int, x double, loc string")


TERMS = [Num("x"), Cat("loc", ["Away", "Home"])]


@pytest.mark.parametrize("rho", [0, 1])
@pytest.mark.parametrize("small", [None, 4])
def test_rank_test_by_loops(spark, sample, frame, rho, small):
    t, e, _, z = sample
    o, ex, var, s = np.zeros(2), np.zeros(2), 0.0, 1.0
    for u in np.unique(t):
        risk = t >= u
        n, d = risk.sum(), ((t == u) & (e == 1)).sum()
        w = s**rho
        for k in (0, 1):
            own = z == bool(k)
            o[k] += w * ((t == u) & (e == 1) & own).sum()
            ex[k] += w * d * (risk & own).sum() / n
        f = (risk & z).sum() / n
        if n > 1:
            var += w * w * d * (n - d) / (n - 1) * f * (1 - f)
        s *= 1 - d / n
    got = survival.rank_test(frame.where("loc <> 'Neutral' AND x IS NOT NULL"), "t", "e", "loc", ["Away", "Home"], rho, small)
    assert got.observed == pytest.approx(o) and got.expected == pytest.approx(ex)
    assert got.chi_square == pytest.approx((o[1] - ex[1]) ** 2 / var) and got.df == 1
    assert got.observed.sum() == pytest.approx(got.expected.sum())


def numpy_cox(t, e, x, b):
    """Efron log-likelihood, score, information, and per tied event: time, mean, covariance."""
    r = np.exp(x @ b)
    p = x.shape[1]
    ll, u, info, parts = 0.0, np.zeros(p), np.zeros((p, p)), []
    for v in np.unique(t[e == 1]):
        risk, dead = t >= v, (t == v) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ b).sum()
        u += x[dead].sum(axis=0)
        for k in range(d):
            w = r * risk - k / d * r * dead
            s0 = w.sum()
            mean = (w[:, None] * x).sum(axis=0) / s0
            cov = (x.T * w) @ x / s0 - np.outer(mean, mean)
            ll -= math.log(s0)
            u -= mean
            info += cov
            parts.append((v, mean, cov))
    return ll, u, info, parts


def design_matrix(sample):
    t, e, x, z = sample
    return t, e, np.column_stack([x, z]).astype(float)


@pytest.fixture(scope="module")
def cox_fit(frame):
    return cox.fit_cox(frame, "t", "e", TERMS)


def test_cox_against_numpy(sample, cox_fit, frame):
    t, e, x = design_matrix(sample)
    x = x - x.mean(axis=0)
    b = np.zeros(2)
    for _ in range(30):
        _, u, info, _ = numpy_cox(t, e, x, b)
        b = b + np.linalg.solve(info, u)
    ll0, u0, info0, _ = numpy_cox(t, e, x, np.zeros(2))
    ll, _, info, _ = numpy_cox(t, e, x, b)
    assert cox_fit.converged and cox_fit.n_dropped == 2
    assert cox_fit.coef == pytest.approx(b, rel=1e-8)
    assert cox_fit.cov == pytest.approx(np.linalg.inv(info), rel=1e-6)
    tests = cox_fit.tests()
    assert tests["likelihood_ratio"].chi_square == pytest.approx(2 * (ll - ll0), rel=1e-8)
    assert tests["score"].chi_square == pytest.approx(u0 @ np.linalg.solve(info0, u0), rel=1e-8)
    assert tests["wald"].chi_square == pytest.approx(b @ info @ b, rel=1e-6)
    cut = cox.fit_cox(frame, "t", "e", TERMS, small_rows=3)
    assert cut.order.cuts and cut.coef == pytest.approx(b, rel=1e-8)


def test_repeated_columns(frame, cox_fit):
    twice = frame.withColumn("copy", F.col("x") * 3)
    terms = [TERMS[0], Num("copy"), TERMS[1]]
    fit = cox.fit_cox(twice, "t", "e", terms)
    assert math.isnan(fit.coef[1]) and fit.coef[[0, 2]] == pytest.approx(cox_fit.coef, rel=1e-7)
    assert fit.tests()["wald"].df == 2
    with pytest.raises(ValueError):
        cox.proportional_hazards_test(fit)
    both = weibull.fit_weibulls(twice, "t", "e", {"once": TERMS, "twice": terms})
    assert math.isnan(both["twice"].coef[2]) and both["twice"].rank == both["once"].rank
    assert both["twice"].coef[[0, 1, 3, 4]] == pytest.approx(both["once"].coef, rel=1e-6)
    assert both["twice"].std_error[[0, 1, 3, 4]] == pytest.approx(both["once"].std_error, rel=1e-6)


def test_tie_sums_for_many_ties(spark):
    """One time with 1000 tied events, risk sum just the events or far above: the closed form against the sum."""
    rows = []
    for d in (1, 2, 24, 25, 26, 1000, 100000):
        for extra in (0.0, 0.5, 50.0, 1e6):
            e = 0.7 * d
            rows.append((e + extra, e, d))
    df = spark.createDataFrame(rows, "s double, e double, d int").selectExpr(
        "*", "bigint(d) AS _d", "e / d AS _h", "s * d / e AS _a"
    ).selectExpr("*", f"_a - (_d - {cox.DIRECT_TERMS}) AS _b")
    for r in df.selectExpr("s", "e", "d", *[f"{q} AS {n}" for n, q in cox._tie_sums().items()]).collect():
        v = r.s - np.arange(r.d) / r.d * r.e
        assert r.h0 == pytest.approx(math.fsum(np.log(v)), rel=1e-11, abs=1e-9)
        assert r.h1 == pytest.approx(math.fsum(1 / v), rel=1e-10)
        assert r.h2 == pytest.approx(math.fsum(1 / v**2), rel=1e-10)


def test_proportional_hazards_by_loops(sample, cox_fit):
    t, e, x = design_matrix(sample)
    x = x - x.mean(axis=0)
    _, _, info, parts = numpy_cox(t, e, x, cox_fit.coef)
    g, s = {}, 1.0
    for v in np.unique(t):
        n, d = (t >= v).sum(), ((t == v) & (e == 1)).sum()
        g[v] = 1 - s
        s *= 1 - d / n
    centre = np.mean([g[v] for v in t[e == 1]])
    u = sum((g[v] - centre) * x[(t == v) & (e == 1)].sum(axis=0) for v in np.unique(t[e == 1]))
    u = u - sum((g[v] - centre) * m for v, m, _ in parts)
    xg = sum((g[v] - centre) * c for v, _, c in parts)
    gg = sum((g[v] - centre) ** 2 * c for v, _, c in parts)
    big = np.block([[info, xg], [xg, gg]])
    got = cox.proportional_hazards_test(cox_fit).tests
    full = np.concatenate([np.zeros(2), u])
    assert got["GLOBAL"].chi_square == pytest.approx(full @ np.linalg.solve(big, full), rel=1e-7) and got["GLOBAL"].df == 2
    for j, name in enumerate(("x", "locHome")):
        keep = [0, 1, 2 + j]
        v = full[keep]
        assert got[name].chi_square == pytest.approx(v @ np.linalg.solve(big[np.ix_(keep, keep)], v), rel=1e-7)


def test_schoenfeld_residuals_sum_to_zero(sample, cox_fit):
    t, e, x = design_matrix(sample)
    out = cox.schoenfeld_residuals(cox_fit).collect()
    assert sum(r["rows"] for r in out) == e.sum()
    for c in ("x", "locHome"):
        assert sum(r["rows"] * r[f"residual_{c}"] for r in out) == pytest.approx(0.0, abs=1e-6)
    _, _, _, parts = numpy_cox(t, e, x - x.mean(axis=0), cox_fit.coef)
    mean = {}
    for v, m, _ in parts:
        mean.setdefault(v, []).append(m)
    one = out[0]
    same = [i for i in range(len(t)) if t[i] == one["time"] and e[i] == 1]
    want = [(x[i] - x.mean(axis=0) - np.mean(mean[one["time"]], axis=0)) for i in same]
    res = np.array([one["residual_x"], one["residual_locHome"]])
    assert min(np.abs(w - res).max() for w in want) < 1e-7
    scaled = cox_fit.cov @ res * e.sum()
    assert [one["scaled_x"], one["scaled_locHome"]] == pytest.approx(scaled, rel=1e-6)
    assert one["beta_x"] == pytest.approx(scaled[0] + cox_fit.coef[0])


def brute_concordance(t, e, s):
    n = len(t)
    good, bad, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        for j in range(n):
            if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                kind = good if s[i] > s[j] else bad if s[i] < s[j] else same
                kind[i] += 1
                kind[j] += 1
    g, b, k = good.sum() / 2, bad.sum() / 2, same.sum() / 2
    pairs = g + b + k
    c = (g + k / 2) / pairs
    pull = good + same / 2 - c * (good + bad + same)
    return g, b, k, c, math.sqrt((pull**2).sum()) / pairs


@pytest.mark.parametrize("small", [None, 3])
@pytest.mark.parametrize("digits", [0, 3])
def test_concordance_against_all_pairs(spark, sample, small, digits):
    t, e, x, z = sample
    s = np.round(0.02 * x + 0.3 * z, digits)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(t, e, s)] + [(3, 1, None)], "t int, e int, s double")
    got = concord.concordance(df, "t", "e", "s", small_rows=small)
    want = brute_concordance(t, e, s)
    assert (got.concordant, got.discordant, got.tied_score) == want[:3]
    assert got.value == pytest.approx(want[3]) and got.std_error == pytest.approx(want[4])


def test_concordance_without_pairs(spark):
    df = spark.createDataFrame([(3, 1, 1.0), (3, 1, 2.0)], "t int, e int, s double")
    assert math.isnan(concord.concordance(df, "t", "e", "s").value)


def test_weibull_score_is_zero_and_errors_match_finite_differences(sample, frame):
    t, e, x = design_matrix(sample)
    fit = weibull.fit_weibull(frame, "t", "e", TERMS)
    assert fit.converged and fit.n == 220 and fit.n_dropped == 2

    def loglik(p):
        s = math.exp(p[-1])
        z = (np.log(t) - p[0] - x @ p[1:-1]) / s
        return float(np.sum(e * (z - p[-1] - np.log(t)) - np.exp(z)))

    assert fit.loglik == pytest.approx(loglik(fit.coef), rel=1e-10)
    h = 1e-4 * np.maximum(fit.std_error, 1e-8) * 10
    p = len(fit.coef)

    def at(i, a, j, b):
        q = fit.coef.copy()
        q[i] += a * h[i]
        q[j] += b * h[j]
        return loglik(q)

    for i in range(p):
        assert (at(i, 1, i, 0) - at(i, -1, i, 0)) / 2 / h[i] * fit.std_error[i] == pytest.approx(0.0, abs=1e-4)
    step = fit.std_error * 0.02
    h = step
    hess = np.array(
        [[(at(i, 1, j, 1) - at(i, 1, j, -1) - at(i, -1, j, 1) + at(i, -1, j, -1)) / (4 * h[i] * h[j]) for j in range(p)] for i in range(p)]
    )
    assert np.linalg.inv(-hess) == pytest.approx(fit.cov, rel=5e-3)
    null = weibull.fit_weibull(frame.where("x IS NOT NULL AND loc <> 'Neutral'"), "t", "e", [])
    assert fit.loglik_null == pytest.approx(null.loglik, rel=1e-10)


def test_weibull_ratios(spark, frame):
    fit = weibull.fit_weibull(frame, "t", "e", TERMS)
    rows = {r.term: r for r in fit.ratios(spark).collect()}
    s = fit.scale
    assert rows["gamma"].estimate == pytest.approx(1 / s) and rows["lambda"].estimate == pytest.approx(math.exp(-fit.coef[0] / s))
    assert rows["x"].hazard_ratio == pytest.approx(math.exp(-fit.coef[1] / s)) and rows["x"].time_ratio == pytest.approx(math.exp(fit.coef[1]))
    assert rows["locHome"].hr_lower < rows["locHome"].hazard_ratio < rows["locHome"].hr_upper


def test_weibull_refuses_times_at_zero(spark):
    df = spark.createDataFrame([(0, 1), (2, 1)], "t int, e int")
    with pytest.raises(ValueError, match="1 rows"):
        weibull.fit_weibull(df, "t", "e", [])


def test_doubling_the_data_halves_the_variance(frame, cox_fit):
    twice = weibull.fit_weibull(frame.union(frame), "t", "e", TERMS)
    once = weibull.fit_weibull(frame.repartition(7, "x"), "t", "e", TERMS)
    assert twice.coef == pytest.approx(once.coef, rel=1e-7) and twice.cov == pytest.approx(once.cov / 2, rel=1e-6)


# ---------------------------------------------------------------- plans


def big_reads(df):
    """Scans of row tables and shuffles by hash in a plan; small tables of bucket totals are broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sent = plan.count("BroadcastExchange")
    return plan.count("FileScan parquet") - sent, plan.count("hashpartitioning")


def many_times(spark):
    rng = np.random.default_rng(12)
    rows = [(float(t), int(e), g) for t, e, g in zip(rng.integers(1, 400, 900), rng.random(900) < 0.6, rng.choice(list("abc"), 900))]
    return spark.createDataFrame(rows, "t double, e int, g string")


def test_curves_read_their_rows_once(spark):
    df = many_times(spark)
    assert big_reads(survival.kaplan_meier(df, "t", "e", ["g"], small_rows=0)) == (1, 0)
    scans, shuffles = big_reads(survival.curve_summary(df, "t", "e", ["g"], small_rows=0))
    assert scans == 1 and shuffles <= 1


def test_bucketed_survival_equals_plain(spark):
    df = many_times(spark)
    for made in (
        lambda n: survival.kaplan_meier(df, "t", "e", ["g"], small_rows=n).orderBy("g", "time"),
        lambda n: survival.curve_summary(df, "t", "e", ["g"], small_rows=n).orderBy("g"),
        lambda n: survival.curve_summary(df, "t", "e", ["g"], end=150.5, small_rows=n).orderBy("g"),
    ):
        for a, b in zip(made(None).collect(), made(0).collect(), strict=True):
            assert [x for x in a] == [pytest.approx(y, rel=1e-10) if isinstance(y, float) else y for y in b]
    for rho in (0.0, 1.0):
        plain, cut = (survival.rank_test(df, "t", "e", "g", rho=rho, small_rows=n) for n in (None, 0))
        assert plain.chi_square == pytest.approx(cut.chi_square, rel=1e-10) and plain.p == pytest.approx(cut.p, rel=1e-9)
        assert {r["p"] for r in plain.table(spark).collect()} == {plain.p}


def test_cox_passes_do_not_shuffle(spark, frame, cox_fit):
    cut = cox.fit_cox(frame, "t", "e", TERMS, small_rows=3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = cox._time_table(cut.cells, cut.labels, cut.means, cut.coef, cut.order)
        assert big_reads(table) == (1, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    plain, ranged = (cox.proportional_hazards_test(f).tests for f in (cox_fit, cut))
    for term, test in plain.items():
        assert ranged[term].chi_square == pytest.approx(test.chi_square, rel=1e-8)
    a, b = (cox.schoenfeld_residuals(f).orderBy("time", "rows", "residual_x").collect() for f in (cox_fit, cut))
    assert len(a) == len(b)
    for p, q in zip(a, b):
        assert [x for x in p] == pytest.approx([x for x in q], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("small", [0, None])
def test_nan_is_left_out_like_null(spark, small):
    rng = np.random.default_rng(3)
    rows = [(float(t), int(e), float(v), float(v > 0.2)) for t, e, v in zip(rng.integers(1, 60, 300), rng.random(300) < 0.7, rng.normal(size=300))]
    odd = [(math.nan, 1, 0.5, 1.0), (5.0, 1, math.nan, 0.0), (6.0, 0, math.nan, 1.0)]
    clean, dirty = (spark.createDataFrame(r, "t double, e int, v double, w double") for r in (rows, rows + odd))
    a, b = (cox.fit_cox(d, "t", "e", [Num("v")], small_rows=small) for d in (clean, dirty))
    assert b.coef == pytest.approx(a.coef, rel=1e-9) and (a.n, a.n_dropped, b.n, b.n_dropped) == (300, 0, 300, 2)
    a, b = (weibull.fit_weibull(d, "t", "e", [Num("v")]) for d in (clean, dirty))
    assert b.coef == pytest.approx(a.coef, rel=1e-9) and b.n == 300
    from touchline.operators import logit

    timed_rows = (d.where(~F.isnan("t")) for d in (clean, dirty))
    a, b = (logit.fit_logit(d, F.col("e") == 1, [Num("v")]) for d in timed_rows)
    assert b.coef == pytest.approx(a.coef, rel=1e-9) and b.converged and b.n_dropped == 2


@pytest.mark.parametrize("rho", [0.0, 1.0])
@pytest.mark.parametrize("small", [None, 0])
def test_many_groups_equal_few(spark, monkeypatch, rho, small):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(1, 300)), int(rng.random() < 0.6), f"g{rng.integers(0, 30):02d}") for _ in range(3000)]
    df = spark.createDataFrame([*rows, (None, 1, "g00"), (5.0, 1, None), (float("nan"), 1, "g01")], "t double, e int, g string")
    one = survival.rank_test(df, "t", "e", "g", rho=rho)
    monkeypatch.setattr(survival, "WIDE_GROUPS", 1)
    two = survival.rank_test(df, "t", "e", "g", rho=rho, small_rows=small)
    for name in ("n", "observed", "expected", "variance"):
        np.testing.assert_allclose(getattr(two, name), getattr(one, name), rtol=1e-9, atol=1e-9)
    assert two.chi_square == pytest.approx(one.chi_square, rel=1e-9) and two.df == one.df == 29


def test_hundred_groups(spark):
    rng = np.random.default_rng(5)
    t, e, g = rng.integers(1, 50, 4000), rng.random(4000) < 0.7, rng.integers(0, 100, 4000)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(t, e, g)], "t double, e int, g int")
    got = survival.rank_test(df, "t", "e", "g", levels=[*range(100), 777])
    gap, var = np.zeros(100), np.zeros((100, 100))
    for u in np.unique(t):
        risk, dead = np.bincount(g[t >= u], minlength=100), np.bincount(g[(t == u) & e], minlength=100)
        n, d = risk.sum(), dead.sum()
        gap += dead - d * risk / n
        if n > 1:
            var += d * (n - d) / (n - 1) * (np.diag(risk / n) - np.outer(risk, risk) / n**2)
    assert got.chi_square == pytest.approx(gap[1:] @ np.linalg.solve(var[1:, 1:], gap[1:]), rel=1e-8)
    assert got.df == 99 and got.n[100] == 0 and 0 < got.p < 1
    table = got.group_table(spark).where("g = '777'").first()
    assert table["std_error"] == 0 and table["z"] is None


@pytest.mark.parametrize("flat", [45.0, 0.1])
def test_proportional_hazards_beside_repeated_columns(frame, cox_fit, flat):
    twice = frame.withColumns({"copy": F.col("x") * 3, "flat": F.lit(flat)})
    fit = cox.fit_cox(twice, "t", "e", [Num("flat"), TERMS[0], Num("copy"), TERMS[1]])
    got = cox.proportional_hazards_test(fit, allow_dropped=True).tests
    want = cox.proportional_hazards_test(cox_fit).tests
    assert all(math.isnan(got[c].chi_square) and got[c].df == 0 and math.isnan(got[c].p) for c in ("flat", "copy"))
    for c in ("x", "locHome", "GLOBAL"):
        assert got[c].chi_square == pytest.approx(want[c].chi_square, rel=1e-6) and got[c].df == want[c].df


@pytest.mark.parametrize("flat", [45.0, 0.1])
def test_schoenfeld_residuals_beside_a_constant_column(frame, cox_fit, flat):
    fit = cox.fit_cox(frame.withColumn("flat", F.lit(flat)), "t", "e", [Num("flat"), *TERMS])
    with pytest.raises(ValueError):
        cox.schoenfeld_residuals(fit)
    order = ["time", "rows", "residual_x", "residual_locHome"]
    got, want = (cox.schoenfeld_residuals(f, allow_dropped=True).orderBy(*order).collect() for f in (fit, cox_fit))
    assert len(got) == len(want) and all(r["residual_flat"] == pytest.approx(0.0, abs=1e-9) for r in got)
    assert all(math.isnan(r["scaled_flat"]) and math.isnan(r["beta_flat"]) for r in got)
    for a, b in zip(got, want):
        assert [a[c] for c in b.asDict()] == pytest.approx(list(b), rel=1e-6, abs=1e-9)
