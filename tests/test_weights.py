"""A grouped frame with a count column gives the same answers as its rows."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import concordance as concord
from touchline.operators import cox, describe, evaluate, logit, survival, weibull
from touchline.operators.terms import Cat, Num
from touchline.plans import league

SF = "/root/testdata/sf0.001"
TERMS = [Num("ref_pts"), Cat("loc", ["Away", "Home"])]


@pytest.fixture(scope="module")
def sides(spark):
    return league.stage(league.durations(spark, SF)), league.duration_counts(spark, SF)


@pytest.fixture(scope="module")
def matches(spark):
    return league.stage(league.outcomes(spark, SF)), league.stage(league.outcome_counts(spark, SF))


def won():
    return F.col("result") == "Win"


def test_grouped_frames_hold_all_rows(sides, matches):
    for rows, counts in (sides, matches):
        assert counts.count() < rows.count() == counts.agg(F.sum("n")).first()[0]


def test_survival(spark, sides):
    rows, counts = sides
    one = survival.kaplan_meier(rows, "goaltime", "cens", ["loc"])
    two = survival.kaplan_meier(counts, "goaltime", "cens", ["loc"], weight="n")
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()
    a = survival.rank_test(rows, "goaltime", "cens", "loc", rho=1)
    b = survival.rank_test(counts, "goaltime", "cens", "loc", rho=1, weight="n")
    assert a.chi_square == pytest.approx(b.chi_square)
    assert survival.curve_summary(rows, "goaltime", "cens").first() == survival.curve_summary(counts, "goaltime", "cens", weight="n").first()


def test_duration_models(sides):
    rows, counts = sides
    for fit in (cox.fit_cox, weibull.fit_weibull):
        a, b = fit(rows, "goaltime", "cens", TERMS), fit(counts, "goaltime", "cens", TERMS, weight="n")
        assert (a.n, a.events, a.n_dropped) == (b.n, b.events, b.n_dropped)
        assert a.coef == pytest.approx(b.coef, rel=1e-9) and a.cov == pytest.approx(b.cov, rel=1e-6)
    pairs = [
        concord.concordance(rows, "goaltime", "cens", "ref_pts"),
        concord.concordance(counts, "goaltime", "cens", "ref_pts", weight="n"),
    ]
    assert pairs[0].concordant == pairs[1].concordant and pairs[0].std_error == pytest.approx(pairs[1].std_error)


def test_outcome_tables_and_models(matches):
    rows, counts = matches
    a = describe.rate_table(rows, ["home_pts"], won())
    assert a.exceptAll(describe.rate_table(counts, ["home_pts"], won(), weight="n")).count() == 0
    a = describe.class_shares(rows, "result")
    assert a.exceptAll(describe.class_shares(counts, "result", weight="n")).count() == 0
    terms = [Num("home_pts"), Cat("distance", ["Short", "Long"])]
    a, b = logit.fit_logit(rows, won(), terms), logit.fit_logit(counts, won(), terms, weight="n")
    assert (a.n, a.wins, a.n_dropped) == (b.n, b.wins, b.n_dropped) and a.coef == pytest.approx(b.coef, rel=1e-9)
    ranked = [
        evaluate.area_under_roc(evaluate.rank_scores(df.withColumn("s", a.score()), won(), "s", weight=w)).first().auc
        for df, w in ((rows, None), (counts, "n"))
    ]
    assert ranked[0] == pytest.approx(ranked[1])
    tests = [logit.hosmer_lemeshow(df.withColumn("s", a.score()), won(), "s", weight=w) for df, w in ((rows, None), (counts, "n"))]
    assert tests[0].chi_square == pytest.approx(tests[1].chi_square)
