"""The registered queries: every operator run over the driver's tables, read as a league."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import columns as C
from touchline.operators import concordance as concord
from touchline.operators import cox, describe, evaluate, joins, logit, reshape, survival, weibull
from touchline.operators.ordered import quantile_bins
from touchline.operators.staging import scratch_path, stage
from touchline.operators.terms import Cat, Inter, Num
from touchline.plans import league
from touchline.plans.frames import FINAL_COEFFICIENTS, FINAL_MODEL
from touchline.sources.csv_tables import read_results

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}

PTS = [Num("home_pts"), Num("away_pts")]
DISTANCE = Cat("distance", C.DISTANCES)
PERIOD = Cat("period", C.PERIODS)
SIDE_TERMS = [Num("ref_pts"), Num("adv_pts"), Cat("loc", C.LOCATIONS)]
STRENGTH = ["position", "pts", "gd", "gf", "ga"]


def win() -> Column:
    return F.col("result") == "Win"


def query(fn: Query) -> Query:
    _registered[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_registered)


def r6(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Round for comparison between engines; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in cols})


# ---- sources, projections, filters


@query
def csv_roundtrip(spark, sf):
    """Write the matches as a results file with day-month-year dates and NA cells, read it with the CSV source."""
    path = scratch_path(spark)
    m = league.matches(spark, sf)
    m.select(
        F.date_format("date", "dd/MM/yyyy").alias("Date"),
        F.col("home").alias("HomeTeam"),
        F.col("away").alias("AwayTeam"),
        F.col("ftr").alias("FTR"),
        F.col("fhg").alias("FHG"),
        F.col("fag").alias("FAG"),
    ).write.option("header", True).option("nullValue", "NA").csv(path)
    back = read_results(spark, path, goals=True)
    return back.groupBy("home", "away", "ftr").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("fhg").alias("fhg"),
        F.sum("fag").alias("fag"),
        F.count_if(F.col("fag").isNull()).alias("no_away_goal"),
    )


@query
def period_flag(spark, sf):
    m = league.matches(spark, sf)
    return m.groupBy("date", C.period_flag(F.col("date"), league.CUTOFF).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query
def outcome_recode(spark, sf):
    m = league.matches(spark, sf).withColumn("result", C.outcome_class(F.col("ftr")))
    return (
        m.withColumn("result_bin", C.indicator(win()))
        .groupBy("home", "ftr", "result", "result_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def exclude_sides(spark, sf):
    m = joins.drop_either_side(league.matches(spark, sf), league.PROMOTED)
    return m.groupBy("home", "away").agg(F.count(F.lit(1)).alias("n"))


@query
def position_filter(spark, sf):
    return league.standings(spark, sf)


@query
def strength_class(spark, sf):
    m = joins.attach_sides(league.matches(spark, sf).select("home", "away"), league.standings(spark, sf).select("team", "position"))
    return m.groupBy(
        C.strength_class(F.col("home_position")).alias("home_ability"), C.strength_class(F.col("away_position")).alias("away_ability")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- joins


@query
def attach_sides(spark, sf):
    m = joins.attach_sides(league.matches(spark, sf).select("home", "away", "ftr"), league.standings(spark, sf))
    cols = [f"{s}_{c}" for s in ("home", "away") for c in STRENGTH]
    return m.groupBy("home", "away", *cols).agg(F.count(F.lit(1)).alias("n"))


@query
def pair_distance(spark, sf):
    pairs = joins.pair_distances(league.matches(spark, sf), league.venues(spark, sf))
    return r6(pairs, ["distance_km"])


@query
def pair_lookup(spark, sf):
    """Distances looked up through the two-column key, as a table of pairs would be."""
    m = league.matches(spark, sf).select("home", "away", "ftr")
    pairs = joins.pair_distances(m, league.venues(spark, sf))
    out = joins.attach_pair(m, pairs)
    return r6(out.groupBy("ftr").agg(F.count(F.lit(1)).alias("n"), F.avg("distance_km").alias("mean_km")), ["mean_km"])


@query
def distance_class(spark, sf):
    m = joins.attach_distance(league.matches(spark, sf).select("home", "away"), league.venues(spark, sf))
    classed = m.withColumn("distance", C.distance_class(F.col("distance_km"), league.SHORT_KM))
    return classed.groupBy("home", "distance").agg(F.count(F.lit(1)).alias("n"))


@query
def semi_keys(spark, sf):
    teams = joins.keep_keys(league.all_standings(spark, sf), "team", league.matches(spark, sf), "away")
    return teams.select("team", "position", "pts")


@query
def anti_keys(spark, sf):
    promoted = league.all_standings(spark, sf).where(F.col("position") > league.SAFE)
    m = joins.drop_keys(joins.drop_keys(league.matches(spark, sf), "home", promoted, "team"), "away", promoted, "team")
    return m.groupBy("home", "ftr").agg(F.count(F.lit(1)).alias("n"))


@query
def unmatched_sides(spark, sf):
    return joins.unmatched_keys(league.matches(spark, sf), league.standings(spark, sf), "home")


# ---- reshape


@query
def two_sided(spark, sf):
    rows = reshape.two_sided(league.matches(spark, sf), keep=["ftr"])
    return rows.groupBy("ref", "loc", "ftr").agg(
        F.count(F.lit(1)).alias("n"), F.count("time").alias("timed"), F.sum("time").alias("total_time")
    )


@query
def censor_fill(spark, sf):
    d = league.durations(spark, sf)
    return d.groupBy("cens", "goaltime").agg(F.count(F.lit(1)).alias("n"))


@query
def combo_label(spark, sf):
    d = league.durations(spark, sf)
    label = C.combination_label(F.col("ref_ability"), F.col("loc"), F.col("adv_ability"))
    return d.groupBy(label.alias("combination")).agg(F.count(F.lit(1)).alias("n"))


@query
def censored_label(spark, sf):
    d = league.durations(spark, sf)
    return d.groupBy(C.censored_label(F.col("goaltime"), F.col("cens")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def first_matches(spark, sf):
    """The earliest matches and the rows at positions 3 and 11 of the same order."""
    m = league.matches(spark, sf)
    order = ["date", "l_orderkey", "l_linenumber", "home", "away", "ftr", "fhg", "fag"]
    return reshape.pick_positions(m, order, [1, 3, 11]).select("row", "l_orderkey", "date", "home")


@query
def deep_positions(spark, sf):
    """The line items at three places in order of quantity, two of them beyond the top that is sorted as a whole."""
    order = ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey"]
    return reshape.pick_positions(league.table(spark, sf, "lineitem").select(order), order, [2, 10_001, 33_333])


@query
def drop_columns(spark, sf):
    m = league.matches(spark, sf).drop("l_orderkey", "l_linenumber", "fhg", "fag", "date")
    return m.where(F.col("ftr") == "H").groupBy("home", "away").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_teams(spark, sf):
    return joins.distinct_values(league.matches(spark, sf), "home")


# ---- descriptive tables


@query
def outcome_share(spark, sf):
    return r6(describe.class_shares(league.outcomes(spark, sf), "result"), ["share"])


def _rates(spark, sf, keys):
    t = describe.rate_table(league.outcome_counts(spark, sf), keys, win(), weight="n")
    return r6(t, ["win_rate", "win_logit"])


@query
def rate_by_home_points(spark, sf):
    return _rates(spark, sf, ["home_pts"])


@query
def rate_by_away_points(spark, sf):
    return _rates(spark, sf, ["away_pts"])


@query
def rate_by_distance(spark, sf):
    return _rates(spark, sf, ["distance"])


@query
def rate_by_period(spark, sf):
    return _rates(spark, sf, ["period"])


@query
def rate_by_home_points_distance(spark, sf):
    return _rates(spark, sf, ["home_pts", "distance"])


@query
def rate_by_away_points_distance(spark, sf):
    return _rates(spark, sf, ["away_pts", "distance"])


@query
def freq_levels(spark, sf):
    """A level that no row has keeps its zero count."""
    t = describe.level_counts(league.outcome_counts(spark, sf), "distance", [*C.DISTANCES, "Missing", "Unknown"], weight="n")
    return r6(t, ["percent"])


@query
def freq_censored(spark, sf):
    return r6(describe.level_counts(league.durations(spark, sf), "cens", [0, 1]), ["percent"])


@query
def summary_stats(spark, sf):
    return r6(describe.summary_stats(league.outcomes(spark, sf), ["home_pts", "away_pts", "distance_km"]), ["mean", "min", "max"])


@query
def mean_by_bin(spark, sf):
    o = league.outcomes(spark, sf)
    return r6(describe.mean_by(o, "distance", ["result_bin", "distance_km"]), ["mean_result_bin", "mean_distance_km"])


@query
def strength_corr(spark, sf):
    """Correlation matrix of the five strength measures over the matches of sides with a standing."""
    o = league.outcomes(spark, sf).where(F.col("home_pts").isNotNull())
    return r6(describe.correlation_matrix(o, [f"home_{c}" for c in STRENGTH]), ["value"])


@query
def rate_trend(spark, sf):
    t = describe.rate_table(league.outcome_counts(spark, sf), ["home_pts"], win(), weight="n")
    return r6(describe.trend_line(t, "home_pts", "win_rate"), ["slope", "intercept"])


@query
def logit_trend(spark, sf):
    t = describe.rate_table(league.outcome_counts(spark, sf), ["away_pts"], win(), weight="n")
    return r6(describe.trend_line(t, "away_pts", "win_logit"), ["slope", "intercept"])


@query
def hist_times(spark, sf):
    return describe.histogram(league.durations(spark, sf), "goaltime", 15)


@query
def hist_event_times(spark, sf):
    return describe.histogram(league.durations(spark, sf).where("cens = 1"), "goaltime", 15)


@query
def first_event_outcome(spark, sf):
    return describe.first_event_outcome(league.matches(spark, sf))


@query
def score_deciles(spark, sf):
    """Ten equal-count bins of the order value."""
    orders = league.table(spark, sf, "orders").select("o_totalprice")
    binned, _ = quantile_bins(orders, "o_totalprice", 10, "bin")
    t = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.avg("o_totalprice").alias("mean")
    )
    return r6(t, ["low", "high", "mean"])


# ---- outcome model


def _coefs(table: DataFrame, cols=("estimate", "std_error")) -> DataFrame:
    """Coefficients with z (to four places: it runs into the hundreds) and p."""
    return r6(table.select("term", *cols, F.round("z", 4).alias("z"), "p"), [*cols, "p"])


@query
def logit_week(spark, sf):
    """Home wins by week of the year: a factor of 53 levels."""
    weeks = [f"{w:02d}" for w in range(1, 54)]
    rows = league.matches(spark, sf).select(F.lpad(F.weekofyear("date"), 2, "0").alias("week"), (F.col("ftr") == "H").alias("won"))
    return _coefs(logit.fit_logit(rows, F.col("won"), [Cat("week", weeks)]).coef_table(spark))


@query
def logit_null(spark, sf):
    fit = logit.fit_logit(league.outcomes(spark, sf), win(), [])
    return _coefs(fit.coef_table(spark))


@query
def logit_distance(spark, sf):
    return _coefs(logit.fit_logit(league.outcomes(spark, sf), win(), [DISTANCE]).coef_table(spark))


@query
def logit_period(spark, sf):
    return _coefs(logit.fit_logit(league.outcome_counts(spark, sf), win(), [PERIOD], weight="n").coef_table(spark))


@query
def logit_points(spark, sf):
    return _coefs(logit.fit_logit(league.outcome_counts(spark, sf), win(), PTS, weight="n").coef_table(spark))


@query
def logit_final(spark, sf):
    return _coefs(logit.fit_logit(league.outcome_counts(spark, sf), win(), FINAL_MODEL, weight="n").coef_table(spark), ("estimate", "std_error", "odds_ratio"))


@query
def logit_summary(spark, sf):
    s = logit.fit_logit(league.outcome_counts(spark, sf), win(), [Cat("distance", C.DISTANCES), PERIOD, Inter(DISTANCE, PERIOD)], weight="n").summary(spark).drop("passes")
    return r6(s, ["null_deviance", "deviance", "aic"])


CANDIDATES = {
    "positions": [Num("home_position"), Num("away_position")],
    "points": PTS,
    "goal_difference": [Num("home_gd"), Num("away_gd")],
    "goals": [Num("home_gf"), Num("home_ga"), Num("away_gf"), Num("away_ga")],
    "null": [],
    "home_points": [Num("home_pts")],
    "away_points": [Num("away_pts")],
    "period": [PERIOD],
    "distance": [DISTANCE],
    "home_points_period": [Num("home_pts"), PERIOD],
    "home_points_distance": [Num("home_pts"), DISTANCE],
    "points_period": [*PTS, PERIOD],
    "points_distance": [*PTS, DISTANCE],
    "points_distance_period": [*PTS, DISTANCE, PERIOD],
    "home_x_away": [*PTS, DISTANCE, Inter(*PTS)],
    "home_x_distance": [*PTS, DISTANCE, Inter(PTS[0], DISTANCE)],
    "away_x_distance": [*PTS, DISTANCE, Inter(PTS[1], DISTANCE)],
}


@query
def logit_compare(spark, sf):
    """All candidate models of the selection, fitted together in shared passes."""
    fits = logit.fit_logits(league.outcome_counts(spark, sf), win(), CANDIDATES, weight="n")
    t = logit.compare_models(fits, spark)
    return r6(t.withColumn("all_significant", F.col("all_significant").cast("int")), ["deviance", "aic"])


@query
def forward_choice(spark, sf):
    steps = [
        {k: CANDIDATES[k] for k in ("home_points", "away_points", "period", "distance")},
        {k: CANDIDATES[k] for k in ("points", "home_points_period", "home_points_distance")},
        {k: CANDIDATES[k] for k in ("points_period", "points_distance")},
        {k: CANDIDATES[k] for k in ("points_distance_period", "home_x_away", "home_x_distance", "away_x_distance")},
    ]
    best, fits = logit.choose_forward(league.outcome_counts(spark, sf), win(), steps, weight="n")
    return r6(spark.createDataFrame([(best, fits[best].aic)], "model string, aic double"), ["aic"])


@query
def lrt_nested(spark, sf):
    models = {"small": [DISTANCE], "large": [DISTANCE, PERIOD, Inter(DISTANCE, PERIOD)]}
    fits = logit.fit_logits(league.outcome_counts(spark, sf), win(), models, weight="n")
    t = logit.nested_test(fits["small"], fits["large"])
    return r6(spark.createDataFrame([(t.chi_square, t.df, t.p)], "chi_square double, df int, p double"), ["chi_square", "p"])


@query
def odds_profile_ci(spark, sf):
    _, t = logit.profile_intervals(league.outcome_counts(spark, sf), win(), FINAL_MODEL, weight="n", allow_dropped=True)
    return r6(t, ["estimate", "lower", "upper", "odds_ratio", "or_lower", "or_upper"])


@query
def profile_ci_distance(spark, sf):
    _, t = logit.profile_intervals(league.outcome_counts(spark, sf), win(), [DISTANCE], weight="n", allow_dropped=True)
    return r6(t.select("term", "lower", "upper"), ["lower", "upper"])


@query
def predict_published(spark, sf):
    """Scores of every match under given coefficients, averaged per design row."""
    fit = logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS)
    o = league.outcomes(spark, sf).withColumn("score", fit.score())
    t = o.groupBy("home_pts", "away_pts", "distance").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
    return r6(t, ["score"])


@query
def effect_grid(spark, sf):
    """Fitted win probability along home points at the mean of away points, for both distances."""
    o = league.outcomes(spark, sf)
    low, high, mean = o.agg(F.min("home_pts"), F.max("home_pts"), F.avg("away_pts")).first()
    grid = reshape.value_grid(low, high, 0.1, "home_pts", o)
    full = grid.select("home_pts", F.lit(mean).alias("away_pts"), F.explode(F.array(*[F.lit(v) for v in C.DISTANCES])).alias("distance"))
    return r6(logit.effect_grid(logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS), full), ["home_pts", "away_pts", "fitted"])


@query
def effect_grid_away(spark, sf):
    """Fitted win probability along away points at the mean of home points, for both distances."""
    o = league.outcomes(spark, sf)
    low, high, mean = o.agg(F.min("away_pts"), F.max("away_pts"), F.avg("home_pts")).first()
    grid = reshape.value_grid(low, high, 0.1, "away_pts", o)
    full = grid.select(F.lit(mean).alias("home_pts"), "away_pts", F.explode(F.array(*[F.lit(v) for v in C.DISTANCES])).alias("distance"))
    return r6(logit.effect_grid(logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS), full), ["home_pts", "away_pts", "fitted"])


@query
def residuals(spark, sf):
    """Residuals, leverage and Cook's distance of the fitted model, per distinct design row and result."""
    o = league.outcomes(spark, sf)
    fit = logit.fit_logit(o, win(), FINAL_MODEL)
    cols = ["score", "pearson", "leverage", "std_pearson", "cooks_distance"]
    t = logit.with_residuals(o, win(), fit).groupBy("home_pts", "away_pts", "distance", "result").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]
    )
    return r6(t, cols)


@query
def calibration(spark, sf):
    o = league.outcome_counts(spark, sf).withColumn("score", logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS).score())
    return r6(logit.calibration(o, win(), "score", weight="n"), ["expected", "observed_rate", "predicted_rate"])


@query
def hosmer_lemeshow(spark, sf):
    o = league.outcome_counts(spark, sf).withColumn("score", logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS).score())
    t = logit.hosmer_lemeshow(o, win(), "score", weight="n")
    row = (t.chi_square, t.df, t.groups, t.p)
    return r6(spark.createDataFrame([row], "chi_square double, df int, n_groups int, p double"), ["chi_square", "p"])


@query
def vif(spark, sf):
    fit = logit.fit_logit(league.outcome_counts(spark, sf), win(), FINAL_MODEL, weight="n")
    return r6(spark.createDataFrame(list(logit.variance_inflation(fit, allow_dropped=True).items()), "term string, vif double"), ["vif"])


# ---- classifier evaluation: scores of the published coefficients


def _scored(spark, sf) -> DataFrame:
    fit = logit.fixed_logit(FINAL_MODEL, FINAL_COEFFICIENTS)
    return league.outcome_counts(spark, sf).select("result", "home_pts", "n", fit.score().alias("score"))


@query
def roc_table(spark, sf):
    ranked = evaluate.rank_scores(_scored(spark, sf), win(), "score", weight="n")
    return r6(evaluate.roc_table(ranked), ["threshold", "sensitivity", "specificity"])


@query
def roc_customer_balance(spark, sf):
    """ROC area of a score with as many values as customers: account balance against building-segment membership."""
    c = league.table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")
    ranked = evaluate.rank_scores(c, F.col("c_mktsegment") == "BUILDING", "c_acctbal")
    return r6(evaluate.area_under_roc(ranked).withColumn("higher_score_wins", F.col("higher_score_wins").cast("int")), ["auc"])


@query
def auc(spark, sf):
    ranked = evaluate.rank_scores(_scored(spark, sf), win(), "score", weight="n")
    return r6(evaluate.area_under_roc(ranked).withColumn("higher_score_wins", F.col("higher_score_wins").cast("int")), ["auc"])


@query
def best_threshold(spark, sf):
    ranked = evaluate.rank_scores(_scored(spark, sf), win(), "score", weight="n")
    return r6(evaluate.best_thresholds(ranked), ["threshold", "sensitivity", "specificity"])


def _best_cut(scored: DataFrame) -> float:
    """The lowest of the best thresholds."""
    best = evaluate.best_thresholds(evaluate.rank_scores(scored, win(), "score", weight="n"))
    return best.agg(F.min("threshold")).first()[0]


@query
def classify(spark, sf):
    scored = stage(_scored(spark, sf))  # read for the threshold and again for the classes
    called = scored.withColumn("predicted", evaluate.classify(F.col("score"), _best_cut(scored)))
    return called.groupBy("home_pts", "predicted").agg(F.sum("n").alias("n"))


@query
def confusion(spark, sf):
    scored = stage(_scored(spark, sf))
    c = evaluate.confusion(scored, evaluate.classify(F.col("score"), _best_cut(scored)), F.col("result"), weight="n")
    return r6(c.table(spark), ["value"])


@query
def heldout_season(spark, sf):
    """Fit on the matches up to the cut-off, score the later ones without their own list of sides, and judge the calls."""
    early = league.outcome_counts(spark, sf).where(F.col("period") == "Pre")
    fit = logit.fit_logit(early, win(), FINAL_MODEL, weight="n")
    later = league.outcomes(spark, sf, grouped=True, promoted=league.PROMOTED_LATER).where(F.col("period") == "Post")
    scored = stage(later.select("result", "n", fit.score().alias("score")))
    area = evaluate.area_under_roc(evaluate.rank_scores(scored, win(), "score", weight="n")).first()["auc"]
    cut = _best_cut(scored)
    c = evaluate.confusion(scored, evaluate.classify(F.col("score"), cut), F.col("result"), weight="n")
    row = (int(early.agg(F.sum("n")).first()[0]), area, cut, c.true_pos, c.false_neg, c.false_pos, c.true_neg)
    names = "n_train bigint, auc double, threshold double, true_pos bigint, false_neg bigint, false_pos bigint, true_neg bigint"
    return r6(spark.createDataFrame([row], names), ["auc", "threshold"])


# ---- survival


CURVE = ["survival", "std_err", "lower", "upper", "cum_hazard"]


@query
def km_overall(spark, sf):
    return r6(survival.kaplan_meier(league.durations(spark, sf), "goaltime", "cens"), ["time", *CURVE])


def _km(spark, sf, by):
    return r6(survival.kaplan_meier(league.durations(spark, sf), "goaltime", "cens", [by]), ["time", *CURVE])


@query
def km_by_location(spark, sf):
    return _km(spark, sf, "loc")


@query
def km_by_period(spark, sf):
    return _km(spark, sf, "period")


@query
def km_by_ref_ability(spark, sf):
    return _km(spark, sf, "ref_ability")


@query
def km_by_adv_ability(spark, sf):
    return _km(spark, sf, "adv_ability")


def _with_combination(d: DataFrame) -> DataFrame:
    label = C.combination_label(F.col("ref_ability"), F.col("loc"), F.col("adv_ability"))
    return d.withColumn("combination", C.on_list(label, C.COMBINATIONS))


@query
def km_by_combination(spark, sf):
    d = _with_combination(league.durations(spark, sf))
    return r6(survival.kaplan_meier(d, "goaltime", "cens", ["combination"]), ["time", *CURVE])


@query
def km_first_purchase(spark, sf):
    return r6(survival.kaplan_meier(league.purchase_times(spark, sf), "minute", "bought", ["signup"]), ["time", *CURVE])


@query
def km_summary(spark, sf):
    t = survival.curve_summary(league.durations(spark, sf), "goaltime", "cens", ["adv_ability"])
    return r6(t, ["rmean", "se_rmean", "median", "lower_median", "upper_median"])


@query
def km_summary_first_purchase(spark, sf):
    t = survival.curve_summary(league.purchase_times(spark, sf), "minute", "bought", ["signup"])
    return r6(t, ["rmean", "se_rmean", "median", "lower_median", "upper_median"])


@query
def km_median(spark, sf):
    curve = survival.kaplan_meier(league.durations(spark, sf), "goaltime", "cens", ["loc"])
    return r6(survival.median_survival(curve, ["loc"]), ["median", "lower_median", "upper_median"])


@query
def cumhaz_loglog(spark, sf):
    curve = survival.kaplan_meier(league.durations(spark, sf), "goaltime", "cens", ["loc"])
    return r6(survival.cumulative_hazard(curve, ["loc"]), ["time", "log_time", "cum_hazard", "log_cum_hazard"])


def _cumhaz_combinations(spark, sf, loc: str) -> DataFrame:
    d = _with_combination(league.durations(spark, sf).where(F.col("loc") == loc))
    curve = survival.kaplan_meier(d, "goaltime", "cens", ["combination"])
    return r6(survival.cumulative_hazard(curve, ["combination"]), ["time", "log_time", "cum_hazard", "log_cum_hazard"])


@query
def cumhaz_home_combinations(spark, sf):
    """Log cumulative hazard of the eight combinations, home rows only."""
    return _cumhaz_combinations(spark, sf, "Home")


@query
def cumhaz_away_combinations(spark, sf):
    """The same for the away rows."""
    return _cumhaz_combinations(spark, sf, "Away")


def _rank(spark, d, group, levels, rho):
    t = survival.rank_test(d, "goaltime", "cens", group, levels, rho).table(spark)
    return r6(t.withColumnRenamed(group, "level"), ["observed", "expected", "chi_square", "p"])


@query
def logrank_ref_ability(spark, sf):
    return _rank(spark, league.durations(spark, sf), "ref_ability", C.ABILITIES, 0)


@query
def logrank_combination(spark, sf):
    return _rank(spark, _with_combination(league.durations(spark, sf)), "combination", C.COMBINATIONS, 0)


@query
def logrank_side_location(spark, sf):
    """Every side at home and away, more groups than stand side by side in one row."""
    d = league.durations(spark, sf).withColumn("side", F.concat_ws(" ", "ref", "loc"))
    t = survival.rank_test(d, "goaltime", "cens", "side").group_table(spark)
    return r6(t, ["observed", "expected", "std_error", "z"])


@query
def weighted_rank_location(spark, sf):
    return _rank(spark, league.durations(spark, sf), "loc", C.LOCATIONS, 1)


@query
def weighted_rank_period(spark, sf):
    return _rank(spark, league.durations(spark, sf), "period", C.PERIODS, 1)


@query
def weighted_rank_adv_ability(spark, sf):
    return _rank(spark, league.durations(spark, sf), "adv_ability", C.ABILITIES, 1)


# ---- Weibull


@query
def weibull_shape(spark, sf):
    fit = weibull.fit_weibull(league.durations(spark, sf), "goaltime", "cens", [])
    return _coefs(fit.coef_table(spark))


@query
def weibull_fit(spark, sf):
    fit = weibull.fit_weibull(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    return _coefs(fit.coef_table(spark))


@query
def weibull_lrt(spark, sf):
    models = {"small": SIDE_TERMS, "large": [*SIDE_TERMS, PERIOD]}
    fits = weibull.fit_weibulls(league.durations(spark, sf), "goaltime", "cens", models)
    t = weibull.nested_weibull_test(fits["small"], fits["large"])
    whole = fits["large"].model_test
    row = (fits["large"].loglik, fits["large"].loglik_null, whole.chi_square, whole.p, t.chi_square, t.p, t.df)
    values = ["loglik", "loglik_null", "model_chi_square", "model_p", "chi_square", "p"]
    return r6(spark.createDataFrame([row], ", ".join(f"{v} double" for v in values) + ", df int"), values)


@query
def weibull_ratios(spark, sf):
    fit = weibull.fit_weibull(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    t = fit.ratios(spark)
    return r6(t, t.columns[1:])


@query
def weibull_first_purchase(spark, sf):
    fit = weibull.fit_weibull(league.purchase_times(spark, sf), "minute", "bought", [Num("actions"), Cat("signup", ["No", "Yes"])])
    return _coefs(fit.coef_table(spark))


# ---- Cox


@query
def cox_location(spark, sf):
    fit = cox.fit_cox(league.durations(spark, sf), "goaltime", "cens", [Cat("loc", C.LOCATIONS)])
    return _coefs(fit.coef_table(spark), ("estimate", "std_error", "hazard_ratio", "hr_lower", "hr_upper"))


@query
def cox_points(spark, sf):
    fit = cox.fit_cox(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    return _coefs(fit.coef_table(spark), ("estimate", "std_error"))


@query
def cox_first_purchase(spark, sf):
    fit = cox.fit_cox(league.purchase_times(spark, sf), "minute", "bought", [Num("actions"), Cat("signup", ["No", "Yes"])])
    return _coefs(fit.coef_table(spark))


@query
def cox_tests(spark, sf):
    fit = cox.fit_cox(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    return r6(fit.tests_table(spark), ["chi_square", "p"])


@query
def cox_nested(spark, sf):
    """Full model with the period against the model without it."""
    models = {"small": SIDE_TERMS, "large": [*SIDE_TERMS, PERIOD]}
    fits = cox.fit_coxes(league.durations(spark, sf), "goaltime", "cens", models)
    t = cox.nested_cox_test(fits["small"], fits["large"])
    return r6(spark.createDataFrame([(t.chi_square, t.df, t.p)], "chi_square double, df int, p double"), ["chi_square", "p"])


@query
def concordance(spark, sf):
    # read by the fit and again by the pair counts
    d = league.duration_counts(spark, sf)
    fit = cox.fit_cox(d, "goaltime", "cens", SIDE_TERMS, weight="n")
    return _concordance_row(spark, concord.concordance(d.withColumn("risk", fit.risk_score()), "goaltime", "cens", "risk", weight="n"))


def _concordance_row(spark, c: concord.Concordance) -> DataFrame:
    t = spark.createDataFrame(
        [(c.concordant, c.discordant, c.tied_score, c.value, c.std_error)],
        "concordant double, discordant double, tied_score double, concordance double, std_error double",
    )
    return r6(t, t.columns)


@query
def concordance_opponent(spark, sf):
    """Opponent strength as the risk score: earlier goals against sides with fewer points."""
    d = league.durations(spark, sf).withColumn("risk", -F.col("adv_pts"))
    return _concordance_row(spark, concord.concordance(d, "goaltime", "cens", "risk"))


@query
def ph_test(spark, sf):
    fit = cox.fit_cox(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    t = cox.proportional_hazards_test(fit, allow_dropped=True).table(spark)
    return r6(t, ["chi_square", "p"])


@query
def schoenfeld(spark, sf):
    """Mean residuals per event time."""
    fit = cox.fit_cox(league.durations(spark, sf), "goaltime", "cens", SIDE_TERMS)
    res = cox.schoenfeld_residuals(fit, allow_dropped=True)
    cols = [c for c in res.columns if c not in ("time", "g", "rows")]
    weight = F.col("rows")
    t = res.groupBy("time").agg(
        F.sum("rows").alias("events"), F.max("g").alias("g"), *[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in cols]
    )
    return r6(t, ["time", "g", *cols])
