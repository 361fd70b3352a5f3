"""Readers, column rules, joins and reshaping on hand tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from touchline.functions import columns as C
from touchline.operators import joins, reshape
from touchline.plans import frames
from touchline.sources import csv_tables as S

D = datetime.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_results_reader(spark, tmp_path):
    path = tmp_path / "results.csv"
    path.write_text(
        "Div,Date,HomeTeam,AwayTeam,FTR,FHG,FAG\n"
        "E0,09/08/2019,Liverpool,Norwich,H,7,NA\n"
        "E0,10/08/19,West Ham,Man City,A,,25\n"
        'E0,14/03/2020,"A, B",Leicester,D,oops,3\n'
    )
    with pytest.raises(Exception, match="FHG is no int: oops"):
        S.read_results(spark, str(path), goals=True).collect()
    assert S.read_results(spark, str(path)).count() == 3  # the goal columns aren't read
    assert S.unreadable_cells(spark, str(path), S.GOAL_COLUMNS).first().asDict() == {
        "date": 0, "home": 0, "away": 0, "ftr": 0, "fhg": 1, "fag": 0
    }
    got = rows(S.read_results(spark, str(path), goals=True, strict=False), "date")
    assert got == [
        (D(2019, 8, 9), "Liverpool", "Norwich", "H", 7, None),
        (D(2019, 8, 10), "West Ham", "Man City", "A", None, 25),
        (D(2020, 3, 14), "A, B", "Leicester", "D", None, 3),
    ]
    with pytest.raises(ValueError):
        S.read_standings(spark, str(path))


def test_standings_reader_marks_blank_lines_and_relegated(spark, tmp_path):
    path = tmp_path / "table.csv"
    head = "Position,Team,Played,W,D,L,F,A,GD,Pts,Fl,Y,R,Sh,ShT"
    lines = [head, "1,Man City,38,32,2,4,95,23,72,98,1,1,1,1,1", "18,Cardiff,38,10,4,24,34,69,-35,34,1,1,1,1,1", "," * 14, "," * 14]
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(lines).encode())
    df = S.read_standings(spark, str(path))
    assert df.columns == ["team", "position", "pts", "gd", "gf", "ga"]
    assert rows(df, "team") == [("Man City", 1, 98, 72, 95, 23)]
    assert "ReadSchema: struct<Position:string,Team:string,F:string,A:string,GD:string,Pts:string>" in df._jdf.queryExecution().toString()


def test_venue_reader_keeps_quoted_commas(spark, tmp_path):
    path = tmp_path / "venues.csv"
    path.write_text('Name,Team,Capacity,Latitude,Longitude,Also known as\n"X, Y Park",Z,100,51.5,-0.1,\nGround,"P, Q",5,50,1,"a, b"\n')
    assert rows(S.read_venues(spark, str(path)), "team") == [("P, Q", 50.0, 1.0), ("Z", 51.5, -0.1)]


def test_null_rules(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, "X", 3, 100.0, "H"), (3, "Y", 7, 100.5, "A")], "id int, home string, pos int, km double, ftr string"
    )
    got = df.select(
        "id",
        C.not_listed(F.col("home"), ["X"]).alias("kept"),
        C.strength_class(F.col("pos")).alias("ability"),
        C.outcome_class(F.col("ftr")).alias("result"),
        C.distance_class(F.col("km")).alias("distance"),
        C.indicator(F.col("pos") <= 6).alias("flag"),
    )
    assert rows(got, "id") == [
        (1, True, None, "Loss/Draw", "Missing", None),
        (2, False, "Top 6", "Win", "Short", 1),
        (3, True, "Not Top 6", "Loss/Draw", "Long", 0),
    ]


def test_period_and_labels(spark):
    df = spark.createDataFrame([(D(2020, 3, 13), 5, 1), (D(2020, 3, 14), 90, 0), (None, 7, 1)], "d date, t int, e int")
    got = df.select("t", C.period_flag(F.col("d")).alias("p"), C.censored_label(F.col("t"), F.col("e")).alias("l"))
    assert rows(got, "t") == [(5, "Pre", "5"), (7, None, "7"), (90, "Post", "90+")]
    label = spark.range(1).select(C.combination_label(F.lit("Top 6"), F.lit("Home"), F.lit(None).cast("string")))
    assert label.first()[0] == "Top 6 (Home) vs NA"


def test_log_odds_and_report_rounding(spark):
    df = spark.createDataFrame([(3, 4), (2, 2), (0, 3)], "w int, n int")
    got = [r[0] for r in df.select(C.log_odds(F.col("w"), F.col("n"))).collect()]
    assert got == [pytest.approx(math.log(3)), math.inf, -math.inf]
    got = spark.createDataFrame([(0.125,), (0.375,), (math.inf,), (None,)], "v double").select(C.report(F.col("v"), 2))
    assert [r[0] for r in got.collect()] == [0.12, 0.38, math.inf, None]


VENUES = [
    ("Arsenal", 51.554901, -0.108436),
    ("Everton", 53.438702, -2.96619),
    ("Liverpool", 53.430801, -2.96096),
]


def test_distances_both_forms(spark):
    venues = spark.createDataFrame(VENUES, "team string, lat double, long double")
    m = spark.createDataFrame(
        [("Arsenal", "Everton"), ("Arsenal", "Everton"), ("Liverpool", "Everton"), ("Arsenal", "Norwich")], "home string, away string"
    )
    pairs = joins.pair_distances(m, venues)
    got = {(r.home, r.away): r.distance_km for r in pairs.collect()}
    assert got["Arsenal", "Everton"] == pytest.approx(285.412681, abs=1e-6)
    assert got["Liverpool", "Everton"] == pytest.approx(0.945452, abs=1e-6)
    assert got["Arsenal", "Norwich"] is None and len(got) == 3
    for r in joins.attach_distance(m, venues).collect():
        want = got[r.home, r.away]
        assert r.distance_km is None if want is None else r.distance_km == pytest.approx(want, abs=1e-8)
    # a repeated pair on the right must not multiply matches
    again = joins.attach_pair(m, pairs.union(pairs))
    assert again.count() == 4 and again.columns == ["home", "away", "distance_km"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffle_join_equals_broadcast_join(spark):
    # one key holds most rows
    left = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 13)).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = joins.keyed_join(left, right, ["k"], how)
        b = joins.keyed_join(left, right, ["k"], how, broadcast_rows=1)
        assert rows(a, "id") == rows(b, "id")
    assert "BroadcastHashJoin" in plan_of(joins.keyed_join(left, right, ["k"]))
    assert "Generate" not in plan_of(joins.keyed_join(left, right, ["k"], broadcast_rows=1))  # the lookup is not copied


def test_wide_lookup_is_not_broadcast(spark):
    left = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), "id")
    right = spark.createDataFrame([(str(i), "x" * 5000) for i in range(4)], "k string, v string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(joins.keyed_join(left, right, ["k"]))
        wide = joins.keyed_join(left, right, ["k"], broadcast_bytes=10_000)
        assert "BroadcastHashJoin" not in plan_of(wide) and wide.where("length(v) = 5000").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_attach_sides_and_unmatched(spark):
    m = spark.createDataFrame([("A", "B"), ("B", "C")], "home string, away string")
    t = spark.createDataFrame([("A", 1, 90), ("B", 2, 80)], "team string, position int, pts int")
    for limit in (100, 0):
        got = joins.attach_sides(m, t, broadcast_rows=limit)
        assert got.columns == ["home", "away", "home_position", "home_pts", "away_position", "away_pts"]
        assert rows(got, "home") == [("A", "B", 1, 90, 2, 80), ("B", "C", 2, 80, None, None)]
    assert rows(joins.unmatched_keys(m, t, "away"), "away") == [("C", 1)]


def test_semi_and_anti(spark):
    m = spark.createDataFrame([("A",), ("B",), (None,)], "home string")
    t = spark.createDataFrame([("A",), ("A",)], "team string")
    assert rows(joins.keep_keys(m, "home", t, "team"), "home") == [("A",)]
    assert rows(joins.drop_keys(m, "home", t, "team"), "home") == [(None,), ("B",)]
    assert rows(joins.drop_either_side(m.withColumn("away", F.lit("Z")), ["A"]), "home") == [(None, "Z"), ("B", "Z")]


def test_two_sided_match(spark):
    m = spark.createDataFrame([("A", "B", 10, None)], "home string, away string, fhg int, fag int")
    sides = reshape.two_sided(m).select(
        "ref", "adv", "loc", C.censor_fill(F.col("time")).alias("t"), C.event_flag(F.col("time")).alias("e")
    )
    assert rows(sides, "ref") == [("A", "B", "Home", 10, 1), ("B", "A", "Away", 90, 0)]


def test_positions_and_grid(spark):
    df = spark.range(20).select((F.lit(100) - F.col("id")).alias("v"))
    assert rows(reshape.pick_positions(df, ["v"], [1, 11]), "v") == [(81, 1), (91, 11)]
    assert rows(reshape.pick_positions(df, ["v"], [1, 11, 20], top_rows=5), "v") == [(81, 1), (91, 11), (100, 20)]
    assert rows(reshape.first_rows(df, ["v"], 2), "v") == [(81,), (82,)]
    grid = [r[0] for r in reshape.value_grid(16, 98, 0.1, "p", df).orderBy("p").collect()]
    assert len(grid) == 821 and grid[0] == 16.0 and grid[-1] == pytest.approx(98.0, abs=1e-9)


# team: position, points, goal difference, goals for and against of the 2018/19 season, then the venue
SEASON = {
    "Man City": (1, 98, 72, 95, 23, 53.483002, -2.20024),
    "Liverpool": (2, 97, 67, 89, 22, 53.430801, -2.96096),
    "Chelsea": (3, 72, 24, 63, 39, 51.481602, -0.191034),
    "Tottenham": (4, 71, 28, 67, 39, 51.604401, -0.066389),
    "Arsenal": (5, 70, 22, 73, 51, 51.554901, -0.108436),
    "Man United": (6, 66, 11, 65, 54, 53.4631, -2.29139),
    "Wolves": (7, 57, 1, 47, 46, 52.590401, -2.13061),
    "Everton": (8, 54, 8, 54, 46, 53.438702, -2.96619),
    "Leicester": (9, 52, 3, 51, 48, 52.6203, -1.14217),
    "West Ham": (10, 52, -3, 52, 55, 51.5383, -0.016587),
    "Watford": (11, 50, -7, 52, 59, 51.649799, -0.401569),
    "Crystal Palace": (12, 49, -2, 51, 53, 51.3983, -0.085455),
    "Newcastle": (13, 45, -6, 42, 48, 54.975601, -1.62179),
    "Bournemouth": (14, 45, -14, 56, 70, 50.735199, -1.83839),
    "Burnley": (15, 40, -23, 45, 68, 53.788799, -2.23018),
    "Southampton": (16, 39, -20, 45, 65, 50.9058, -1.39114),
    "Brighton": (17, 36, -25, 35, 60, 50.860901, -0.08014),
}


@pytest.fixture(scope="module")
def season(spark):
    """All ordered pairs of the 17 teams, 121 of them home wins, plus matches of promoted sides."""
    pairs = [(h, a) for h in SEASON for a in SEASON if h != a]
    data = [(D(2019, 8, 9) if i % 4 else D(2020, 6, 20), h, a, "H" if i < 121 else ("D" if i % 2 else "A")) for i, (h, a) in enumerate(pairs)]
    data += [(D(2019, 8, 9), "Norwich", "Everton", "H"), (D(2019, 8, 9), "Everton", "Aston Villa", "H")]
    results = spark.createDataFrame(data, "date date, home string, away string, ftr string")
    standings = spark.createDataFrame(
        [(t, *v[:5]) for t, v in SEASON.items()], "team string, position int, pts int, gd int, gf int, ga int"
    )
    venues = spark.createDataFrame([(t, *v[5:]) for t, v in SEASON.items()], "team string, lat double, long double")
    return frames.outcome_frame(results, standings, venues, frames.PROMOTED_2019)


def test_positions_do_not_depend_on_the_others_asked_for(spark):
    df = spark.createDataFrame([(1, i % 7, i) for i in range(40)], "k int, b int, id int").repartition(5)
    near = rows(reshape.pick_positions(df, ["k"], [1, 3, 11]), "row")
    deep = rows(reshape.pick_positions(df, ["k"], [1, 3, 11, 40], top_rows=5), "row")
    assert deep[:3] == near and [r[2] for r in near] == [0, 14, 29]



def test_season_frame(season):
    from touchline.operators import describe, logit

    assert season.count() == 272
    counts = {r["distance"]: (r["n"], r["percent"]) for r in describe.level_counts(season, "distance", C.DISTANCES).collect()}
    assert counts["Short"][0] == 72 and counts["Long"][0] == 200
    assert counts["Long"][1] == pytest.approx(100 * 200 / 272)
    stats = {r["column"]: r for r in describe.summary_stats(season, ["home_pts", "away_pts"]).collect()}
    assert stats["home_pts"]["mean"] == pytest.approx(993 / 17) and stats["away_pts"]["max"] == 98
    m = {(r["row"], r["col"]): r["value"] for r in describe.correlation_matrix(season, ["home_position", "home_pts", "home_gd", "home_gf", "home_ga"]).collect()}
    for pair, want in {
        ("home_position", "home_pts"): -0.9344,
        ("home_position", "home_gd"): -0.9110,
        ("home_position", "home_gf"): -0.8530,
        ("home_position", "home_ga"): 0.8586,
        ("home_pts", "home_gd"): 0.9882,
        ("home_pts", "home_gf"): 0.9592,
        ("home_pts", "home_ga"): -0.8914,
        ("home_gd", "home_gf"): 0.9488,
        ("home_gd", "home_ga"): -0.9279,
        ("home_gf", "home_ga"): -0.7625,
    }.items():
        assert m[pair] == pytest.approx(want, abs=5e-5) and m[pair[::-1]] == m[pair]
    null = logit.fit_logit(season, F.col("result") == "Win", [])
    assert null.aic == pytest.approx(375.757, abs=5e-4)


def test_published_scores(spark):
    from touchline.operators.logit import fixed_logit

    fit = fixed_logit(frames.FINAL_MODEL, frames.FINAL_COEFFICIENTS)
    new = spark.createDataFrame(
        [(1, 100, 50, "Long"), (2, 100, 50, "Short"), (3, 50, 100, "Long"), (4, 50, 100, "Short"), (5, 50, None, "Short"), (6, 50, 50, "Missing")],
        "id int, home_pts int, away_pts int, distance string",
    )
    got = [r[0] for r in new.orderBy("id").select(fit.score()).collect()]
    assert got[:4] == pytest.approx([0.8822, 0.7941, 0.2456, 0.1436], abs=5e-5)
    assert got[4:] == [None, None]


def test_duration_frame(spark):
    goals = spark.createDataFrame(
        [(D(2019, 8, 9), "A", "B", 10, None, "H"), (D(2020, 8, 9), "A", "Norwich", 1, 2, "H"), (D(2020, 8, 9), "C", "A", None, 3, "A")],
        "date date, home string, away string, fhg int, fag int, ftr string",
    )
    t = spark.createDataFrame([("A", 1, 90, 0, 0, 0), ("B", 7, 50, 0, 0, 0)], "team string, position int, pts int, gd int, gf int, ga int")
    got = frames.duration_frame(goals, t, frames.PROMOTED_2019).select(
        "ref", "adv", "loc", "period", "cens", "goaltime", "ref_pts", "adv_pts", "ref_ability", "adv_ability"
    )
    assert rows(got, "ref", "adv") == [
        ("A", "B", "Home", "Pre", 1, 10, 90, 50, "Top 6", "Not Top 6"),
        ("A", "C", "Away", "Post", 1, 3, 90, None, "Top 6", None),
        ("B", "A", "Away", "Pre", 0, 90, 50, 90, "Not Top 6", "Top 6"),
        ("C", "A", "Home", "Post", 0, 90, None, 90, None, "Top 6"),
    ]


def test_cells_group_by_one_value_a_term(spark):
    import re

    from touchline.operators.terms import Cat, Inter, Num, cell_table

    c, v = Cat("c", [f"c{i:02d}" for i in range(60)]), Num("v")
    rows = [("c00", 1.0), ("c00", 1.0), ("c07", 2.0), ("off", 2.0), (None, 2.0), ("c07", float("nan"))]
    df = spark.createDataFrame(rows, "c string, v double").withColumn("part", F.col("v") + 1)
    cells = cell_table(df, [[c, v, Inter(v, c)], [Num("part")]], [], [("n", F.lit(1))])
    # a column a level would make the rows' keys as wide as the factor
    keys = re.search(r"Aggregate \[([^\]]*)\]", cells._jdf.queryExecution().optimizedPlan().toString()).group(1)
    assert len(keys.split(",")) == 3
    got = {tuple(r[x] for x in ("x_cc01", "x_cc07", "x_v", "x_v:cc07", "x_part")): r["n"] for r in cells.collect()}
    assert got == {(0.0, 0.0, 1.0, 0.0, 2.0): 2.0, (0.0, 1.0, 2.0, 2.0, 3.0): 1.0, (None, None, 2.0, None, 3.0): 2.0, (0.0, 1.0, None, None, None): 1.0}
