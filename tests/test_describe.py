import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import describe, ordered


def test_rate_table(spark):
    data = [("k", "Win")] * 3 + [("k", "Loss/Draw")] + [("m", "Win")] * 2 + [("z", "Loss/Draw")] * 3 + [(None, "Win")]
    df = spark.createDataFrame(data, "key string, result string")
    got = {r["key"]: tuple(r)[1:] for r in describe.rate_table(df, ["key"], F.col("result") == "Win").collect()}
    assert got["k"] == (3, 4, 0.75, pytest.approx(math.log(3)))
    assert got["m"] == (2, 2, 1.0, math.inf)
    assert "z" not in got and None in got


def test_trend_leaves_infinite_points_out(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 6.0), (4, math.inf), (None, 1.0)], "x int, y double")
    r = describe.trend_line(df, "x", "y").first()
    assert (r.slope, r.points, r.left_out) == (pytest.approx(2.0), 3, 2) and r.intercept == pytest.approx(0.0, abs=1e-12)


def test_shares_and_levels(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert {r["c"]: (r["n"], r["share"]) for r in describe.class_shares(df, "c").collect()} == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}
    got = {r["c"]: (r["n"], r["percent"]) for r in describe.level_counts(df, "c", ["b", "a", "none"]).collect()}
    assert got == {"a": (2, pytest.approx(200 / 3)), "b": (1, pytest.approx(100 / 3)), "none": (0, 0.0)}
    empty = {r["c"]: (r["n"], r["percent"]) for r in describe.level_counts(df.where("false"), "c", ["a"]).collect()}
    assert empty == {"a": (0, None)}


def test_round_breaks():
    # minutes 1..90 in about 15 bins: width 5
    assert describe.round_breaks(1, 90, 15) == [5.0 * i for i in range(19)]
    assert describe.round_breaks(0, 1, 5) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert describe.round_breaks(0, 100, 5) == [0, 20, 40, 60, 80, 100]
    assert describe.round_breaks(3, 3, 5) == [2.5, 3.5]


def test_histogram_is_right_closed_and_shows_empty_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 5, 6, 90, None)], "t int")
    got = [tuple(r) for r in describe.histogram(df, "t", 15).orderBy("bin").collect()]
    assert got[0] == (1, 0.0, 5.0, 3) and got[1] == (2, 5.0, 10.0, 1) and got[-1] == (18, 85.0, 90.0, 1)
    assert sum(r[3] for r in got) == 5 and len(got) == 18
    assert describe.histogram(df.where("false"), "t").count() == 0


def test_first_event_outcome(spark):
    df = spark.createDataFrame(
        [(10, 20, "H"), (20, 10, "H"), (10, None, "D"), (10, 10, "D"), (None, None, "D")], "fhg int, fag int, ftr string"
    )
    assert {r["outcome"]: r["n"] for r in describe.first_event_outcome(df).collect()} == {"Win": 1, "Loss": 1, "Draw": 1}


@pytest.mark.parametrize("small", [None, 3])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(5)
    values = np.round(rng.gamma(2.0, 10.0, 900), 1)
    # a third of all rows share one value
    values[:300] = 12.5
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert ordered.exact_quantiles(df, "v", probs, small) == pytest.approx(np.quantile(values, probs), rel=1e-12)
    binned, cuts = ordered.quantile_bins(df, "v", 10, "bin", small_rows=small)
    assert len(cuts) == len(set(np.quantile(values, np.arange(11) / 10)))
    assert binned.where("bin IS NULL").count() == 1
    assert ordered.exact_quantiles(df.where("false"), "v", probs) == []


def test_bucketed_running_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(6)
    data = [(s, int(k), float(v) if v > 0.2 else None) for s in "ab" for k, v in zip(rng.permutation(400), rng.random(400))]
    df = spark.createDataFrame(data, "s string, k int, v double")
    plain = ordered.Order("k", ("s",))
    cut = ordered.Order.of(df, "k", ("s",), small_rows=10)
    assert cut.cuts and len(cut.cuts) >= 7

    up = ordered.Step({"up": "v"}, totals={"whole": "v"}, following="next")
    down = ordered.Step({"down": "coalesce(up, 0) + coalesce(v, 0)"}, descending=True)

    def run(order):
        return order.scan(df, up, down).select("s", "k", "up", "down", "whole", "next").orderBy("s", "k").collect()

    for a, b in zip(run(plain), run(cut)):
        assert a["next"] == b["next"]
        for c in ("up", "down", "whole"):
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == pytest.approx(b[c], rel=1e-12))
    plan = cut.scan(df, up)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(s" in plan and "_bucket" in plan


@pytest.mark.parametrize("small", [0, None])
def test_nan_has_no_place_in_an_order(spark, small):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,), (2.0,)], "v double")
    assert ordered.exact_quantiles(df, "v", [0.0, 0.5, 1.0], small) == [1.0, 2.0, 3.0]
    assert sum(r["n"] for r in describe.histogram(df, "v").collect()) == 3


def test_first_event_needs_two_different_times(spark):
    rows = [(5, 9, "H"), (5, 9, "A"), (None, 9, "A"), (None, None, "D"), (7, 7, "H"), (7, None, "D"), (3, 4, None), (3, 4, "x")]
    df = spark.createDataFrame(rows, "fhg int, fag int, ftr string")
    got = {r["outcome"]: r["n"] for r in describe.first_event_outcome(df).collect()}
    assert got == {"Win": 2, "Loss": 1, "Draw": 1, "": 2}


def test_correlation_of_a_constant_column_is_nan(spark):
    df = spark.createDataFrame([(1, 45, 2.0, None), (2, 45, 3.0, 1), (4, 45, 1.0, 2)], "a int, flat int, b double, part int")
    got = {(r.row, r.col): r.value for r in describe.correlation_matrix(df, ["a", "flat", "b", "part"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 3, 1])[0, 1])
    assert all(math.isnan(got[pair]) for pair in (("a", "flat"), ("flat", "a"), ("flat", "b")))
    assert got["flat", "flat"] == 1.0 and got["a", "part"] is None and got["flat", "part"] is None
