import math

import pytest

from touchline.functions import tails as T


def test_known_points():
    assert T.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert T.chi_square_upper(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert T.chi_square_upper(15.507313055865453, 8) == pytest.approx(0.05, abs=1e-12)
    assert T.normal_two_sided(T.Z95) == pytest.approx(0.05, abs=1e-14)
    assert T.beta_lower(0.5, 2, 3) == pytest.approx(0.6875, abs=1e-14)


def test_chi_square_two_df_is_exponential():
    for x in (0.01, 1.0, 7.5, 80.0):
        assert T.chi_square_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)


def test_binomial_tail_and_interval_by_sums():
    n, p = 23, 0.37
    mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    for k in (0, 1, 8, 23):
        assert T.binomial_upper(k, n, p) == pytest.approx(sum(mass[k:]), rel=1e-10)
    low, high = T.exact_binomial_interval(8, n)
    assert T.binomial_upper(8, n, low) == pytest.approx(0.025, rel=1e-9)
    assert 1 - T.binomial_upper(9, n, high) == pytest.approx(0.025, rel=1e-9)
    assert T.exact_binomial_interval(0, 5)[0] == 0.0
    assert T.exact_binomial_interval(5, 5)[1] == 1.0
