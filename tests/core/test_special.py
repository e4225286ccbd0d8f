"""Distribution functions against closed forms and published values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamstat.functions import special as s


def test_lgamma_matches_math():
    x = np.array([0.1, 0.5, 1, 2.5, 9.99, 10, 50, 1e4])
    assert np.allclose(s.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.floats(0.001, 0.999))
def test_betainc_is_a_binomial_tail(a, b, x):
    n = a + b - 1
    want = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
    assert float(s.betainc(a, b, x)) == pytest.approx(want, rel=1e-10, abs=1e-14)


def test_t_closed_forms_and_tiny_tails():
    t = np.array([0.0, 0.5, 3.0, 40.0, -2.0])
    assert np.allclose(s.t_two_sided(t, 1), 1 - 2 / np.pi * np.arctan(np.abs(t)), rtol=1e-12)
    assert np.allclose(s.t_two_sided(t, 2), 1 - np.abs(t) / np.sqrt(t * t + 2), rtol=1e-9)
    assert 0 < float(s.t_two_sided(60.0, 30)) < 1e-30
    assert float(s.t_two_sided(math.inf, 5)) == 0
    assert np.allclose(s.t_ppf([0.975, 0.5, 0.05], [10, 3, 7]), [2.228138852, 0, -1.894578605], atol=1e-7)


def test_f_norm_and_beta():
    assert np.allclose(s.f_sf([1.0, 4.0], 2, [10.0, 10.0]), (1 + 2 * np.array([1.0, 4.0]) / 10) ** -5.0, rtol=1e-12)
    assert np.allclose(s.f_sf([2.5**2], 1, 9), s.t_two_sided([2.5], 9))
    assert np.allclose(s.norm_ppf([0.975, 0.5]), [1.959963984540054, 0], atol=1e-12)
    assert np.allclose(s.erf([0.3, 2.0, 3.5, -1]), [math.erf(v) for v in (0.3, 2.0, 3.5, -1)], atol=1e-13)
    assert np.allclose(s.betainc(3, 7, s.beta_ppf([0.1, 0.9], 3, 7)), [0.1, 0.9], atol=1e-12)


def test_studentized_range():
    # tabulated upper 5 % points
    assert s.studentized_range_sf([3.877], 3, [10])[0] == pytest.approx(0.05, abs=2e-4)
    assert s.studentized_range_sf([4.232], 5, [20])[0] == pytest.approx(0.05, abs=2e-4)
    # two means: the range is sqrt(2) |t|
    assert s.studentized_range_sf([2.228138852 * math.sqrt(2)], 2, [10])[0] == pytest.approx(0.05, abs=1e-5)
