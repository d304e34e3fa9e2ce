"""Binomial tails against sums of exact fractions, and at sizes where such sums never end."""

import time
from fractions import Fraction
from math import comb

import pytest

from folioscope.functions import numbers as N


@pytest.mark.parametrize("n", [1, 7, 60, 400])
def test_tails_equal_exact_sums(n):
    for p in (Fraction(1, 1000), Fraction(3, 10), Fraction(1, 2), Fraction(98, 100)):
        for k in {0, 1, n // 3, n // 2, n - 1} - {n}:
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert N._at_most(k, n, float(p)) == pytest.approx(float(want), rel=1e-9, abs=1e-13)


def test_large_cells():
    assert N.mcnemar_exact(480, 540) == pytest.approx(float(2 * Fraction(sum(comb(1020, i) for i in range(481)), 2**1020)), rel=1e-9)
    began = time.monotonic()
    assert N.mcnemar_exact(2_000_000, 2_000_000) == 1.0 and N.mcnemar_exact(1_000_000, 3_000_000) < 1e-100
    low, high = N.clopper_pearson(9_000_000, 12_000_000)
    assert 0.7497 < low < 0.75 < high < 0.7503 and high - low == pytest.approx(2 * 1.96 * (0.75 * 0.25 / 12e6) ** 0.5, rel=1e-3)
    assert time.monotonic() - began < 20
