"""Tests and funnels against known values."""

import math

import pytest

from ledgerline.functions.pvalues import normal_two_sided, student_two_sided
from ledgerline.operators import statistics


def test_known_p_values():
    t = student_two_sided()
    assert t(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert t(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert t(0.0, 5) == pytest.approx(1.0)
    assert t(1.0, 1) == pytest.approx(0.5)
    assert t(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert normal_two_sided()(1.959963984540054) == pytest.approx(0.05)


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    rows = [("a", v) for v in a] + [("b", v) for v in b] + [("a", None), ("c", 99.0)]
    got = statistics.welch_test(spark.createDataFrame(rows, "g string, v double"), "v", "g", "a", "b").first()
    va, vb = (5 / 3) / 4, 10 / 5
    assert got.t == pytest.approx((2.5 - 6) / math.sqrt(va + vb))
    assert got.dof == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 4))
    assert 0.05 < got.p_value < 0.1 and not got.rejected and (got.n1, got.n2) == (4, 5)


def test_funnel_and_z(spark):
    events = [(u, s, "A") for u in range(10) for s in ("a", "a", "b") if s == "a" or u < 5]
    events += [(u, s, "B") for u in range(100, 120) for s in ("a", "b") if s == "a" or u < 102]
    rows = statistics.funnel(spark.createDataFrame(events, "u int, e string, g string"), "u", "e", ["a", "b"], "g")
    got = {(r.g, r.step): (r.users, r.share_of_all, r.share_of_previous) for r in rows.collect()}
    assert got == {("A", "a"): (10, 100.0, 100.0), ("A", "b"): (5, 50.0, 50.0), ("B", "a"): (20, 100.0, 100.0), ("B", "b"): (2, 10.0, 10.0)}
    z = {r.step: r for r in statistics.funnel_z(rows, "g", "A", "B").collect()}
    p = 7 / 30
    assert z["b"].z == pytest.approx(0.4 / math.sqrt(p * (1 - p) * (1 / 10 + 1 / 20)), abs=1e-6)
    assert z["b"].rejected and z["a"].z is None
