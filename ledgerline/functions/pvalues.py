"""p-values for test statistics; used on result tables of a few rows.

The functions are built inside factories, so Spark ships them by value and executors do not
need this package.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def student_two_sided() -> Callable[[float, float], float]:
    """P(|T| >= |t|) from the incomplete beta function, by its continued fraction."""

    def fraction(a: float, b: float, x: float) -> float:
        def nonzero(v: float) -> float:
            return v if abs(v) > 1e-300 else 1e-300

        c, d = 1.0, 1.0 / nonzero(1.0 - (a + b) * x / (a + 1.0))
        result = d
        for m in range(1, 1000):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for step in (even, odd):
                d, c = 1.0 / nonzero(1.0 + step * d), nonzero(1.0 + step / c)
                result *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return result

    def p(t: float, dof: float) -> float:
        a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
        if x <= 0.0 or x >= 1.0:
            return float(x >= 1.0)
        scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        front = math.exp(scale + a * math.log(x) + b * math.log1p(-x))
        if x < (a + 1.0) / (a + b + 2.0):
            return front * fraction(a, b, x) / a
        return 1.0 - front * fraction(b, a, 1.0 - x) / b

    return p


def normal_two_sided() -> Callable[[float], float]:
    """P(|Z| >= |z|)."""
    return lambda z: math.erfc(abs(z) / math.sqrt(2.0))


def _vectorized(p: Callable[..., float]):
    def known(*values: pd.Series) -> pd.Series:
        return pd.Series([p(*v) if all(x == x for x in v) else None for v in zip(*values)], dtype="float64")

    return known


def student_p(t: str, dof: str) -> Column:
    run = _vectorized(student_two_sided())

    def student(x: pd.Series, d: pd.Series) -> pd.Series:
        return run(x, d)

    return F.pandas_udf(student, DoubleType())(F.col(t), F.col(dof))


def normal_p(z: str) -> Column:
    run = _vectorized(normal_two_sided())

    def normal(x: pd.Series) -> pd.Series:
        return run(x)

    return F.pandas_udf(normal, DoubleType())(F.col(z))
