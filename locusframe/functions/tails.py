"""Upper tails of the normal and Student's t, and the hypergeometric tail, as Arrow functions over aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution; null for null or NaN."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)) if x == x and x is not None else None)


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


@F.pandas_udf(DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of Student's t with ``df`` degrees of freedom; null where t or df is null, or df is not positive."""
    def one(x: float, v: float) -> float:
        half = 0.5 * _beta_tail(v / 2, 0.5, v / (v + x * x))
        return half if x >= 0 else 1 - half

    return pd.Series([one(x, v) if x == x and v == v and v > 0 else None for x, v in zip(t, df)])


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """P of a or more in the 2 x 2 table ((a, b), (c, d)) with its margins."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def one(a: int, b: int, c: int, d: int) -> float:
        row, col, n = a + b, a + c, a + b + c + d
        return min(1.0, sum(math.exp(choose(row, k) + choose(n - row, col - k) - choose(n, col)) for k in range(int(a), int(min(row, col)) + 1)))

    return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d)])
