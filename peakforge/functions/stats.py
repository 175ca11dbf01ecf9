"""p-values for statistics that SQL computes: normal and Student tails, exact rank-sum distribution."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if abs(1 + num * d) > 1e-300 else 1e300
        c = 1 + num / c if abs(c) > 1e-300 else 1e300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=16)
def rank_sum_ways(n1: int, n2: int) -> list[int]:
    """Number of orders of n1 + n2 distinct values for each value of U, by adding the second group one value at a time."""
    ways = [1] + [0] * (n1 * n2)
    # Coefficients of the Gaussian binomial: multiply by 1 - q^(n2+i), divide by 1 - q^i.
    for i in range(1, n1 + 1):
        for k in range(n1 * n2, n2 + i - 1, -1):
            ways[k] -= ways[k - n2 - i]
        for k in range(i, n1 * n2 + 1):
            ways[k] += ways[k - i]
    return ways


@lru_cache(maxsize=16)
def _rank_sum_tails(n1: int, n2: int) -> tuple[list[int], int]:
    """Ways of at least each U, and of all."""
    tails = list(accumulate(reversed(rank_sum_ways(n1, n2))))[::-1]
    return tails, tails[0]


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U; exact for small groups without ties, else normal with tie and continuity correction."""
    if n1 == 0 or n2 == 0:
        return 1.0
    if min(n1, n2) <= 8 and ties == 0:
        tails, all_ = _rank_sum_tails(min(n1, n2), max(n1, n2))
        return min(1.0, 2 * tails[int(max(u, n1 * n2 - u))] / all_)
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return normal_two_sided(z)


@F.pandas_udf(T.DoubleType())
def mann_whitney(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([1.0 if pd.isna(a) else mann_whitney_p(float(a), int(b), int(c), float(d)) for a, b, c, d in zip(u, n1, n2, ties)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([1.0 if pd.isna(a) or pd.isna(b) else student_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")
