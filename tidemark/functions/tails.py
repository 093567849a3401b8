"""Tail probabilities that Spark SQL has no function for; they run on one row a feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this many values on a side the asymptotic p-value is used; where both are near it, an exact one takes about a second.
EXACT_ROWS = 10_000


def chi_square_tail(x: float, dof: int) -> float:
    """The chance of a chi-square value of ``x`` or more, for whole degrees of freedom; a finite sum."""
    h = max(x, 0.0) / 2
    if dof <= 0:
        return 1.0
    if dof % 2 == 0:
        term, total = math.exp(-h), 0.0
        for k in range(dof // 2):
            total += term
            term *= h / (k + 1)
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.sqrt(h / math.pi) * 2 * math.exp(-h)
    for k in range(dof // 2):
        total += term
        term *= h / (k + 1.5)
    return min(1.0, total)


def exact_ks_tail(d: float, n: int, m: int) -> float:
    """The chance of a two-sample KS distance of ``d`` or more without ties: lattice paths from (0, 0) to (n, m) that stay nearer than ``d``.

    A path is weighed by the chance that a walk takes it whose steps go either way as often as the samples are large, so weights
    neither grow nor vanish on the way. The places after so many steps follow from those a step before in one sum of arrays.
    """
    if n < m:
        n, m = m, n
    limit = round(d * n * m)
    if limit <= 0:
        return 1.0
    first, whole = n / (n + m), n + m
    at, low, high = np.zeros(n + 2), 0, 0  # at[i + 1]: i of the steps were of the first kind
    at[1] = 1.0
    for step in range(1, whole + 1):
        # i is near enough after ``step`` steps if |i (n + m) - step n| < limit.
        a, b = max(0, step - m, (step * n - limit) // whole + 1), min(n, step, (step * n + limit - 1) // whole)
        if a > b:
            return 1.0
        at[a + 1 : b + 2] = (1 - first) * at[a + 1 : b + 2] + first * at[a : b + 1]
        at[low + 1 : a + 1] = 0.0
        at[b + 2 : high + 2] = 0.0
        low, high = a, b
    every = math.lgamma(whole + 1) - math.lgamma(n + 1) - math.lgamma(m + 1) + n * math.log(first) + m * math.log1p(-first)
    return float(min(1.0, max(0.0, -math.expm1(math.log(at[n + 1]) - every)))) if at[n + 1] > 0 else 1.0


def chi_square_p(x: str, dof: str) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi_square_tail(float(a), int(b)) for a, b in zip(x, dof, strict=True)], dtype="float64")

    return of(x, dof)


def exact_ks_p(d: str, n: str, m: str) -> Column:
    @F.pandas_udf("double")
    def of(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([exact_ks_tail(float(a), int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)], dtype="float64")

    return of(d, n, m)
