"""Exact p-values of two-sample rank tests, by recurrences over positions or counts.

Each is a function of a few whole numbers that are left of the data, so one row
in one task; the size of what it works on is bounded by the limits here.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Largest sample for which the Kolmogorov–Smirnov p is exact.
KS_ROWS = 10_000
#: Rows of the smaller sample up to which the Mann–Whitney p is exact, and most products of both sizes.
MW_ROWS, MW_PAIRS = 8, 2_000_000


def ks_exact(m: int, n: int, h: int) -> float:
    """Chance that a random order of m and n rows has max |i·n − j·m| of ``h`` or more.

    q(i, j) is the share of the ways to have i and j rows behind one that touched
    the bound. The last row was one of the first sample with chance i / (i + j),
    so q is a mean of two neighbours; outside the band around the diagonal it is
    1. Worked by diagonals i + j, each a band of i; all terms are positive.
    """
    if h <= 0:
        return 1.0
    low, q = 0, np.zeros(1)
    for s in range(1, m + n + 1):
        # i·n − (s − i)·m = i·(m + n) − s·m, strictly within h
        first, last = (s * m - h) // (m + n) + 1, -((-s * m - h) // (m + n)) - 1
        if first > last:
            return 1.0
        i = np.arange(first, last + 1)
        padded = np.concatenate([[1.0, 1.0], q, [1.0, 1.0]])  # q(k) at k - low + 2
        at = np.clip(i - low + 2, 1, len(padded) - 1)
        q = np.clip(padded[at - 1] * (i / s) + padded[at] * ((s - i) / s), 0.0, 1.0)
        low = first
    return float(q[m - low])


def mann_whitney_exact(a: int, b: int, u: int) -> float:
    """Two-sided p of U = ``u`` without ties: twice the chance of the nearer tail, at most 1.

    The number of orders with each U are the coefficients of the Gaussian
    binomial, a product of (1 − q^(b+i)) / (1 − q^i); whole numbers, up to the
    tail only.
    """
    a, b = min(a, b), max(a, b)
    tail = min(u, a * b - u)
    count = np.zeros(tail + 1, object)
    count[0] = 1
    for i in range(1, a + 1):
        if b + i <= tail:
            count[b + i:] = count[b + i:] - count[:tail + 1 - b - i].copy()
        for start in range(min(i, tail + 1)):
            count[start::i] = np.cumsum(count[start::i])
    return min(1.0, 2 * int(count.sum()) / comb(a + b, a))


def ks_p(m: Column, n: Column, h: Column) -> Column:
    """``ks_exact`` where both samples have at most ``KS_ROWS`` rows, else NULL."""

    @pandas_udf("double")
    def exact(m: pd.Series, n: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([ks_exact(int(a), int(b), int(c)) if c is not None and max(a, b) <= KS_ROWS else None for a, b, c in zip(m, n, h)], dtype="float64")

    return exact(m, n, h)


def mann_whitney_p(a: Column, b: Column, u: Column) -> Column:
    """``mann_whitney_exact`` where the smaller sample has at most ``MW_ROWS`` rows and U is whole, else NULL."""

    @pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
        fits = [min(x, y) <= MW_ROWS and x * y <= MW_PAIRS and z == int(z) for x, y, z in zip(a, b, u)]
        return pd.Series([mann_whitney_exact(int(x), int(y), int(z)) if ok else None for x, y, z, ok in zip(a, b, u, fits)], dtype="float64")

    return exact(a, b, u)
