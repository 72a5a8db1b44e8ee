"""Tail probabilities of test statistics: column expressions for the smooth ones, counted null distributions for small rank tests."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Rank sums of samples without ties, the smaller of at most this size, and signed ranks of at most so many differences, have counted distributions.
EXACT_RANK_SUM, EXACT_SIGNED = 8, 50
#: Products of sample sizes beyond which a rank sum's distribution isn't counted.
MAX_STATES = 1_000_000
#: Stirling's series holds from here on; its coefficients over odd powers.
STIRLING_FROM, STIRLING = 10, (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series, moved up where x is small."""
    y = x + STIRLING_FROM
    series = sum((F.lit(c) / F.pow(y, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    moved = sum((F.log(x + i) for i in range(STIRLING_FROM)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - moved


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its last term down."""
    last = (F.lit(60) + F.lit(8) * F.sqrt(F.greatest(a, b))).cast("int")

    def step(tail: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(i % 2 == 0, even).otherwise(odd) / tail

    return F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.lit(1.0), step)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularized incomplete beta function; its work grows with the root of the larger parameter."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    value = F.when(x < (a + 1) / (a + b + 2), front / a / _beta_fraction(a, b, x)).otherwise(1 - front / b / _beta_fraction(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|); null without a degree of freedom."""
    return F.when((dof > 0) & ~F.isnan(t), beta_inc(dof / 2, F.lit(0.5), dof / (dof + t * t)))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f); null where a degree of freedom is missing or f is negative."""
    return F.when((d1 > 0) & (d2 > 0) & (f >= 0), beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|): the series of the central part up to 4, the tail's continued fraction beyond."""
    z = F.abs(z.cast("double"))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(z.alias("term"), z.alias("sum")), lambda s, i: F.struct((s["term"] * z * z / (2 * i + 1)).alias("term"), (s["sum"] + s["term"] * z * z / (2 * i + 1)).alias("sum")))["sum"]
    tail = density / F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, i: z + i / s)
    return F.when(z < 4, 1 - 2 * density * series).otherwise(2 * tail)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; null for fewer than three."""
    return F.when((n > 2) & r.isNotNull() & ~F.isnan(r), beta_inc((n - 2) / 2, F.lit(0.5), F.greatest(1 - r * r, F.lit(0.0))))


@lru_cache(maxsize=64)
def rank_sum_shares(n1: int, n2: int) -> np.ndarray:
    """P(U = u) for u = 0..n1*n2 under the null: one factor (1 - q^(n2+i)) / (1 - q^i) after another."""
    if n1 > n2:
        n1, n2 = n2, n1
    p = np.zeros(n1 * n2 + 1)
    p[0] = 1.0
    for i in range(1, n1 + 1):
        p[n2 + i :] -= p[: -(n2 + i)].copy() if n2 + i < len(p) else 0.0
        for r in range(i):
            p[r::i] = np.cumsum(p[r::i])
        p *= i / (n2 + i)
    return p


@lru_cache(maxsize=64)
def signed_rank_shares(n: int) -> np.ndarray:
    """P(W = w) for w = 0..n(n+1)/2: each rank is in the sum or not."""
    p = np.zeros(n * (n + 1) // 2 + 1)
    p[0] = 1.0
    for i in range(1, n + 1):
        p[i:] += p[:-i].copy()
        p /= 2
    return p


@F.pandas_udf(DoubleType())
def _rank_sum(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * rank_sum_shares(int(a), int(b))[int(max(x, a * b - x)) :].sum()) if a == a else None for a, b, x in zip(n1, n2, u, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _signed(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * signed_rank_shares(int(k))[: int(x) + 1].sum()) if k == k else None for k, x in zip(n, w, strict=True)], dtype=float)


def rank_sum_p(n1: Column, n2: Column, u: Column, ties: Column) -> Column:
    """Two-sided p of U. ``ties``: the sum of t^3 - t over runs of t equal values.

    Counted where there are no ties and the smaller sample has at most ``EXACT_RANK_SUM`` values (and
    the product of sizes stays below ``MAX_STATES``); else normal, with corrections for ties and
    continuity. Null for an empty sample, 1 where all values are equal.
    """
    n1, n2 = n1.cast("double"), n2.cast("double")
    small = (ties == 0) & (F.least(n1, n2) <= EXACT_RANK_SUM) & (n1 * n2 <= MAX_STATES)
    n = n1 + n2
    deviation = F.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / deviation
    normal = F.when(deviation > 0, F.when(z <= 0, 1.0).otherwise(normal_two_sided(z))).otherwise(1.0)
    counted = _rank_sum(F.when(small, n1), F.when(small, n2), F.when(small, u))
    return F.when((n1 > 0) & (n2 > 0), F.when(small, counted).otherwise(normal))


def signed_rank_p(n: Column, statistic: Column, ties: Column) -> Column:
    """Two-sided p of the smaller signed-rank sum of n differences other than 0.

    Counted without ties and up to ``EXACT_SIGNED`` differences, else normal with the correction for
    ties; null for no differences.
    """
    n = n.cast("double")
    small = (ties == 0) & (n <= EXACT_SIGNED)
    deviation = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    normal = F.when(deviation > 0, normal_two_sided((statistic - n * (n + 1) / 4) / deviation)).otherwise(1.0)
    return F.when(n > 0, F.when(small, _signed(F.when(small, n), F.when(small, statistic))).otherwise(normal))
