"""Tail probabilities against numerical integrals, enumerations and published values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import analytics as A
from lumenfold.operators import distributions as D


def value(spark, column):
    return spark.range(1).select(column.alias("p")).first()["p"]


def simpson(f, a, b, n=200_000):
    x = np.linspace(a, b, n + 1)
    return float((f(x) * np.where(np.arange(n + 1) % 2, 4, 2)).sum() - f(x[:1])[0] - f(x[-1:])[0]) * (b - a) / n / 3


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 2.0, 3.7, 50.5, 1e5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(D.log_gamma(F.col("x")).alias("g")).collect()
    assert np.allclose([r["g"] for r in got], [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-11)


def test_t_and_normal_and_f(spark):
    cases = [(0.0, 3), (0.5, 1), (2.1, 4), (-3.3, 17), (12.0, 5), (1.96, 1_000_000), (4.5, 250_000)]
    got = spark.createDataFrame([(t, float(n)) for t, n in cases], "t double, n double").select(D.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    for (t, n), r in zip(cases, got):
        c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        assert abs(r["p"] - (1 - 2 * simpson(lambda x: c * (1 + x * x / n) ** (-(n + 1) / 2), 0, abs(t)))) < 1e-9
    z = [0.0, 0.3, 1.96, 3.999, 4.001, 8.0, 30.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(D.normal_two_sided(F.col("z")).alias("p")).collect()
    assert np.allclose([r["p"] for r in got], [math.erfc(x / math.sqrt(2)) for x in z], rtol=1e-8, atol=0)
    for f, a, b in [(3.2, 1, 20), (0.7, 2, 5), (1.1, 7, 100_000), (9.0, 3, 8)]:
        c = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
        tail = 1 - simpson(lambda s: 2 * s ** (a - 1) * c * (1 + a / b * s * s) ** (-(a + b) / 2), 0, math.sqrt(f))
        assert abs(value(spark, D.f_tail(F.lit(f), F.lit(a), F.lit(b))) - tail) < 1e-8
    assert value(spark, D.t_two_sided(F.lit(1.0), F.lit(0))) is None and value(spark, D.f_tail(F.lit(-1.0), F.lit(1), F.lit(1))) is None


@pytest.mark.parametrize("n1,n2", [(1, 1), (3, 4), (5, 5), (2, 7), (6, 3)])
def test_rank_sum_shares_by_enumeration(n1, n2):
    u = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    assert np.allclose(D.rank_sum_shares(n1, n2), np.bincount(u, minlength=n1 * n2 + 1) / len(u))


@pytest.mark.parametrize("n", [1, 4, 9])
def test_signed_rank_shares_by_enumeration(n):
    w = [sum(i + 1 for i in range(n) if b >> i & 1) for b in range(2**n)]
    assert np.allclose(D.signed_rank_shares(n), np.bincount(w) / 2**n)


def test_published_p_values(spark):
    """Eleven differences of one sign, or all but the smallest; two samples of five that don't overlap."""
    d = spark.createDataFrame([("all", 1.0 + i / 100, 0.0) for i in range(11)] + [("but one", -0.001, 0.0)] + [("but one", 1.0 + i / 100, 0.0) for i in range(10)], "k string, a double, b double")
    got = {r["k"]: r["p"] for r in A.wilcoxon(d, ["k"], "a", "b").collect()}
    assert abs(got["all"] - 0.000977) < 1e-6 and abs(got["but one"] - 0.001953) < 1e-6
    d = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", 10.0 + i) for i in range(5)], "g string, v double")
    r = A.mann_whitney(d, "g", "v").first()
    assert r["u"] == 0 and abs(r["p"] - 2 / 252) < 1e-9


def test_ties_go_by_the_normal_approximation(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0], [2.0, 5.0, 6.0, 7.0, 8.0]
    r = A.mann_whitney(spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double"), "g", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(t**3 - t for t in np.unique(a + b, return_counts=True)[1])
    s = math.sqrt(30 / 12 * (12 - ties / 110))
    assert r["u"] == u and abs(r["p"] - math.erfc((max(u, 30 - u) - 15 - 0.5) / s / math.sqrt(2))) < 1e-9


def test_pearson_of_few_pairs(spark):
    d = spark.createDataFrame([("two", 1.0, 2.0), ("two", 2.0, 3.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0), ("line", 3.0, 3.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, a double, b double")
    got = {r["k"]: r["p"] for r in A.pearson(d, ["k"], "a", "b").collect()}
    assert got["two"] is None and got["line"] < 1e-6 and got["flat"] is None
