import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import projection as P
from lumenfold.operators.information import covariance


def table(spark, m, column="x"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], f"id long, {column} array<double>")


def planted(rows, width, rank, seed=3):
    g = np.random.default_rng(seed)
    return g.normal(size=(rows, rank)) * np.linspace(9, 3, rank) @ np.linalg.qr(g.normal(size=(width, rank)))[0].T + g.normal(size=(rows, width)) * 0.05 + g.normal(size=width)


def whole(m, k, standardize=False):
    c = m - m.mean(axis=0)
    c = c / c.std(axis=0, ddof=1) if standardize else c
    _, s, v = np.linalg.svd(c, full_matrices=False)
    return P.signed(v[:k]), s[:k] ** 2 / (len(m) - 1), c


@pytest.mark.parametrize("standardize", [False, True])
def test_equals_a_full_decomposition(spark, standardize):
    m = planted(300, 12, 4)
    p = P.fit_projection(table(spark, m).repartition(5), 4, standardize=standardize)
    v, s, c = whole(m, 4, standardize)
    assert np.allclose(p.components, v, atol=1e-8) and np.allclose(p.variance, s)
    got = [r["features"] for r in p.apply(table(spark, m)).orderBy("id").collect()]
    assert np.allclose(got, c @ v.T, atol=1e-8)
    assert p.shares().sum() <= 1 + 1e-12 and np.isclose(p.total, (c**2).sum() / 299)


def test_wide_vectors_by_the_range_finder(spark):
    m = planted(250, 400, 5)
    d = table(spark, m).repartition(4)
    p = P.fit_projection(d, 5, narrow=100)
    v, s, _ = whole(m, 5)
    assert np.allclose(p.components, v, atol=1e-6) and np.allclose(p.variance, s, rtol=1e-8)


def test_covariance(spark):
    m = planted(200, 6, 3) + 1e4
    mean, c = covariance(table(spark, m).repartition(7), "x")
    assert np.allclose(mean, m.mean(axis=0)) and np.allclose(c, np.cov(m.T), rtol=1e-9, atol=1e-9)
    mean, c = covariance(table(spark, m).filter("false"), "x")
    assert mean.shape == (0,) and c.shape == (0, 0)


def test_fitted_on_training_rows_only(spark):
    m = planted(100, 5, 2)
    d = table(spark, m).withColumn("a", F.slice("x", 1, 2)).withColumn("b", F.slice("x", 3, 3))
    out = P.combine(d, ["a", "b"], "pca", 2, fit_on=d.filter("id < 60"))
    v, _, _ = whole(m[:60], 2)
    got = [r["features"] for r in out.orderBy("id").collect()]
    assert np.allclose(got, (m - m[:60].mean(axis=0)) @ v.T, atol=1e-8)


def test_concatenation_is_projected_only_if_too_wide(spark):
    d = table(spark, planted(20, 4, 2)).withColumn("y", F.col("x"))
    assert P.combine(d, ["x", "y"]).first()["features"] == d.first()["x"] * 2
    assert len(P.combine(d, ["x", "y"], k=8).first()["features"]) == 8
    assert P.combine(d, ["x", "y"], k=8).first()["features"] == d.first()["x"] * 2
    assert len(P.combine(d, ["x", "y"], k=3).first()["features"]) == 3


def test_hard_inputs(spark):
    m = np.tile([1.0, 2.0, 3.0], (6, 1))
    p = P.fit_projection(table(spark, m), 2)  # equal rows have no variance
    assert np.allclose(p.variance, 0) and np.allclose(p.shares(), 0)
    assert np.allclose([r["features"] for r in p.apply(table(spark, m)).collect()], 0)
    p = P.fit_projection(table(spark, planted(3, 5, 2)), 9)  # no more components than rows less one
    assert p.components.shape == (2, 5)
    odd = spark.createDataFrame([(0, None), (1, [None, 1.0, 1.0, 1.0, 1.0])], "id long, x array<double>")
    got = {r["id"]: r["features"] for r in p.apply(odd).collect()}
    assert got[0] is None and len(got[1]) == 2 and np.isfinite(got[1]).all()
    for bad in ([], [[1.0, 2.0]], [[1.0, 2.0], [1.0]]):
        with pytest.raises(ValueError):
            P.fit_projection(table(spark, bad), 1)
    with pytest.raises(ValueError):
        P.combine(table(spark, m), ["x"], "pca")
    with pytest.raises(ValueError):
        P.combine(table(spark, m), ["x"], "sum")
