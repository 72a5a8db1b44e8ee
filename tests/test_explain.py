"""Explanations against enumerations of coalitions, planted linear models and planted features."""

import itertools
import math

import numpy as np
import pytest

from lumenfold.operators import explain as E
from lumenfold.operators import models as M


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 5)), 1)
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] + (x[:, 0] > 0.5) * 3 + 0.01 * rng.normal(size=300)
    d = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double")
    return d, x


@pytest.fixture(scope="module")
def fitted(data):
    d = M.assembled(data[0])
    return M.forest(6, 5).fit(d), M.GBTRegressor(maxIter=4, maxDepth=3, seed=1).fit(d)


def shapley(value, d):
    """By the definition, over all coalitions."""
    out = np.zeros(d)
    for i in range(d):
        for k in range(d):
            for s in itertools.combinations([j for j in range(d) if j != i], k):
                out[i] += math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) * (value({*s, i}) - value(set(s)))
    return out


def expected(e, row, known):
    """The ensemble's prediction where only some features are known: others go down by shares."""

    def down(n):
        if e.left[n] < 0:
            return e.value[n]
        a, b = e.left[n], e.right[n]
        if e.feature[n] in known:
            return down(a if row[e.feature[n]] <= e.threshold[n] else b)
        return (e.cover[a] * down(a) + e.cover[b] * down(b)) / e.cover[n]

    return sum(w * down(r) for r, w in zip(e.roots, e.weights))


@pytest.mark.parametrize("which", [0, 1])
def test_tree_shap_against_all_coalitions(data, fitted, which):
    d, x = data
    model, e = fitted[which], E.Ensemble.of(fitted[which])
    told = {r["id"]: r["prediction"] for r in model.transform(M.assembled(d)).select("id", "prediction").collect()}
    assert np.allclose(e.predict(x), [told[i] for i in range(len(x))])
    got = {r["id"]: np.array(r["values"]) for r in E.tree_shap(d, model).collect()}
    for i in range(300):
        assert abs(got[i].sum() + e.base() - told[i]) < 1e-9
    for i in range(0, 300, 43):
        assert np.allclose(got[i], shapley(lambda s, i=i: expected(e, x[i], s), 5))


def test_kernel_shap_with_all_coalitions_is_exact(data, fitted):
    d, x = data
    e = E.Ensemble.of(fitted[0])
    known, weights = E.coalitions(5)
    assert len(known) == 30
    background = x[:7]
    got = E.kernel_values(x[20:23], e.predict, background, known, weights)
    for i, row in enumerate(x[20:23]):
        value = lambda s, row=row: e.predict(np.where(np.isin(np.arange(5), list(s)), row, background)).mean()
        assert np.allclose(got[i], shapley(value, 5))
    rows = E.kernel_shap(d, fitted[0], background=5).collect()
    assert len(rows) == 300 and all(len(r["values"]) == 5 for r in rows)


def test_sampled_coalitions_recover_an_additive_model():
    coefficients = np.linspace(-2, 2, 24)
    known, weights = E.coalitions(24, extra=300)
    assert len(known) <= 348 and (known.sum(axis=1) > 0).all() and (known.sum(axis=1) < 24).all()
    rng = np.random.default_rng(0)
    x, background = rng.normal(size=(4, 24)), rng.normal(size=(9, 24))
    assert np.allclose(E.kernel_values(x, lambda v: v @ coefficients, background, known, weights), coefficients * (x - background.mean(axis=0)))


def test_lime_recovers_a_linear_model(data, fitted):
    coefficients, spread = np.array([3.0, -1.0, 0.0, 0.5]), np.array([1.0, 2.0, 1.0, 0.0])
    got = E.local_weights(np.ones((3, 4)), np.array([1, 2, -(2**63)]), lambda v: v @ coefficients + 7, spread)
    assert np.allclose(got, coefficients * spread, atol=1e-3)
    rows = E.lime(data[0], fitted[0], perturbed=60).collect()
    assert len(rows) == 300
    score = {r["pos"]: r["score"] for r in E.mean_absolute(E.lime(data[0], fitted[0], perturbed=60)).collect()}
    assert max(score, key=score.get) == 0 and score[0] > 5 * score[4]


def test_boruta_confirms_planted_features(data):
    got = E.boruta(data[0], runs=14, trees=15)
    assert got[0]["status"] == "confirmed" and got[0]["rank"] == 1
    assert got[3]["status"] != "confirmed" and got[4]["status"] != "confirmed"
    assert all(v["hits"] <= v["runs"] <= 14 for v in got.values())
    assert E.binomial_tail(0, 5) == 1 and abs(E.binomial_tail(5, 5) - 1 / 32) < 1e-15
