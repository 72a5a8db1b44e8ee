"""Quantile regression against the linear program's optimum, jackknife against a loop, random-feature processes against the exact one, registries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import models as M
from lumenfold.operators import noise_registry as R
from lumenfold.operators import uncertainty as U
from lumenfold.operators.splits import bootstrap


def frame(spark, x, y):
    return spark.createDataFrame([(i, [float(a) for a in v], float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double")


def pinball(r, q):
    return float(np.maximum(q * r, (q - 1) * r).sum())


def test_quantile_regression_reaches_the_optimum(spark):
    """A line through two points is optimal for two coefficients, so the best of all such lines is the program's optimum."""
    rng = np.random.default_rng(1)
    x, e = rng.uniform(0, 4, 41), rng.normal(size=41)
    y = 1 + 2 * x + (0.5 + x) * e
    found = U.quantile_coefficients(frame(spark, x[:, None], y).select("x", "y"), [0.1, 0.5, 0.9], steps=40)
    for (slope, cut), q in zip(found, (0.1, 0.5, 0.9)):
        best = min(pinball(y - (s * x + y[i] - s * x[i]), q) for i in range(41) for j in range(i) for s in [(y[i] - y[j]) / (x[i] - x[j])])
        assert pinball(y - slope * x - cut, q) <= best * (1 + 2e-3)


def test_quantile_regression_covers(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 3, (600, 2))
    y = x[:, 0] + (0.2 + x[:, 1]) * rng.normal(size=600)
    d = frame(spark, x, y)
    r = U.quantile_regression(d, steps=20).join(d, "id")
    share, wide = r.agg(F.avg(((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).cast("double")), F.corr("half_width", F.element_at("x", 2))).first()
    assert abs(share - 0.8) < 0.03 and wide > 0.95
    assert U.quantile_regression(d.limit(0)).count() == 0


def test_jackknife_against_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    d = frame(spark, x, x[:, 0] ** 2 + 0.1 * rng.normal(size=60))
    members = 4
    got = {r["id"]: r for r in U.jackknife(d, members=members, depth=3).collect()}
    counts = np.zeros((60, members))
    for r in bootstrap(d, "id", members).collect():
        counts[r["id"], r["run"]] = r["weight"]
    told = np.zeros((60, members))
    for b in range(members):
        own = M.assembled(d.join(bootstrap(d.select("id"), "id", members).filter(F.col("run") == b).select("id", F.col("weight").cast("double").alias("weight")), "id").filter("weight > 0"))
        model = U.DecisionTreeRegressor(maxDepth=3, seed=M.SEED + b, weightCol="weight").fit(own)
        for r in model.transform(M.assembled(d)).select("id", "prediction").collect():
            told[r["id"], b] = r["prediction"]
    for i in range(60):
        c = told[i] - told[i].mean()
        v = sum((((counts[j] - counts[j].mean()) * c).mean()) ** 2 for j in range(60))
        assert np.isclose(got[i]["variance"], v) and np.isclose(got[i]["corrected"], max(0, v - 60 / members**2 * (c**2).sum()))


def test_gaussian_process_is_near_the_exact_one(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, (200, 1))
    y = np.sin(2 * x[:, 0]) + 0.2 * rng.normal(size=200)
    y[:5] += 3
    got = {r["id"]: r for r in U.gaussian_process(frame(spark, x, y), features=150, scales=(0.5,), noises=(0.1,)).collect()}
    z, t = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    k = np.exp(-((z - z.T) ** 2) / (2 * 0.5**2))
    inverse = np.linalg.inv(k + 0.1 * np.eye(200))
    mean, std = k @ inverse @ t, np.sqrt(np.maximum(1 - ((k @ inverse) * k).sum(axis=1), 0))
    mine = np.array([(got[i]["mean"] - y.mean()) / y.std() for i in range(200)])
    assert np.abs(mine - mean).mean() < 0.05 and abs(np.mean([got[i]["std"] / y.std() for i in range(200)]) - std.mean()) < 0.05
    worst = sorted(range(200), key=lambda i: -got[i]["score"])[:5]
    assert len(set(worst) & set(range(5))) >= 4
    chosen = U.gaussian_process(frame(spark, x, y), features=30, scales=(0.5, 1.0))
    assert chosen.count() == 200 and U.gaussian_process(frame(spark, x, y).limit(0)).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=120)
    y[:6] += 9
    return frame(spark, x, y)


SMALL = {"dividemix": {"members": 2}, "bootstrap_ensemble": {"members": 3, "trees": 5}, "co_teaching": {"epochs": 1}, "cv_disagreement": {"k": 2}, "cross_val": {"k": 2}, "ensemble": {"members": 2}, "leave_one_out": {"members": 3}, "conformal": {"trees": 4}, "bayesian_rf": {"members": 4}, "quantile_regression": {"steps": 8}, "gaussian_process": {"features": 40, "scales": (1.0,)}}


@pytest.mark.parametrize("name", R.DETECTORS)
def test_every_detector_flags(planted, name):
    rows = R.detect(name, planted, **SMALL.get(name, {})).collect()
    assert len(rows) == 120 and all(r["is_noise"] in (True, False) for r in rows)


@pytest.mark.parametrize("name", R.ESTIMATORS)
def test_every_estimator_scores(planted, name):
    rows = R.estimate(name, planted, **SMALL.get(name, {})).collect()
    assert len({r["id"] for r in rows}) == len(rows) and len(rows) >= 110
    if name not in ("bayesian_rf", "conformal", "quantile_regression"):
        assert sum(r["id"] < 6 for r in sorted(rows, key=lambda r: -r["score"])[:12]) >= 4


def test_unknown_names_and_kinds(planted):
    for call in (R.detect, R.estimate):
        with pytest.raises(ValueError, match="is called"):
            call("nobody", planted)
    with pytest.raises(NotImplementedError):
        R.estimate("ngboost", planted)
    with pytest.raises(ValueError, match="criterion"):
        U.bootstrap_ensemble(planted, "luck")
    times = M.boosted_importance(planted, 3, "weight")
    assert max(range(3), key=times.__getitem__) == 0 and M.boosted_importance(planted, 3, "cover")[0] > 0
    with pytest.raises(ValueError, match="kind"):
        M.boosted_importance(planted, 3, "luck")


def test_permutation_of_all_components(planted):
    got = M.permutation_importance(planted, repeats=2)
    assert set(got) == {0, 1, 2} and got[0] > 10 * abs(got[1]) and got[0] > 10 * abs(got[2])
