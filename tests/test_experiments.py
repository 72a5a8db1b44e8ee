import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import experiments as X
from lumenfold.operators.evaluation import recovery_table


def planted(spark, rows=120, width=6, seed=2):
    g = np.random.default_rng(seed)
    x = g.normal(size=(rows, width))
    y = x @ np.linspace(2, -1, width) + 0.1 * g.normal(size=rows)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i]), i % 12) for i in range(rows)], "id long, x array<double>, y double, g int")
    return d, x, y


def ridge(x, y, others):
    mean, s = x.mean(axis=0), x.std(axis=0, ddof=1)
    a, b = (x - mean) / s, (others - mean) / s
    w = np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ (y - y.mean()))
    return a @ w + y.mean(), b @ w + y.mean()


def r2(y, p):
    return 1 - ((y - p) ** 2).mean() / y.var()


def test_grid_is_every_combination():
    assert X.grid(a=[1, 2], b=["p", "q"]) == [{"a": 1, "b": "p"}, {"a": 1, "b": "q"}, {"a": 2, "b": "p"}, {"a": 2, "b": "q"}]
    assert X.config_id({"a": 1, "b": 2}) == X.config_id({"b": 2, "a": 1}) != X.config_id({"a": 2, "b": 1})


def test_stopped_grid_goes_on_without_repeating(spark, tmp_path):
    path, ran = str(tmp_path / "grid"), []

    class Stop(BaseException):
        pass

    def run(c, stop=None):
        if c["v"] == stop:
            raise Stop
        ran.append(c["v"])
        if c["v"] == 5:
            raise ValueError("no five")
        return spark.range(c["v"]).select(F.col("id").alias("n"))

    configs = X.grid(v=[0, 1, 5, 2, 3, 2])
    with pytest.raises(Stop):
        X.run_grid(spark, configs, lambda c: run(c, 2), path, "n long")
    assert ran == [0, 1, 5]
    # rows that a stop left without their state are replaced
    half = X.config_id({"v": 2})
    X.write_checkpoint(spark.createDataFrame([(77, half)], "n long, config string"), f"{path}/rows", "config")
    out = X.run_grid(spark, configs, run, path, "n long")
    assert ran == [0, 1, 5, 5, 2, 3]  # done ones don't run again, a failed one does, repeated ones run once
    got = {}
    for r in out.collect():
        got.setdefault(json.loads(r["settings"])["v"], []).append(r["n"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [0], 2: [0, 1], 3: [0, 1, 2]}
    state = {json.loads(r["settings"])["v"]: (r["status"], r["error"]) for r in X.states(spark, path).collect()}
    assert state == {0: ("done", None), 1: ("done", None), 2: ("done", None), 3: ("done", None), 5: ("failed", "ValueError: no five")}
    X.run_grid(spark, configs[:2], run, path, "n long")
    assert len(ran) == 6


def test_scores_equal_a_loop(spark):
    d, x, y = planted(spark)
    got = X.train_and_score(d.filter("id < 90"), d.filter("id >= 90")).first()
    a, b = ridge(x[:90], y[:90], x[90:])
    assert np.allclose([got["train_r2"], got["r2"]], [r2(y[:90], a), r2(y[90:], b)], atol=1e-6)
    assert np.allclose([got["rmse"], got["mae"]], [np.sqrt(((y[90:] - b) ** 2).mean()), np.abs(y[90:] - b).mean()], atol=1e-6)
    assert got["n_features"] == 6
    none = X.train_and_score(d, d.filter("false")).first()
    assert none["train_r2"] > 0.9 and none["r2"] is None and none["mae"] is None
    with pytest.raises(ValueError):
        X.train_and_score(d, d, "oracle")


def test_hybrid_search(spark, tmp_path):
    d, x, y = planted(spark)
    d = d.select("id", "y", "g", F.slice("x", 1, 3).alias("a"), F.slice("x", 4, 3).alias("b"))
    configs = X.grid(allocation=["fixed"], n_per_rep=[1, 3], importance=["correlation", "no such"], model=["ridge"])
    rows = X.hybrid_search(d, ["a", "b"], configs, str(tmp_path / "s"), "g", 3)
    s = {r["n_per_rep"]: r for r in X.search_summary(rows, ("n_per_rep", "importance")).collect()}
    assert set(s) == {"1", "3"} and all(r["folds"] == 3 and r["importance"] == "correlation" for r in s.values())
    assert (s["1"]["n_features"], s["3"]["n_features"]) == (2, 6)
    assert X.states(spark, str(tmp_path / "s")).filter("status = 'failed' and error like 'NotImplementedError%'").count() == 2
    # all features: the folds' scores are those of a loop over the same folds
    fold = {r["id"]: r["fold"] for r in spark.read.parquet(str(tmp_path / "s/folds-3")).collect()}
    f = np.array([fold[i] for i in range(len(y))])
    assert all(len({fold[i] for i in range(len(y)) if i % 12 == g}) == 1 for g in range(12))
    want = [r2(y[f == i], ridge(x[f != i], y[f != i], x[f == i])[1]) for i in range(3)]
    assert np.isclose(s["3"]["score_mean"], np.mean(want), atol=1e-6) and np.isclose(s["3"]["score_std"], np.std(want), atol=1e-6)
    assert np.isclose(s["3"]["gap"], s["3"]["train_mean"] - s["3"]["score_mean"])


def test_generalization_gap(spark, tmp_path):
    d, x, y = planted(spark)
    rows = X.generalization_gap(d, [2, 6], ["ridge"], str(tmp_path / "g"), "g", 3)
    s = {int(r["components"]): r for r in X.search_summary(rows, ("components",)).collect()}
    assert s[6]["train_mean"] > s[2]["train_mean"] and (s[2]["n_features"], s[6]["n_features"]) == (2, 6)


def test_noise_grid(spark, tmp_path):
    d, x, y = planted(spark, 200)
    train, others = d.filter("id < 150"), d.filter("id >= 150")
    configs = [*X.grid(method=["zscore", "knn_k5"], sigma=[0.8], seed=[1], strategy=["outlier"]), *X.grid(method=["zscore"], sigma=[0.0], seed=[1])]
    rows = X.noise_grid(train, others, configs, str(tmp_path / "n"))
    got = {(r["method"], r["sigma"]): r for r in rows.withColumns({"method": X.setting("method"), "sigma": X.setting("sigma", "double")}).collect()}
    assert X.states(spark, str(tmp_path / "n")).filter("status <> 'done'").count() == 0 and len(got) == 3
    still = got["zscore", 0.0]
    assert still["r2_clean"] == pytest.approx(still["r2_noisy"]) and still["n_true"] == 0 and still["precision"] == 0 and still["recall"] == 0 and still["f1"] == 0
    for r in got.values():
        assert r["n_detected"] + r["n_after"] == 150
    knn = got["knn_k5", 0.8]
    assert knn["n_true"] == 150 and knn["precision"] == 1 and knn["recall"] == knn["n_detected"] / 150
    assert knn["f1"] == pytest.approx(2 * knn["recall"] / (1 + knn["recall"]))
    assert knn["recovery"] == pytest.approx((knn["r2_cleaned"] - knn["r2_noisy"]) / (knn["r2_clean"] - knn["r2_noisy"]))
    _, b = ridge(x[:150], y[:150], x[150:])
    assert knn["r2_clean"] == pytest.approx(r2(y[150:], b), abs=1e-6)
    table = recovery_table(rows.withColumn("method", X.setting("method")), ["method"]).collect()
    assert {r["method"]: r["n"] for r in table} == {"zscore": 2, "knn_k5": 1}
