"""The hybrid builder, model-based scores, exact ranks and registries on small planted tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import evaluation as E
from lumenfold.operators import hybrid as H
from lumenfold.operators import models as M
from lumenfold.operators import neighbors as N
from lumenfold.operators import noise as Z
from lumenfold.operators import ranks as K
from lumenfold.operators import splits as S


@pytest.fixture(scope="module")
def planted(spark):
    """y follows a[0] and b[1]; ``good`` carries what is left of it, ``noise`` nothing."""
    rng = np.random.default_rng(1)
    a, b, noise, rest = rng.standard_normal((240, 6)), rng.standard_normal((240, 4)), rng.standard_normal((240, 3)), rng.standard_normal(240)
    y = 2 * a[:, 0] + b[:, 1] + 3 * rest
    rows = [(i, a[i].tolist(), b[i].tolist(), [float(rest[i]), 0.0], noise[i].tolist(), float(y[i])) for i in range(240)]
    return spark.createDataFrame(rows, "id long, a array<double>, b array<double>, good array<double>, noise array<double>, y double").cache()


def test_fixed_allocation_finds_the_planted_features(planted):
    d, h = H.create_hybrid(planted, ["a", "b"], allocation="fixed", n_per_rep=2, importance="correlation")
    assert h.selection["a"][0] == 0 and h.selection["b"][0] == 1 and h.allocation == {"a": 2, "b": 2}
    r = d.filter("id = 7").first()
    assert r["features"] == [r["a"][0], r["a"][h.selection["a"][1]], r["b"][1], r["b"][h.selection["b"][1]]]


def test_augmentations_are_kept_if_they_help(planted):
    _, h = H.create_hybrid(planted, ["a", "b"], allocation="fixed", n_per_rep=2, importance="correlation", augmentations=("noise", "good"), augmentation="greedy_ablation", threshold=0.05)
    assert list(h.augmentations) == ["good"] and h.gains["good"] > 0.05 > h.gains["noise"]
    d, h = H.create_hybrid(planted, ["a"], allocation="fixed", n_per_rep=1, importance="correlation", augmentations=("noise", "good"), augmentation="all", augmentation_budget=2)
    assert set(h.augmentations) == {"noise", "good"} and d.select(F.size("features")).first()[0] == 5


def test_other_allocations_share_the_budget(planted):
    value = lambda train, held: float(train.agg(F.abs(F.corr(F.element_at("x", 1), "y"))).first()[0])
    _, h = H.create_hybrid(planted, ["a", "b"], allocation="performance_weighted", budget=6, importance="correlation", value=value)
    assert sum(h.allocation.values()) == 6 and h.allocation["a"] >= h.allocation["b"]
    _, h = H.create_hybrid(planted, ["a", "b"], allocation="mrmr", budget=4, importance="correlation")
    assert sum(h.allocation.values()) == 4 and min(h.allocation.values()) >= 1
    tried = []
    value = lambda train, held: (tried.append(1), -abs(train.select(F.size("x")).first()[0] - 4.0))[1]
    _, h = H.create_hybrid(planted, ["a", "b"], allocation="greedy", budget=8, step=2, patience=1, importance="correlation", value=value)
    assert sum(h.allocation.values()) == 4 and len(h.history) == 3


def test_bad_input_is_an_error(planted, spark):
    make = lambda d=planted, reps=("a",), **o: H.create_hybrid(d, list(reps), importance=o.pop("importance", "correlation"), **o)
    for options in ({"budget": 0}, {"step": 0}, {"n_per_rep": 0}, {"validation": 1.0}, {"patience": 0}, {"allocation": "no"}, {"augmentation": "no"}, {"reps": ()}):
        with pytest.raises(ValueError):
            make(**options)
    with pytest.raises(NotImplementedError):
        make(importance="integrated_gradients")
    with pytest.raises(ValueError, match="not a number"):
        make(planted.withColumn("y", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("y"))))
    with pytest.raises(ValueError, match="features"):
        make(planted.withColumn("a", F.when(F.col("id") == 3, F.slice("a", 1, 2)).otherwise(F.col("a"))))
    with pytest.raises(ValueError, match="filtered"):
        make(planted.withColumn("a", F.array(F.lit(1.0))), filters="quality_only")


def test_model_scores_find_planted_noise(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 3))
    y = 2 * x[:, 0] - x[:, 1]
    y[:8] += 12
    d = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(200)], "id long, x array<double>, y double").cache()
    oob = {r["id"]: r["score"] for r in M.model_score("leave_one_out", d, members=6).collect()}
    assert np.mean([oob[i] for i in range(8) if i in oob]) > 3 * np.mean([v for i, v in oob.items() if i >= 8])
    flagged = {r["id"] for r in M.co_teaching(d, 3).filter("is_noise").collect()}
    assert len(flagged & set(range(8))) >= 6 and len(flagged) <= 100
    q = M.tree_quantiles(d, trees=10).collect()
    assert len(q) == 200 and all(r["low"] <= r["median"] <= r["high"] and math.isclose(r["half_width"], (r["high"] - r["low"]) / 2, abs_tol=1e-9) for r in q)
    with pytest.raises(ValueError):
        M.model_score("unknown", d)
    with pytest.raises(ValueError):
        Z.detect("unknown", d)
    with pytest.raises(ValueError):
        Z.detect("lof", d)


def test_ranks_are_those_of_one_sort(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(int(i), "xyz"[int(s)] if s < 3 else None, int(v)) for i, s, v in zip(range(1000), rng.integers(0, 4, 1000), rng.integers(-50, 50, 1000), strict=True)], "id long, s string, bucket int").repartition(7)
    from pyspark.sql import Window

    want = d.select("id", (F.row_number().over(Window.partitionBy("s").orderBy(K.order_key("id", 5), "id")) - 1).alias("w"), F.count("*").over(Window.partitionBy("s")).alias("m"))
    got = K.hash_ranked(d, "id", 5, "place", "n", ["s"])
    assert sorted(got.columns) == sorted([*d.columns, "place", "n"])
    assert got.join(want, "id").filter("place <> w or n <> m").count() == 0 and got.count() == 1000
    got = {r["id"]: r["place"] for r in K.key_ranked(d, "id", "place", "n").collect()}
    assert got == {i: i for i in range(1000)}
    folds = {r["id"]: r["fold"] for r in S.folds(d.filter("id < 13"), "id", 5).collect()}
    assert [folds[i] for i in range(13)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    assert S.random_split(d.filter("false"), "id").count() == 0 and S.folds(d.filter("false"), "id").count() == 0


def test_groups_stay_together(spark):
    d = spark.createDataFrame([(i, f"g{i % 7}" if i % 7 else None) for i in range(100)], "id long, g string")
    for out, column in ((S.group_split(d, "g"), "split"), (S.group_folds(d, "g", 3), "fold")):
        assert out.count() == 100 and out.groupBy("g").agg(F.count_distinct(column).alias("k")).filter("k <> 1").count() == 0
    load = {r["fold"]: r["n"] for r in S.group_folds(d, "g", 3).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert max(load.values()) - min(load.values()) <= 15


def test_learning_curve_fit_recovers_a_planted_curve(spark):
    d = spark.createDataFrame([("m", n, 0.9 - 2.0 / n**0.7) for n in (10, 20, 50, 100, 400)] + [("flat", n, 0.5 + n / 1e4) for n in (10, 20, 50)], "model string, n long, r2 double")
    got = {r["model"]: r for r in E.learning_curve_fit(d, ["model"]).collect()}
    assert math.isclose(got["m"]["r2_max"], 0.9, abs_tol=1e-6) and math.isclose(got["m"]["a"], 2.0, abs_tol=1e-6) and got["m"]["b"] == 0.7 and got["m"]["fit"] > 0.999999
    assert got["flat"]["a"] > 0 or got["flat"]["fit"] == 0


def test_column_aliases(spark):
    d = spark.createDataFrame([(1, "x", 0.5)], "model_name int, representation string, sigma double")
    assert E.standardize_columns(d).columns == ["model", "rep", "sigma"]
    assert E.standardize_columns(d.withColumn("noise_level", F.lit(1.0))).columns == ["model", "rep", "sigma", "noise_level"]


def test_pair_order_statistics(spark):
    rng = np.random.default_rng(5)
    y = np.round(rng.gamma(1, 2, 90), 1)  # ties
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "_id long, _y double")
    gap = lambda a, h: np.abs(a["_y"].to_numpy()[:, None] - h["_y"].to_numpy()[None, :]).ravel()
    every = np.sort(np.abs(y[:, None] - y[None, :]).ravel())
    for k in (0, 89, 90, 4_000, 8_099):
        assert N.pair_order_statistic(d, gap, k, float(np.ptp(y)), bins=7, few=40) == every[k]
    assert math.isclose(N.pair_quantile(d, gap, 0.37, float(np.ptp(y)), 8_100), np.quantile(every, 0.37))


def test_statistics_of_arrays_are_those_of_the_long_form(spark):
    import numpy as np

    from lumenfold.operators import selection as S

    g = np.random.default_rng(8)
    x = g.normal(size=(200, 5)) * (g.random((200, 5)) < [1, 0.5, 0.03, 1, 0]) + [1e5, 0, 0, 0, 0]
    x[:, 3] = 4.0
    y = x[:, 0] - 1e5 + 0.3 * g.normal(size=200)
    d = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(200)], "id long, a array<double>, y double").repartition(5)
    long = S.long_form(d, "id", ["a"])
    want = {r["pos"]: (r["mean"], r["variance"], r["zeros"]) for r in S.feature_statistics(long).collect()}
    assert np.allclose(S.vector_statistics(d, "a"), [want[i] for i in range(5)], atol=1e-9)
    for limits in S.FILTERS.values():
        assert S.vector_quality(d, "a", *limits) == {r["pos"] for r in S.quality_filter(long, *limits).collect()}
    scores = {r["pos"]: r["score"] for r in S.correlation_scores(long, d.select("id", "y"), "id").collect()}
    assert np.allclose(S.vector_correlations(d, "a", "y"), [scores[i] for i in range(5)], atol=1e-9)
