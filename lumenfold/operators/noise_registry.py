"""Every detector and every estimator of label noise by one name each, over rows (id, x, y).

Neighbour tables are computed here, so a name is all a caller needs; options go to the method. Detectors
by neighbours take a table of as many or more (``near``) from callers that use several.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import models as M
from lumenfold.operators import neighbors as N
from lumenfold.operators import noise as Z
from lumenfold.operators import uncertainty as U
from lumenfold.operators.information import mahalanobis

Flagger = Callable[..., DataFrame]


def _by_neighbors(make: Flagger, k: int) -> Flagger:
    def flag(df: DataFrame, key: str = "id", metric: str = "euclidean", neighbors: int = k, near: DataFrame | None = None, **options: object) -> DataFrame:
        found = N.neighbors(df, neighbors, metric, key) if near is None else near.filter(F.col("rank") <= neighbors)
        return make(df.drop("x"), found, key=key, **options).select(key, "is_noise")

    return flag


def _cliffs(df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    found = N.activity_cliffs(df, key=key, **options)
    return df.select(key).join(found, key, "left").select(key, F.col("cliffs").isNotNull().alias("is_noise"))


def _mixture(df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    return M.mixture_noise(M.model_score("ensemble", df, key, **options), key)


def _z_score(df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    return Z.z_score(df, **options)


#: Detectors: (df, key, options) -> key, is_noise.
DETECTORS: dict[str, Flagger] = {
    **{f"knn_k{k}": _by_neighbors(Z.knn_consistency, k) for k in (5, 10, 20)},
    "lof": _by_neighbors(Z.lof_noise, 20), "lof_k10": _by_neighbors(Z.lof_noise, 10), "lof_k20": _by_neighbors(Z.lof_noise, 20),
    "distance_weighted": _by_neighbors(Z.distance_weighted, 10), "neighborhood_consensus": _by_neighbors(Z.consensus, 10), "activity_cliffs": _cliffs,
    "mahalanobis": mahalanobis, "cv_disagreement": M.cv_disagreement, "bootstrap_ensemble": U.bootstrap_ensemble, "co_teaching": M.co_teaching, "dividemix": _mixture,
    "zscore": _z_score, "prediction_error": M.prediction_error,
}


def _estimated(method: str) -> Flagger:
    def score(df: DataFrame, key: str = "id", k: int = 10, metric: str = "euclidean", **options: object) -> DataFrame:
        return Z.estimate(df.drop("x"), N.neighbors(df, k, metric, key), method, key, **options)

    return score


def _hybrid(df: DataFrame, key: str = "id", k: int = 10, metric: str = "euclidean", members: tuple[str, ...] = ("neighbor_residual", "local_variance_ratio")) -> DataFrame:
    near, rows = N.neighbors(df, k, metric, key), df.drop("x")
    return Z.hybrid_score([Z.estimate(rows, near, m, key) for m in members], key)


def _conformal(df: DataFrame, key: str = "id", trees: int = 30, **options: object) -> DataFrame:
    """Widths from a forest's trees, calibrated on held-out rows."""
    spread = M.tree_spread(df, trees, key)
    told = df.select(key, F.col("y")).join(spread, key).select(key, "y", F.col("mean").alias("y_pred"), F.col("std").alias("unc"))
    return Z.conformal_widths(told, key=key, **options)


def _bayesian(df: DataFrame, key: str = "id", method: str = "jackknife", **options: object) -> DataFrame:
    """A forest's own uncertainty: ``jackknife``, ``tree_variance``, or half the trees' ``quantile`` range."""
    if method == "tree_variance":
        return M.tree_spread(df, key=key, **options).select(key, F.col("std").alias("score"))
    if method not in ("jackknife", "quantile"):
        raise ValueError(f"method {method!r} is none of jackknife, tree_variance, quantile")
    d = U.jackknife(df, key=key, **options)
    return d.select(key, (F.sqrt("variance") if method == "jackknife" else (F.col("high") - F.col("low")) / 2).alias("score"))


def _quantile(df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    return U.quantile_regression(df, key=key, **options).select(key, (2 * F.col("half_width")).alias("score"))


#: Estimators: (df, key, options) -> key, score (higher: noisier).
ESTIMATORS: dict[str, Flagger] = {
    **{m: _estimated(m) for m in Z.ESTIMATORS}, "hybrid": _hybrid, "conformal": _conformal, "bayesian_rf": _bayesian, "quantile_regression": _quantile, "gaussian_process": U.gaussian_process,
    "cross_val": partial(M.model_score, "cross_validation"), "ensemble": partial(M.model_score, "ensemble"), "leave_one_out": partial(M.model_score, "leave_one_out"),
}
#: Names whose method trains neural networks or another library's boosting: known, not here.
ELSEWHERE = ("heteroscedastic_nn", "deep_ensemble", "ngboost")


def detect(method: str, df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    """(key, is_noise) by a named detector; an unknown name is an error."""
    if method not in DETECTORS:
        raise ValueError(f"no detector is called {method!r}; there are {', '.join(DETECTORS)}")
    return DETECTORS[method](df, key=key, **options).select(key, "is_noise")


def estimate(method: str, df: DataFrame, key: str = "id", normalize: bool = True, **options: object) -> DataFrame:
    """(key, score) by a named estimator, over the scores' deviation if ``normalize``; an unknown name is an error."""
    if method in ELSEWHERE:
        raise NotImplementedError(f"{method} needs a neural or boosting library that isn't a dependency")
    if method not in ESTIMATORS:
        raise ValueError(f"no estimator is called {method!r}; there are {', '.join(ESTIMATORS)}")
    make = ESTIMATORS[method]
    d = make(df, key=key, **options).select(key, "score")
    return Z.with_scalar(d, _s=F.stddev_pop("score")).select(key, (F.col("score") / (F.col("_s") + Z.EPS)).alias("score")) if normalize else d
