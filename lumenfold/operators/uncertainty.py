"""Uncertainty of labels from models whose fit is a sum over rows: quantile regression, forests' jackknife, Gaussian processes; bootstrap votes.

A pass over the rows gives sums as wide as the features (or their bounded number of random features),
added up in executors; only those sums reach the driver, where small systems are solved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import models as M
from lumenfold.operators.explain import Ensemble
from lumenfold.operators.quantiles import with_quantile
from lumenfold.operators.splits import bootstrap, poisson_weight

#: Random features of a Gaussian process; length scales (times the root of the number of components) and noise levels that the likelihood chooses from.
FEATURES, SCALES, NOISES = 192, (0.5, 1.0, 2.0, 4.0), (0.01, 0.05, 0.1, 0.3, 1.0)
#: Steps of quantile regression, the first step's smoothing (in deviations of the label) and how fast it falls.
STEPS, SMOOTHING, FALL = 45, 0.3, 0.75


def summed(df: DataFrame, of: Callable[[pd.DataFrame], np.ndarray], length: int) -> np.ndarray:
    """The sum over all batches of ``of(batch)``, a vector of bounded length: partial sums by task, then by place."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(length)
        for pdf in frames:
            if len(pdf):
                total += of(pdf)
        yield pd.DataFrame({"i": np.arange(length), "v": total})

    found = df.mapInPandas(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # ``length`` rows
    out = np.zeros(length)
    out[found["i"]] = found["v"]
    return out


def _rows(df: DataFrame, key: str, vector: str, y: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))


def _scales(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the components and, last, of the label (1 where that is 0)."""
    width = d.select(F.max(F.size("x"))).first()[0] or 0

    def of(pdf: pd.DataFrame) -> np.ndarray:
        v = np.column_stack([np.array(pdf["x"].tolist()), pdf["y"]])
        return np.concatenate([[len(v)], v.sum(axis=0), (v * v).sum(axis=0)])

    s = summed(d, of, 2 * width + 3)
    n, mean = max(s[0], 1.0), s[1 : width + 2] / max(s[0], 1.0)
    spread = np.sqrt(np.maximum(s[width + 2 :] / n - mean**2, 0))
    return mean, np.where(spread > 1e-12 * (1 + np.abs(mean)), spread, 1.0)


def quantile_coefficients(d: DataFrame, shares: list[float], steps: int = STEPS) -> np.ndarray:
    """(shares, components + 1) linear coefficients that minimize the pinball loss; the last is the intercept. ``d``: x, y.

    Each step minimizes a quadratic that touches the smoothed loss at the current coefficients and
    lies above it elsewhere, so the loss never rises; the smoothing falls from step to step.
    """
    mean, spread = _scales(d)
    p, q = len(mean), np.array(shares)
    b = np.zeros((len(q), p))

    for step in range(steps):
        eps = max(1e-7, SMOOTHING * FALL**step)

        def of(pdf: pd.DataFrame, b: np.ndarray = b, eps: float = eps) -> np.ndarray:
            x = np.column_stack([(np.array(pdf["x"].tolist()) - mean[:-1]) / spread[:-1], np.ones(len(pdf))])
            y = (pdf["y"].to_numpy() - mean[-1]) / spread[-1]
            parts = []
            for k in range(len(q)):
                w = 1 / (eps + np.abs(y - x @ b[k]))
                parts += [((x * w[:, None]).T @ x).ravel(), x.T @ (w * y + 2 * q[k] - 1)]
            return np.concatenate(parts)

        s = summed(d, of, len(q) * (p * p + p)).reshape(len(q), p * p + p)
        b = np.array([np.linalg.lstsq(r[: p * p].reshape(p, p), r[p * p :], rcond=1e-12)[0] for r in s])
    slope = b[:, :-1] * spread[-1] / spread[:-1]
    return np.column_stack([slope, b[:, -1] * spread[-1] + mean[-1] - slope @ mean[:-1]])


def quantile_regression(df: DataFrame, shares: tuple[float, float, float] = (0.1, 0.5, 0.9), steps: int = STEPS, key: str = "id", vector: str = "x", y: str = "y") -> DataFrame:
    """(key, low, median, high, half_width) by linear quantile regression; rows are left where they are."""
    d = _rows(df, key, vector, y)
    if d.isEmpty():
        return d.select(F.col("id").alias(key), *(F.lit(None).cast("double").alias(c) for c in ("low", "median", "high", "half_width")))
    told = []
    for row in quantile_coefficients(d.select("x", "y"), list(shares), steps):
        told.append(F.aggregate(F.zip_with("x", F.array(*map(F.lit, map(float, row[:-1]))), lambda a, c: a * c), F.lit(float(row[-1])), lambda s, v: s + v))
    out = d.select(F.col("id").alias(key), *(t.alias(c) for t, c in zip(told, ("low", "median", "high"), strict=True)))
    return out.withColumn("half_width", (F.col("high") - F.col("low")) / 2)


def jackknife(df: DataFrame, members: int = 25, depth: int = 8, key: str = "id", vector: str = "x", y: str = "y") -> DataFrame:
    """(key, mean, variance, corrected, low, high): the infinitesimal jackknife over trees fitted to hashed bootstraps.

    The variance of the mean prediction is the sum over training rows of the squared covariance, over
    trees, of how often the tree drew the row and what it predicts. With G the sum over rows of the
    outer products of their centred counts that is t' G t / members^2, where t are the trees'
    predictions less their mean: one pass gives G, members^2 numbers, and each row needs no other.
    ``corrected`` leaves out what a finite number of trees adds, and is 0 at least; low and high are
    the trees' tenth and ninetieth percentiles.
    """
    d = _rows(df, key, vector, y)
    runs = range(members)
    drawn = d.select("id", "x", "y", F.array(*(poisson_weight(F.col("id"), F.lit(r)) for r in runs)).alias("counts"))
    trees = []
    for r in runs:
        own = M.assembled(drawn.withColumn("weight", F.element_at("counts", r + 1).cast("double")).filter("weight > 0"))
        if own.isEmpty():
            continue
        trees.append(Ensemble.of(DecisionTreeRegressor(maxDepth=depth, seed=M.SEED + r, weightCol="weight").fit(own)))
    if not trees:
        return d.select(F.col("id").alias(key), *(F.lit(None).cast("double").alias(c) for c in ("mean", "variance", "corrected", "low", "high")))
    b = len(trees)

    def outer(pdf: pd.DataFrame) -> np.ndarray:
        n = np.array(pdf["counts"].tolist(), dtype=float)[:, :b]
        n -= n.mean(axis=1, keepdims=True)
        return np.append((n.T @ n).ravel(), len(n))

    s = summed(drawn.select("counts"), outer, b * b + 1)
    g, rows = s[:-1].reshape(b, b), s[-1]

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["x"].tolist())
                t = np.column_stack([tree.predict(x) for tree in trees])
                mean = t.mean(axis=1)
                c = t - mean[:, None]
                v = np.einsum("ij,jk,ik->i", c, g, c) / b**2
                low, high = np.quantile(t, [0.1, 0.9], axis=1)
                yield pd.DataFrame({key: pdf["id"], "mean": mean, "variance": v, "corrected": np.maximum(v - rows / b**2 * (c**2).sum(axis=1), 0), "low": low, "high": high})

    return d.select("id", "x").mapInPandas(spread, f"`{key}` {d.schema['id'].dataType.simpleString()}, mean double, variance double, corrected double, low double, high double")


def jackknife_score(df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    """(key, score): the trees' deviation of the mean, with the finite number of trees left in (corrected, most rows would have 0)."""
    return jackknife(df, key=key, **options).select(key, F.sqrt("variance").alias("score"))


def random_features(width: int, features: int, scale: float, seed: int = M.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases whose cosines' products have the squared-exponential kernel as their mean."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(width, features)) / scale, rng.uniform(0, 2 * np.pi, features)


def gaussian_process(df: DataFrame, features: int = FEATURES, scales: tuple[float, ...] = SCALES, noises: tuple[float, ...] = NOISES, key: str = "id", vector: str = "x", y: str = "y") -> DataFrame:
    """(key, mean, std, score): posterior of a Gaussian process over ``features`` random features.

    Components and labels are standardized. Length scale and noise level are those of the grid with
    the largest marginal likelihood; all it needs are sums of products of the features. std is the
    posterior's, without the noise; score is the standardized std plus |residual|.
    """
    d = _rows(df, key, vector, y)
    if d.isEmpty():
        return d.select(F.col("id").alias(key), *(F.lit(None).cast("double").alias(c) for c in ("mean", "std", "score")))
    mean, spread = _scales(d)
    width = len(mean) - 1

    def mapped(x: np.ndarray, scale: float) -> np.ndarray:
        w, phase = random_features(width, features, scale * width**0.5)
        return np.cos((x - mean[:-1]) / spread[:-1] @ w + phase) * (2 / features) ** 0.5

    best = None
    for scale in scales:

        def of(pdf: pd.DataFrame, scale: float = scale) -> np.ndarray:
            phi, t = mapped(np.array(pdf["x"].tolist()), scale), (pdf["y"].to_numpy() - mean[-1]) / spread[-1]
            return np.concatenate([(phi.T @ phi).ravel(), phi.T @ t, [t @ t, len(t)]])

        s = summed(d.select("x", "y"), of, features**2 + features + 2)
        gram, b, total, n = s[: features**2].reshape(features, features), s[features**2 : -2], s[-2], s[-1]
        for noise in noises:
            a = gram + noise * np.eye(features)
            solved = np.linalg.solve(a, b)
            likelihood = -((total - b @ solved) / noise + (n - features) * np.log(noise) + np.linalg.slogdet(a)[1]) / 2
            if best is None or likelihood > best[0]:
                best = likelihood, scale, noise, solved, np.linalg.inv(a)
    _, scale, noise, weights, inverse = best

    def posterior(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                phi = mapped(np.array(pdf["x"].tolist()), scale)
                m, s = phi @ weights, np.sqrt(noise * np.maximum(((phi @ inverse) * phi).sum(axis=1), 0))
                gap = np.abs((pdf["y"].to_numpy() - mean[-1]) / spread[-1] - m)
                yield pd.DataFrame({key: pdf["id"], "mean": m * spread[-1] + mean[-1], "std": s * spread[-1], "score": s + gap})

    return d.mapInPandas(posterior, f"`{key}` {d.schema['id'].dataType.simpleString()}, mean double, std double, score double")


def bootstrap_votes(df: DataFrame, members: int = 10, trees: int = 20, depth: int = 8, key: str = "id") -> DataFrame:
    """(key, votes, mean_error, vote_variance): what members that didn't draw a row say of it; errors are 0 where every member drew it, variances where fewer than two didn't."""
    d = M.assembled(df).select(key, "features", "label")
    drawn = bootstrap(d, key, members)
    said = None
    for r in range(members):
        own = drawn.filter(F.col("run") == r)
        seen = own.filter("weight > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), "weight")))
        p = M.forest(trees, depth, M.SEED + r).fit(seen).transform(own.filter("weight = 0")).select(key, F.col("prediction").alias("p"))
        said = p if said is None else said.union(p)
    told = said.groupBy(key).agg(F.count(F.lit(1)).alias("votes"), F.avg("p").alias("_m"), F.var_pop("p").alias("_v"))
    out = d.select(key, "label").join(told, key, "left")
    variance = F.when(F.col("votes") > 1, F.col("_v")).otherwise(0.0)
    return out.select(key, F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce(F.abs(F.col("label") - F.col("_m")), F.lit(0.0)).alias("mean_error"), variance.alias("vote_variance"))


def bootstrap_ensemble(df: DataFrame, criterion: str = "mean_error", percentile: float = 0.9, key: str = "id", **options: object) -> DataFrame:
    """Flags rows whose votes disagree, with the label (``mean_error``) or each other (``vote_variance``), more than the percentile of all."""
    if criterion not in ("mean_error", "vote_variance"):
        raise ValueError(f"criterion {criterion!r} is neither mean_error nor vote_variance")
    d = bootstrap_votes(df, key=key, **options)
    return with_quantile(d, "_c", criterion, percentile, df.count()).withColumn("is_noise", F.col(criterion) > F.col("_c")).drop("_c")
