"""Principal components of array columns: fitted on some rows, applied to any.

Up to ``NARROW`` components the covariance is summed over the rows' partitions and taken apart; wider vectors go by a randomized range finder, whose passes sum a thin matrix. Neither holds
rows anywhere. A component's sign is such that its largest loading (the first of equal ones) is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.information import scatter

#: The widest vector whose covariance is formed; extra directions and power passes of the range finder.
NARROW, EXTRA, PASSES = 2048, 10, 4


@dataclass
class Projection:
    """Means, components (one per row), their variances and the variance of all; ``scale`` divides centred values where it was asked for."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float
    scale: np.ndarray

    def apply(self, df: DataFrame, vector: str = "x", name: str = "features") -> DataFrame:
        """Adds the projected vector; a null vector stays null, a null component counts as its mean."""
        basis, mean = self.components.T / self.scale[:, None], self.mean

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            held = x.notna().to_numpy()
            v = np.array(x[held].tolist(), dtype=float).reshape(-1, len(mean))
            found = iter(np.where(np.isnan(v), 0.0, v - mean) @ basis)
            return pd.Series([next(found) if h else None for h in held], dtype=object)

        return df.withColumn(name, project(F.col(vector).cast("array<double>")))

    def shares(self) -> np.ndarray:
        """Each component's share of the variance."""
        return self.variance / self.total if self.total else np.zeros(len(self.variance))


def signed(components: np.ndarray) -> np.ndarray:
    largest = np.abs(components).round(12).argmax(axis=1)
    return components * np.where(components[np.arange(len(components)), largest] < 0, -1, 1)[:, None]


def fit_projection(df: DataFrame, k: int, vector: str = "x", standardize: bool = False, narrow: int = NARROW) -> Projection:
    """The first ``k`` principal components of the rows' vectors, at most as many as they have numbers or rows less one.

    Null vectors are left out. Fewer than two rows, or a vector of another length, is an error.
    """
    if k < 1:
        raise ValueError(f"{k} components")
    d = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))
    n, low, width = d.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n < 2 or low != width or not width:
        raise ValueError(f"{n} rows of {low} to {width} numbers")
    s = d.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")).first()["s"]
    mean, spread = s["mean"].toArray(), s["variance"].toArray()
    scale = np.where(spread > 0, np.sqrt(spread), 1.0) if standardize else np.ones(width)
    k = min(k, width, n - 1)
    if width <= narrow:
        values, vectors = np.linalg.eigh(scatter(d, mean, scale) / (n - 1))
        values, basis = values[::-1][:k], vectors[:, ::-1][:, :k].T
    else:
        values, basis = _range(d, mean, scale, k, n)
    return Projection(mean, signed(basis), values.clip(0), float((spread / scale**2).sum()), scale)


def _range(d: DataFrame, mean: np.ndarray, scale: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, components) by subspace iteration from random directions, which a fixed seed gives."""
    width = len(mean)
    q = np.linalg.qr(np.random.default_rng(42).normal(size=(width, min(width, k + EXTRA))))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(scatter(d, mean, scale, q))[0]
    small = q.T @ scatter(d, mean, scale, q) / (n - 1)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:k], (q @ vectors[:, ::-1][:, :k]).T


def combine(df: DataFrame, vectors: list[str], how: str = "concat", k: int | None = None, name: str = "features", fit_on: DataFrame | None = None) -> DataFrame:
    """Several representations as one vector: one after another (``concat``), projected to ``k`` components if there are more, or always (``pca``).

    The projection is fitted on ``fit_on`` (the rows themselves, if not given).
    """
    if how not in ("concat", "pca"):
        raise ValueError(f"how {how!r} is neither concat nor pca")
    if how == "pca" and k is None:
        raise ValueError("pca needs the number of components")
    stacked = df.withColumn(name, F.concat(*vectors))
    if k is None:
        return stacked
    train = stacked if fit_on is None else fit_on.withColumn(name, F.concat(*vectors))
    if how == "concat" and (train.agg(F.max(F.size(name))).first()[0] or 0) <= k:
        return stacked
    return fit_projection(train, k, name).apply(stacked, name, name)
