"""Mutual information, cluster quality and covariance-based outliers over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.neighbors import _matrix as distance_matrix
from lumenfold.operators.neighbors import against_all, neighbors
from lumenfold.operators.quantiles import with_quantile

EULER = 0.5772156649015329


def nearer(s: np.ndarray, v: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many of the sorted ``s`` have |s - v| < r, for each v and r.

    v - r and v + r are rounded; values next to them are looked at until the differences agree.
    """

    def inside(i: np.ndarray) -> np.ndarray:
        return (i >= 0) & (i < len(s)) & (np.abs(s[np.clip(i, 0, len(s) - 1)] - v) < r)

    low, high = np.searchsorted(s, v - r, side="right"), np.searchsorted(s, v + r, side="left")
    at = lambda i: s[np.clip(i, 0, len(s) - 1)]
    for _ in range(4):
        low = np.where(inside(low - 1), np.searchsorted(s, at(low - 1), side="left"), np.where((low < high) & ~inside(low), np.searchsorted(s, at(low), side="right"), low))
        high = np.where(inside(high), np.searchsorted(s, at(high), side="right"), np.where((low < high) & ~inside(high - 1), np.searchsorted(s, at(high - 1), side="left"), high))
    return np.maximum(high - low, 0)


def mutual_information(df: DataFrame, x: str, y: str, k: int = 3, key: str = "id") -> DataFrame:
    """One row: the k-nearest-neighbour estimate of the mutual information of two numbers.

    A row's radius is the Chebyshev distance of its k-th neighbour in the joint plane; counted are
    the others nearer than that in each number. Work is quadratic in rows by nature; it goes block
    against block, and a block gives out one row per row of its own.
    """
    d = df.select(F.col(key).alias("id"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("x"))
    radius = neighbors(d, k, "chebyshev").filter(F.col("rank") == k).select("id", F.col("distance").alias("_e"))

    def count(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        own, held, e = np.array(a["x"].tolist()), np.array(h["x"].tolist()), a["_e"].to_numpy()
        out = []
        for axis in (0, 1):  # others nearer than the radius, by a sorted search in the block
            out.append(nearer(np.sort(held[:, axis]), own[:, axis], e))
        same = np.isin(a["_id"].to_numpy(), h["_id"].to_numpy()) & (e > 0)
        return pd.DataFrame({"_id": a["_id"].to_numpy(), "nx": out[0] - same, "ny": out[1] - same, "m": len(h) - np.isin(a["_id"].to_numpy(), h["_id"].to_numpy())})

    rows = d.join(radius, "id").select(F.col("id").alias("_id"), "x", "_e")
    counts = against_all(rows, count, "_id long, nx long, ny long, m long").groupBy("_id").agg(F.sum("nx").alias("_nx"), F.sum("ny").alias("_ny"), F.sum("m").alias("_m"))
    # digamma of a whole number n is the sum of 1 / i for i < n, less Euler's constant
    digamma = lambda n: F.aggregate(F.when(n > 1, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(-EULER), lambda s, i: s + 1 / i)
    at_k = sum(1 / i for i in range(1, k)) - EULER
    terms = counts.select((digamma(F.col("_nx") + 1) + digamma(F.col("_ny") + 1)).alias("_t"), digamma(F.col("_m") + 1).alias("_n"))
    return terms.agg(F.greatest(F.lit(0.0), F.lit(at_k) + F.max("_n") - F.avg("_t")).alias("information"))


def silhouette(df: DataFrame, cluster: str, key: str = "id", vector: str = "x") -> DataFrame:
    """One row: mean over rows of (b - a) / max(a, b) by Euclidean distance; 0 for a cluster of one.

    Distances to every other row: quadratic work by nature, block against block; a block gives out,
    for each row of its own, a sum of distances per cluster.
    """

    def sums(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        m = distance_matrix(np.array(a["_x"].tolist()), np.array(h["_x"].tolist()), "euclidean")
        codes, names = pd.factorize(h["_c"])
        total = np.zeros((len(a), len(names)))
        np.add.at(total.T, codes, m.T)
        n = np.bincount(codes, minlength=len(names))
        i, j = np.indices(total.shape)
        return pd.DataFrame({"_id": a["_id"].to_numpy()[i.ravel()], "_c": a["_c"].to_numpy()[i.ravel()], "_d": np.asarray(names)[j.ravel()], "s": total.ravel(), "n": n[j.ravel()]})

    kind = df.schema[cluster].dataType.simpleString()
    d = df.select(F.col(key).alias("_id"), F.col(cluster).alias("_c"), F.col(vector).alias("_x"))
    m = against_all(d, sums, f"_id long, _c {kind}, _d {kind}, s double, n long").groupBy("_id", "_c", "_d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("_c") == F.col("_d")
    m = m.withColumn("_m", F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)).when(~own, F.col("s") / F.col("n")))
    s = m.groupBy("_id").agg(F.max(F.when(own, F.col("_m"))).alias("_a"), F.min(F.when(~own, F.col("_m"))).alias("_b"))
    return s.agg(F.avg(F.when(F.col("_a").isNull(), 0.0).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))).alias("silhouette"))


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance) of the components; one matrix as wide as a vector reaches the driver."""
    d = df.select(F.col(vector).cast("array<double>").alias("x"))
    n = d.count()
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    mean = d.agg(Summarizer.metrics("mean").summary(array_to_vector("x")).alias("s")).first()["s"]["mean"].toArray()
    return mean, scatter(d, mean, np.ones(len(mean))) / max(1, n - 1)


def scatter(d: DataFrame, mean: np.ndarray, scale: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
    """The scatter matrix of (x - mean) / scale, times ``q`` if there is one: tasks give their matrix row by row, and Spark sums each row over the tasks."""
    shape = (len(mean), len(mean) if q is None else q.shape[1])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, seen = np.zeros(shape), False
        for pdf in frames:
            if len(pdf):
                x, seen = (np.array(pdf["x"].tolist(), dtype=float) - mean) / scale, True
                out += x.T @ (x if q is None else x @ q)
        if seen:
            yield pd.DataFrame({"i": np.arange(len(out)), "row": list(out)})

    summed = d.mapInPandas(partial, "i long, row array<double>").groupBy("i").agg(Summarizer.metrics("sum").summary(array_to_vector("row")).alias("s"))
    out = np.zeros(shape)
    for r in summed.select("i", "s.sum").collect():  # as many rows as a vector has numbers
        out[r["i"]] = r["sum"].toArray()
    return out


def clusters(df: DataFrame, k: int, key: str = "id", vector: str = "x", seed: int = 42) -> DataFrame:
    """(key, cluster) by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.select(key, array_to_vector(F.col(vector)).alias("features"))
    return KMeans(k=k, seed=seed).fit(d).transform(d).select(key, F.col("prediction").alias("cluster"))


def mahalanobis(df: DataFrame, key: str = "id", vector: str = "x", percentile: float = 0.9) -> DataFrame:
    """(key, distance, is_noise): squared distance from the mean under the covariance; the matrix is as wide as a vector."""
    mean, c = covariance(df, vector)
    inverse = np.linalg.pinv(c) if c.any() else np.eye(len(mean))
    rows = F.array(*(F.array(*map(F.lit, map(float, row))) for row in inverse))
    centred = F.zip_with(vector, F.array(*map(F.lit, map(float, mean))), lambda a, b: a - b)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    out = df.select(key, centred.alias("_z")).select(key, dot(F.col("_z"), F.transform(rows, lambda row: dot(row, F.col("_z")))).alias("distance"))
    return with_quantile(out, "_c", "distance", percentile, df.count()).withColumn("is_noise", F.col("distance") > F.col("_c")).drop("_c")
