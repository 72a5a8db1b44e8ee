"""What a model's predictions owe to each feature: exact Shapley values of tree ensembles, kernel Shapley values, local linear models, and features tested against shadows.

A fitted ensemble becomes a few arrays (nodes of all trees: a number bounded by trees and depth), which
are shipped to the tasks; rows are explained in batches where they lie, and importances are partial sums
of absolute values, a row per feature and task. Random choices are drawn by hash of a row's key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import models as M
from lumenfold.operators.ranks import fresh, hash_ranked
from lumenfold.sources.readers import scratch

#: Rows of the background that kernel Shapley values are taken against, coalitions beside two for each feature, and perturbed rows of a local model: documented bounds of sampling methods.
BACKGROUND, COALITIONS, PERTURBED = 20, 256, 500


class Ensemble:
    """Trees as arrays: prediction = base + sum over trees of weight * leaf value."""

    def __init__(self, roots: list[int], weights: list[float], feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, cover: np.ndarray) -> None:
        self.roots, self.weights = np.array(roots), np.array(weights)
        self.feature, self.threshold, self.left, self.right, self.value, self.cover = feature, threshold, left, right, value, cover

    @classmethod
    def of(cls, model) -> Ensemble:  # noqa: ANN001
        """The arrays of a fitted MLlib tree, forest (mean over trees) or boosted ensemble (weighted sum), numeric splits only."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        path = scratch(spark, "trees")
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
        node = "nodeData" if "nodeData" in data.columns else None
        get = lambda c: F.col(f"{node}.{c}" if node else c)
        nodes = data.select(tree.alias("tree"), *(get(c).alias(c) for c in ("id", "prediction", "rawCount", "leftChild", "rightChild")), get("split.featureIndex").alias("f"), F.get(get("split.leftCategoriesOrThreshold"), F.lit(0)).alias("t"))
        nodes = nodes.orderBy("tree", "id").toPandas()  # trees * 2^(depth + 1) rows at most
        first = nodes.groupby("tree")["id"].size().cumsum().shift(fill_value=0)
        at = nodes["tree"].map(first).to_numpy()
        move = lambda c: np.where(nodes[c] < 0, -1, nodes[c] + at).astype(np.int64)
        weights = list(getattr(model, "treeWeights", [1.0]))
        if type(model).__name__.startswith("RandomForest"):
            weights = [w / len(weights) for w in weights]
        return cls(first.tolist(), weights, nodes["f"].to_numpy(), nodes["t"].fillna(0.0).to_numpy(), move("leftChild"), move("rightChild"), nodes["prediction"].to_numpy(), nodes["rawCount"].to_numpy(dtype=float))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (inner := self.left[at] >= 0).any():
            goes = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
        return self.value[at] @ self.weights

    def leaves(self) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
        """(weighted value, {feature: (low, high, share)}) of each leaf.

        A row satisfies a feature's splits on the path if low < x <= high; share is the product of the
        splits' shares of rows that go down the path, for rows whose feature isn't known.
        """
        for root, weight in zip(self.roots, self.weights, strict=True):
            stack = [(int(root), {})]
            while stack:
                n, path = stack.pop()
                if self.left[n] < 0:
                    yield weight * self.value[n], path
                    continue
                f, t = int(self.feature[n]), float(self.threshold[n])
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                for child, bounds in ((int(self.left[n]), (low, min(high, t))), (int(self.right[n]), (max(low, t), high))):
                    stack.append((child, path | {f: (*bounds, share * self.cover[child] / self.cover[n])}))

    def base(self) -> float:
        """The mean prediction where no feature is known."""
        return sum(v * math.prod(s for _, _, s in path.values()) for v, path in self.leaves())

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Exact Shapley values of every row and feature; unknown features go down by the shares of training rows.

        A leaf with features j on its path counts, with a feature coming in at time t uniform on
        (0, 1), the product of z_j (1 - t) + o_j t, where z is the share and o whether the row
        satisfies the feature's splits. A feature's value is the integral over t of that product
        without its own factor, times o - z: a polynomial, which Gauss-Legendre nodes integrate
        exactly. Rows that satisfy the same splits of a leaf have the same values there.
        """
        out = np.zeros(x.shape)
        for value, path in self.leaves():
            if not path:
                continue
            features = np.array(list(path))
            low, high, z = np.array(list(path.values())).T
            met = (x[:, features] > low) & (x[:, features] <= high)
            bits = np.packbits(met, axis=1)
            patterns, which = np.unique(bits, axis=0, return_inverse=True)
            o = np.unpackbits(patterns, axis=1, count=len(features)).astype(float)
            t, w = np.polynomial.legendre.leggauss(len(features) // 2 + 1)
            t, w = (t + 1) / 2, w / 2
            factors = z[None, :, None] * (1 - t) + o[:, :, None] * t
            share = (factors.prod(axis=1, keepdims=True) / factors) @ w  # shares of rows are above 0, and so are factors
            out[:, features] += (value * (o - z) * share)[which.ravel()]
        return out


def _batches(df: DataFrame, explain: Callable[[np.ndarray, np.ndarray], np.ndarray], key: str, vector: str) -> DataFrame:
    """(key, values): what ``explain(x, keys)`` gives each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                values = explain(np.array(pdf["x"].tolist(), dtype=float), pdf["k"].to_numpy())
                yield pd.DataFrame({key: pdf["k"], "values": list(values)})

    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).mapInPandas(run, f"`{key}` {kind}, values array<double>")


def tree_shap(df: DataFrame, model, key: str = "id", vector: str = "x") -> DataFrame:  # noqa: ANN001
    """(key, values): Shapley values of a fitted ensemble; with the ensemble's ``base`` they sum to the prediction."""
    ensemble = Ensemble.of(model)
    return _batches(df, lambda x, _: ensemble.shapley(x), key, vector)


def coalitions(features: int, extra: int = COALITIONS, seed: int = M.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions of features (rows of 0 and 1) and their weights under the Shapley kernel.

    All of them where there are at most 2 * features + ``extra``; else whole sizes from both ends as
    long as they fit, and for the sizes between random ones with their complements, which share the
    weight that is left.
    """
    most = 2 * features + extra
    rows, weights = [], []
    size = lambda s: (features - 1) / (s * (features - s))  # noqa: E731 - weight of all coalitions of a size
    sizes = list(range(1, features // 2 + 1))
    while sizes:
        s = sizes[0]
        ends = {s, features - s}
        if len(rows) + len(ends) * math.comb(features, s) > most:
            break
        sizes.pop(0)
        for e in ends:
            for held in combinations(range(features), e):
                rows.append(np.isin(np.arange(features), held))
                weights.append(size(e) / math.comb(features, e))
    if sizes and len(rows) + 1 < most:
        rng = np.random.default_rng(seed)
        share = np.array([size(s) * (1 if 2 * s == features else 2) for s in sizes])
        drawn = (most - len(rows)) // 2
        for s in rng.choice(sizes, drawn, p=share / share.sum()):
            one = np.isin(np.arange(features), rng.choice(features, s, replace=False))
            rows += [one, ~one]
            weights += [share.sum() / (2 * drawn)] * 2
    return np.array(rows, dtype=float).reshape(-1, features), np.array(weights)


def kernel_values(x: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shapley values of each row by weighted least squares over the coalitions, constrained to sum to the prediction less the mean one.

    A coalition's value is the mean prediction with its features from the row and the others from
    each background row. With all coalitions this is the exact Shapley value of that game.
    """
    d = x.shape[1]
    base, whole = predict(background).mean(), predict(x)
    if d == 1:
        return (whole - base)[:, None]
    free = known[:, :-1] - known[:, -1:]  # the last feature takes what is left
    solve = np.linalg.pinv((free * weights[:, None]).T @ free) @ (free * weights[:, None]).T
    out = np.empty(x.shape)
    for i, row in enumerate(x):
        mixed = np.where(known[:, None, :] > 0, row, background[None, :, :]).reshape(-1, d)
        value = predict(mixed).reshape(len(known), -1).mean(axis=1) - base
        out[i, :-1] = solve @ (value - known[:, -1] * (whole[i] - base))
        out[i, -1] = whole[i] - base - out[i, :-1].sum()
    return out


def kernel_shap(df: DataFrame, model, key: str = "id", vector: str = "x", background: int = BACKGROUND, extra: int = COALITIONS) -> DataFrame:  # noqa: ANN001
    """(key, values): kernel Shapley values against ``background`` rows, the first in hash order."""
    ensemble = Ensemble.of(model)
    rows = df.orderBy(F.xxhash64(key, F.lit(M.SEED)), key).limit(background).select(F.col(vector).cast("array<double>").alias("x")).collect()
    if not rows:
        return df.select(key, F.array().cast("array<double>").alias("values"))
    held = np.array([r["x"] for r in rows])
    known, weights = coalitions(held.shape[1], extra)
    return _batches(df, lambda x, _: kernel_values(x, ensemble.predict, held, known, weights), key, vector)


def local_weights(x: np.ndarray, seeds: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], spread: np.ndarray, perturbed: int = PERTURBED, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients, per deviation of each feature, of a weighted ridge regression around each row.

    Rows are perturbed by normal steps of the features' deviations; those nearer weigh more (kernel
    width 0.75 * root of the number of features).
    """
    d, out = x.shape[1], np.empty(x.shape)
    for i, (row, seed) in enumerate(zip(x, seeds, strict=True)):
        step = np.random.default_rng(int(seed) & (1 << 63) - 1).normal(size=(perturbed, d))
        step[:, spread == 0] = 0
        step[0] = 0
        w = np.exp(-(step**2).sum(axis=1) / (0.5625 * d))
        y = predict(row + step * spread)
        centred, target = step - (w @ step) / w.sum(), y - (w @ y) / w.sum()
        out[i] = np.linalg.solve((centred * w[:, None]).T @ centred + ridge * np.eye(d), (centred * w[:, None]).T @ target)
    return out


def lime(df: DataFrame, model, key: str = "id", vector: str = "x", perturbed: int = PERTURBED) -> DataFrame:  # noqa: ANN001
    """(key, values): a local linear model's coefficients for each row."""
    from lumenfold.operators.information import covariance

    ensemble = Ensemble.of(model)
    _, c = covariance(df.withColumn("x", F.col(vector)), "x")
    spread = np.sqrt(np.maximum(np.diag(c), 0))
    k = fresh(df, "seed")[0]
    seeded = df.withColumn(k, F.xxhash64(F.col(key).cast("string"), F.lit(M.SEED)))
    found = _batches(seeded, lambda x, seeds: local_weights(x, seeds, ensemble.predict, spread, perturbed), k, vector)
    # Equal keys draw equal steps; rows are told apart by key, so repeated keys keep one explanation for each vector.
    return seeded.select(key, k).distinct().join(found, k).select(key, "values")


def mean_absolute(explained: DataFrame) -> DataFrame:
    """(pos, score): mean absolute value of each feature over the explained rows."""
    return explained.select(F.posexplode("values").alias("pos", "v")).groupBy("pos").agg(F.avg(F.abs("v")).alias("score"))


def binomial_tail(hits: int, runs: int) -> float:
    """P(at least ``hits`` of ``runs`` fair coins)."""
    return sum(math.comb(runs, i) for i in range(hits, runs + 1)) / 2**runs


def boruta(df: DataFrame, runs: int = 20, alpha: float = 0.05, trees: int = 30, depth: int = 5, key: str = "id", vector: str = "x", y: str = "y") -> dict[int, dict]:
    """Per feature: status (confirmed, rejected, tentative), hits, runs, rank (1 confirmed, 2 tentative, 3 on: rejected, the last ones longest in the race first).

    In a run the features still in the race are joined by shadows, the same vectors exchanged
    between rows in a random (hash) order, so that shadows keep their joint distribution and lose the
    label. A feature that is more important than every shadow has a hit. After each run a feature is
    confirmed or rejected when its hits are too many or too few for a fair coin, the level divided by
    the number of features; confirmed ones stay, rejected ones leave.
    """
    d = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    width = d.select(F.max(F.size("x"))).first()[0] or 0
    status, hits, seen, left = dict.fromkeys(range(width), "tentative"), dict.fromkeys(range(width), 0), dict.fromkeys(range(width), 0), {}
    for run in range(runs):
        racing = [f for f in range(width) if status[f] != "rejected"]
        if not any(status[f] == "tentative" for f in racing):
            break
        own = d.withColumn("x", F.array(*(F.element_at("x", f + 1) for f in racing)))
        place = hash_ranked(own, "id", f"shadow{run}", "k", "n")
        shadow = hash_ranked(own.select("id", F.col("x").alias("s")), "id", f"row{run}", "k", "n").select("k", "s")
        both = place.join(shadow, "k").select("id", F.concat("x", "s").alias("x"), "y")
        score = M.forest(trees, depth, M.SEED + run).fit(M.assembled(both)).featureImportances.toArray()
        bar = score[len(racing) :].max()
        for f, s in zip(racing, score):
            if status[f] == "tentative":
                seen[f], hits[f] = run + 1, hits[f] + int(s > bar)
                if binomial_tail(hits[f], run + 1) <= alpha / width:
                    status[f] = "confirmed"
                elif binomial_tail(run + 1 - hits[f], run + 1) <= alpha / width:
                    status[f], left[f] = "rejected", run
    rounds = sorted(set(left.values()), reverse=True)
    rank = {f: 1 if status[f] == "confirmed" else 2 if status[f] == "tentative" else 3 + rounds.index(left[f]) for f in status}
    return {f: {"status": status[f], "hits": hits[f], "runs": seen[f], "rank": rank[f]} for f in status}
