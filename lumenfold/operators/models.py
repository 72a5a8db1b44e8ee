"""Model-based importance, evaluation and noise scores with MLlib. Numbers follow MLlib, not other libraries.

Loops here launch Spark jobs; their number is bounded by parameters (folds, members, candidates),
never by rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.quantiles import quantiles, with_quantile
from lumenfold.operators.ranks import fresh, hash_ranked
from lumenfold.operators.splits import bootstrap, folds

SEED = 42


def assembled(df: DataFrame, vector: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector))).withColumn("label", F.col(y).cast("double"))


def forest(trees: int = 50, depth: int = 10, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")


def forest_importance(df: DataFrame, trees: int = 50, depth: int = 10) -> list[float]:
    return list(forest(trees, depth).fit(assembled(df)).featureImportances.toArray())


def boosted_importance(df: DataFrame, rounds: int = 20, kind: str = "gain") -> list[float]:
    """Of boosted trees: a feature's share of the ``gain``, its number of splits (``weight``), or the mean rows of its splits (``cover``)."""
    if kind not in ("gain", "weight", "cover"):
        raise ValueError(f"kind {kind!r} is none of gain, weight, cover")
    model = GBTRegressor(maxIter=rounds, seed=SEED).fit(assembled(df))
    if kind == "gain":
        return list(model.featureImportances.toArray())
    from lumenfold.operators.explain import Ensemble

    e = Ensemble.of(model)
    split = e.left >= 0
    times = np.bincount(e.feature[split], minlength=model.numFeatures)
    return list(times.astype(float) if kind == "weight" else np.bincount(e.feature[split], e.cover[split], model.numFeatures) / np.maximum(times, 1))


def r2(predicted: DataFrame) -> float:
    e = F.col("label") - F.col("prediction")
    return float(predicted.agg((1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop("label"))).alias("r2")).first()["r2"])


def permutation_importance(df: DataFrame, columns: list[int] | None = None, repeats: int = 5, key: str = "id", model=None) -> dict[int, float]:  # noqa: ANN001
    """Mean drop of R2 on the training rows when one component (all of them, one at a time) is exchanged between rows, in hash order.

    In a repeat every row meets one other and takes its components one at a time, so a repeat is one
    join and one pass; a task gives out an error sum for each component.
    """
    from lumenfold.operators.explain import Ensemble

    d = assembled(df)
    model = model or forest().fit(d)
    ensemble = Ensemble.of(model)
    rows = d.select(key, F.col("x").cast("array<double>").alias("x"), "label")
    n, spread, width = rows.agg(F.count(F.lit(1)), F.var_pop("label"), F.max(F.size("x"))).first()
    columns = list(range(width or 0)) if columns is None else columns
    k, total = fresh(rows, "k", "n")
    place = hash_ranked(rows, key, "place", k, total).drop(total)

    def errors(frames):  # noqa: ANN001, ANN202
        sums = np.zeros(len(columns) + 1)
        for pdf in frames:
            if len(pdf):
                x, other, y = np.array(pdf["x"].tolist()), np.array(pdf["o"].tolist()), pdf["label"].to_numpy()
                sums[-1] += ((y - ensemble.predict(x)) ** 2).sum()
                for i, c in enumerate(columns):
                    moved = x.copy()
                    moved[:, c] = other[:, c]
                    sums[i] += ((y - ensemble.predict(moved)) ** 2).sum()
        yield pd.DataFrame({"c": [*columns, -1], "e": sums})

    out = dict.fromkeys(columns, 0.0)
    for r in range(repeats):
        other = hash_ranked(rows.select(key, F.col("x").alias("o")), key, f"moved_{r}", k, total).select(k, "o")
        found = {x["c"]: x["e"] for x in place.join(other, k).select("x", "o", "label").mapInPandas(errors, "c long, e double").groupBy("c").agg(F.sum("e").alias("e")).collect()}
        for c in columns:
            out[c] += (found[c] - found[-1]) / (n * spread) / repeats
    return out


def drop_column_importance(df: DataFrame, columns: list[int], k: int = 3, key: str = "id") -> dict[int, float]:
    """Cross-validated R2 with all components minus that without one; may be negative."""
    base = sum(cross_validated(df, k, key)) / k
    out = {}
    for c in columns:
        without = df.withColumn("x", F.filter("x", lambda v, i: i != c))
        out[c] = base - sum(cross_validated(without, k, key)) / k
    return out


def fold_predictions(df: DataFrame, k: int = 5, key: str = "id", make: Callable[[], RandomForestRegressor] | None = None) -> DataFrame:
    """Adds out-of-fold ``prediction`` (unshuffled folds)."""
    d = folds(assembled(df), key, k)
    out = None
    for i in range(k):
        p = (make or forest)().fit(d.filter(F.col("fold") != i)).transform(d.filter(F.col("fold") == i))
        out = p if out is None else out.union(p)
    return out


def cross_validated(df: DataFrame, k: int = 5, key: str = "id") -> list[float]:
    p = fold_predictions(df, k, key)
    e = F.col("label") - F.col("prediction")
    return [r["r2"] for r in p.groupBy("fold").agg((1 - F.sum(e * e) / (F.count(F.lit(1)) * F.var_pop("label"))).alias("r2")).orderBy("fold").collect()]  # k rows


def cv_disagreement(df: DataFrame, k: int = 5, percentile: float = 0.9, key: str = "id") -> DataFrame:
    """Flags rows whose out-of-fold error is above the percentile."""
    d = fold_predictions(df, k, key).withColumn("error", F.abs(F.col("label") - F.col("prediction")))
    return with_quantile(d, "_c", "error", percentile, df.count()).withColumn("is_noise", F.col("error") > F.col("_c")).select(key, "error", "is_noise")


def prediction_error(df: DataFrame, percentile: float = 0.9, key: str = "id") -> DataFrame:
    """Flags rows with the largest in-sample errors."""
    d = assembled(df)
    p = forest(100).fit(d).transform(d).withColumn("error", F.abs(F.col("label") - F.col("prediction")))
    return with_quantile(p, "_c", "error", percentile, df.count()).withColumn("is_noise", F.col("error") > F.col("_c")).select(key, "error", "is_noise")


def ensemble_scores(df: DataFrame, members: int = 10, key: str = "id") -> DataFrame:
    """Deviation of the members' predictions plus |residual| of their mean; each member is fitted to a hashed bootstrap."""
    d = assembled(df)
    drawn = bootstrap(d, key, members)
    out = None
    for i in range(members):
        own = drawn.filter((F.col("run") == i) & (F.col("weight") > 0)).withColumn("_c", F.explode(F.sequence(F.lit(1), "weight")))
        p = forest(20, 8, SEED + i).fit(own).transform(d).select(key, "label", F.col("prediction").alias("p"))
        out = p if out is None else out.union(p)
    return out.groupBy(key).agg((F.stddev_pop("p") + F.abs(F.first("label") - F.avg("p"))).alias("score"))


def tree_spread(df: DataFrame, trees: int = 30, key: str = "id") -> DataFrame:
    """Mean and deviation over a forest's trees: the forest's own uncertainty."""
    d = assembled(df)
    model = forest(trees, 8).fit(d)
    out = None
    for t in model.trees:
        p = t.transform(d).select(key, F.col("prediction").alias("p"))
        out = p if out is None else out.union(p)
    return out.groupBy(key).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def mixture_noise(scores: DataFrame, key: str = "id", cut: float = 0.5) -> DataFrame:
    """Flags rows that a two-part mixture of the scores puts in its higher part."""
    from pyspark.ml.clustering import GaussianMixture

    d = scores.withColumn("features", array_to_vector(F.array("score")))
    model = GaussianMixture(k=2, seed=SEED).fit(d)
    means = [g.mean[0] for g in model.gaussians]
    high = int(means[1] > means[0])
    from pyspark.ml.functions import vector_to_array

    return model.transform(d).withColumn("p_noise", F.element_at(vector_to_array("probability"), high + 1)).select(key, "score", "p_noise", (F.col("p_noise") > cut).alias("is_noise"))


def oob_scores(df: DataFrame, members: int = 10, key: str = "id") -> DataFrame:
    """(key, prediction, score): |label - mean prediction of the members that didn't see the row| over the labels' deviation.

    Bootstrap weights are Poisson by hash; a row that every member saw has no score.
    """
    d = assembled(df)
    spread = d.agg(F.stddev_pop("label")).first()[0] or 0.0
    drawn = bootstrap(d, key, members)
    out = None
    for i in range(members):
        own = drawn.filter(F.col("run") == i)
        seen = own.filter("weight > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), "weight")))
        p = forest(20, 8, SEED + i).fit(seen).transform(own.filter("weight = 0")).select(key, "label", "prediction")
        out = p if out is None else out.union(p)
    return out.groupBy(key).agg(F.avg("prediction").alias("prediction"), (F.abs(F.first("label") - F.avg("prediction")) / (spread + 1e-10)).alias("score"))


def tree_quantiles(df: DataFrame, shares: tuple[float, float, float] = (0.1, 0.5, 0.9), trees: int = 30, key: str = "id") -> DataFrame:
    """(key, low, median, high, half_width): quantiles over a forest's trees, in place of a quantile loss."""
    d = assembled(df)
    out = None
    for t in forest(trees, 8).fit(d).trees:
        p = t.transform(d).select(key, F.col("prediction").alias("p"))
        out = p if out is None else out.union(p)
    q = out.groupBy(key).agg(F.percentile("p", F.array(*map(F.lit, shares))).alias("q"))
    low, middle, high = (F.element_at("q", i) for i in (1, 2, 3))
    return q.select(key, low.alias("low"), middle.alias("median"), high.alias("high"), ((high - low) / 2).alias("half_width"))


def co_teaching(df: DataFrame, epochs: int = 4, keep: float = 0.7, rejected: float = 0.6, key: str = "id") -> DataFrame:
    """(key, rejections, is_noise): two forests teach each other with their rows of small error, epoch by epoch.

    In an epoch each is fitted to the rows whose error under the other was among the ``keep``
    smallest; a row can be rejected twice in an epoch and is noise from ``rejected`` * epochs on.
    """
    d = assembled(df).select(key, "features", "label")
    u = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) < int(1000 * keep)
    sets, rows = [d.filter(u(1)), d.filter(u(2))], d.count()
    votes = None
    for epoch in range(epochs):
        small = []
        for i in (0, 1):
            p = forest(15, 6, SEED + 2 * epoch + i).fit(sets[i]).transform(d).select(key, F.abs(F.col("label") - F.col("prediction")).alias("e"))
            cut = quantiles(p, "e", [keep], most=rows).first()["q"][0]
            v = p.select(key, (F.col("e") > cut).cast("int").alias("r"))
            small.append(v.filter("r = 0").select(key))
            votes = v if votes is None else votes.union(v)
        sets = [d.join(small[1], key, "left_semi"), d.join(small[0], key, "left_semi")]
    return votes.groupBy(key).agg(F.sum("r").alias("rejections")).withColumn("is_noise", F.col("rejections") >= rejected * epochs)


#: Model-based noise scores by name: each takes (df, key=...) and gives the key and its score.
SCORES: dict[str, tuple[Callable[..., DataFrame], str]] = {"ensemble": (ensemble_scores, "score"), "leave_one_out": (oob_scores, "score"), "bayesian": (tree_spread, "std"), "quantile": (tree_quantiles, "half_width"), "cross_validation": (cv_disagreement, "error")}


def model_score(method: str, df: DataFrame, key: str = "id", **options: object) -> DataFrame:
    """(key, score) by a named estimator; an unknown name is an error."""
    if method not in SCORES:
        raise ValueError(f"unknown estimator {method!r}; known: {sorted(SCORES)}")
    make, column = SCORES[method]
    return make(df, key=key, **options).select(key, F.col(column).alias("score"))
