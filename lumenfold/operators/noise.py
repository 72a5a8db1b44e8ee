"""Detection, scoring, correction and injection of label noise.

Detectors take labelled rows (key, y) and their neighbour table (key, neighbor, distance, rank) and
add a flag; estimators add a score and a target to correct towards. Thresholds are computed from
the rows at hand each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.quantiles import with_quantile
from lumenfold.operators.ranks import fresh, hash_ranked

EPS = 1e-10


def everything() -> Window:
    return Window.partitionBy()


def with_scalar(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds aggregates over all rows as columns (one broadcast row)."""
    return df.crossJoin(F.broadcast(df.agg(*(a.alias(n) for n, a in aggregates.items()))))


def neighbor_labels(rows: DataFrame, near: DataFrame, key: str = "id") -> DataFrame:
    """Per row: mean and population deviation of its neighbours' labels, and the mean weighted by 1 / distance."""
    y = rows.select(F.col(key).alias("neighbor"), F.col("y").alias("_y"))
    w = 1 / (F.col("distance") + EPS)
    stats = near.join(y, "neighbor").groupBy(key).agg(F.avg("_y").alias("nbr_mean"), F.stddev_pop("_y").alias("nbr_std"), (F.sum(F.col("_y") * w) / F.sum(w)).alias("nbr_weighted"))
    return rows.join(stats, key)


def knn_consistency(rows: DataFrame, near: DataFrame, percentile: float = 0.9, key: str = "id") -> DataFrame:
    """Flags rows whose neighbours' labels deviate more than the percentile of all rows' deviations."""
    d = neighbor_labels(rows, near, key)
    return with_quantile(d, "_cut", "nbr_std", percentile, rows.count()).withColumn("is_noise", F.col("nbr_std") > F.col("_cut")).drop("_cut")


def distance_weighted(rows: DataFrame, near: DataFrame, deviations: float = 2.0, key: str = "id") -> DataFrame:
    d = neighbor_labels(rows, near, key)
    return with_scalar(d, _s=F.stddev_pop("y")).withColumn("is_noise", F.abs(F.col("y") - F.col("nbr_weighted")) > deviations * F.col("_s")).drop("_s")


def consensus(rows: DataFrame, near: DataFrame, disagreement: float = 2.0, consistency: float = 1.0, key: str = "id") -> DataFrame:
    """Flags rows far from a consistent neighbourhood; far from an inconsistent one is an activity cliff."""
    d = with_scalar(neighbor_labels(rows, near, key), _s=F.stddev_pop("y") + EPS)
    far, steady = F.abs(F.col("y") - F.col("nbr_mean")) / F.col("_s") > disagreement, F.col("nbr_std") / F.col("_s") < consistency
    return d.withColumns({"is_noise": far & steady, "is_cliff": far & ~steady}).drop("_s")


def local_outlier_factor(near: DataFrame, key: str = "id") -> DataFrame:
    """(key, lof) from a k-neighbour table: mean local density of the neighbours over the row's own."""
    k_distance = near.groupBy(key).agg(F.max("distance").alias("_kd"))
    reach = near.join(k_distance.withColumnRenamed(key, "neighbor"), "neighbor").withColumn("_reach", F.greatest("distance", "_kd"))
    density = reach.groupBy(key).agg((1 / (F.avg("_reach") + EPS)).alias("_lrd"))
    around = near.join(density.toDF("neighbor", "_nl"), "neighbor").groupBy(key).agg(F.avg("_nl").alias("_around"))
    return around.join(density, key).select(key, (F.col("_around") / F.col("_lrd")).alias("lof"))


def lof_noise(rows: DataFrame, near: DataFrame, contamination: float = 0.1, key: str = "id") -> DataFrame:
    d = rows.join(local_outlier_factor(near, key), key)
    return with_quantile(d, "_cut", "lof", 1 - contamination, rows.count()).withColumn("is_noise", F.col("lof") > F.col("_cut")).drop("_cut")


def z_score(rows: DataFrame, limit: float = 3.0) -> DataFrame:
    d = with_scalar(rows, _m=F.avg("y"), _s=F.stddev_pop("y"))
    return d.withColumn("is_noise", F.abs(F.col("y") - F.col("_m")) > limit * F.col("_s")).drop("_m", "_s")


def removed(flagged: DataFrame) -> DataFrame:
    """The rows that aren't flagged."""
    return flagged.filter(~F.col("is_noise"))


ESTIMATORS = {
    "neighbor_residual": lambda s: F.abs(F.col("y") - F.col("nbr_mean")) / (s + EPS),
    "local_variance_ratio": lambda s: F.abs(F.col("y") - F.col("nbr_mean")) / (F.col("nbr_std") + EPS),
    "distance_weighted": lambda s: F.abs(F.col("y") - F.col("nbr_weighted")) / (s + EPS),
    "activity_cliff_aware": lambda s: F.abs(F.col("y") - F.col("nbr_mean")) / (s + EPS) / (1 + F.col("nbr_std") / (s + EPS)),
}


def estimate(rows: DataFrame, near: DataFrame, method: str = "neighbor_residual", key: str = "id") -> DataFrame:
    """Adds ``score`` (higher: noisier) and ``target``."""
    if method not in ESTIMATORS:
        raise ValueError(f"unknown estimator {method!r}; known: {sorted(ESTIMATORS)}")
    d = with_scalar(neighbor_labels(rows, near, key), _s=F.stddev_pop("y"))
    target = "nbr_weighted" if method == "distance_weighted" else "nbr_mean"
    return d.withColumns({"score": ESTIMATORS[method](F.col("_s")), "target": F.col(target)}).drop("_s")


def hybrid_score(scored: list[DataFrame], key: str = "id") -> DataFrame:
    """Mean of min-max scaled scores of several estimators."""
    out = None
    for i, d in enumerate(scored):
        part = with_scalar(d.select(key, "score"), _lo=F.min("score"), _hi=F.max("score")).select(key, ((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS)).alias(f"_{i}"))
        out = part if out is None else out.join(part, key)
    return out.select(key, (sum(F.col(f"_{i}") for i in range(len(scored))) / len(scored)).alias("score"))


def scaled_score(df: DataFrame) -> DataFrame:
    return with_scalar(df, _lo=F.min("score"), _hi=F.max("score")).withColumn("_n", (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS)).drop("_lo", "_hi")


def weight_forms(n: Column, strength: float = 1.0) -> dict[str, Column]:
    """A weight for a scaled score, by name."""
    return {"inverse": 1 / (1 + strength * n), "exponential": F.exp(-strength * n), "soft": F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - strength * n * n))}


def weights(df: DataFrame, strength: float = 1.0, method: str | tuple[str, ...] = "inverse") -> DataFrame:
    """Adds ``weight`` (mean 1) from scaled scores; of several methods, given as a tuple, a column each by name."""
    forms = weight_forms(F.col("_n"), strength)
    methods = (method,) if isinstance(method, str) else method
    if unknown := set(methods) - forms.keys():
        raise ValueError(f"unknown weighting {sorted(unknown)}; known: {sorted(forms)}")
    names = ["weight"] if isinstance(method, str) else list(methods)
    d = scaled_score(df).withColumns({n: forms[m] for n, m in zip(names, methods, strict=True)})
    means = {f"_m{i}": F.avg(n) for i, n in enumerate(names)}
    return with_scalar(d, **means).withColumns({n: F.col(n) / F.col(f"_m{i}") for i, n in enumerate(names)}).drop(*means, "_n")


def smooth(df: DataFrame, alpha: float = 0.5, method: str | tuple[str, ...] = "proportional") -> DataFrame:
    """Adds ``y_smooth``: labels moved towards ``target`` by their scores; of several methods, given as a tuple, a column each by name."""
    d, n, y, t = scaled_score(df), F.col("_n"), F.col("y"), F.col("target")
    c = alpha * F.col("score") / (1 + alpha * F.col("score"))
    forms = {
        "proportional": y + alpha * n * (t - y), "soft_threshold": y + alpha / (1 + F.exp(-5 * (n - 0.5))) * (t - y), "confidence": (1 - c) * y + c * t,
        "threshold": F.when(n > F.col("_cut"), (1 - alpha) * y + alpha * t).otherwise(y),
    }
    methods = (method,) if isinstance(method, str) else method
    if unknown := set(methods) - forms.keys():
        raise ValueError(f"unknown smoothing {sorted(unknown)}; known: {sorted(forms)}")
    if "threshold" in methods:
        d = with_quantile(d, "_cut", "_n", 1 - alpha)
    names = ["y_smooth"] if isinstance(method, str) else list(methods)
    return d.withColumns({x: forms[m] for x, m in zip(names, methods, strict=True)}).drop("_n", "_cut")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a hash of the key: the same in every run and engine."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"_{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def normal(key: Column, seed: str) -> Column:
    """A standard normal number from two hashes of the key."""
    return F.sqrt(-2 * F.log(uniform(key, f"{seed}a"))) * F.cos(2 * 3.141592653589793 * uniform(key, f"{seed}b"))


STRATEGIES = ("legacy", "outlier", "quantile", "hetero", "threshold", "valprop")


def inject(rows: DataFrame, sigma: float, strategy: str | tuple[str, ...] = "legacy", seed: str = "0", key: str = "id") -> DataFrame:
    """Adds ``y_noisy``; of several strategies, given as a tuple, a column each by name. Unknown strategies are plain normal noise.

    Outliers are the first twentieth of the rows, at least one, in hash order.
    """
    names = ["y_noisy"] if isinstance(strategy, str) else list(strategy)
    strategies = (strategy,) if isinstance(strategy, str) else strategy
    z = normal(F.col(key), seed)
    s, m, q = fresh(rows, "s", "m", "q")
    d = with_quantile(with_scalar(rows, **{s: F.stddev_pop("y"), m: F.avg("y")}), q, "y", [0.25, 0.5, 0.75], rows.count())
    place, n = fresh(d, "place", "n")
    if "outlier" in strategies:
        d = hash_ranked(d, key, f"{seed}o", place, n)
    y, plain = F.col("y"), z * sigma * F.col(s)
    noise = {
        "outlier": lambda: plain * F.when(F.col(place) < F.greatest(F.lit(1), F.floor(F.col(n) * 0.05)), 5.0).otherwise(1.0),
        "quantile": lambda: plain * F.when((y < F.element_at(q, 1)) | (y > F.element_at(q, 3)), 2.0).otherwise(1.0), "hetero": lambda: z * sigma * F.abs(y - F.col(m)),
        "threshold": lambda: plain * F.when(y > F.element_at(q, 2), 1.5).otherwise(1.0), "valprop": lambda: z * sigma * (F.abs(y) + 0.1),
    }
    return d.withColumns({x: y + noise.get(t, lambda: plain)() for x, t in zip(names, strategies, strict=True)}).drop(s, m, q, place, n)


def flip(rows: DataFrame, probability: float, seed: str = "0", key: str = "id", label: str = "label", strategy: str = "uniform") -> DataFrame:
    """Adds ``label_noisy``: 0/1 labels flipped with this probability, by hash of the key.

    ``binary_asymmetric``: ones flip with the probability, zeros with half of it. ``class_imbalance``:
    a label flips with the probability times twice the share of the other class, so that the rarer
    class loses more of its labels.
    """
    p = {"uniform": F.lit(probability), "binary_asymmetric": F.when(F.col(label) == 1, probability).otherwise(probability / 2)}
    d = rows
    if strategy == "class_imbalance":
        ones = fresh(rows, "ones")[0]
        d = with_scalar(rows, **{ones: F.avg(F.col(label).cast("double"))})
        p[strategy] = 2 * probability * F.when(F.col(label) == 1, 1 - F.col(ones)).otherwise(F.col(ones))
    if strategy not in p:
        raise ValueError(f"unknown flips {strategy!r}; known: uniform, binary_asymmetric, class_imbalance")
    return d.withColumn("label_noisy", F.when(uniform(F.col(key), seed) < p[strategy], 1 - F.col(label)).otherwise(F.col(label))).select(*rows.columns, "label_noisy")


#: Detectors by name: what each needs of (rows, near) and its options.
DETECTORS = {"knn_consistency": knn_consistency, "distance_weighted": distance_weighted, "consensus": consensus, "lof": lof_noise, "z_score": lambda rows, near, **options: z_score(rows, **options)}


def detect(method: str, rows: DataFrame, near: DataFrame | None = None, **options: object) -> DataFrame:
    """Flags noise by a named detector; an unknown name is an error."""
    if method not in DETECTORS:
        raise ValueError(f"unknown detector {method!r}; known: {sorted(DETECTORS)}")
    if near is None and method != "z_score":
        raise ValueError(f"{method} needs a neighbour table")
    return DETECTORS[method](rows, near, **options)


def conformal_widths(predicted: DataFrame, alpha: float = 0.1, calibration: float = 0.2, seed: str = "42", key: str = "id", y: str = "y", p: str = "y_pred", unc: str = "unc") -> DataFrame:
    """Adds ``width`` (twice the calibration rows' (1 - alpha) quantile of |y - p| / unc, times unc) and ``score`` (width over its deviation).

    Calibration rows are the first ``floor(n * calibration)`` in hash order.
    """
    place, n, cut, s = fresh(predicted, "place", "n", "cut", "s")
    d = hash_ranked(predicted, key, seed, place, n)
    ratio = F.abs(F.col(y) - F.col(p)) / (F.col(unc) + EPS)
    d = with_quantile(d, cut, F.when(F.col(place) < F.floor(F.col(n) * calibration), ratio), 1 - alpha, predicted.count())
    d = d.withColumn("width", 2 * F.col(cut) * F.col(unc))
    return with_scalar(d, **{s: F.stddev_pop("width") + EPS}).withColumn("score", F.col("width") / F.col(s)).drop(place, n, cut, s)
