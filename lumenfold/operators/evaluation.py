"""Robustness by exact noise levels and by folds, cross-validation summaries, learning-curve fits, label checks, mitigation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.analytics import regression_metrics
from lumenfold.operators.quantiles import quantiles

# Kinds of mitigation methods, and those that take a distance or spare activity cliffs.
CATEGORIES = {"distance": ("knn_k5", "knn_k10", "knn_k20", "neighborhood_consensus", "distance_weighted", "lof"), "ensemble": ("cv_disagreement", "bootstrap_ensemble", "co_teaching"), "outlier": ("zscore", "mahalanobis", "prediction_error")}
CLIFF_AWARE = ("neighborhood_consensus", "activity_cliff")
# Other names of the columns of result files.
ALIASES = {"rep": ("representation",), "sigma": ("sigma_noise", "noise_level", "flip_prob"), "r2": ("R2", "r2_score"), "model": ("model_name",)}


def at(value: str, sigma: float) -> Column:
    """The value at exactly this noise level (the largest, should it repeat)."""
    return F.max(F.when(F.col("sigma") == sigma, F.col(value)))


def exact_sigma_index(df: DataFrame, keys: list[str], high: float = 0.6) -> DataFrame:
    """(baseline - high) / sigma and retention in percent, of configurations that have both noise levels."""
    d = df.groupBy(*keys).agg(at("r2", 0.0).alias("baseline"), at("r2", high).alias("high")).filter("baseline is not null and high is not null")
    retention = F.when(F.col("baseline") > 0, F.col("high") / F.col("baseline") * 100).otherwise(0.0)
    return d.withColumns({"nsi": (F.col("baseline") - F.col("high")) / high, "retention": retention})


def fold_robustness(df: DataFrame, keys: list[str], fold: str = "fold") -> DataFrame:
    """Degradation slopes over noise levels of fold averages, the baseline's deviation between folds, retention at 0.5 and 1.0, the fit."""
    by_fold = df.groupBy(*keys, "sigma", fold).agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
    s = by_fold.groupBy(*keys, "sigma").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.stddev_samp("r2").alias("spread"))
    out = s.groupBy(*keys).agg(
        F.min_by("r2", "sigma").alias("baseline"), F.min_by("rmse", "sigma").alias("baseline_rmse"), at("spread", 0.0).alias("baseline_std"),
        F.regr_slope("r2", "sigma").alias("slope_r2"), F.regr_slope("rmse", "sigma").alias("slope_rmse"), F.regr_r2("r2", "sigma").alias("fit"), at("r2", 0.5).alias("half"), at("r2", 1.0).alias("full"),
    )
    share = lambda c: F.when(F.col("baseline") > 0, F.col(c) / F.col("baseline"))
    return out.withColumns({"retention_half": share("half"), "retention_full": share("full")}).drop("half", "full")


def regression_robustness(df: DataFrame, keys: list[str], high: float = 0.5, tolerance: float = 0.1, floor: float = 0.05, cap: float = 150.0) -> DataFrame:
    """Baseline, score near the high noise level, capped retention (none below a baseline of ``floor``) and slope; at least three noise levels."""
    near = F.when(F.abs(F.col("sigma") - high) < tolerance, F.col("sigma"))
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), at("r2", 0.0).alias("baseline"), F.min_by("r2", near).alias("r2_high"), F.min_by("rmse", near).alias("rmse_high"), F.regr_slope("r2", "sigma").alias("nsi")).filter("n >= 3")
    return d.withColumn("retention", F.when(F.col("baseline") > floor, F.least(F.lit(cap), F.col("r2_high") / F.col("baseline") * 100)))


def fold_summary(df: DataFrame, keys: list[str], metrics: list[str], score: str = "r2", limit: float = 0.5) -> DataFrame:
    """Of each metric the mean, population deviation, least and largest over folds, and whether the mean score passes the limit."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), *(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))
    return out.withColumn("passes", F.col(f"{score}_mean") > limit)


def allocation_shares(selected: DataFrame, widths: DataFrame) -> DataFrame:
    """Per representation: features selected, share of its width and of the budget (percent), mean and deviation of importance.

    ``selected`` is (rep, pos, score), ``widths`` (rep, width).
    """
    s = selected.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("importance_mean"), F.stddev_pop("score").alias("importance_std"))
    total = s.agg(F.sum("n").alias("budget"))
    d = s.join(widths, "rep").crossJoin(F.broadcast(total))  # one row per representation
    return d.select("rep", "n", "width", (100 * F.col("n") / F.col("width")).alias("of_width"), (100 * F.col("n") / F.col("budget")).alias("of_budget"), "importance_mean", "importance_std")


def representation_report(predictions: DataFrame, cross: DataFrame, rep: str = "rep") -> DataFrame:
    """Per representation r2 on training and test rows, rmse and mae on test rows, mean and population deviation of r2 over folds, and its rank by test r2.

    ``predictions`` is (rep, split, y_true, y_pred) with splits train and test, ``cross`` (rep, fold,
    y_true, y_pred). Where labels don't differ r2 is null; null ranks last, ties go by name.
    """
    return ranked_report(_by_split(predictions, rep), regression_metrics(cross, [rep, "fold"]), rep)


def _by_split(predictions: DataFrame, rep: str) -> DataFrame:
    m = regression_metrics(predictions, [rep, "split"])
    of = lambda metric, split: F.max(F.when(F.col("split") == split, F.col(metric)))
    return m.groupBy(rep).agg(of("r2", "train").alias("r2_train"), of("r2", "test").alias("r2_test"), of("rmse", "test").alias("rmse_test"), of("mae", "test").alias("mae_test"))


def ranked_report(scores: DataFrame, folds: DataFrame, rep: str = "rep") -> DataFrame:
    """Scores by representation with the mean and deviation of its folds' r2, and their rank."""
    f = folds.groupBy(rep).agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"), F.count(F.lit(1)).alias("folds"))
    return scores.join(f, rep, "left").withColumn("rank", F.row_number().over(Window.orderBy(F.col("r2_test").desc_nulls_last(), rep)))  # one row per representation


def learning_curve_fit(df: DataFrame, keys: list[str], size: str = "n", score: str = "r2", powers: tuple[float, float, float] = (0.1, 2.0, 0.01)) -> DataFrame:
    """score = limit - a / size ** b, by least squares for each power of a grid; the power with the least error wins.

    As in a bounded fit, a isn't below 0; a power that would need that fits a constant.
    """
    low, high, step = powers
    grid = F.transform(F.sequence(F.lit(0), F.lit(round((high - low) / step))), lambda i: F.round(F.lit(low) + i * step, 6))
    d = df.withColumn("b", F.explode(grid)).withColumn("x", F.pow(F.col(size).cast("double"), -F.col("b")))
    fit = d.groupBy(*keys, "b").agg(F.regr_slope(score, "x").alias("slope"), F.regr_intercept(score, "x").alias("at_zero"), F.regr_syy(score, "x").alias("total"), F.regr_sxy(score, "x").alias("sxy"), F.avg(score).alias("mean"))
    down = F.col("slope") < 0
    fit = fit.withColumn("error", F.when(down, F.col("total") - F.col("slope") * F.col("sxy")).otherwise(F.col("total")))
    best = fit.groupBy(*keys).agg(F.min(F.struct(F.round("error", 12).alias("e"), "b", F.when(down, F.col("at_zero")).otherwise(F.col("mean")).alias("r2_max"), F.when(down, -F.col("slope")).otherwise(0.0).alias("a"), "total", "error")).alias("f"))
    return best.select(*keys, "f.r2_max", "f.a", "f.b", F.when(F.col("f.total") > 0, 1 - F.col("f.error") / F.col("f.total")).otherwise(0.0).alias("fit"))


def label_faults(df: DataFrame, y: str) -> DataFrame:
    """One row: labels, and those that are null, not a number, or infinite."""
    v = F.col(y).cast("double")
    infinite = F.abs(v) == float("inf")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(infinite & ~F.isnan(v)).alias("infinite"))


def check_labels(df: DataFrame, y: str = "y") -> DataFrame:
    """The rows as they are; an error before any work if a label is missing, not a number or infinite."""
    f = label_faults(df, y).first()
    if f["nulls"] or f["nans"] or f["infinite"]:
        raise ValueError(f"labels of {f['n']} rows: {f['nulls']} null, {f['nans']} not a number, {f['infinite']} infinite")
    return df


def standardize_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their standard names, where a file uses another known one (its standard name has precedence)."""
    for name, others in aliases.items():
        if name not in df.columns:
            for other in others:
                if other in df.columns:
                    df = df.withColumnRenamed(other, name)
                    break
    return df


def half_width(df: DataFrame, keys: list[str], value: str, low: float = 0.16, high: float = 0.84) -> DataFrame:
    """Median and half the distance between two quantiles: one standard deviation of a normal value."""
    d = quantiles(df, value, [low, 0.5, high], keys)
    return d.select(*keys, F.element_at("q", 2).alias("median"), ((F.element_at("q", 3) - F.element_at("q", 1)) / 2).alias("half_width"))


def method_category(method: Column) -> Column:
    out = F
    for name, methods in CATEGORIES.items():
        out = out.when(method.isin(*methods), name)
    return out.otherwise("other")


def recovery_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation, best and number of recovery rates, mean precision and recall."""
    return df.groupBy(*keys).agg(F.avg("recovery").alias("recovery_mean"), F.stddev_samp("recovery").alias("recovery_std"), F.max("recovery").alias("recovery_max"), F.count(F.lit(1)).alias("n"), F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"))


def distance_methods(df: DataFrame) -> DataFrame:
    return df.filter(F.col("method").isin(*CATEGORIES["distance"]))


def weighting_effect(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: what weighting features adds to the recovery of configurations that were run both ways."""
    of = lambda w: F.max(F.when(F.col("weighted") == w, F.col("recovery")))
    d = distance_methods(df).groupBy(*keys).agg((of(True) - of(False)).alias("gain")).filter("gain is not null")
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean"), F.median("gain").alias("median"), F.avg((F.col("gain") > 0).cast("double")).alias("improved"), F.max("gain").alias("best"), F.min("gain").alias("worst"))


def cliff_aware_gain(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean recovery of plain nearest-neighbour methods against that of the one that spares activity cliffs."""
    plain, aware = F.col("method").startswith("knn_"), F.col("method") == "neighborhood_consensus"
    d = df.groupBy(*keys).agg(F.avg(F.when(plain, F.col("recovery"))).alias("knn"), F.avg(F.when(aware, F.col("recovery"))).alias("aware")).filter("knn is not null and aware is not null")
    return d.withColumn("advantage", F.col("aware") - F.col("knn"))
