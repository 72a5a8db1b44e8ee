"""Experiment analytics: aggregates, robustness under noise, variance decomposition, rank tests, calibration, conformal coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.distributions import f_tail, pearson_p, rank_sum_p, signed_rank_p, t_two_sided
from lumenfold.operators.quantiles import quantiles
from lumenfold.operators.ranks import fresh, with_sum_before


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (Spark prunes groups before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= n)


def best_row(df: DataFrame, groups: list[str], score: str, ties: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest score of each group; ties by the given columns, ascending."""
    key = F.struct(F.col(score).alias("_score"), *[(-F.col(t)).alias(f"_{t}") if dict(df.dtypes)[t] in ("int", "bigint", "double") else F.col(t).alias(f"_{t}") for t in ties])
    return df.groupBy(*groups).agg(F.max_by(F.struct(*keep), key).alias("_b")).select(*groups, "_b.*")


def minmax(x: str, keys: tuple[str, ...] = (), constant: float = 0.0) -> Column:
    """Scaled to 0..1 within the keys' rows."""
    window = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(window), F.max(x).over(window)
    return F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(constant)


def slope(df: DataFrame, keys: list[str], y: str = "r2", x: str = "sigma") -> DataFrame:
    """Least-squares slope, intercept and r2 of y over x."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("fit_r2"), F.count(F.lit(1)).alias("n"))


def at_sigma(value: str, target: float, tolerance: float = 0.05) -> Column:
    """The value at the first noise level within the tolerance."""
    return F.min_by(value, F.when(F.abs(F.col("sigma") - target) < tolerance, F.col("sigma")))


def robustness(df: DataFrame, keys: list[str], high: float = 0.6, clip: tuple[float, float] = (0.0, 150.0), min_rows: int = 3) -> DataFrame:
    """Per configuration: baseline and high-noise score, retention (percent, clipped), slopes, score at given noise levels.

    ``df`` has one row per key and sigma (r2, rmse). Configurations with fewer than ``min_rows``
    noise levels are left out; valid if there is a positive baseline and a high-noise score.
    """
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("r2", F.when(F.col("sigma") == 0, F.col("sigma"))).alias("baseline"), at_sigma("r2", high).alias("high"),
        F.regr_slope("r2", "sigma").alias("nsi"), F.regr_slope("rmse", "sigma").alias("nsi_rmse"), *(at_sigma("r2", s).alias(f"r2_at_{int(s * 10)}") for s in (0.2, 0.3, 0.4)),
    ).filter(F.col("n") >= min_rows)
    valid = F.col("baseline").isNotNull() & F.col("high").isNotNull() & (F.col("baseline") > 0)
    retention = F.when(valid, F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("high") / F.col("baseline") * 100)))
    return out.withColumn("is_valid", valid).withColumn("retention", retention).withColumn("relative_nsi", F.when(valid, F.col("nsi") / F.col("baseline")))


def two_point_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """(score at 0 - score at the largest sigma) / that sigma, retention, error increase, trapezoid area and area / range."""
    by = Window.partitionBy(*keys).orderBy("sigma")
    step = df.withColumn("_area", (F.col("sigma") - F.lag("sigma").over(by)) * (F.col("r2") + F.lag("r2").over(by)) / 2)
    out = step.groupBy(*keys).agg(F.min_by("r2", "sigma").alias("r2_0"), F.max_by("r2", "sigma").alias("r2_max"), F.max("sigma").alias("sigma_max"), F.min_by("mae", "sigma").alias("mae_0"), F.max_by("mae", "sigma").alias("mae_max"), F.sum("_area").alias("auc"))
    return out.select(
        *keys, ((F.col("r2_0") - F.col("r2_max")) / F.col("sigma_max")).alias("nsi"), (F.col("r2_max") / F.col("r2_0") * 100).alias("retention"),
        ((F.col("mae_max") - F.col("mae_0")) / F.col("mae_0") * 100).alias("mae_increase"), "auc", (F.col("auc") / F.col("sigma_max")).alias("auc_normalized"),
    )


def composite_score(df: DataFrame) -> DataFrame:
    """Mean of min-max retention and inverted min-max |nsi| over valid rows."""
    ok = df.filter("is_valid").withColumn("_abs", F.abs("nsi"))
    return ok.withColumn("composite", (minmax("retention") + 1 - minmax("_abs")) / 2).drop("_abs")


def variance_decomposition(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Sums of squares of a, b, their interaction and the rest: one row per term, from one pass of grouping sets.

    Marginal sums of squares are subtracted as they are, so that unbalanced cells can leave a
    negative rest, as in the published tables; p is null where f can't be one then.
    """
    s = df.cube(a, b).agg(F.grouping_id().alias("_g"), F.avg(y).alias("_y"), F.count(F.lit(1)).alias("_k"), F.var_pop(y).alias("_v")).select("_g", "_y", "_k", "_v")
    g = s.filter("_g = 3").select(F.col("_y").alias("_m"), F.col("_k").alias("_n"), (F.col("_v") * F.col("_k")).alias("_total"))
    part = s.crossJoin(F.broadcast(g)).withColumn("_ss", F.col("_k") * (F.col("_y") - F.col("_m")) ** 2)  # g is one row
    level = F.col("_g")
    t = part.agg(
        F.sum(F.when(level == 1, F.col("_ss"))).alias("ss_a"), F.sum(F.when(level == 2, F.col("_ss"))).alias("ss_b"), F.sum(F.when(level == 0, F.col("_ss"))).alias("ss_cells"),
        F.count_if(level == 1).alias("ka"), F.count_if(level == 2).alias("kb"), F.max("_n").alias("n"), F.max("_total").alias("total"),
    )
    inter, rest = F.col("ss_cells") - F.col("ss_a") - F.col("ss_b"), F.col("total") - F.col("ss_cells")
    term = lambda name, ss, dof: F.struct(F.lit(name).alias("term"), ss.alias("ss"), dof.cast("long").alias("df"))
    terms = F.array(term(a, F.col("ss_a"), F.col("ka") - 1), term(b, F.col("ss_b"), F.col("kb") - 1), term("interaction", inter, (F.col("ka") - 1) * (F.col("kb") - 1)), term("residual", rest, F.col("n") - F.col("ka") * F.col("kb")))
    out = t.select("total", F.explode(terms).alias("t")).select("t.*", "total")
    residual = F.max(F.when(F.col("term") == "residual", F.col("ss") / F.col("df"))).over(Window.partitionBy())
    rest = F.max(F.when(F.col("term") == "residual", F.col("df"))).over(Window.partitionBy())
    out = out.withColumn("_rest", rest).withColumn("ms", F.col("ss") / F.col("df")).withColumn("f", F.when(F.col("term") != "residual", F.col("ss") / F.col("df") / residual)).withColumn("eta2", F.col("ss") / F.col("total") * 100)
    return out.withColumn("p", f_tail(F.col("f"), F.col("df"), F.col("_rest"))).drop("_rest")


def average_ranks(counts: DataFrame, value: str, n: str, groups: list[str], name: str) -> DataFrame:
    """Adds the average rank that the ``n`` rows of a value have within groups; ``counts`` has each value once."""
    before = fresh(counts, "before")[0]
    return with_sum_before(counts, value, n, before, groups).withColumn(name, F.col(before) + (F.col(n) + 1) / 2.0).drop(before)


def with_average_rank(df: DataFrame, value: str, groups: list[str], name: str) -> DataFrame:
    """Adds the average rank of ``value`` within groups; ties share the mean of their places.

    Values are counted, the counts ranked by buckets of their order and joined back: no group is one task.
    """
    n = fresh(df, "n")[0]
    keys = [*groups, value]
    other = fresh(df, *(f"{k}_of" for k in keys))
    r = average_ranks(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)), value, n, groups, name)
    r = r.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), name)
    return df.join(r, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)))).drop(*other)


def _tied(n: str) -> Column:
    """The sum of t**3 - t over runs of t equal values."""
    t = F.col(n).cast("double")
    return F.sum(t * t * t - t)


def mann_whitney(df: DataFrame, group: str, value: str, top: int = 6, min_n: int = 3) -> DataFrame:
    """U and its two-sided p for every pair among the ``top`` most frequent groups, average ranks for ties.

    A group's rows are counted by value before anything is paired.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n).orderBy(F.desc("n"), group).limit(top)
    s = df.join(F.broadcast(sizes.select(group)), group).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    names = sizes.select(F.col(group).alias("g"))
    pairs = names.select(F.col("g").alias("g1")).join(names.select(F.col("g").alias("g2")), F.col("g1") < F.col("g2"))
    both = s.join(F.broadcast(pairs), (F.col("g") == F.col("g1")) | (F.col("g") == F.col("g2")))  # at most top * (top - 1) / 2 pairs
    counts = both.groupBy("g1", "g2", "v").agg(F.sum(F.when(F.col("g") == F.col("g1"), F.col("k")).otherwise(0)).alias("_a"), F.sum("k").alias("_k"))
    r = average_ranks(counts, "v", "_k", ["g1", "g2"], "_r")
    out = r.groupBy("g1", "g2").agg(F.sum("_a").alias("n1"), F.sum(F.col("_k") - F.col("_a")).alias("n2"), F.sum(F.col("_a") * F.col("_r")).alias("_r1"), _tied("_k").alias("_ties"))
    out = out.select("g1", "g2", "n1", "n2", (F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "_ties")
    return out.withColumn("p", rank_sum_p(F.col("n1"), F.col("n2"), F.col("u"), F.col("_ties"))).drop("_ties")


def wilcoxon(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank sums of a - b per key, zero differences left out: statistic is the smaller sum, p two-sided."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).filter("_d <> 0").groupBy(*keys, F.abs("_d").alias("_abs")).agg(F.count_if(F.col("_d") > 0).alias("_up"), F.count(F.lit(1)).alias("_k"))
    r = average_ranks(d, "_abs", "_k", keys, "_r")
    out = r.groupBy(*keys).agg(F.sum("_k").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum((F.col("_k") - F.col("_up")) * F.col("_r")).alias("w_minus"), _tied("_k").alias("_ties"))
    out = out.withColumn("statistic", F.least("w_plus", "w_minus"))
    return out.withColumn("p", signed_rank_p(F.col("n"), F.col("statistic"), F.col("_ties"))).drop("_ties")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per key; 0 where a side is constant."""
    r = with_average_rank(with_average_rank(df, a, keys, "_ra"), b, keys, "_rb")
    return r.groupBy(*keys).agg(F.coalesce(correlation(F.col("_ra"), F.col("_rb")), F.lit(0.0)).alias("rho"), F.count(F.lit(1)).alias("n"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate, null where a side is constant."""
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def pearson(df: DataFrame, keys: list[str], a: str | Column, b: str | Column) -> DataFrame:
    """Correlation, its two-sided p and n per key; null p for fewer than three pairs or a constant side."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    out = df.groupBy(*keys).agg(correlation(a, b).alias("r"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"))
    return out.withColumn("p", pearson_p(F.col("r"), F.col("n")))


def paired_t(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean difference, t and its two-sided p per key."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_difference"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))))).alias("t"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Errors and r2 per key; r2 is null where labels don't differ."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*keys).agg(F.avg(e**2).alias("mse"), F.sqrt(F.avg(e**2)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e**2), F.count(F.lit(1)) * F.var_pop(y))).alias("r2"), F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, y: str, p: str, score: str | None = None) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, F1; the area under the curve by average ranks if there is a score. Null where there is nothing to divide by."""
    pos, hit = F.col(y) == 1, F.col(p) == 1
    out = df.agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))
    if score:
        counts = df.groupBy(F.col(score).alias("_s")).agg(F.count_if(pos).alias("_p"), F.count(F.lit(1)).alias("_k"))
        out = out.crossJoin(average_ranks(counts, "_s", "_k", [], "_r").agg(F.sum(F.col("_p") * F.col("_r")).alias("_rp")))  # one row each
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = out.withColumns({"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("auc", F.try_divide(F.col("_rp") - (tp + fn) * (tp + fn + 1) / 2, (tp + fn) * (fp + tn))).drop("_rp") if score else out


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; a class never predicted has precision 0."""
    long = df.select(F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col(y) == F.col(p)).cast("int").alias("h")), F.struct(F.col(p).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("s")).select("s.*")
    s = long.groupBy("c").agg(F.sum("t").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support")), "f1": ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))})


def calibration_error(df: DataFrame, keys: list[str], error: str, unc: str, bins: int = 10, min_n: int = 10) -> DataFrame:
    """Mean over rows of |mean error - mean uncertainty| of their percentile bin; null for fewer than ``min_n`` rows.

    Bin edges are percentiles of the uncertainty, bins are half open and the last edge is raised a
    little; equal edges leave empty bins, which count nothing.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(quantiles(df, unc, [i / bins for i in range(bins + 1)], keys, "_edges").join(sizes, keys), keys)
    top = F.element_at("_edges", bins + 1) + 1e-8
    bin_of = F.size(F.filter(F.slice("_edges", 1, bins), lambda e: e <= F.col(unc)))
    b = d.filter(F.col(unc) < top).withColumn("_bin", bin_of).groupBy(*keys, "_bin").agg(F.avg(error).alias("_e"), F.avg(unc).alias("_u"), F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n"))
    return b.groupBy(*keys).agg(F.first("_n").alias("n"), F.when(F.first("_n") >= min_n, F.sum(F.abs(F.col("_e") - F.col("_u")) * F.col("_k")) / F.first("_n")).alias("ece"))


def conformal(df: DataFrame, keys: list[str], alpha: float, tolerance: float = 0.05, y: str = "y_true", p: str = "y_pred", width: str = "unc") -> DataFrame:
    """Coverage against 1 - alpha, interval widths, errors and width / rmse (infinite where rmse is 0)."""
    e = F.col(y) - F.col(p)
    out = df.groupBy(*keys).agg(
        F.avg((F.abs(e) <= F.col(width)).cast("double")).alias("empirical"), F.avg(2 * F.col(width)).alias("width_mean"), F.median(2 * F.col(width)).alias("width_median"),
        F.stddev_samp(2 * F.col(width)).alias("width_std"), F.sqrt(F.avg(e**2)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"),
    )
    out = out.withColumns({"expected": F.lit(1 - alpha), "deviation": F.col("empirical") - (1 - alpha)})
    return out.withColumns({"calibrated": F.abs("deviation") < tolerance, "efficiency": F.when(F.col("rmse") > 0, F.col("width_mean") / F.col("rmse")).otherwise(float("inf"))})
