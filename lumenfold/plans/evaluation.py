"""Queries of robustness variants, cross-validation summaries and mitigation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import evaluation as E
from lumenfold.operators import selection as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import PRED, predictions, table, vectors
from lumenfold.plans.registry import query
from lumenfold.plans.selection import _STAT, _scores

CONFIG = ["dataset", "model", "rep", "strategy"]
_FOLDS = """fold_runs AS (SELECT CASE l_partkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS dataset, l_returnflag AS model, l_linestatus AS rep, l_linenumber::VARCHAR AS strategy, round(l_discount * 10, 1) AS sigma, l_suppkey % 5 AS fold,
  l_quantity / 50 AS r2, l_extendedprice / 1e5 AS rmse, l_tax AS mae FROM lineitem),
per_sigma AS (SELECT dataset, model, rep, strategy, sigma, avg(r2) AS r2, avg(rmse) AS rmse FROM fold_runs GROUP BY ALL)"""


def _folds(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        F.when(c("l_partkey") % 2 == 0, "even").otherwise("odd").alias("dataset"), c("l_returnflag").alias("model"), c("l_linestatus").alias("rep"), c("l_linenumber").cast("string").alias("strategy"),
        F.round(c("l_discount") * 10, 1).alias("sigma"), (c("l_suppkey") % 5).alias("fold"), (c("l_quantity") / 50).alias("r2"), (c("l_extendedprice") / 1e5).alias("rmse"), c("l_tax").alias("mae"),
    )


def _per_sigma(spark, sf):
    return _folds(spark, sf).groupBy(*CONFIG, "sigma").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))


@query("exact_sigma_index", f"""WITH {_FOLDS}, s AS (SELECT dataset, model, rep, strategy, max(r2) FILTER (WHERE sigma = 0) AS baseline, max(r2) FILTER (WHERE sigma = 0.6) AS high FROM per_sigma GROUP BY ALL)
SELECT dataset, model, rep, strategy, round(baseline, 6) AS baseline, round(high, 6) AS high, round((baseline - high) / 0.6, 6) AS nsi, round(CASE WHEN baseline > 0 THEN high / baseline * 100 ELSE 0 END, 5) AS retention FROM s WHERE baseline IS NOT NULL AND high IS NOT NULL""")
def exact_sigma_index(spark, sf):
    return rounded(E.exact_sigma_index(_per_sigma(spark, sf), CONFIG), retention=5)


@query("fold_robustness", f"""WITH {_FOLDS}, f AS (SELECT model, rep, strategy, sigma, fold, avg(r2) AS r2, avg(rmse) AS rmse FROM fold_runs GROUP BY ALL), s AS (SELECT model, rep, strategy, sigma, avg(r2) AS r2, avg(rmse) AS rmse, stddev_samp(r2) AS spread FROM f GROUP BY ALL),
t AS (SELECT model, rep, strategy, min_by(r2, sigma) AS baseline, min_by(rmse, sigma) AS baseline_rmse, max(spread) FILTER (WHERE sigma = 0) AS baseline_std, regr_slope(r2, sigma) AS slope_r2, regr_slope(rmse, sigma) AS slope_rmse, regr_r2(r2, sigma) AS fit, max(r2) FILTER (WHERE sigma = 0.5) AS half, max(r2) FILTER (WHERE sigma = 1) AS one FROM s GROUP BY ALL)
SELECT model, rep, strategy, round(baseline, 6) AS baseline, round(baseline_rmse, 9) AS baseline_rmse, round(baseline_std, 6) AS baseline_std, round(slope_r2, 6) AS slope_r2, round(slope_rmse, 6) AS slope_rmse, round(fit, 5) AS fit, round(CASE WHEN baseline > 0 THEN half / baseline END, 6) AS retention_half, round(CASE WHEN baseline > 0 THEN one / baseline END, 6) AS retention_full FROM t""")
def fold_robustness(spark, sf):
    return rounded(E.fold_robustness(_folds(spark, sf), ["model", "rep", "strategy"]), fit=5, baseline_rmse=9)


@query("regression_robustness", f"""WITH {_FOLDS}, s AS (SELECT dataset, model, rep, strategy, count(*) AS n, max(r2) FILTER (WHERE sigma = 0) AS baseline, min_by(r2, CASE WHEN abs(sigma - 0.5::DOUBLE) < 0.1::DOUBLE THEN sigma END) AS r2_high, min_by(rmse, CASE WHEN abs(sigma - 0.5::DOUBLE) < 0.1::DOUBLE THEN sigma END) AS rmse_high, regr_slope(r2, sigma) AS nsi FROM per_sigma GROUP BY ALL HAVING count(*) >= 3)
SELECT dataset, model, rep, strategy, n, round(baseline, 6) AS baseline, round(r2_high, 6) AS r2_high, round(rmse_high, 6) AS rmse_high, round(nsi, 6) AS nsi, round(CASE WHEN baseline > 0.05 THEN least(150, r2_high / baseline * 100) END, 5) AS retention FROM s""")
def regression_robustness(spark, sf):
    return rounded(E.regression_robustness(_per_sigma(spark, sf), CONFIG), retention=5)


@query("fold_summary", f"""WITH {_FOLDS}, f AS (SELECT dataset, model, fold, avg(r2) AS r2, avg(mae) AS mae, corr(r2, rmse) AS rho FROM fold_runs GROUP BY ALL)
SELECT dataset, model, count(*) AS folds, {', '.join(f'round({f}({m}), 6) AS {m}_{n}' for m in ('r2', 'mae', 'rho') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))}, avg(r2) > 0.5 AS passes FROM f GROUP BY ALL""")
def fold_summary(spark, sf):
    f = _folds(spark, sf).groupBy("dataset", "model", "fold").agg(F.avg("r2").alias("r2"), F.avg("mae").alias("mae"), F.corr("r2", "rmse").alias("rho"))
    return rounded(E.fold_summary(f, ["dataset", "model"], ["r2", "mae", "rho"]))


@query("allocation_shares", f"""WITH {_STAT}, w AS (SELECT rep, count(*) AS width FROM stat GROUP BY 1), k AS (SELECT * FROM stat QUALIFY row_number() OVER (ORDER BY c DESC, rep DESC, pos DESC) <= 20)
SELECT rep, count(*) AS n, any_value(width) AS width, round(100 * count(*) / any_value(width), 6) AS of_width, round(100 * count(*) / sum(count(*)) OVER (), 6) AS of_budget, round(avg(c), 6) AS importance_mean, round(stddev_pop(c), 6) AS importance_std FROM k JOIN w USING (rep) GROUP BY rep""")
def allocation_shares(spark, sf):
    s = _scores(spark, sf)
    return rounded(E.allocation_shares(s.orderBy(F.desc("score"), F.desc("rep"), F.desc("pos")).limit(20), s.groupBy("rep").agg(F.count(F.lit(1)).alias("width"))))


_PREDICTED = """given AS (SELECT l_linestatus || l_returnflag AS rep, CASE WHEN l_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, l_suppkey % 5 AS fold, l_quantity::DOUBLE AS y_true, l_quantity + l_extendedprice / 15000 AS y_pred FROM lineitem),
s AS (SELECT rep, split, fold, y_true, y_pred, y_true - y_pred AS e FROM given), m AS (SELECT rep, split, 1 - sum(e * e) / (count(*) * var_pop(y_true)) AS r2, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM s GROUP BY ALL),
f AS (SELECT rep, fold, 1 - sum(e * e) / (count(*) * var_pop(y_true)) AS r2 FROM s WHERE split = 'train' GROUP BY ALL)"""


@query("representation_report", f"""WITH {_PREDICTED}, r AS (SELECT rep, max(r2) FILTER (WHERE split = 'train') AS r2_train, max(r2) FILTER (WHERE split = 'test') AS r2_test, max(rmse) FILTER (WHERE split = 'test') AS rmse_test, max(mae) FILTER (WHERE split = 'test') AS mae_test FROM m GROUP BY 1),
c AS (SELECT rep, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std, count(*) AS folds FROM f GROUP BY 1)
SELECT rep, round(r2_train, 6) AS r2_train, round(r2_test, 6) AS r2_test, round(rmse_test, 6) AS rmse_test, round(mae_test, 6) AS mae_test, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, folds, row_number() OVER (ORDER BY r2_test DESC NULLS LAST, rep) AS rank FROM r LEFT JOIN c USING (rep)""")
def representation_report(spark, sf):
    c = F.col
    d = table(spark, sf, "lineitem").select(
        F.concat("l_linestatus", "l_returnflag").alias("rep"), F.when(c("l_partkey") % 5 == 0, "test").otherwise("train").alias("split"), (c("l_suppkey") % 5).alias("fold"),
        c("l_quantity").cast("double").alias("y_true"), (c("l_quantity") + c("l_extendedprice") / 15000).cast("double").alias("y_pred"),
    )
    return rounded(E.representation_report(d, d.filter("split = 'train'")))


_GRID = "list_transform(range(0, 191), lambda i: round(0.1 + i * 0.01, 6))"


@query("learning_curve_fit", f"""WITH {_FOLDS}, c AS (SELECT model, l.n, avg(r2) AS r2 FROM (SELECT model, strategy::INT * 100 AS n, r2 FROM fold_runs) l GROUP BY ALL), g AS (SELECT *, pow(n::DOUBLE, -b) AS x FROM (SELECT *, unnest({_GRID}) AS b FROM c)),
f AS (SELECT model, b, regr_slope(r2, x) AS slope, regr_intercept(r2, x) AS at_zero, regr_syy(r2, x) AS total, regr_sxy(r2, x) AS sxy, avg(r2) AS mean FROM g GROUP BY ALL), e AS (SELECT *, CASE WHEN slope < 0 THEN total - slope * sxy ELSE total END AS error FROM f)
SELECT model, round(CASE WHEN slope < 0 THEN at_zero ELSE mean END, 5) AS r2_max, round(CASE WHEN slope < 0 THEN -slope ELSE 0 END, 5) AS a, b, round(CASE WHEN total > 0 THEN 1 - error / total ELSE 0 END, 5) AS fit FROM e QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(error, 12), b) = 1""")
def learning_curve_fit(spark, sf):
    c = _folds(spark, sf).groupBy("model", (F.col("strategy").cast("int") * 100).alias("n")).agg(F.avg("r2").alias("r2"))
    return rounded(E.learning_curve_fit(c, ["model"]), 5, b=6)


@query("label_faults", "SELECT count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS nulls, count(*) FILTER (WHERE isnan(y)) AS nans, count(*) FILTER (WHERE isinf(y)) AS infinite FROM (SELECT CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE value END AS y FROM events)")
def label_faults(spark, sf):
    k = F.col("event_id") % 7
    y = F.when(k == 0, F.lit(None)).when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("value"))
    return E.label_faults(table(spark, sf, "events").select(y.alias("y")), "y")


@query("checked_labels", "SELECT vec_id AS id, label::DOUBLE + embedding[1]::DOUBLE AS y FROM embeddings")
def checked_labels(spark, sf):
    return E.check_labels(vectors(spark, sf).select("id", "y"))


@query("standardized_results", f"WITH {_FOLDS} SELECT model, rep, sigma, count(*) AS n, round(avg(r2), 6) AS r2 FROM fold_runs GROUP BY ALL")
def standardized_results(spark, sf):
    d = _folds(spark, sf).select("dataset", "model", "rep", "sigma", "r2")
    files = [d.filter("dataset = 'even'").withColumnRenamed("rep", "representation").withColumnRenamed("sigma", "sigma_noise"), d.filter("dataset = 'odd'").withColumnRenamed("sigma", "noise_level").withColumnRenamed("model", "model_name")]
    both = E.standardize_columns(files[0]).unionByName(E.standardize_columns(files[1]))
    return rounded(both.groupBy("model", "rep", "sigma").agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2")))


@query("prediction_half_width", f"WITH {PRED} SELECT model, rep, sigma, round(median(y_pred), 6) AS median, round((quantile_cont(y_pred, 0.84) - quantile_cont(y_pred, 0.16)) / 2, 6) AS half_width FROM preds GROUP BY ALL")
def prediction_half_width(spark, sf):
    return rounded(E.half_width(predictions(spark, sf), ["model", "rep", "sigma"], "y_pred"))


_METHODS = ("knn_k5", "knn_k10", "knn_k20", "neighborhood_consensus", "zscore", "cv_disagreement", "unlisted")
_METRICS = ("euclidean", "cosine", "manhattan")
_TRIALS = f"""trials AS (SELECT l_returnflag AS rep, CASE l_returnflag WHEN 'R' THEN 'hybrid' ELSE 'base' END AS rep_type, ([{', '.join(f"'{m}'" for m in _METHODS)}])[l_suppkey % 7 + 1] AS method, ([{', '.join(f"'{m}'" for m in _METRICS)}])[l_partkey % 3 + 1] AS metric,
  l_linestatus = 'O' AS weighted, l_linenumber / 10 AS sigma, avg(l_discount * 10 - 0.3) AS recovery, avg(l_tax * 10) AS precision, avg(l_quantity / 50) AS recall, avg(l_extendedprice / 1e5) AS r2_cleaned FROM lineitem GROUP BY ALL)"""


def _trials(spark, sf):
    c, pick = F.col, lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    d = table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("rep"), F.when(c("l_returnflag") == "R", "hybrid").otherwise("base").alias("rep_type"), pick(_METHODS, c("l_suppkey") % 7).alias("method"), pick(_METRICS, c("l_partkey") % 3).alias("metric"),
        (c("l_linestatus") == "O").alias("weighted"), (c("l_linenumber") / 10).alias("sigma"), (c("l_discount") * 10 - 0.3).alias("recovery"), (c("l_tax") * 10).alias("precision"), (c("l_quantity") / 50).alias("recall"), (c("l_extendedprice") / 1e5).alias("r2_cleaned"),
    )
    return d.groupBy("rep", "rep_type", "method", "metric", "weighted", "sigma").agg(*(F.avg(v).alias(v) for v in ("recovery", "precision", "recall", "r2_cleaned")))


_RECOVERY = "round(avg(recovery), 6) AS recovery_mean, round(stddev_samp(recovery), 6) AS recovery_std, round(max(recovery), 6) AS recovery_max, count(*) AS n, round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean"
_NEAR = ", ".join(f"'{m}'" for m in E.CATEGORIES["distance"])
_CASES = " ".join(f"WHEN method IN ({', '.join(repr(m) for m in ms)}) THEN '{n}'" for n, ms in E.CATEGORIES.items())


@query("mitigation_overall", f"WITH {_TRIALS} SELECT rep, rep_type, method, metric, weighted, sigma, round(recovery, 6) AS recovery, round(precision, 6) AS precision, round(recall, 6) AS recall, round(r2_cleaned, 6) AS r2_cleaned FROM trials ORDER BY round(recovery, 9) DESC, rep, method, metric, weighted, sigma LIMIT 15")
def mitigation_overall(spark, sf):
    return rounded(_trials(spark, sf).orderBy(F.round("recovery", 9).desc(), "rep", "method", "metric", "weighted", "sigma").limit(15))


@query("mitigation_by_representation", f"WITH {_TRIALS} SELECT rep_type, rep, sigma, {_RECOVERY} FROM trials GROUP BY ALL")
def mitigation_by_representation(spark, sf):
    return rounded(E.recovery_table(_trials(spark, sf), ["rep_type", "rep", "sigma"]))


@query("mitigation_by_category", f"WITH {_TRIALS} SELECT method, CASE {_CASES} ELSE 'other' END AS category, method IN ('neighborhood_consensus', 'activity_cliff') AS cliff_aware, {_RECOVERY} FROM trials GROUP BY ALL")
def mitigation_by_category(spark, sf):
    d = _trials(spark, sf).withColumns({"category": E.method_category(F.col("method")), "cliff_aware": F.col("method").isin(*E.CLIFF_AWARE)})
    return rounded(E.recovery_table(d, ["method", "category", "cliff_aware"]))


@query("mitigation_by_metric", f"WITH {_TRIALS} SELECT metric, weighted, {_RECOVERY} FROM trials WHERE method IN ({_NEAR}) GROUP BY ALL")
def mitigation_by_metric(spark, sf):
    return rounded(E.recovery_table(E.distance_methods(_trials(spark, sf)), ["metric", "weighted"]))


@query("mitigation_weighting", f"""WITH {_TRIALS}, g AS (SELECT max(recovery) FILTER (WHERE weighted) - max(recovery) FILTER (WHERE NOT weighted) AS gain FROM trials WHERE method IN ({_NEAR}) GROUP BY rep, method, metric, sigma)
SELECT count(gain) AS n, round(avg(gain), 6) AS mean, round(median(gain), 6) AS median, round(avg((gain > 0)::INT), 6) AS improved, round(max(gain), 6) AS best, round(min(gain), 6) AS worst FROM g""")
def mitigation_weighting(spark, sf):
    return rounded(E.weighting_effect(_trials(spark, sf), ["rep", "method", "metric", "sigma"]))


@query("mitigation_cliff_aware", f"""WITH {_TRIALS}, g AS (SELECT rep, sigma, avg(recovery) FILTER (WHERE starts_with(method, 'knn_')) AS knn, avg(recovery) FILTER (WHERE method = 'neighborhood_consensus') AS aware FROM trials GROUP BY ALL)
SELECT rep, sigma, round(knn, 6) AS knn, round(aware, 6) AS aware, round(aware - knn, 6) AS advantage FROM g WHERE knn IS NOT NULL AND aware IS NOT NULL""")
def mitigation_cliff_aware(spark, sf):
    return rounded(E.cliff_aware_gain(_trials(spark, sf), ["rep", "sigma"]))


@query("two_stage_selection", f"WITH {_STAT}, a AS (SELECT * FROM stat QUALIFY row_number() OVER (ORDER BY round(variance, 12) DESC, rep DESC, pos DESC) <= 30) SELECT rep, pos, round(c, 6) AS score, row_number() OVER (ORDER BY c DESC, rep DESC, pos DESC) AS rank FROM a QUALIFY row_number() OVER (ORDER BY c DESC, rep DESC, pos DESC) <= 10")
def two_stage_selection(spark, sf):
    from lumenfold.plans.selection import _long

    first = S.feature_statistics(_long(spark, sf)).select("rep", "pos", F.round("variance", 12).alias("score"))
    return rounded(S.two_stage(first, _scores(spark, sf), 10).withColumn("pos", F.col("pos").cast("long")))
