"""Queries that train models: rows are checked for shape and invariants, not for another library's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import experiments as X
from lumenfold.operators import explain as E
from lumenfold.operators import hybrid as H
from lumenfold.operators import models as M
from lumenfold.operators import neighbors as N
from lumenfold.operators import noise_registry as R
from lumenfold.operators import selection as S
from lumenfold.operators import uncertainty as U
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import VEC, table, vectors
from lumenfold.plans.registry import query
from lumenfold.plans.selection import _LONG, _reps
from lumenfold.sources.readers import scratch
from lumenfold.streaming.curation import windowed_potency


@query("forest_importance")
def forest_importance(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(M.forest_importance(vectors(spark, sf), 20, 6))], "pos long, importance double")


@query("boosted_importance")
def boosted_importance(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(M.boosted_importance(vectors(spark, sf), 5))], "pos long, importance double")


@query("noise_cv_disagreement")
def noise_cv_disagreement(spark, sf):
    return M.cv_disagreement(vectors(spark, sf), 3)


@query("noise_prediction_error")
def noise_prediction_error(spark, sf):
    return M.prediction_error(vectors(spark, sf))


@query("forest_uncertainty")
def forest_uncertainty(spark, sf):
    return M.tree_spread(vectors(spark, sf), 10)


@query("windowed_potency", "SELECT date_trunc('day', ts) AS start, event_type, round(avg(9 - log10(value)), 6) AS p_mean, count(*) AS n, round(max(9 - log10(value)) - min(9 - log10(value)), 6) AS spread FROM events WHERE value > 0 GROUP BY ALL")
def windowed(spark, sf):
    d = windowed_potency(table(spark, sf, "events"))
    return d.select("start", "event_type", F.round("p_mean", 6).alias("p_mean"), "n", F.round("spread", 6).alias("spread"))


_TRAIN = f"{_LONG}, split AS (SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR || '_42'), id) <= greatest(floor(count(*) OVER () * 0.2), 1) AS held FROM vecs)"
_KEPT = "kept AS (SELECT rep, pos FROM long_v GROUP BY ALL HAVING var_pop(value) > 0.01 AND avg((value = 0)::INT) <= 0.95)"
_TRAINED = "scored AS (SELECT rep, pos, abs(corr(value, y)) AS c FROM long_v JOIN split USING (id) SEMI JOIN kept USING (rep, pos) WHERE NOT held GROUP BY ALL)"


@query("create_hybrid", f"WITH {_TRAIN}, {_KEPT}, {_TRAINED}, k AS (SELECT rep, pos FROM scored QUALIFY row_number() OVER (PARTITION BY rep ORDER BY c DESC, pos DESC) <= 4) SELECT id, count(*) AS n, round(sum(value), 6) AS total FROM long_v SEMI JOIN k USING (rep, pos) GROUP BY 1")
def create_hybrid(spark, sf):
    d, _ = H.create_hybrid(_reps(spark, sf), ["a", "b", "c"], allocation="fixed", importance="correlation", n_per_rep=4, filters="quality_only")
    return rounded(d.select("id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, v: s + v).alias("total")))


@query("hybrid_augmented", f"WITH {_TRAIN}, all_scores AS (SELECT rep, pos, abs(corr(value, y)) AS c FROM long_v JOIN split USING (id) WHERE NOT held OR rep = 'c' GROUP BY ALL), k AS (SELECT rep, pos FROM all_scores QUALIFY row_number() OVER (PARTITION BY rep ORDER BY c DESC, pos DESC) <= CASE rep WHEN 'c' THEN 6 ELSE 3 END) SELECT id, count(*) AS n, round(sum(value), 6) AS total FROM long_v SEMI JOIN k USING (rep, pos) GROUP BY 1")
def hybrid_augmented(spark, sf):
    d, _ = H.create_hybrid(_reps(spark, sf), ["a", "b"], allocation="fixed", importance="correlation", n_per_rep=3, augmentations=("c",), augmentation="all", augmentation_budget=6)
    return rounded(d.select("id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, v: s + v).alias("total")))


@query("hybrid_greedy")
def hybrid_greedy(spark, sf):
    _, h = H.create_hybrid(_reps(spark, sf), ["a", "b", "c"], budget=12, step=6, patience=1, importance="correlation", augmentations=("c",), augmentation="greedy_ablation", augmentation_budget=4)
    return spark.createDataFrame([(r, n, r in h.augmentations) for r, n in h.allocation.items()], "rep string, n long, augments boolean")


@query("stable_features", f"WITH {_LONG}, r AS (SELECT run, rep, pos, abs(corr(value, y)) AS c FROM long_v, range(5) t(run) WHERE id % 5 <> run GROUP BY ALL), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY c DESC, pos DESC) <= 16) SELECT rep, pos, count(*) / 5 AS frequency FROM k GROUP BY ALL HAVING count(*) / 5 >= 0.6")
def stable_features(spark, sf):
    d = S.long_form(_reps(spark, sf), "id", ["a", "b", "c"]).join(vectors(spark, sf).select("id", "y"), "id").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("id % 5 <> run")
    runs = d.groupBy("run", "rep", "pos").agg(F.abs(F.corr("value", "y")).alias("score"))
    return S.stable_features(runs, 8).withColumn("pos", F.col("pos").cast("long"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    found = M.permutation_importance(vectors(spark, sf).select("id", "x", "y"))
    return spark.createDataFrame([(i, float(v)) for i, v in found.items()], "pos long, importance double")


@query("drop_column_importance")
def drop_column_importance(spark, sf):
    found = M.drop_column_importance(vectors(spark, sf).select("id", F.slice("x", 1, 4).alias("x"), "y"), [0, 1], 2)
    return spark.createDataFrame([(i, float(v)) for i, v in found.items()], "pos long, importance double")


@query("cross_validated")
def cross_validated(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(M.cross_validated(vectors(spark, sf).select("id", "x", "y"), 3))], "fold long, r2 double")


@query("noise_co_teaching")
def noise_co_teaching(spark, sf):
    return M.co_teaching(vectors(spark, sf).select("id", "x", "y"), 2)


@query("noise_mixture")
def noise_mixture(spark, sf):
    return M.mixture_noise(M.model_score("ensemble", vectors(spark, sf).select("id", "x", "y"), members=4))


@query("estimate_leave_one_out")
def estimate_leave_one_out(spark, sf):
    return M.model_score("leave_one_out", vectors(spark, sf).select("id", "x", "y"), members=4)


@query("estimate_quantile")
def estimate_quantile(spark, sf):
    return M.model_score("quantile", vectors(spark, sf).select("id", "x", "y"), trees=10)


def _labelled(spark, sf):
    return vectors(spark, sf).select("id", "x", "y")


@query("boosted_split_counts")
def boosted_split_counts(spark, sf):
    rows = [(kind, i, float(v)) for kind in ("weight", "cover") for i, v in enumerate(M.boosted_importance(_labelled(spark, sf), 5, kind))]
    return spark.createDataFrame(rows, "kind string, pos long, importance double")


@query("tree_shap_importance")
def tree_shap_importance(spark, sf):
    d = _labelled(spark, sf)
    return E.mean_absolute(E.tree_shap(d, M.forest(20, 6).fit(M.assembled(d))))


@query("kernel_shap_importance")
def kernel_shap_importance(spark, sf):
    d = _labelled(spark, sf)
    return E.mean_absolute(E.kernel_shap(d, M.forest(10, 5).fit(M.assembled(d)), background=10, extra=128))


@query("lime_importance")
def lime_importance(spark, sf):
    d = _labelled(spark, sf)
    return E.mean_absolute(E.lime(d, M.forest(10, 5).fit(M.assembled(d)), perturbed=300))


@query("boruta_selection")
def boruta_selection(spark, sf):
    found = E.boruta(_labelled(spark, sf), runs=8, trees=20)
    return spark.createDataFrame([(i, v["status"], v["hits"], v["runs"], v["rank"]) for i, v in found.items()], "pos long, status string, hits long, runs long, rank long")


@query("quantile_regression")
def quantile_regression(spark, sf):
    return U.quantile_regression(_labelled(spark, sf), steps=15)


@query("jackknife_variance")
def jackknife_variance(spark, sf):
    return U.jackknife(_labelled(spark, sf), members=8)


@query("gaussian_process_scores")
def gaussian_process_scores(spark, sf):
    return U.gaussian_process(_labelled(spark, sf), features=96, scales=(1.0, 2.0))


@query("noise_bootstrap_ensemble")
def noise_bootstrap_ensemble(spark, sf):
    return U.bootstrap_ensemble(_labelled(spark, sf), members=4)


_BY_K = {k: f"SELECT 'knn_k{k}' AS method, count(*) FILTER (WHERE s > c) AS flagged, count(*) AS n FROM (SELECT s, quantile_cont(s, 0.9) OVER () AS c FROM (SELECT a.id, stddev_pop(b.y) AS s FROM near a JOIN vecs b ON b.id = a.neighbor WHERE rank <= {k} GROUP BY 1))" for k in (5, 10, 20)}


@query("noise_registry_flags", f"WITH {VEC}, near AS (SELECT * FROM (SELECT a.id, b.id AS neighbor, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM vecs a JOIN vecs b ON a.id <> b.id) WHERE rank <= 20) {' UNION ALL '.join(_BY_K.values())} UNION ALL SELECT 'zscore', count(*) FILTER (WHERE abs(y - m) > 3 * s), count(*) FROM (SELECT y, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s FROM vecs)")
def noise_registry_flags(spark, sf):
    rows = _labelled(spark, sf)
    near, out = N.neighbors(rows, 20), None
    for name in ("knn_k5", "knn_k10", "knn_k20", "zscore"):
        part = R.detect(name, rows, **({} if name == "zscore" else {"near": near})).agg(F.lit(name).alias("method"), F.count_if("is_noise").alias("flagged"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


def _grouped(df):
    """Twenty groups by id: whole ones go to a fold."""
    return df.withColumn("g", F.pmod("id", F.lit(20)))


@query("grid_search")
def grid_search(spark, sf):
    configs = X.grid(allocation=["fixed"], n_per_rep=[2, 8], importance=["correlation"], model=["ridge"])
    rows = X.hybrid_search(_grouped(_reps(spark, sf)), ["a", "b", "c"], configs, scratch(spark, "grid"), "g", 2)
    return X.search_summary(rows, ("n_per_rep", "model")).drop("config", "settings")


@query("generalization_gap")
def generalization_gap(spark, sf):
    rows = X.generalization_gap(_grouped(_labelled(spark, sf)), [2, 8, 32], ["ridge"], scratch(spark, "gap"), "g", 3)
    return X.search_summary(rows, ("components", "model")).drop("config", "settings")


@query("noise_experiments")
def noise_experiments(spark, sf):
    d = _labelled(spark, sf)
    configs = X.grid(method=["zscore", "knn_k5"], sigma=[0.3, 0.6], seed=[7], strategy=["outlier"])
    rows = X.noise_grid(d.filter("id % 5 <> 0"), d.filter("id % 5 = 0"), configs, scratch(spark, "noise"))
    return rows.select(X.setting("method").alias("method"), X.setting("sigma", "double").alias("sigma"), "r2_clean", "r2_noisy", "r2_cleaned", "recovery", "precision", "recall", "f1", "n_detected", "n_true", "n_after")
