"""Queries of feature selection, allocation and rank fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import projection as P
from lumenfold.operators import rank_fusion as R
from lumenfold.operators import selection as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import VEC, vectors
from lumenfold.plans.registry import query

_LONG = VEC + """, raw AS (SELECT id, y, 'a' AS rep, x[1:16] AS v FROM vecs UNION ALL SELECT id, y, 'b', x[17:32] FROM vecs UNION ALL SELECT id, y, 'c', x[33:64] FROM vecs),
long_v AS (SELECT id, y, rep, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS pos FROM raw)"""
_STAT = _LONG + ", stat AS (SELECT rep, pos, avg(value) AS mean, var_pop(value) AS variance, avg((value = 0)::INT) AS zeros, abs(corr(value, y)) AS c FROM long_v GROUP BY ALL)"


def _reps(spark, sf):
    return vectors(spark, sf).select("id", "y", F.slice("x", 1, 16).alias("a"), F.slice("x", 17, 16).alias("b"), F.slice("x", 33, 32).alias("c"))


def _long(spark, sf):
    return S.long_form(_reps(spark, sf), "id", ["a", "b", "c"])


def _scores(spark, sf):
    return S.correlation_scores(_long(spark, sf), vectors(spark, sf).select("id", "y"), "id")


@query("feature_statistics", f"WITH {_STAT} SELECT rep, pos, round(mean, 6) AS mean, round(variance, 6) AS variance, round(zeros, 6) AS zeros FROM stat")
def feature_statistics(spark, sf):
    return rounded(S.feature_statistics(_long(spark, sf)).withColumn("pos", F.col("pos").cast("long")))


@query("quality_filter", f"WITH {_STAT} SELECT rep, pos FROM stat WHERE zeros <= 0.95 AND variance > 0.015")
def quality_filter(spark, sf):
    return S.quality_filter(_long(spark, sf), 0.95, 0.015).withColumn("pos", F.col("pos").cast("long"))


@query("filter_train_apply_test", f"WITH {_LONG}, k AS (SELECT rep, pos FROM long_v WHERE id % 5 <> 0 GROUP BY ALL HAVING var_pop(value) > 0.015) SELECT id, rep, count(*) AS n, round(sum(value), 6) AS total FROM long_v SEMI JOIN k USING (rep, pos) WHERE id % 5 = 0 GROUP BY ALL")
def filter_train_apply_test(spark, sf):
    d = _long(spark, sf)
    return rounded(S.apply_filter(d.filter("id % 5 = 0"), S.quality_filter(d.filter("id % 5 <> 0"), 0.95, 0.015)).groupBy("id", "rep").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("top_features", f"WITH {_STAT} SELECT * FROM (SELECT rep, pos, round(c, 6) AS score, row_number() OVER (PARTITION BY rep ORDER BY c DESC, pos DESC) AS rank FROM stat) WHERE rank <= 5")
def top_features(spark, sf):
    return rounded(S.top_features(_scores(spark, sf), 5).select("rep", F.col("pos").cast("long").alias("pos"), "score", "rank"))


_ALLOCATED = """s AS (SELECT * FROM (VALUES ('a', 0.61, 16), ('b', 0.27, 16), ('c', 0.52, 32)) t(rep, score, width)), n AS (SELECT *, least(CASE WHEN abs(score / sum(score) OVER () * 40 % 1 - 0.5) < 1e-12 THEN 2 * round(score / sum(score) OVER () * 20) ELSE round(score / sum(score) OVER () * 40) END, width) AS n FROM s)"""


@query("allocate_budget", f"WITH {_ALLOCATED}, g AS (SELECT *, 40 - sum(n) OVER () AS gap, sum(width - n) OVER (ORDER BY score DESC) - (width - n) AS up FROM n) SELECT rep, score::DOUBLE AS score, width::BIGINT AS width, (n + CASE WHEN gap > 0 THEN greatest(0, least(width - n, gap - up)) ELSE 0 END)::BIGINT AS n FROM g")
def allocate_budget(spark, sf):
    s = spark.createDataFrame([("a", 0.61, 16), ("b", 0.27, 16), ("c", 0.52, 32)], "rep string, score double, width long")
    return S.allocate(s, 40)


_SHARED = _STAT + """, perf AS (SELECT rep, avg(c) AS score, count(*) AS width FROM stat GROUP BY 1), raw_n AS (SELECT *, score / sum(score) OVER () * 40 AS e FROM perf),
n AS (SELECT *, least(CASE WHEN e % 1 = 0.5 THEN 2 * round(e / 2) ELSE round(e) END, width)::BIGINT AS n FROM raw_n),
g AS (SELECT *, 40 - sum(n) OVER () AS gap, sum(width - n) OVER (ORDER BY score DESC, rep) - (width - n) AS up, sum(n) OVER (ORDER BY score, rep DESC) - n AS down FROM n)"""


@query("allocate_by_performance", f"WITH {_SHARED} SELECT rep, round(score, 6) AS score, width, (n + CASE WHEN gap > 0 THEN greatest(0, least(width - n, gap - up)) WHEN gap < 0 THEN -greatest(0, least(n, -gap - down)) ELSE 0 END)::BIGINT AS n FROM g")
def allocate_by_performance(spark, sf):
    """A budget of 40 features shared by the representations' mean correlation with the label."""
    scores = _scores(spark, sf).groupBy("rep").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("width"))
    return rounded(S.allocate(scores, 40))


@query("selected_stack", f"WITH {_STAT}, k AS (SELECT rep, pos FROM (SELECT rep, pos, row_number() OVER (PARTITION BY rep ORDER BY c DESC, pos DESC) AS r FROM stat) WHERE r <= 4) SELECT id, count(*) AS n, round(sum(value), 6) AS total FROM long_v SEMI JOIN k USING (rep, pos) GROUP BY 1")
def selected_stack(spark, sf):
    chosen = S.top_features(_scores(spark, sf), 4).groupBy("rep").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()  # one row per representation
    out = S.apply_selection(_reps(spark, sf), {r["rep"]: r["p"] for r in sorted(chosen)})
    return rounded(out.select("id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda s, v: s + v).alias("total")))


# Principal components by squaring the covariance over and over: what is left of it is the first component's.
_ROW = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"
_TRACE = "list_sum(list_transform(m, lambda a: list_dot_product(a, a)))"
_LARGEST = "list_transform({m}, lambda a: list_dot_product(a, a))"


def _component(name: str, source: str) -> str:
    sizes = _LARGEST.format(m="m")
    return f"""{name}_pow AS (SELECT 0 AS k, m FROM {source} UNION ALL SELECT k + 1, list_transform({_ROW}, lambda a: list_transform(a, lambda v: v / {_TRACE})) FROM {name}_pow WHERE k < 24),
{name}_row AS (SELECT m[list_position({sizes}, list_max({sizes}))] AS r FROM {name}_pow WHERE k = 24),
{name}_v AS (SELECT list_transform(r, lambda v: v / sqrt(list_dot_product(r, r)) * sign(r[list_position(list_transform(r, lambda w: round(abs(w), 12)), list_max(list_transform(r, lambda w: round(abs(w), 12))))])) AS v FROM {name}_row)"""


_PCA = f"""{VEC}, train AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vecs WHERE id % 5 <> 0), mean_i AS (SELECT i, avg(v) AS m FROM train GROUP BY 1),
centred AS (SELECT id, i, v - m AS v FROM train JOIN mean_i USING (i)), cov AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS c FROM centred a JOIN centred b USING (id) GROUP BY ALL),
matrix AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY 1)), {_component("p1", "matrix")},
rest AS (SELECT list_transform(m, lambda a, i: list_transform(a, lambda c, j: c - l * v[i] * v[j])) AS m FROM (SELECT m, v, list_dot_product(v, list_transform(m, lambda a: list_dot_product(a, v))) AS l FROM matrix, p1_v)), {_component("p2", "rest")},
mean_v AS (SELECT list(m ORDER BY i) AS mean FROM mean_i)"""


@query("projected_features", f"WITH RECURSIVE {_PCA} SELECT id, round(list_dot_product(x, a.v) - list_dot_product(mean, a.v), 5) AS p1, round(list_dot_product(x, b.v) - list_dot_product(mean, b.v), 5) AS p2 FROM vecs, p1_v a, p2_v b, mean_v")
def projected_features(spark, sf):
    reps = _reps(spark, sf)
    d = P.combine(reps, ["a", "b", "c"], "pca", 2, fit_on=reps.filter("id % 5 <> 0"))
    return rounded(d.select("id", F.element_at("features", 1).alias("p1"), F.element_at("features", 2).alias("p2")), 5)


@query("importance_by_rep", f"WITH {_STAT} SELECT rep, round(sum(c), 6) AS importance, count(*) AS n, round(sum(c) / sum(sum(c)) OVER (), 6) AS share FROM stat GROUP BY 1")
def importance_by_rep(spark, sf):
    return rounded(S.importance_by_rep(_scores(spark, sf)))


@query("variance_inflation")
def variance_inflation(spark, sf):
    v = S.variance_inflation(vectors(spark, sf), "x")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, vif double")


@query("effective_dimensions")
def effective_dimensions(spark, sf):
    return spark.createDataFrame([(float(s), int(n)) for s, n in S.effective_dimensions(vectors(spark, sf), "x").items()], "share double, components long")


@query("collinearity_report")
def collinearity_report(spark, sf):
    """Both diagnoses in one row set: components with inflated variance, and how far the features compress."""
    v = vectors(spark, sf)
    vif, dims = S.variance_inflation(v, "x"), S.effective_dimensions(v, "x")
    inflated = int((vif > 10).sum())
    return spark.createDataFrame([(float(s), int(n), len(vif) / n, inflated) for s, n in dims.items()], "share double, components long, compression double, inflated long")


@query("selection_summary", f"WITH {_STAT}, k AS (SELECT rep, c, pos FROM stat QUALIFY row_number() OVER (ORDER BY c DESC, rep DESC, pos DESC) <= 20) SELECT rep, printf('%s: %d features, best %d, %.2f%% of the importance', rep, count(*), max_by(pos, c), 100 * sum(c) / sum(sum(c)) OVER ()) AS line FROM k GROUP BY 1")
def selection_summary(spark, sf):
    from pyspark.sql import Window

    k = _scores(spark, sf).orderBy(F.desc("score"), F.desc("rep"), F.desc("pos")).limit(20)
    s = k.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.max_by("pos", "score").alias("best"), F.sum("score").alias("t"))
    share = 100 * F.col("t") / F.sum("t").over(Window.partitionBy())  # one row per representation
    return s.select("rep", F.format_string("%s: %d features, best %d, %.2f%% of the importance", "rep", "n", "best", share).alias("line"))


@query("diversity_selection")
def diversity_selection(spark, sf):
    v = vectors(spark, sf)
    scores = S.correlation_scores(S.long_form(v, "id", ["x"]), v.select("id", "y"), "id").orderBy("pos").select("score").toPandas()["score"].to_numpy()  # as long as a vector
    c = S.correlation_matrix(v, "x")
    return spark.createDataFrame([("diversity", k, int(i)) for k, i in enumerate(S.greedy_diversity(scores, c, 10))] + [("mrmr", k, int(i)) for k, i in enumerate(S.greedy_relevance(scores, c, 10))], "method string, place long, pos long")


# Scores of each component by five methods.
_METHODS = VEC + """, l AS (SELECT id, y, unnest(x) AS v, generate_subscripts(x, 1) AS idx FROM vecs),
raw_s AS (SELECT idx, var_pop(v) AS variance, avg(abs(v)) AS magnitude, max(v) AS peak, abs(corr(v, y)) AS relevance, stddev_pop(abs(v)) AS spread FROM l GROUP BY 1),
s AS (UNPIVOT raw_s ON variance, magnitude, peak, relevance, spread INTO NAME method VALUE score),
nrm AS (SELECT *, CASE WHEN max(score) OVER m > min(score) OVER m THEN (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m) ELSE 1 / count(*) OVER m END AS norm,
  row_number() OVER (PARTITION BY method ORDER BY score DESC, idx) - 1 AS rank, row_number() OVER (PARTITION BY method ORDER BY score, idx DESC) - 1 AS ascending,
  rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2 AS avg_rank FROM s WINDOW m AS (PARTITION BY method))"""


def _fusion_scores(spark, sf):
    v = vectors(spark, sf).select("y", F.posexplode("x").alias("pos", "v")).withColumn("idx", F.col("pos").cast("long") + 1)
    g = v.groupBy("idx").agg(F.var_pop("v").alias("variance"), F.avg(F.abs("v")).alias("magnitude"), F.max("v").alias("peak"), F.abs(F.corr("v", "y")).alias("relevance"), F.stddev_pop(F.abs("v")).alias("spread"))
    return g.unpivot("idx", ["variance", "magnitude", "peak", "relevance", "spread"], "method", "score")


_FUSED = {
    "average": "avg(norm)", "reciprocal_rank": "sum(1 / (61 + rank))", "borda": "sum(ascending)::BIGINT", "median_rank": "-median(rank)", "geometric": "exp(avg(ln(norm + 1e-10)))", "rank_product": "-sum(ln(rank + 1))",
    "voting": "CASE WHEN count(*) FILTER (WHERE rank < 20) >= 2 THEN count(*) FILTER (WHERE rank < 20) ELSE 0 END", "weighted": "sum(norm * CASE method WHEN 'variance' THEN 2.0 WHEN 'peak' THEN 0.5 ELSE 1 END) / sum(CASE method WHEN 'variance' THEN 2.0 WHEN 'peak' THEN 0.5 ELSE 1 END)",
}
_OPTIONS = {"voting": {"top": 20}, "weighted": {"weights": {"variance": 2.0, "peak": 0.5}}}


def _fusion(how: str) -> None:
    @query(f"fuse_{how}", f"WITH {_METHODS} SELECT idx, round({_FUSED[how]}, 6) AS fused FROM nrm GROUP BY 1")
    def fuse(spark, sf):
        return rounded(R.fuse(_fusion_scores(spark, sf), how, **_OPTIONS.get(how, {})))


for _h in _FUSED:
    _fusion(_h)


@query("fuse_trimmed", f"WITH {_METHODS}, k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY norm, method) AS k FROM nrm) SELECT idx, round(avg(norm), 6) AS fused FROM k WHERE k BETWEEN 2 AND 4 GROUP BY 1")
def fuse_trimmed(spark, sf):
    return rounded(R.fuse(_fusion_scores(spark, sf), "trimmed"))


@query("fuse_disagreement", f"WITH {_METHODS}, g AS (SELECT idx, avg(norm) AS m, stddev_pop(norm) AS s FROM nrm GROUP BY 1) SELECT idx, round(m * (1 - 0.5 * s / max(s) OVER ()), 6) AS fused, round(s / max(s) OVER (), 6) AS disagreement FROM g")
def fuse_disagreement(spark, sf):
    return rounded(R.fuse(_fusion_scores(spark, sf), "disagreement"))


@query("fuse_stable", f"WITH {_METHODS}, g AS (SELECT idx, avg(norm) AS m, stddev_pop(norm) AS s FROM nrm GROUP BY 1) SELECT idx, round(m * (1 - 0.5 * s / max(s) OVER ()), 6) AS fused FROM g")
def fuse_stable(spark, sf):
    return rounded(R.fuse(_fusion_scores(spark, sf), "stable"))


@query("normalized_scores", f"WITH {_METHODS} SELECT method, idx, round(norm, 6) AS norm, rank FROM nrm")
def normalized_scores(spark, sf):
    return rounded(R.ranked(R.normalized(_fusion_scores(spark, sf))).select("method", "idx", "norm", F.col("rank").cast("long").alias("rank")))


@query("score_deviation", f"WITH {_METHODS} SELECT idx, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY 1")
def score_deviation(spark, sf):
    return rounded(R.mean_and_deviation(_fusion_scores(spark, sf)))


@query("method_agreement", f"""WITH {_METHODS} SELECT a.method AS m1, b.method AS m2, round(corr(a.avg_rank, b.avg_rank), 6) AS spearman, round(count(*) FILTER (WHERE a.rank < 10 AND b.rank < 10) / count(*) FILTER (WHERE a.rank < 10 OR b.rank < 10), 6) AS jaccard,
  round(count(*) FILTER (WHERE a.rank < 10 AND b.rank < 10) / 10, 6) AS overlap FROM nrm a JOIN nrm b ON a.idx = b.idx AND a.method < b.method GROUP BY ALL""")
def method_agreement(spark, sf):
    return rounded(R.agreement(_fusion_scores(spark, sf)))


@query("method_kendall", f"WITH {_METHODS}, p AS (SELECT a.method, a.idx AS i, b.idx AS j, sign(a.score - b.score) AS d FROM s a JOIN s b ON a.method = b.method AND a.idx < b.idx) SELECT a.method AS m1, b.method AS m2, round(sum(a.d * b.d) / sqrt(sum(abs(a.d)) * sum(abs(b.d))), 6) AS tau FROM p a JOIN p b ON a.i = b.i AND a.j = b.j AND a.method < b.method GROUP BY ALL")
def method_kendall(spark, sf):
    return rounded(R.kendall(_fusion_scores(spark, sf)))
