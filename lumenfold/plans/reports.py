"""Queries of summary tables, explanations, information measures and data-set descriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.operators import analytics as A
from lumenfold.operators import information as I
from lumenfold.operators import selection as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import CELLS, VEC, cells, table, vectors
from lumenfold.plans.registry import query

# Name, task, what is predicted, unit.
DATASETS = [
    ("cox2", "regression", "inhibition", "pIC50"), ("drd2", "regression", "inhibition", "pKi"), ("herg", "classification", "channel block", "label"), ("esol", "regression", "solubility", "log mol/L"),
    ("qm9", "regression", "orbital energies", "eV"), ("sabdab", "regression", "affinity", "log Kd"), ("tcga", "classification", "tumour type", "label"),
]


@query("dataset_info", "SELECT * FROM (VALUES " + ", ".join(map(str, DATASETS)) + ") t(name, task, target, unit)")
def dataset_info(spark, sf):
    return spark.createDataFrame(DATASETS, "name string, task string, target string, unit string")


_MIT = f"""{CELLS}, m AS (SELECT strategy, rep, sigma, max(r2) FILTER (WHERE model = 'A') AS clean, max(r2) FILTER (WHERE model = 'N') AS noisy, max(r2) FILTER (WHERE model = 'R') AS cleaned FROM cells GROUP BY ALL),
mit AS (SELECT *, CASE WHEN abs(clean - noisy) < 1e-10 THEN 0 ELSE (cleaned - noisy) / (clean - noisy) END AS recovery FROM m WHERE clean IS NOT NULL AND noisy IS NOT NULL AND cleaned IS NOT NULL)"""


def _mitigation(spark, sf):
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("r2")))
    m = cells(spark, sf).groupBy("strategy", "rep", "sigma").agg(of("A").alias("clean"), of("N").alias("noisy"), of("R").alias("cleaned")).na.drop()
    gap = F.col("clean") - F.col("noisy")
    return m.withColumn("recovery", F.when(F.abs(gap) < 1e-10, 0.0).otherwise((F.col("cleaned") - F.col("noisy")) / gap))


@query("mitigation_by_method", f"WITH {_MIT} SELECT strategy AS method, round(avg(recovery), 5) AS recovery_mean, round(stddev_samp(recovery), 5) AS recovery_std, round(max(recovery), 5) AS recovery_max, count(*) AS n, round(avg((cleaned > noisy)::INT), 6) AS improved FROM mit GROUP BY 1")
def mitigation_by_method(spark, sf):
    m = _mitigation(spark, sf).groupBy(F.col("strategy").alias("method")).agg(F.avg("recovery").alias("recovery_mean"), F.stddev_samp("recovery").alias("recovery_std"), F.max("recovery").alias("recovery_max"), F.count(F.lit(1)).alias("n"), F.avg((F.col("cleaned") > F.col("noisy")).cast("double")).alias("improved"))
    return rounded(m, 5, improved=6)


@query("mitigation_best", f"WITH {_MIT} SELECT rep, sigma, strategy, round(recovery, 5) AS recovery FROM (SELECT *, row_number() OVER (PARTITION BY rep, sigma ORDER BY recovery DESC, strategy) AS k FROM mit) WHERE k = 1")
def mitigation_best(spark, sf):
    return rounded(A.top_per_group(_mitigation(spark, sf), ["rep", "sigma"], [F.desc("recovery"), F.asc("strategy")], 1).select("rep", "sigma", "strategy", "recovery"), 5)


@query("mitigation_alignment", f"WITH {_MIT} SELECT strategy, sigma, round(max(cleaned) FILTER (WHERE rep = 'F') - max(cleaned) FILTER (WHERE rep = 'O'), 6) AS advantage FROM mit GROUP BY ALL HAVING count(DISTINCT rep) = 2")
def mitigation_alignment(spark, sf):
    m = _mitigation(spark, sf)
    a, b = m.filter("rep = 'F'").select("strategy", "sigma", F.col("cleaned").alias("f")), m.filter("rep = 'O'").select("strategy", "sigma", F.col("cleaned").alias("o"))
    return rounded(a.join(b, ["strategy", "sigma"]).select("strategy", "sigma", (F.col("f") - F.col("o")).alias("advantage")))


_FLIPS = """flips AS (SELECT l_returnflag AS model, l_linestatus AS rep, round(l_discount * 10, 1) AS p, avg((l_quantity > 25)::INT) AS acc, avg(1 - l_tax) AS auc, count(*) AS n FROM lineitem GROUP BY ALL)"""


@query("classification_robustness", f"WITH {_FLIPS} SELECT model, rep, round(regr_slope(acc, p), 6) AS acc_slope, round(regr_slope(auc, p), 6) AS auc_slope, round(max(acc) FILTER (WHERE p = 0.6) / max(acc) FILTER (WHERE p = 0) * 100, 5) AS acc_retention, round(max(auc) FILTER (WHERE p = 0.6) / max(auc) FILTER (WHERE p = 0) * 100, 5) AS auc_retention FROM flips GROUP BY ALL")
def classification_robustness(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("rep"), F.round(F.col("l_discount") * 10, 1).alias("p")).agg(F.avg((F.col("l_quantity") > 25).cast("double")).alias("acc"), F.avg(1 - F.col("l_tax")).alias("auc"))
    at = lambda v, p: F.max(F.when(F.col("p") == p, F.col(v)))
    out = f.groupBy("model", "rep").agg(F.regr_slope("acc", "p").alias("acc_slope"), F.regr_slope("auc", "p").alias("auc_slope"), *((at(v, 0.6) / at(v, 0.0) * 100).alias(f"{v}_retention") for v in ("acc", "auc")))
    return rounded(out, 6, acc_retention=5, auc_retention=5)


@query("top_variable_features", f"WITH {VEC}, l AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM vecs) SELECT pos, round(var_pop(v), 8) AS variance FROM l GROUP BY 1 ORDER BY var_pop(v) DESC, pos LIMIT 10")
def top_variable_features(spark, sf):
    s = S.feature_statistics(S.long_form(vectors(spark, sf), "id", ["x"])).select(F.col("pos").cast("long").alias("pos"), "variance")
    return rounded(s.orderBy(F.desc("variance"), "pos").limit(10), 8)


@query("explain_selection", f"""WITH {VEC}, l AS (SELECT id, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM vecs), s AS (SELECT CASE WHEN pos < 16 THEN 'a' WHEN pos < 32 THEN 'b' ELSE 'c' END AS rep, pos, abs(corr(v, y)) AS score FROM l GROUP BY ALL),
t AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS place, score / sum(score) OVER () * 100 AS percent FROM s) SELECT place, rep, pos, round(score, 6) AS score, round(percent, 5) AS percent, round(sum(percent) OVER (ORDER BY place), 5) AS cumulative FROM t QUALIFY place <= 10""")
def explain_selection(spark, sf):
    v = vectors(spark, sf)
    s = S.correlation_scores(S.long_form(v, "id", ["x"]), v.select("id", "y"), "id").withColumn("pos", F.col("pos").cast("long"))
    everything, order = Window.partitionBy(), Window.orderBy(F.desc("score"), "pos")
    t = s.select(F.row_number().over(order).cast("long").alias("place"), F.when(F.col("pos") < 16, "a").when(F.col("pos") < 32, "b").otherwise("c").alias("rep"), "pos", "score", (F.col("score") / F.sum("score").over(everything) * 100).alias("percent"))
    return rounded(t.withColumn("cumulative", F.sum("percent").over(Window.orderBy("place"))).filter("place <= 10"), 5, score=6)


_DIGAMMA = "(coalesce(list_sum(list_transform(range(1, {0}), lambda i: 1 / i)), 0) - 0.5772156649015329)"


@query("mutual_information", f"""WITH {VEC}, v AS (SELECT id, x[1] AS a, x[2] + y AS b FROM vecs), p AS (SELECT s.id, abs(s.a - t.a) AS dx, abs(s.b - t.b) AS dy FROM v s JOIN v t ON s.id <> t.id),
e AS (SELECT id, greatest(dx, dy) AS e FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY greatest(dx, dy)) = 3), c AS (SELECT p.id, count(*) FILTER (WHERE dx < e) AS nx, count(*) FILTER (WHERE dy < e) AS ny, count(*) + 1 AS n FROM p JOIN e USING (id) GROUP BY 1)
SELECT round(greatest(0, {_DIGAMMA.format(3)} + {_DIGAMMA.format('max(n)')} - avg({_DIGAMMA.format('nx + 1')} + {_DIGAMMA.format('ny + 1')})), 6) AS information FROM c""")
def mutual_information(spark, sf):
    v = vectors(spark, sf).select("id", F.element_at("x", 1).alias("a"), (F.element_at("x", 2) + F.col("y")).alias("b"))
    return rounded(I.mutual_information(v, "a", "b"))


@query("silhouette", f"WITH {VEC}, m AS (SELECT a.id, a.label AS c, b.label AS d, avg(list_distance(a.x, b.x)) AS m FROM vecs a JOIN vecs b ON a.id <> b.id GROUP BY ALL), s AS (SELECT id, max(m) FILTER (WHERE c = d) AS a, min(m) FILTER (WHERE c <> d) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    return rounded(I.silhouette(vectors(spark, sf), "label"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return I.clusters(vectors(spark, sf), 10)


@query("noise_mahalanobis", f"""WITH {VEC}, m AS (SELECT avg(x[1]) AS p, avg(x[2]) AS q, covar_samp(x[1], x[1]) AS a, covar_samp(x[1], x[2]) AS b, covar_samp(x[2], x[2]) AS d FROM vecs), z AS (SELECT id, x[1] - p AS u, x[2] - q AS v, a, b, d FROM vecs, m),
s AS (SELECT id, (d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b) AS distance FROM z) SELECT id, round(distance, 5) AS distance, distance > quantile_cont(distance, 0.9) OVER () AS is_noise FROM s""")
def noise_mahalanobis(spark, sf):
    return rounded(I.mahalanobis(vectors(spark, sf).select("id", F.slice("x", 1, 2).alias("x"))), 5)


@query("noise_mahalanobis_wide")
def noise_mahalanobis_wide(spark, sf):
    return I.mahalanobis(vectors(spark, sf).select("id", "x"))
