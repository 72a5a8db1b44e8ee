"""Queries of experiment analytics: aggregation, ranking, robustness, statistics, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import analytics as A
from lumenfold.operators.quantiles import quantiles, with_quantile
from lumenfold.plans.carriers import CELLS, PRED, RUNS, cells, predictions, runs, table
from lumenfold.plans.registry import query

CONFIG = ["model", "rep", "strategy"]


def rounded(df, digits: int = 6, **other: int):
    """Every double to the given number of decimals; other numbers by column."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("average_runs", f"WITH {CELLS} SELECT model, rep, strategy, sigma, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n FROM cells")
def average_runs(spark, sf):
    return rounded(cells(spark, sf))


@query("nested_average", f"WITH {CELLS}, m AS (SELECT model, rep, sigma, avg(r2) AS r2 FROM cells GROUP BY ALL) SELECT model, rep, round(regr_slope(r2, sigma), 6) AS slope, round(regr_intercept(r2, sigma), 6) AS intercept, round(regr_r2(r2, sigma), 5) AS fit_r2, count(*) AS n FROM m GROUP BY ALL")
def nested_average(spark, sf):
    m = cells(spark, sf).groupBy("model", "rep", "sigma").agg(F.avg("r2").alias("r2"))
    return A.slope(m, ["model", "rep"]).select("model", "rep", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("fit_r2", 5).alias("fit_r2"), "n")


@query("multi_aggregate", f"WITH {RUNS} SELECT model, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std, max(r2) AS r2_max, count(*) AS n, round(min_by(rmse, rmse), 6) AS rmse_first, round(avg(abs(r2 - 0.5)), 6) AS mean_abs FROM runs GROUP BY 1")
def multi_aggregate(spark, sf):
    return rounded(runs(spark, sf).groupBy("model").agg(F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"), F.max("r2").alias("r2_max"), F.count(F.lit(1)).alias("n"), F.min_by("rmse", "rmse").alias("rmse_first"), F.avg(F.abs(F.col("r2") - 0.5)).alias("mean_abs")))


@query("paired_improvement", f"""WITH {CELLS}, p AS (SELECT strategy, sigma, rep, max(r2) FILTER (WHERE model = 'A') - max(r2) FILTER (WHERE model = 'N') AS d FROM cells GROUP BY ALL)
SELECT rep, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(avg((d > 0)::INT), 6) AS improved, round(max(d), 6) AS best, round(min(d), 6) AS worst FROM p WHERE d IS NOT NULL GROUP BY 1""")
def paired_improvement(spark, sf):
    r2 = lambda m: F.max(F.when(F.col("model") == m, F.col("r2")))
    p = cells(spark, sf).groupBy("strategy", "sigma", "rep").agg((r2("A") - r2("N")).alias("d")).filter("d is not null")
    return rounded(p.groupBy("rep").agg(F.avg("d").alias("mean"), F.median("d").alias("median"), F.avg((F.col("d") > 0).cast("double")).alias("improved"), F.max("d").alias("best"), F.min("d").alias("worst")))


@query("best_per_group", f"WITH {CELLS} SELECT rep, strategy, model, sigma, round(r2, 6) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY rep, strategy ORDER BY r2 DESC, sigma, model) AS k FROM cells) WHERE k = 1")
def best_per_group(spark, sf):
    return A.top_per_group(cells(spark, sf), ["rep", "strategy"], [F.desc("r2"), F.asc("sigma"), F.asc("model")], 1).select("rep", "strategy", "model", "sigma", F.round("r2", 6).alias("r2"))


@query("pivot_mean", f"WITH {CELLS} SELECT rep, strategy, round(avg(r2) FILTER (WHERE model = 'A'), 6) AS A, round(avg(r2) FILTER (WHERE model = 'N'), 6) AS N, round(avg(r2) FILTER (WHERE model = 'R'), 6) AS R FROM cells GROUP BY ALL")
def pivot_mean(spark, sf):
    return rounded(cells(spark, sf).groupBy("rep", "strategy").pivot("model", ["A", "N", "R"]).avg("r2"))


@query("pivot_difference", f"WITH {CELLS} SELECT model, sigma, round(avg(r2) FILTER (WHERE rep = 'F') - avg(r2) FILTER (WHERE rep = 'O'), 6) AS r2_difference, round(avg(mae) FILTER (WHERE rep = 'F') - avg(mae) FILTER (WHERE rep = 'O'), 6) AS mae_difference FROM cells GROUP BY ALL")
def pivot_difference(spark, sf):
    of = lambda v, r: F.avg(F.when(F.col("rep") == r, F.col(v)))
    return rounded(cells(spark, sf).groupBy("model", "sigma").agg(*((of(v, "F") - of(v, "O")).alias(f"{v}_difference") for v in ("r2", "mae"))))


@query("best_by_tier", f"WITH {CELLS}, tiers AS (SELECT unnest([0.2, 0.5, 1.0]) AS tier) SELECT model, tier, round(max(r2), 6) AS best FROM cells JOIN tiers ON sigma <= tier GROUP BY ALL")
def best_by_tier(spark, sf):
    tiers = spark.range(1).select(F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0))).alias("tier"))
    return rounded(cells(spark, sf).join(F.broadcast(tiers), F.col("sigma") <= F.col("tier")).groupBy("model", "tier").agg(F.max("r2").alias("best")))  # three tiers


@query("uncertainty_merge", f"WITH {PRED} SELECT sigma, y_true, round(avg(y_pred), 6) AS y_pred, round(avg(unc), 6) AS unc FROM preds GROUP BY ALL")
def uncertainty_merge(spark, sf):
    return rounded(predictions(spark, sf).groupBy("sigma", "y_true").agg(F.avg("y_pred").alias("y_pred"), F.avg("unc").alias("unc")))


@query("value_counts", "SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY ALL")
def value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_chars").alias("lengths"))


@query("percentiles", f"WITH {RUNS} SELECT model, round(quantile_cont(rmse, 0.1), 6) AS p10, round(quantile_cont(rmse, 0.5), 6) AS p50, round(quantile_cont(rmse, 0.9), 6) AS p90 FROM runs GROUP BY 1")
def percentiles(spark, sf):
    q = quantiles(runs(spark, sf), "rmse", [0.1, 0.5, 0.9], ["model"])
    return rounded(q.select("model", *(F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p10", "p50", "p90")))))


@query("class_counts", "SELECT quality, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1")
def class_counts(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("ordinal_ranks", f"WITH {CELLS} SELECT model, rep, strategy, sigma, row_number() OVER (PARTITION BY model ORDER BY r2, rep, strategy, sigma) AS rank FROM cells")
def ordinal_ranks(spark, sf):
    from pyspark.sql import Window

    return cells(spark, sf).select("model", "rep", "strategy", "sigma", F.row_number().over(Window.partitionBy("model").orderBy("r2", "rep", "strategy", "sigma")).alias("rank"))


@query("top_n_per_group", f"WITH {CELLS} SELECT * FROM (SELECT model, rep, strategy, sigma, row_number() OVER (PARTITION BY model ORDER BY r2 DESC, rep, strategy, sigma) AS rank FROM cells) WHERE rank <= 5")
def top_n_per_group(spark, sf):
    return A.top_per_group(cells(spark, sf), ["model"], [F.desc("r2"), F.asc("rep"), F.asc("strategy"), F.asc("sigma")], 5).select("model", "rep", "strategy", "sigma", "rank")


@query("quartile_bins", "WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders) SELECT (o_totalprice >= q[1])::INT + (o_totalprice >= q[2])::INT + (o_totalprice >= q[3])::INT AS bin, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders, e GROUP BY 1")
def quartile_bins(spark, sf):
    o = table(spark, sf, "orders").select("o_totalprice")
    b = with_quantile(o, "q", "o_totalprice", [0.25, 0.5, 0.75]).withColumn("bin", F.size(F.filter("q", lambda e: e <= F.col("o_totalprice"))))  # one row
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("top_ten", f"WITH {CELLS} SELECT model, rep, round(avg(r2), 6) AS r2, round(avg(rmse), 6) AS rmse, strategy FROM cells GROUP BY ALL ORDER BY avg(r2) DESC, model, rep, strategy LIMIT 10")
def top_ten(spark, sf):
    s = cells(spark, sf).groupBy("model", "rep", "strategy").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
    return rounded(s.orderBy(F.desc("r2"), "model", "rep", "strategy").limit(10))


@query("smallest_ten", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def smallest_ten(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(10)


@query("compare_models", f"""WITH {CELLS}, m AS (SELECT model, rep, max(CASE WHEN r2 > 0.5 THEN rmse END) AS metric FROM cells WHERE strategy = '1' AND sigma < 0.25 GROUP BY ALL)
SELECT model, rep, round(metric, 6) AS metric, row_number() OVER (ORDER BY coalesce(metric, 'infinity'::DOUBLE), model, rep) AS place FROM m""")
def compare_models(spark, sf):
    from pyspark.sql import Window

    m = cells(spark, sf).filter("strategy = '1' and sigma < 0.25").groupBy("model", "rep").agg(F.max(F.when(F.col("r2") > 0.5, F.col("rmse"))).alias("metric"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("metric", F.lit(float("inf"))), "model", "rep"))).select("model", "rep", F.round("metric", 6).alias("metric"), "place")


_AT = "min_by(r2, CASE WHEN abs(sigma - {0}) < 0.05 THEN sigma END)"
_ROBUST = f"""{CELLS}, rob AS (SELECT model, rep, strategy, count(*) AS n, min_by(r2, CASE WHEN sigma = 0 THEN sigma END) AS baseline, {_AT.format(0.6)} AS high, regr_slope(r2, sigma) AS nsi,
  regr_slope(rmse, sigma) AS nsi_rmse, {_AT.format(0.2)} AS r2_at_2, {_AT.format(0.3)} AS r2_at_3, {_AT.format(0.4)} AS r2_at_4 FROM cells GROUP BY ALL HAVING count(*) >= 3),
rob2 AS (SELECT *, coalesce(baseline IS NOT NULL AND high IS NOT NULL AND baseline > 0, false) AS is_valid FROM rob),
robust AS (SELECT *, CASE WHEN is_valid THEN greatest(0, least(150, high / baseline * 100)) END AS retention, CASE WHEN is_valid THEN nsi / baseline END AS relative_nsi FROM rob2)"""


@query("robustness", f"WITH {_ROBUST} SELECT model, rep, strategy, n, is_valid, round(baseline, 6) AS baseline, round(high, 6) AS high, round(nsi, 6) AS nsi, round(nsi_rmse, 6) AS nsi_rmse, round(r2_at_2, 6) AS r2_at_2, round(r2_at_3, 6) AS r2_at_3, round(r2_at_4, 6) AS r2_at_4, round(retention, 5) AS retention, round(relative_nsi, 6) AS relative_nsi FROM robust")
def robustness(spark, sf):
    d = A.robustness(cells(spark, sf), CONFIG)
    return rounded(d.withColumn("retention", F.round("retention", 5)))


@query("robustness_outliers", f"WITH {_ROBUST} SELECT model, rep, strategy, round(retention, 5) AS retention FROM robust WHERE baseline >= 0.1 AND retention BETWEEN -50 AND 150 AND is_valid")
def robustness_outliers(spark, sf):
    return A.robustness(cells(spark, sf), CONFIG).filter("baseline >= 0.1 and retention between -50 and 150 and is_valid").select(*CONFIG, F.round("retention", 5).alias("retention"))


@query("composite_robustness", f"""WITH {_ROBUST}, v AS (SELECT *, abs(nsi) AS a FROM robust WHERE is_valid)
SELECT model, rep, strategy, round(((retention - min(retention) OVER ()) / (max(retention) OVER () - min(retention) OVER ()) + 1 - (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ())) / 2, 6) AS composite FROM v""")
def composite_robustness(spark, sf):
    return A.composite_score(A.robustness(cells(spark, sf), CONFIG)).select(*CONFIG, F.round("composite", 6).alias("composite"))


@query("robustness_views", f"WITH {_ROBUST} SELECT 'strategy' AS view, strategy AS name, round(avg(retention), 5) AS retention, round(avg(nsi), 6) AS nsi, count(*) AS n FROM robust WHERE is_valid GROUP BY strategy UNION ALL SELECT 'model', model, round(avg(retention), 5), round(avg(nsi), 6), count(*) FROM robust WHERE is_valid GROUP BY model UNION ALL SELECT 'rep', rep, round(avg(retention), 5), round(avg(nsi), 6), count(*) FROM robust WHERE is_valid GROUP BY rep")
def robustness_views(spark, sf):
    r = A.robustness(cells(spark, sf), CONFIG).filter("is_valid")
    views = r.select("retention", "nsi", F.explode(F.array(*(F.struct(F.lit(c).alias("view"), F.col(c).alias("name")) for c in ("strategy", "model", "rep")))).alias("v")).select("v.*", "retention", "nsi")
    return views.groupBy("view", "name").agg(F.round(F.avg("retention"), 5).alias("retention"), F.round(F.avg("nsi"), 6).alias("nsi"), F.count(F.lit(1)).alias("n"))


@query("two_point_index", f"""WITH {CELLS}, s AS (SELECT *, (sigma - lag(sigma) OVER w) * (r2 + lag(r2) OVER w) / 2 AS area FROM cells WINDOW w AS (PARTITION BY model, rep, strategy ORDER BY sigma)),
t AS (SELECT model, rep, strategy, min_by(r2, sigma) AS a, max_by(r2, sigma) AS b, max(sigma) AS s, min_by(mae, sigma) AS ma, max_by(mae, sigma) AS mb, sum(area) AS auc FROM s GROUP BY ALL)
SELECT model, rep, strategy, round((a - b) / s, 6) AS nsi, round(b / a * 100, 5) AS retention, round((mb - ma) / ma * 100, 5) AS mae_increase, round(auc, 6) AS auc, round(auc / s, 6) AS auc_normalized FROM t""")
def two_point_index(spark, sf):
    d = A.two_point_index(cells(spark, sf), CONFIG)
    return rounded(d.withColumns({"retention": F.round("retention", 5), "mae_increase": F.round("mae_increase", 5)}))


def _integral(f: str, upper: str, nodes: int = 4_000) -> str:
    """Simpson's rule from 0 in SQL; ``f`` is written over @."""
    weight = f"CASE WHEN i IN (0, {nodes}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {nodes + 1}), lambda i: {weight} * {f.replace('@', f'(({upper}) * i / {nodes})')})) * ({upper}) / {3 * nodes})"


def _normal_p(z: str) -> str:
    return f"(1 - 2 * {_integral('exp(-pow(@, 2) / 2) / sqrt(2 * pi())', f'least(abs({z}), 30)')})"


def _t_p(t: str, n: str) -> str:
    """Two-sided, n degrees of freedom."""
    c = f"exp(lgamma(({n} + 1) / 2.0) - lgamma({n} / 2.0)) / sqrt({n} * pi())"
    return f"(1 - 2 * {_integral(f'{c} * pow(1 + pow(@, 2) / {n}, -({n} + 1) / 2.0)', f'least(abs({t}), 60)')})"


def _f_p(f: str, a: str, b: str) -> str:
    c = f"exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0)) * pow({a}::DOUBLE / {b}, {a} / 2.0)"
    return f"(1 - {_integral(f'2 * {c} * pow(@, {a} - 1) * pow(1 + {a}::DOUBLE / {b} * pow(@, 2), -({a} + {b}) / 2.0)', f'least(sqrt({f}), 60)')})"


_ANOVA = """g AS (SELECT avg(y) AS m, count(*) AS n, var_pop(y) * count(*) AS total FROM d),
sa AS (SELECT sum(x.n * (k - g.m) ** 2) AS ss, count(*) AS c FROM (SELECT a, avg(y) AS k, count(*) AS n FROM d GROUP BY a) x, g),
sb AS (SELECT sum(x.n * (k - g.m) ** 2) AS ss, count(*) AS c FROM (SELECT b, avg(y) AS k, count(*) AS n FROM d GROUP BY b) x, g),
sc AS (SELECT sum(x.n * (k - g.m) ** 2) AS ss FROM (SELECT a, b, avg(y) AS k, count(*) AS n FROM d GROUP BY a, b) x, g),
t AS (SELECT 'model' AS term, sa.ss AS ss, sa.c - 1 AS df FROM sa UNION ALL SELECT 'rep', sb.ss, sb.c - 1 FROM sb
  UNION ALL SELECT 'interaction', sc.ss - sa.ss - sb.ss, (sa.c - 1) * (sb.c - 1) FROM sa, sb, sc UNION ALL SELECT 'residual', g.total - sc.ss, g.n - sa.c * sb.c FROM sa, sb, sc, g),
f AS (SELECT t.*, CASE WHEN term <> 'residual' THEN ss / df / (SELECT ss / df FROM t WHERE term = 'residual') END AS f, (SELECT df FROM t WHERE term = 'residual') AS rest FROM t)
SELECT term, round(ss, 6) AS ss, df, round(ss / df, 8) AS ms, round(f, 5) AS f, round(ss / g.total * 100, 6) AS eta2, round(CASE WHEN f >= 0 AND df > 0 AND rest > 0 THEN @P END, 6) AS p FROM f, g""".replace("@P", _f_p("f", "df", "rest"))


@query("variance_decomposition", f"WITH {CELLS}, d AS (SELECT model AS a, rep AS b, r2 AS y FROM cells WHERE abs(sigma - 0.3) < 0.05), {_ANOVA}")
def variance_decomposition(spark, sf):
    d = A.variance_decomposition(cells(spark, sf).filter("abs(sigma - 0.3) < 0.05"), "model", "rep", "r2")
    return d.select("term", F.round("ss", 6).alias("ss"), "df", F.round("ms", 8).alias("ms"), F.round("f", 5).alias("f"), F.round("eta2", 6).alias("eta2"), F.round("p", 6).alias("p"))


@query("mann_whitney", f"""WITH {CELLS}, p AS (SELECT DISTINCT x.rep || x.model AS g1, y.rep || y.model AS g2 FROM cells x, cells y WHERE x.rep || x.model < y.rep || y.model),
b AS (SELECT g1, g2, rep || model AS g, r2 AS v FROM cells JOIN p ON rep || model IN (g1, g2)), r AS (SELECT *, rank() OVER (PARTITION BY g1, g2 ORDER BY v) + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2 AS r, pow(count(*) OVER (PARTITION BY g1, g2, v), 2) - 1 AS t FROM b),
u AS (SELECT g1, g2, count(*) FILTER (WHERE g = g1) AS n1, count(*) FILTER (WHERE g = g2) AS n2, sum(r) FILTER (WHERE g = g1) - count(*) FILTER (WHERE g = g1) * (count(*) FILTER (WHERE g = g1) + 1) / 2 AS u, sum(t) AS t, count(*) AS n FROM r GROUP BY ALL),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM u)
SELECT g1, g2, n1, n2, u, round(CASE WHEN z <= 0 THEN 1 ELSE {_normal_p('z')} END, 6) AS p FROM z""")
def mann_whitney(spark, sf):
    return A.mann_whitney(cells(spark, sf).withColumn("g", F.concat("rep", "model")).select("g", "r2"), "g", "r2").withColumn("p", F.round("p", 6))


@query("wilcoxon", f"""WITH {CELLS}, p AS (SELECT rep, strategy, sigma, max(r2) FILTER (WHERE model = 'A') - max(r2) FILTER (WHERE model = 'R') AS d FROM cells GROUP BY ALL),
r AS (SELECT rep, d, rank() OVER (PARTITION BY rep ORDER BY abs(d)) + (count(*) OVER (PARTITION BY rep, abs(d)) - 1) / 2 AS r, pow(count(*) OVER (PARTITION BY rep, abs(d)), 2) - 1 AS t FROM p WHERE d <> 0),
w AS (SELECT rep, sum(t) AS t, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS w_minus, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS statistic FROM r GROUP BY 1),
z AS (SELECT *, (statistic - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM w)
SELECT rep, n, w_plus, w_minus, statistic, round({_normal_p('z')}, 6) AS p FROM z""")
def wilcoxon(spark, sf):
    r2 = lambda m: F.max(F.when(F.col("model") == m, F.col("r2")))
    p = cells(spark, sf).groupBy("rep", "strategy", "sigma").agg(r2("A").alias("a"), r2("R").alias("b")).filter("a is not null and b is not null")
    return A.wilcoxon(p, ["rep"], "a", "b").withColumn("p", F.round("p", 6))


@query("spearman_by_sigma", f"""WITH {PRED}, r AS (SELECT sigma, rank() OVER (PARTITION BY sigma ORDER BY y_true) + (count(*) OVER (PARTITION BY sigma, y_true) - 1) / 2 AS a,
  rank() OVER (PARTITION BY sigma ORDER BY y_pred) + (count(*) OVER (PARTITION BY sigma, y_pred) - 1) / 2 AS b FROM preds) SELECT sigma, round(coalesce(corr(a, b), 0), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman_by_sigma(spark, sf):
    return rounded(A.spearman(predictions(spark, sf), ["sigma"], "y_true", "y_pred"))


@query("pearson_by_group", f"WITH {PRED}, c AS (SELECT model, rep, corr(abs(y_true - y_pred), unc) AS r, count(*) AS n FROM preds GROUP BY ALL) SELECT model, rep, round(r, 6) AS r, n, round({_t_p('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')}, 6) AS p FROM c")
def pearson_by_group(spark, sf):
    return rounded(A.pearson(predictions(spark, sf), ["model", "rep"], F.abs(F.col("y_true") - F.col("y_pred")), F.col("unc")))


@query("paired_t", f"WITH {PRED}, s AS (SELECT model, count(*) AS n, avg(y_true - y_pred) AS m, avg(y_true - y_pred) / (stddev_samp(y_true - y_pred) / sqrt(count(*))) AS t FROM preds GROUP BY 1) SELECT model, n, round(m, 6) AS mean_difference, round(t, 5) AS t, round({_t_p('t', '(n - 1)')}, 6) AS p FROM s")
def paired_t(spark, sf):
    return A.paired_t(predictions(spark, sf), ["model"], "y_true", "y_pred").select("model", "n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 5).alias("t"), F.round("p", 6).alias("p"))


@query("regression_metrics", f"WITH {PRED} SELECT model, sigma, round(avg((y_true - y_pred) ** 2), 5) AS mse, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(1 - sum((y_true - y_pred) ** 2) / (count(*) * var_pop(y_true)), 6) AS r2, count(*) AS n FROM preds GROUP BY ALL")
def regression_metrics(spark, sf):
    return rounded(A.regression_metrics(predictions(spark, sf), ["model", "sigma"]).withColumn("mse", F.round("mse", 5)))


@query("binary_metrics", """WITH d AS (SELECT quality AS y, toxic AS p, doc_id % 97 AS s FROM labels), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM d),
c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn, sum(r) FILTER (WHERE y = 1) AS rp FROM r)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((rp - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS auc FROM c""")
def binary_metrics(spark, sf):
    return rounded(A.binary_metrics(table(spark, sf, "labels").withColumn("s", F.col("doc_id") % 97), "quality", "toxic", "s"))


@query("multiclass_metrics", """WITH d AS (SELECT l_linenumber AS y, l_suppkey % 7 + 1 AS p FROM lineitem), c AS (SELECT DISTINCT y AS c FROM d UNION SELECT DISTINCT p FROM d),
s AS (SELECT c, (SELECT count(*) FROM d WHERE y = c) AS support, (SELECT count(*) FROM d WHERE p = c) AS predicted, (SELECT count(*) FROM d WHERE y = c AND p = c) AS hits FROM c)
SELECT c, support, predicted, hits, round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 6) AS recall, round(2 * hits / (predicted + support), 6) AS f1 FROM s""")
def multiclass_metrics(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("y"), (F.col("l_suppkey") % 7 + 1).alias("p"))
    return rounded(A.class_metrics(d, "y", "p"))


_ECE = f"""WITH {PRED}, e AS (SELECT model, quantile_cont(unc, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, count(*) AS n FROM preds GROUP BY 1),
b AS (SELECT p.model, n, len(list_filter(q[1:10], lambda z: z <= unc)) AS bin, avg(abs(y_true - y_pred)) AS er, avg(unc) AS u, count(*) AS k FROM preds p JOIN e ON p.model = e.model WHERE unc < q[11] + 1e-8 GROUP BY ALL)
SELECT model, n, round(sum(abs(er - u) * k) / n, 6) AS ece FROM b GROUP BY model, n"""


@query("calibration_error", _ECE)
def calibration_error(spark, sf):
    d = predictions(spark, sf).withColumn("err", F.abs(F.col("y_true") - F.col("y_pred")))
    return rounded(A.calibration_error(d, ["model"], "err", "unc"))


@query("uncertainty_metrics", f"""WITH {PRED}, d AS (SELECT *, abs(y_true - y_pred) AS e FROM preds) SELECT model, rep, sigma, round(corr(e, unc), 6) AS r, round(avg(unc), 6) AS unc_mean, round(stddev_samp(unc), 6) AS unc_std, round(median(unc), 6) AS unc_median,
  round(avg(e), 6) AS mae, round(avg((e <= unc)::INT), 6) AS within_1, round(avg((e <= 2 * unc)::INT), 6) AS within_2 FROM d GROUP BY ALL HAVING count(*) >= 10""")
def uncertainty_metrics(spark, sf):
    d = predictions(spark, sf).withColumn("e", F.abs(F.col("y_true") - F.col("y_pred")))
    within = lambda k: F.avg((F.col("e") <= k * F.col("unc")).cast("double"))
    out = d.groupBy("model", "rep", "sigma").agg(F.corr("e", "unc").alias("r"), F.avg("unc").alias("unc_mean"), F.stddev_samp("unc").alias("unc_std"), F.median("unc").alias("unc_median"), F.avg("e").alias("mae"), within(1).alias("within_1"), within(2).alias("within_2"), F.count(F.lit(1)).alias("_n"))
    return rounded(out.filter("_n >= 10").drop("_n"))


@query("uncertainty_split", f"""WITH {PRED}, s AS (SELECT sigma, CASE model WHEN 'A' THEN 0.8 WHEN 'N' THEN 0.7 ELSE 0.9 END * unc AS epi, CASE model WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.3 ELSE 0.1 END * unc AS ale FROM preds)
SELECT sigma, round(avg(epi), 6) AS epistemic, round(avg(ale), 6) AS aleatoric, round(avg(epi) / avg(ale), 6) AS ratio, round(avg(sqrt(epi * epi + ale * ale)), 6) AS total FROM s GROUP BY 1""")
def uncertainty_split(spark, sf):
    share = F.when(F.col("model") == "A", 0.8).when(F.col("model") == "N", 0.7).otherwise(0.9)
    d = predictions(spark, sf).withColumns({"epi": share * F.col("unc"), "ale": (1 - share) * F.col("unc")})
    return rounded(d.groupBy("sigma").agg(F.avg("epi").alias("epistemic"), F.avg("ale").alias("aleatoric"), (F.avg("epi") / F.avg("ale")).alias("ratio"), F.avg(F.sqrt(F.col("epi") ** 2 + F.col("ale") ** 2)).alias("total")))


_CONFORMAL = f"""{PRED}, c AS (SELECT model, sigma, avg((abs(y_true - y_pred) <= unc)::INT) AS empirical, avg(2 * unc) AS width_mean, median(2 * unc) AS width_median, stddev_samp(2 * unc) AS width_std,
  sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, count(*) AS n FROM preds GROUP BY ALL)"""


@query("conformal_metrics", f"""WITH {_CONFORMAL} SELECT model, sigma, round(empirical, 6) AS empirical, round(width_mean, 6) AS width_mean, round(width_median, 6) AS width_median, round(width_std, 6) AS width_std, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n,
  round(0.9, 6) AS expected, round(empirical - 0.9, 6) AS deviation, abs(empirical - 0.9) < 0.05 AS calibrated, round(CASE WHEN rmse > 0 THEN width_mean / rmse ELSE 'infinity'::DOUBLE END, 6) AS efficiency FROM c""")
def conformal_metrics(spark, sf):
    return rounded(A.conformal(predictions(spark, sf), ["model", "sigma"], 0.1))


@query("conformal_pivot", f"WITH {_CONFORMAL} SELECT sigma, round(avg(abs(empirical - 0.9)) FILTER (WHERE model = 'A'), 6) AS A, round(avg(abs(empirical - 0.9)) FILTER (WHERE model = 'N'), 6) AS N, round(avg(abs(empirical - 0.9)) FILTER (WHERE model = 'R'), 6) AS R FROM c GROUP BY 1")
def conformal_pivot(spark, sf):
    c = A.conformal(predictions(spark, sf), ["model", "sigma"], 0.1).withColumn("d", F.abs("deviation"))
    return rounded(c.groupBy("sigma").pivot("model", ["A", "N", "R"]).avg("d"))


@query("recovery_rate", f"""WITH {CELLS}, m AS (SELECT rep, strategy, max(r2) FILTER (WHERE sigma = 0) AS clean, max(r2) FILTER (WHERE sigma = 1) AS noisy, max(r2) FILTER (WHERE sigma = 0.5) AS cleaned FROM cells WHERE model = 'A' GROUP BY ALL)
SELECT rep, strategy, round(CASE WHEN clean = noisy THEN 0 ELSE (cleaned - noisy) / (clean - noisy) END, 5) AS recovery FROM m""")
def recovery_rate(spark, sf):
    at = lambda s: F.max(F.when(F.col("sigma") == s, F.col("r2")))
    m = cells(spark, sf).filter("model = 'A'").groupBy("rep", "strategy").agg(at(0.0).alias("clean"), at(1.0).alias("noisy"), at(0.5).alias("cleaned"))
    return m.select("rep", "strategy", F.round(F.when(F.col("clean") == F.col("noisy"), 0.0).otherwise((F.col("cleaned") - F.col("noisy")) / (F.col("clean") - F.col("noisy"))), 5).alias("recovery"))


@query("cleaning_scores", """WITH d AS (SELECT source, toxic = 1 AS truth, n_chars % 3 = 0 AS found FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (WHERE truth AND found) AS tp, count(*) FILTER (WHERE found) AS d, count(*) FILTER (WHERE truth) AS t FROM d GROUP BY 1)
SELECT source, round(CASE WHEN d > 0 THEN tp / d WHEN t = 0 THEN 1 ELSE 0 END, 6) AS precision, round(CASE WHEN t > 0 THEN tp / t WHEN d = 0 THEN 1 ELSE 0 END, 6) AS recall FROM c""")
def cleaning_scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id").withColumns({"truth": F.col("toxic") == 1, "found": F.col("n_chars") % 3 == 0})
    c = d.groupBy("source").agg(F.count_if(F.col("truth") & F.col("found")).alias("tp"), F.count_if("found").alias("d"), F.count_if("truth").alias("t"))
    ratio = lambda part, whole, other: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).when(F.col(other) == 0, 1.0).otherwise(0.0)
    return rounded(c.select("source", ratio("tp", "d", "t").alias("precision"), ratio("tp", "t", "d").alias("recall")))
