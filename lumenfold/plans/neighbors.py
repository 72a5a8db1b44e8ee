"""Queries of distances, neighbours and label noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import neighbors as N
from lumenfold.operators import noise as Z
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import VEC, table, vectors
from lumenfold.plans.registry import query


def _knn(metric: str, k: int) -> str:
    d = {"euclidean": "list_distance(a.x, b.x)", "cosine": "list_cosine_distance(a.x, b.x)"}[metric]
    return f"{VEC}, near AS (SELECT * FROM (SELECT a.id, b.id AS neighbor, {d} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS rank FROM vecs a JOIN vecs b ON a.id <> b.id) WHERE rank <= {k})"


_STATS = """st AS (SELECT n.id, avg(v.y) AS nbr_mean, stddev_pop(v.y) AS nbr_std, sum(v.y / (distance + 1e-10)) / sum(1 / (distance + 1e-10)) AS nbr_weighted FROM near n JOIN vecs v ON v.id = n.neighbor GROUP BY 1),
r AS (SELECT v.id, v.y, nbr_mean, nbr_std, nbr_weighted, stddev_pop(y) OVER () AS s FROM vecs v JOIN st USING (id))"""


def _near(spark, sf, k, metric="euclidean"):
    v = vectors(spark, sf).select("id", "x", "y")
    return v.select("id", "y"), N.neighbors(v, k, metric)


_PAIR = f"WITH {VEC}, p AS (SELECT a.id AS a, b.id AS b, a.x AS x, b.x AS y FROM vecs a JOIN vecs b ON b.id = a.id + 1)"


@query("vector_distances", _PAIR + """, z AS (SELECT *, list_zip(x, y) AS q FROM p) SELECT a, b, round(list_distance(x, y), 6) AS euclidean, round(list_sum(list_transform(q, lambda t: abs(t[1] - t[2]))), 6) AS manhattan, round(list_cosine_distance(x, y), 6) AS cosine,
  round(list_max(list_transform(q, lambda t: abs(t[1] - t[2]))), 6) AS chebyshev, round(list_sum(list_transform(q, lambda t: abs(t[1] - t[2]) / (abs(t[1]) + abs(t[2])))), 6) AS canberra,
  round(list_sum(list_transform(q, lambda t: abs(t[1] - t[2]))) / list_sum(list_transform(q, lambda t: abs(t[1] + t[2]))), 6) AS braycurtis, round(pow(list_sum(list_transform(q, lambda t: pow(abs(t[1] - t[2]), 3))), 1 / 3), 6) AS minkowski_3,
  round(1 - (list_sum(list_transform(q, lambda t: t[1] * t[2])) - 64 * list_avg(x) * list_avg(y)) / (sqrt(list_sum(list_transform(x, lambda t: t * t)) - 64 * list_avg(x) ** 2) * sqrt(list_sum(list_transform(y, lambda t: t * t)) - 64 * list_avg(y) ** 2)), 6) AS correlation FROM z""")
def vector_distances(spark, sf):
    v = vectors(spark, sf).select("id", "x")
    p = v.select(F.col("id").alias("a"), "x").join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("x").alias("y")), "a")
    return rounded(p.select("a", "b", *(N.distance(F.col("x"), F.col("y"), m).alias(m) for m in N.METRICS)))


@query("nearest_neighbors", f"WITH {_knn('euclidean', 5)} SELECT id, neighbor, round(distance, 6) AS distance, rank FROM near")
def nearest_neighbors(spark, sf):
    return rounded(_near(spark, sf, 5)[1])


@query("nearest_neighbors_cosine", f"WITH {_knn('cosine', 5)} SELECT id, neighbor, round(distance, 6) AS distance, rank FROM near")
def nearest_neighbors_cosine(spark, sf):
    return rounded(_near(spark, sf, 5, "cosine")[1])


@query("noise_knn_consistency", f"WITH {_knn('euclidean', 5)}, {_STATS} SELECT id, round(nbr_std, 6) AS nbr_std, nbr_std > quantile_cont(nbr_std, 0.9) OVER () AS is_noise FROM r")
def noise_knn_consistency(spark, sf):
    return rounded(Z.knn_consistency(*_near(spark, sf, 5)).select("id", "nbr_std", "is_noise"))


@query("noise_distance_weighted", f"WITH {_knn('euclidean', 15)}, {_STATS} SELECT id, round(nbr_weighted, 6) AS nbr_weighted, abs(y - nbr_weighted) > 1.5 * s AS is_noise FROM r")
def noise_distance_weighted(spark, sf):
    return rounded(Z.distance_weighted(*_near(spark, sf, 15), deviations=1.5).select("id", "nbr_weighted", "is_noise"))


@query("noise_consensus", f"WITH {_knn('euclidean', 10)}, {_STATS} SELECT id, abs(y - nbr_mean) / s > 1.5 AND nbr_std / s < 1 AS is_noise, abs(y - nbr_mean) / s > 1.5 AND NOT nbr_std / s < 1 AS is_cliff FROM r")
def noise_consensus(spark, sf):
    return Z.consensus(*_near(spark, sf, 10), disagreement=1.5).select("id", "is_noise", "is_cliff")


@query("noise_lof", f"""WITH {_knn('euclidean', 20)}, kd AS (SELECT id, max(distance) AS kd FROM near GROUP BY 1), lrd AS (SELECT n.id, 1 / (avg(greatest(distance, kd)) + 1e-10) AS l FROM near n JOIN kd ON kd.id = n.neighbor GROUP BY 1),
f AS (SELECT n.id, avg(b.l) / any_value(a.l) AS lof FROM near n JOIN lrd b ON b.id = n.neighbor JOIN lrd a ON a.id = n.id GROUP BY 1) SELECT id, round(lof, 6) AS lof, lof > quantile_cont(lof, 0.9) OVER () AS is_noise FROM f""")
def noise_lof(spark, sf):
    return rounded(Z.lof_noise(*_near(spark, sf, 20)).select("id", "lof", "is_noise"))


@query("noise_z_score", f"WITH {VEC} SELECT id, abs(y - avg(y) OVER ()) > 1.5 * stddev_pop(y) OVER () AS is_noise FROM vecs")
def noise_z_score(spark, sf):
    return Z.z_score(vectors(spark, sf).select("id", "y"), 1.5)[["id", "is_noise"]]


_SCORES = {"neighbor_residual": ("abs(y - nbr_mean) / (s + 1e-10)", "nbr_mean"), "local_variance_ratio": ("abs(y - nbr_mean) / (nbr_std + 1e-10)", "nbr_mean"), "distance_weighted": ("abs(y - nbr_weighted) / (s + 1e-10)", "nbr_weighted"), "activity_cliff_aware": ("abs(y - nbr_mean) / (s + 1e-10) / (1 + nbr_std / (s + 1e-10))", "nbr_mean")}


def _estimator(method: str) -> None:
    score, target = _SCORES[method]

    @query(f"estimate_{method}", f"WITH {_knn('cosine', 10)}, {_STATS} SELECT id, round({score}, 5) AS score, round({target}, 6) AS target FROM r")
    def estimate(spark, sf):
        return rounded(Z.estimate(*_near(spark, sf, 10, "cosine"), method=method).select("id", "score", "target"), 6, score=5)


for _m in _SCORES:
    _estimator(_m)

_SCALED = f"WITH {_knn('cosine', 10)}, {_STATS}, e AS (SELECT id, y, abs(y - nbr_mean) / (s + 1e-10) AS score, nbr_mean AS target FROM r), n AS (SELECT *, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-10) AS n FROM e)"


@query("weights_from_scores", _SCALED + """, w AS (SELECT id, 1 / (1 + n) AS a, exp(-n) AS b, greatest(0.1, least(1.0, 1 - n * n)) AS c FROM n)
SELECT id, round(a / avg(a) OVER (), 6) AS inverse, round(b / avg(b) OVER (), 6) AS exponential, round(c / avg(c) OVER (), 6) AS soft FROM w""")
def weights_from_scores(spark, sf):
    d = Z.estimate(*_near(spark, sf, 10, "cosine")).select("id", "y", "score", "target")
    methods = ("inverse", "exponential", "soft")
    return rounded(Z.weights(d, method=methods).select("id", *methods))


@query("smooth_labels", _SCALED + """SELECT id, round(y + 0.5 * n * (target - y), 6) AS proportional, round(CASE WHEN n > quantile_cont(n, 0.5) OVER () THEN 0.5 * y + 0.5 * target ELSE y END, 6) AS threshold,
  round(y + 0.5 / (1 + exp(-5 * (n - 0.5))) * (target - y), 6) AS soft_threshold, round((1 - 0.5 * score / (1 + 0.5 * score)) * y + 0.5 * score / (1 + 0.5 * score) * target, 6) AS confidence FROM n""")
def smooth_labels(spark, sf):
    d = Z.estimate(*_near(spark, sf, 10, "cosine")).select("id", "y", "score", "target")
    methods = ("proportional", "threshold", "soft_threshold", "confidence")
    return rounded(Z.smooth(d, method=methods).select("id", *methods))


@query("hybrid_noise_score", f"""WITH {_knn('cosine', 10)}, {_STATS}, e AS (SELECT id, abs(y - nbr_mean) / (s + 1e-10) AS a, abs(y - nbr_mean) / (nbr_std + 1e-10) AS b FROM r)
SELECT id, round(((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER () + 1e-10) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER () + 1e-10)) / 2, 6) AS score FROM e""")
def hybrid_noise_score(spark, sf):
    rows, near = _near(spark, sf, 10, "cosine")
    return rounded(Z.hybrid_score([Z.estimate(rows, near), Z.estimate(rows, near, "local_variance_ratio")]))


def _u(seed: str) -> str:
    return f"((('0x' || substr(md5(id::VARCHAR || '_{seed}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


_NORMAL = f"sqrt(-2 * ln({_u('7a')})) * cos(2 * 3.141592653589793 * {_u('7b')})"
_NOISE = {"legacy": "z * 0.3 * s", "quantile": "z * 0.3 * s * CASE WHEN y < q[1] OR y > q[3] THEN 2 ELSE 1 END", "hetero": "z * 0.3 * abs(y - m)", "threshold": "z * 0.3 * s * CASE WHEN y > q[2] THEN 1.5 ELSE 1 END", "valprop": "z * 0.3 * (abs(y) + 0.1)", "outlier": "z * 0.3 * s * CASE WHEN k <= greatest(1, floor(0.05 * c)) THEN 5 ELSE 1 END"}


@query("inject_noise", f"""WITH {VEC}, g AS (SELECT stddev_pop(y) AS s, avg(y) AS m, quantile_cont(y, [0.25, 0.5, 0.75]) AS q, count(*) AS c FROM vecs), d AS (SELECT id, y, s, m, q, c, {_NORMAL} AS z, row_number() OVER (ORDER BY {_u('7o')}, id) AS k FROM vecs, g)
SELECT id, {', '.join(f'round(y + {e}, 6) AS {n}' for n, e in _NOISE.items())} FROM d""")
def inject_noise(spark, sf):
    return rounded(Z.inject(vectors(spark, sf).select("id", "y"), 0.3, tuple(_NOISE), "7").select("id", *_NOISE))


@query("flip_labels", f"SELECT doc_id, toxic, CASE WHEN {_u('3').replace('id::', 'doc_id::')} < 0.2 THEN 1 - toxic ELSE toxic END AS label_noisy FROM labels")
def flip_labels(spark, sf):
    return Z.flip(table(spark, sf, "labels").select("doc_id", "toxic"), 0.2, "3", "doc_id", "toxic")


_DRAW = _u("3").replace("id::", "doc_id::")


@query("flip_labels_asymmetric", f"SELECT doc_id, toxic, CASE WHEN {_DRAW} < CASE WHEN toxic = 1 THEN 0.4 ELSE 0.2 END THEN 1 - toxic ELSE toxic END AS label_noisy FROM labels")
def flip_labels_asymmetric(spark, sf):
    return Z.flip(table(spark, sf, "labels").select("doc_id", "toxic"), 0.4, "3", "doc_id", "toxic", "binary_asymmetric")


@query("flip_labels_imbalanced", f"SELECT doc_id, toxic, CASE WHEN {_DRAW} < 0.4 * CASE WHEN toxic = 1 THEN 1 - avg(toxic) OVER () ELSE avg(toxic) OVER () END THEN 1 - toxic ELSE toxic END AS label_noisy FROM labels")
def flip_labels_imbalanced(spark, sf):
    return Z.flip(table(spark, sf, "labels").select("doc_id", "toxic"), 0.2, "3", "doc_id", "toxic", "class_imbalance")


@query("conformal_widths", f"""WITH {VEC}, p AS (SELECT id, y, label::DOUBLE AS y_pred, 0.05 + abs(x[2]) AS unc FROM vecs), k AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR || '_42'), id) - 1 AS place, count(*) OVER () AS n FROM p),
c AS (SELECT quantile_cont(abs(y - y_pred) / (unc + 1e-10), 0.9) AS q FROM k WHERE place < floor(n * 0.2)), w AS (SELECT id, 2 * q * unc AS width FROM p, c) SELECT id, round(width, 6) AS width, round(width / (stddev_pop(width) OVER () + 1e-10), 6) AS score FROM w""")
def conformal_widths(spark, sf):
    p = vectors(spark, sf).select("id", "y", F.col("label").cast("double").alias("y_pred"), (0.05 + F.abs(F.element_at("x", 2))).alias("unc"))
    return rounded(Z.conformal_widths(p).select("id", "width", "score"))


@query("detector_flags", f"WITH {_knn('euclidean', 15)}, {_STATS} SELECT 'distance_weighted' AS method, count(*) FILTER (WHERE abs(y - nbr_weighted) > 1.5 * s) AS flagged, count(*) AS n FROM r UNION ALL SELECT 'knn_consistency', count(*) FILTER (WHERE k), count(*) FROM (SELECT nbr_std > quantile_cont(nbr_std, 0.9) OVER () AS k FROM r) UNION ALL SELECT 'z_score', count(*) FILTER (WHERE k), count(*) FROM (SELECT abs(y - avg(y) OVER ()) > 1.5 * stddev_pop(y) OVER () AS k FROM vecs)")
def detector_flags(spark, sf):
    rows, near = _near(spark, sf, 15)
    options = {"distance_weighted": {"deviations": 1.5}, "knn_consistency": {}, "z_score": {"limit": 1.5}}
    out = None
    for method, o in options.items():
        part = Z.detect(method, rows, near, **o).agg(F.lit(method).alias("method"), F.count_if("is_noise").alias("flagged"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.union(part)
    return out


_WHITE = f"{VEC}, m AS (SELECT covar_samp(x[1], x[1]) AS a, covar_samp(x[1], x[2]) AS b, covar_samp(x[2], x[2]) AS d FROM vecs), p AS (SELECT s.id, s.x[1] - t.x[1] AS u, s.x[2] - t.x[2] AS v FROM vecs s JOIN vecs t ON t.id = s.id + 1)"


@query("mahalanobis_distance", f"WITH {_WHITE} SELECT id, round(sqrt((d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b)), 5) AS d FROM p, m")
def mahalanobis_distance(spark, sf):
    v = N.whitened(vectors(spark, sf).select("id", F.slice("x", 1, 2).alias("x")))
    return rounded(v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", N.distance(F.col("x"), F.col("y")).alias("d")), 5)


@query("activity_cliffs", f"""WITH {VEC}, p AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS d, abs(a.y - b.y) AS dy FROM vecs a, vecs b), t AS (SELECT quantile_cont(d, 0.1) FILTER (WHERE a < b) AS ds, quantile_cont(dy, 0.9) AS da FROM p)
SELECT a AS id, count(*) AS cliffs FROM p, t WHERE d < ds AND dy > da GROUP BY 1""")
def activity_cliffs(spark, sf):
    return N.activity_cliffs(vectors(spark, sf).select("id", "x", "y"))


@query("standardized_distance", f"""WITH {VEC}, l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM vecs), s AS (SELECT p, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY 1), z AS (SELECT id, p, (v - m) / s AS z FROM l JOIN s USING (p))
SELECT a.id, round(sqrt(sum((a.z - b.z) ** 2)), 6) AS d FROM z a JOIN z b ON b.id = a.id + 1 AND a.p = b.p GROUP BY 1""")
def standardized_distance(spark, sf):
    v = N.standardize_vectors(vectors(spark, sf).select("id", "x"))
    return rounded(v.join(v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", N.distance(F.col("x"), F.col("y")).alias("d")))


@query("radius_pairs", f"WITH {VEC} SELECT label, id, neighbor, round(distance, 6) AS distance FROM (SELECT a.label, a.id, b.id AS neighbor, list_distance(a.x, b.x) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS k FROM vecs a JOIN vecs b ON a.label = b.label AND a.id <> b.id WHERE list_distance(a.x, b.x) < 1.35) WHERE k <= 32")
def radius_pairs(spark, sf):
    return rounded(N.pairs_within(vectors(spark, sf).select("label", "id", "x"), 1.35, groups=["label"], limit=32))


@query("nearest_tanimoto", "WITH t AS (SELECT doc_id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS g FROM documents WHERE text IS NOT NULL), p AS (SELECT a.doc_id, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM t a JOIN t b ON a.doc_id % 100 = 0 AND b.doc_id % 100 <> 0) SELECT doc_id, round(max(n / (m - n)), 6) AS best FROM p GROUP BY 1")
def nearest_tanimoto(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return rounded(N.nearest_grams(t.filter("doc_id % 100 = 0"), t.filter("doc_id % 100 <> 0"), "doc_id"))


@query("nearest_tanimoto_all", "WITH t AS (SELECT doc_id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS g FROM documents WHERE text IS NOT NULL), p AS (SELECT a.doc_id, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM t a JOIN t b ON a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id) SELECT doc_id, round(max(n / (m - n)), 6) AS best FROM p GROUP BY 1")
def nearest_tanimoto_all(spark, sf):
    """Every document whose id is divisible by 100 against all others, such ones too."""
    t = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    return rounded(N.nearest_grams(t.filter("doc_id % 100 = 0"), t, "doc_id"))


@query("intrinsic_dimension", f"WITH {_knn('euclidean', 10)}, t AS (SELECT id, max(distance) FILTER (WHERE rank = 10) AS tk FROM near GROUP BY 1), m AS (SELECT n.id, 9 / sum(ln(tk / distance)) AS d FROM near n JOIN t USING (id) WHERE rank < 10 GROUP BY 1) SELECT round(avg(d), 5) AS dimension, count(*) AS n FROM m")
def intrinsic_dimension(spark, sf):
    from lumenfold.operators.selection import intrinsic_dimension as dimension

    return rounded(dimension(_near(spark, sf, 10)[1], 10), 5)


@query("neighbor_property_difference", f"WITH {_knn('euclidean', 5)} SELECT round(avg(d), 6) AS difference FROM (SELECT n.id, avg(abs(a.y - b.y)) AS d FROM near n JOIN vecs a ON a.id = n.id JOIN vecs b ON b.id = n.neighbor GROUP BY 1)")
def neighbor_property_difference(spark, sf):
    rows, near = _near(spark, sf, 5)
    d = near.join(rows, "id").join(rows.select(F.col("id").alias("neighbor"), F.col("y").alias("y2")), "neighbor").groupBy("id").agg(F.avg(F.abs(F.col("y") - F.col("y2"))).alias("d"))
    return rounded(d.agg(F.avg("d").alias("difference")))
