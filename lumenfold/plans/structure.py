"""Queries of splits and small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import graphs as G
from lumenfold.operators import splits as S
from lumenfold.plans.analytics import rounded
from lumenfold.plans.carriers import EDGES, VEC, edges, table, vectors
from lumenfold.plans.registry import query


def _md5(key: str, seed: object) -> str:
    return f"md5({key}::VARCHAR || '_{seed}')"


_SPLIT = "CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END"


@query("random_split", f"SELECT c_custkey, {_SPLIT} AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY {_md5('c_custkey', 42)}, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer)")
def random_split(spark, sf):
    return S.random_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("stratified_split", f"SELECT doc_id, toxic, {_SPLIT} AS split FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_md5('doc_id', 7)}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels)")
def stratified_split(spark, sf):
    return S.random_split(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", seed=7, strata=["toxic"])


@query("quartile_split", f"WITH {VEC}, q AS (SELECT quantile_cont(y, [0.25, 0.5, 0.75]) AS q FROM vecs), s AS (SELECT id, (y >= q[1])::INT + (y >= q[2])::INT + (y >= q[3])::INT AS stratum FROM vecs, q) SELECT id, stratum, {_SPLIT} AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_md5('id', 42)}, id) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s)")
def quartile_split(spark, sf):
    return S.random_split(S.quartile_strata(vectors(spark, sf).select("id", "y"), "y").drop("y"), "id", strata=["stratum"])


def _drawn(source: str, share: str, seed: int, name: str) -> str:
    """CTEs: ``source``'s rows (id, y) with whether their quartile draws them."""
    return f"{name}_q AS (SELECT quantile_cont(y, [0.25, 0.5, 0.75]) AS q FROM {source}), {name}_s AS (SELECT id, y, (y >= q[1])::INT + (y >= q[2])::INT + (y >= q[3])::INT AS s FROM {source}, {name}_q), {name} AS (SELECT id, y, row_number() OVER (PARTITION BY s ORDER BY {_md5('id', seed)}, id) <= floor(count(*) OVER (PARTITION BY s) * {share}) AS drawn FROM {name}_s)"


@query("quartile_resplit", f"WITH {VEC}, {_drawn('vecs', '0.1::DOUBLE', 42, 'one')}, rest AS (SELECT id, y FROM one WHERE NOT drawn), {_drawn('rest', '(0.1::DOUBLE / (1 - 0.1::DOUBLE))', 43, 'two')} SELECT id, 'test' AS split FROM one WHERE drawn UNION ALL SELECT id, CASE WHEN drawn THEN 'validation' ELSE 'train' END FROM two")
def quartile_resplit(spark, sf):
    return S.quartile_split(vectors(spark, sf).select("id", "y"), "id", "y").select("id", "split")


@query("internal_validation", f"SELECT id, row_number() OVER (ORDER BY {_md5('id', 42)}, id) <= greatest(floor(count(*) OVER () * 0.15), 1) AS is_validation FROM (SELECT vec_id AS id FROM embeddings)")
def internal_validation(spark, sf):
    return S.internal_validation(vectors(spark, sf).select("id"), "id", 0.15)


@query("shuffled_folds", f"SELECT id, ntile(5) OVER (ORDER BY {_md5('id', 3)}, id) - 1 AS fold FROM (SELECT vec_id AS id FROM embeddings)")
def shuffled_folds(spark, sf):
    return S.folds(vectors(spark, sf).select("id"), "id", 5, 3)


@query("ordered_folds", "SELECT vec_id AS id, ntile(5) OVER (ORDER BY vec_id) - 1 AS fold FROM embeddings")
def ordered_folds(spark, sf):
    return S.folds(vectors(spark, sf).select("id"), "id")


@query("hash_sample", f"SELECT c_custkey FROM customer ORDER BY {_md5('c_custkey', 42)}, c_custkey LIMIT 200")
def hash_sample(spark, sf):
    return S.sample(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 200)


@query("learning_curve", f"WITH s AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(id::VARCHAR || '_' || seed::VARCHAR), id) AS k FROM (SELECT vec_id AS id FROM embeddings), (VALUES (1), (2)) t(seed)) SELECT size, seed, count(*) AS n, sum(id)::BIGINT AS ids FROM s, (VALUES (50), (200)) z(size) WHERE k <= size GROUP BY ALL")
def learning_curve(spark, sf):
    d = S.learning_curve(vectors(spark, sf).select("id"), "id", [50, 200], [1, 2])
    return d.groupBy("size", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("group_split", """WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) AS k FROM documents GROUP BY 1), t AS (SELECT count(*) AS total FROM documents),
r AS (SELECT 0::BIGINT AS k, 0::BIGINT AS a, 0::BIGINT AS b, NULL::VARCHAR AS source, NULL::BIGINT AS n, NULL::VARCHAR AS split UNION ALL
  SELECT g.k, a + CASE WHEN a + g.n <= total * 0.8 THEN g.n ELSE 0 END, b + CASE WHEN a + g.n > total * 0.8 AND a + b + g.n <= total * (0.8 + 0.1) THEN g.n ELSE 0 END, g.source, g.n,
    CASE WHEN a + g.n <= total * 0.8 THEN 'train' WHEN a + b + g.n <= total * (0.8 + 0.1) THEN 'validation' ELSE 'test' END FROM r JOIN g ON g.k = r.k + 1, t)
SELECT source, split, n FROM r WHERE k > 0""")
def group_split(spark, sf):
    return S.group_split(table(spark, sf, "documents").select("doc_id", "source"), "source").groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@query("group_folds", """WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) AS k FROM documents GROUP BY 1),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::VARCHAR AS source, NULL::BIGINT AS n, NULL::INT AS fold UNION ALL
  SELECT g.k, list_transform(load, lambda v, i: v + CASE WHEN i = list_position(load, list_min(load)) THEN g.n ELSE 0 END), g.source, g.n, (list_position(load, list_min(load)) - 1)::INT FROM r JOIN g ON g.k = r.k + 1)
SELECT source, fold, n FROM r WHERE k > 0""")
def group_folds(spark, sf):
    return S.group_folds(table(spark, sf, "documents").select("doc_id", "source"), "source").groupBy("source", "fold").agg(F.count(F.lit(1)).alias("n"))


_POISSON, _MASS = [0.36787944117144233], 0.36787944117144233
for _k in range(1, 8):
    _MASS /= _k
    _POISSON.append(_POISSON[-1] + _MASS)


@query("bootstrap_weights", f"""WITH u AS (SELECT run, ('0x' || substr(md5(c_custkey::VARCHAR || '_' || run::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u FROM customer, range(10) t(run)),
w AS (SELECT run, {' + '.join(f'(u >= {p!r}::DOUBLE)::INT' for p in _POISSON)} AS weight FROM u) SELECT run::INT AS run, sum(weight)::BIGINT AS drawn, count(*) FILTER (WHERE weight = 0) AS out_of_bag FROM w GROUP BY 1""")
def bootstrap_weights(spark, sf):
    b = S.bootstrap(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 10)
    return b.groupBy("run").agg(F.sum("weight").alias("drawn"), F.count_if(F.col("weight") == 0).alias("out_of_bag"))


@query("degree_features", f"WITH {EDGES}, d AS (SELECT g, src, count(*) AS d FROM edges_v GROUP BY ALL), f AS (SELECT g, count(*) AS nodes, (sum(d) / 2)::BIGINT AS edges, avg(d) AS m, max(d) AS x, stddev_pop(d) AS s FROM d GROUP BY 1) SELECT g, nodes, edges, round(m, 6) AS degree_mean, x AS degree_max, round(s, 6) AS degree_std, round(CASE WHEN nodes > 1 THEN 2 * edges / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM f")
def degree_features(spark, sf):
    return rounded(G.degree_features(edges(spark, sf)))


@query("refinement_histogram", f"""WITH {EDGES}, l0 AS (SELECT DISTINCT g, src AS node, CASE WHEN src < 5 THEN 's' ELSE 'p' END AS label FROM edges_v), a1 AS (SELECT e.g, e.src AS node, string_agg(l.label, '_' ORDER BY l.label) AS a FROM edges_v e JOIN l0 l ON l.g = e.g AND l.node = e.dst GROUP BY ALL),
l1 AS (SELECT l0.g, l0.node, md5(label || '|' || coalesce(a, '')) AS label FROM l0 LEFT JOIN a1 USING (g, node)), a2 AS (SELECT e.g, e.src AS node, string_agg(l.label, '_' ORDER BY l.label) AS a FROM edges_v e JOIN l1 l ON l.g = e.g AND l.node = e.dst GROUP BY ALL),
l2 AS (SELECT l1.g, l1.node, md5(label || '|' || coalesce(a, '')) AS label FROM l1 LEFT JOIN a2 USING (g, node)) SELECT g, label, count(*) AS n FROM (SELECT g, '0_' || label AS label FROM l0 UNION ALL SELECT g, '1_' || label FROM l1 UNION ALL SELECT g, '2_' || label FROM l2) GROUP BY ALL""")
def refinement_histogram(spark, sf):
    e = edges(spark, sf)
    labels = e.select("g", F.col("src").alias("node")).distinct().withColumn("label", F.when(F.col("node") < 5, "s").otherwise("p"))
    return G.refinement_histogram(e, labels, 2)


_HOPS = """paths AS (SELECT g, src, dst, 1 AS h FROM edges_v UNION SELECT p.g, p.src, e.dst, p.h + 1 FROM paths p JOIN edges_v e ON e.g = p.g AND e.src = p.dst WHERE p.h < 10),
hops AS (SELECT g, src, dst, min(h) AS h FROM paths WHERE src <> dst GROUP BY ALL)"""


@query("graph_paths", f"""WITH RECURSIVE {EDGES}, {_HOPS},
ecc AS (SELECT g, src, max(h) AS e, count(*) AS r FROM hops GROUP BY ALL), c AS (SELECT g, max(e) AS d, min(e) AS m, avg(e) AS ecc_mean, stddev_pop(e) AS ecc_std, min(r) AS reach, count(*) AS nodes FROM ecc GROUP BY 1),
p AS (SELECT g, avg(h) AS path_mean, max(h) AS path_max, sum(h) / 2 AS wiener FROM hops GROUP BY 1), b AS (SELECT g, count(*) FILTER (WHERE e = d) AS periphery, count(*) FILTER (WHERE e = m) AS center FROM ecc JOIN c USING (g) GROUP BY 1)
SELECT g, round(path_mean, 6) AS path_mean, path_max, wiener, round(ecc_mean, 6) AS ecc_mean, round(ecc_std, 6) AS ecc_std, periphery, center, CASE WHEN reach = nodes - 1 THEN d ELSE -1 END AS diameter, CASE WHEN reach = nodes - 1 THEN m ELSE -1 END AS radius FROM p JOIN c USING (g) JOIN b USING (g)""")
def graph_paths(spark, sf):
    e = edges(spark, sf)
    return rounded(G.path_features(G.hop_distances(e), G.degree_features(e).select("g", "nodes")))


@query("graph_components", f"WITH RECURSIVE {EDGES}, reach AS (SELECT g, src, dst FROM edges_v UNION SELECT r.g, r.src, e.dst FROM reach r JOIN edges_v e ON e.g = r.g AND e.src = r.dst) SELECT g, count(DISTINCT root) AS components FROM (SELECT g, src, min(dst) AS root FROM reach GROUP BY ALL) GROUP BY 1")
def graph_components(spark, sf):
    return G.component_counts(G.hop_distances(edges(spark, sf)))


_MAIN = "comp AS (SELECT g, src, least(src, min(dst)) AS root FROM hops GROUP BY g, src), size AS (SELECT g, root, count(*) AS nodes FROM comp GROUP BY g, root QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, root) = 1)"


@query("graph_distances", f"""WITH RECURSIVE {EDGES}, {_HOPS}, {_MAIN}, own AS (SELECT hops.* FROM hops JOIN comp USING (g, src) JOIN size USING (g, root)), ecc AS (SELECT g, src, max(h) AS e FROM own GROUP BY ALL),
c AS (SELECT g, max(e) AS d, min(e) AS m, avg(e) AS ecc_mean, stddev_pop(e) AS ecc_std FROM ecc GROUP BY 1), b AS (SELECT g, count(*) FILTER (WHERE e = d) AS periphery, count(*) FILTER (WHERE e = m) AS center FROM ecc JOIN c USING (g) GROUP BY 1),
p AS (SELECT g, avg(h) AS path_mean, sum(h) / 2 AS wiener, stddev_pop(h) AS path_std FROM own GROUP BY 1)
SELECT g, nodes, round(path_mean, 6) AS path_mean, d AS path_max, wiener, round(path_std, 6) AS path_std, round(ecc_mean, 6) AS ecc_mean, round(ecc_std, 6) AS ecc_std, periphery, center FROM p JOIN c USING (g) JOIN b USING (g) JOIN size USING (g)""")
def graph_distances(spark, sf):
    return rounded(G.distance_features(G.hop_distances(edges(spark, sf))))


def _rounds(n: int) -> str:
    """The CTEs of refinement rounds 1 to n: r0 holds (g, node, label)."""
    one = "a{0} AS (SELECT e.g, e.src AS node, string_agg(l.label, '_' ORDER BY l.label) AS a FROM edges_v e JOIN r{1} l ON l.g = e.g AND l.node = e.dst GROUP BY ALL), r{0} AS (SELECT r{1}.g, r{1}.node, md5(label || '|' || coalesce(a, '')) AS label FROM r{1} LEFT JOIN a{0} USING (g, node))"
    return ", ".join(one.format(i, i - 1) for i in range(1, n + 1))


_KERNEL = f"""{EDGES}, r0 AS (SELECT DISTINCT g, src AS node, CASE WHEN src < 5 THEN 's' ELSE 'p' END AS label FROM edges_v), {_rounds(5)},
hist AS (SELECT g, label, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT g, '{i}_' || label AS label FROM r{i}" for i in range(6))}) GROUP BY ALL)"""


@query("refinement_features", f"WITH {_KERNEL}, v AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT label FROM hist WHERE g % 5 <> 0)) SELECT g, place, n FROM hist JOIN v USING (label) WHERE g % 5 = 0")
def refinement_features(spark, sf):
    """Five rounds; graphs of every fifth key are the test set, counted over the others' vocabulary."""
    e = edges(spark, sf)
    labels = e.select("g", F.col("src").alias("node")).distinct().withColumn("label", F.when(F.col("node") < 5, "s").otherwise("p"))
    test = lambda d: d.filter("g % 5 = 0")
    train = lambda d: d.filter("g % 5 <> 0")
    places = G.label_places(G.refinement_histogram(train(e), train(labels), 5))
    return G.placed_counts(G.refinement_histogram(test(e), test(labels), 5), places)


@query("scaffold_groups", "SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS group_id FROM documents")
def scaffold_groups(spark, sf):
    return S.group_ids(table(spark, sf, "documents").select("doc_id", "source"), "source").select("doc_id", "group_id")


_TRIANGLES = """half AS (SELECT DISTINCT l_orderkey // 4 AS g, l_suppkey % 7 AS src, l_partkey % 7 AS dst FROM lineitem WHERE l_suppkey % 7 <> l_partkey % 7),
t AS (SELECT g, src, dst FROM half UNION SELECT g, dst, src FROM half)"""


@query("graph_clustering", f"""WITH {_TRIANGLES}, d AS (SELECT g, src, count(*) AS d FROM t GROUP BY ALL), w AS (SELECT a.g, a.src, count(*) AS c FROM t a JOIN t b ON b.g = a.g AND b.src = a.src AND a.dst < b.dst JOIN t e ON e.g = a.g AND e.src = a.dst AND e.dst = b.dst GROUP BY ALL)
SELECT g, round(avg(CASE WHEN d > 1 THEN coalesce(c, 0) * 2 / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN w USING (g, src) GROUP BY 1""")
def graph_clustering(spark, sf):
    half = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("g"), (F.col("l_suppkey") % 7).alias("src"), (F.col("l_partkey") % 7).alias("dst")).filter("src <> dst")
    return rounded(G.clustering(half.union(half.select("g", "dst", "src")).distinct()))


@query("graph_spectrum")
def graph_spectrum(spark, sf):
    return G.spectral_features(edges(spark, sf), 5)


_TOKENS = "tokens AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents), vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token DESC) AS place FROM (SELECT token, count(DISTINCT doc_id) AS n FROM tokens WHERE token <> '' GROUP BY 1) ORDER BY n DESC, token DESC LIMIT 100)"


def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.filter(F.split(F.lower("text"), " "), lambda t: t != "").alias("tokens"))


@query("token_vocabulary", f"WITH {_TOKENS} SELECT token, n, place FROM vocab")
def token_vocabulary(spark, sf):
    return G.row_vocabulary(_tokens(spark, sf), 100)


@query("sort_and_slice", f"WITH {_TOKENS} SELECT doc_id, place, count(*) AS value FROM tokens JOIN vocab USING (token) GROUP BY ALL")
def sort_and_slice(spark, sf):
    t = _tokens(spark, sf)
    return G.sort_and_slice(t.select("doc_id", F.explode("tokens").alias("token")), G.row_vocabulary(t, 100))
