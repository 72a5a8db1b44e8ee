"""Hand-worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import protein as P
from lumenfold.functions import sequence as S
from lumenfold.operators import analytics as A
from lumenfold.operators import curation as C
from lumenfold.operators import graphs as G
from lumenfold.operators import models as M
from lumenfold.operators import neighbors as N
from lumenfold.operators import noise as Z
from lumenfold.operators import selection as L
from lumenfold.operators import splits as SP
from lumenfold.streaming import curation as ST


def one(df):
    return df.first().asDict()


def strings(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, s string")


def test_curation_keeps_single_measurements_and_orders_assays(spark):
    d = spark.createDataFrame([("a", 10.0, "y"), ("a", 100.0, "x"), ("b", 5.0, "x"), ("c", 0.0, "x"), ("d", 1.0, "x"), ("d", 1e6, "x")], "c string, nm double, assay string")
    got = {r["c"]: r for r in C.curate(d, ["c"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["assays"] == "x,y" and math.isclose(got["a"]["nm_mean"], 10**1.5)
    assert got["b"]["spread"] == 0 and got["b"]["n"] == 1


def test_truthy_and_clipped(spark):
    d = spark.createDataFrame([("", 1.0), (None, 1.0), ("C", 0.0), ("C", float("nan")), ("C", float("inf"))], "s string, v double")
    assert d.filter(C.truthy("s", "v")).count() == 2
    assert [r[0] for r in d.select(C.clipped(F.col("v"))).collect()] == [1.0, 1.0, 0.0, 0.0, 1e10]
    assert [r[0] for r in d.select(C.finite_or_zero(F.col("v"))).collect()][-2:] == [0.0, 0.0]


def test_sequences(spark):
    d = strings(spark, "", "A", "AAAA", "GGCC", "ACGTN")
    got = [r.asDict() for r in S.complexity_features(d, "s").orderBy("id").collect()]
    assert got[0]["longest_run"] == 0 and got[1]["base_entropy"] == 0
    assert got[2]["longest_run"] == 4 and got[2]["linguistic"] == 0.5
    gc = [r.asDict() for r in S.gc_features(d, "s").orderBy("id").collect()]
    assert gc[0]["gc"] == 0 and gc[3]["gc"] == 1 and gc[3]["skew"] == 0 and gc[3]["gc_variance"] == 0
    assert [r[0] for r in strings(spark, "AAAA").select(S.count_of(F.col("s"), "AA")).collect()] == [2]
    assert one(strings(spark, "acgux").select(S.clean(F.col("s")).alias("x")))["x"] == "ACGTN"
    k = {r["kmer"]: r["value"] for r in S.kmer_counts(strings(spark, "ACNA"), "id", "s", 2).collect()}
    assert k == {"A": 0.5, "C": 0.25, "AC": 0.25}


def test_hybrid_dispatch(spark):
    d = S.hybrid_features(strings(spark, "ACGTACGT"), "id", "s", ("gc", "motifs"))
    assert d.columns == ["id", "gc", "motifs"] and len(d.first()["motifs"]) == len(S.MOTIFS)
    with pytest.raises(ValueError):
        S.hybrid_features(d, "id", "gc", ("nothing",))


def test_proteins(spark):
    d = P.isoelectric_point(strings(spark, "", "K", "D"), "s").orderBy("id").collect()
    assert d[0][-1] == 7.0 and d[1][-1] > 9 and d[2][-1] < 4
    got = one(P.developability(strings(spark, "NGSDGC"), "s"))
    assert got["deamidation"] == 1 and got["isomerization"] == 1 and got["odd_cysteines"] == 1
    with pytest.raises(Exception):
        strings(spark, "AXB").select(P.require_valid(F.col("s"))).collect()
    with pytest.raises(ValueError):
        P.humanness(d, "id", "s", "middle")


def test_robustness_of_a_known_line(spark):
    d = spark.createDataFrame([("m", s / 10, 0.8 - 0.05 * s, 0.1, 0.1) for s in range(0, 11, 2)], "m string, sigma double, r2 double, rmse double, mae double")
    r = one(A.robustness(d, ["m"]))
    assert math.isclose(r["nsi"], -0.5) and math.isclose(r["retention"], 62.5) and r["is_valid"]
    t = one(A.two_point_index(d, ["m"]))
    assert math.isclose(t["nsi"], 0.5) and math.isclose(t["auc"], 0.55)


def test_unbalanced_variance_decomposition(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", "y", 9.0)], "m string, r string, v double")
    got = {r["term"]: r for r in A.variance_decomposition(d, "m", "r", "v").collect()}
    assert math.isclose(got["m"]["ss"], 3 * 4 + 2 * 9) and math.isclose(sum(r["ss"] for r in got.values()), got["m"]["total"])


def test_calibration_needs_ten_rows(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0)] * 9 + [("b", 1.0, 1.0)] * 12, "g string, e double, u double")
    assert {r["g"]: r["ece"] for r in A.calibration_error(d, ["g"], "e", "u").collect()} == {"a": None, "b": 0.0}


def test_perfect_predictions_are_infinitely_efficient(spark):
    r = one(A.conformal(spark.createDataFrame([("a", 1.0, 1.0, 0.5)], "g string, y_true double, y_pred double, unc double"), ["g"], 0.1))
    assert r["efficiency"] == float("inf") and r["empirical"] == 1


@pytest.mark.parametrize("metric", N.METRICS)
def test_neighbors_agree_with_brute_force_over_several_blocks(spark, metric):
    x = np.random.default_rng(1).normal(size=(60, 5))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = {(r["id"], r["rank"]): r for r in N.neighbors(d, 3, metric, block_rows=25).collect()}
    both = d.toDF("id", "x").crossJoin(d.toDF("j", "y")).filter("id <> j").withColumn("d", N.distance(F.col("x"), F.col("y"), metric)).toPandas()
    for i, g in both.sort_values(["d", "j"]).groupby("id"):
        assert [got[i, k + 1]["neighbor"] for k in range(3)] == g["j"].tolist()[:3]


def test_neighbors_edge_cases(spark):
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, x array<double>")
    got = {(r["id"], r["neighbor"]): r["distance"] for r in N.neighbors(d, 9, "cosine").collect()}
    assert got[1, 2] == 1 and got[2, 3] == 0 and len(got) == 6
    assert N.neighbors(d.filter("id < 0"), 2).count() == 0
    with pytest.raises(ValueError):
        N.neighbors(d, 1, "nothing")


def test_graphs(spark):
    def graph(g, pairs):
        return [(g, a, b) for x, y in pairs for a, b in ((x, y), (y, x))]

    e = spark.createDataFrame(graph(1, [(0, 1), (1, 2), (0, 2)]) + graph(2, [(0, 1), (2, 3)]), "g long, src long, dst long")
    assert {r["g"]: r["clustering"] for r in G.clustering(e).collect()} == {1: 1.0, 2: 0.0}
    h = G.hop_distances(e)
    assert {r["g"]: r["components"] for r in G.component_counts(h).collect()} == {1: 1, 2: 2}
    p = {r["g"]: r for r in G.path_features(h, G.degree_features(e).select("g", "nodes")).collect()}
    assert p[1]["diameter"] == 1 and p[2]["diameter"] == -1 and p[1]["wiener"] == 3
    s = {r["g"]: r["eigenvalues"] for r in G.spectral_features(e, 4).collect()}
    assert np.allclose(s[1], [0, 1.5, 1.5, 0]) and np.allclose(s[2], [0, 0, 2, 2])


def test_splits(spark):
    d = spark.createDataFrame([(i, "g" if i < 50 else f"h{i % 7}") for i in range(100)], "id long, grp string")
    assert {r["split"]: r["count"] for r in SP.random_split(d, "id").groupBy("split").count().collect()} == {"train": 80, "validation": 10, "test": 10}
    for out, part in ((SP.group_split(d, "grp"), "split"), (SP.group_folds(d, "grp", 3), "fold")):
        assert out.count() == 100 and out.groupBy("grp").agg(F.count_distinct(part).alias("n")).filter("n > 1").count() == 0
    load = sorted(r["count"] for r in SP.group_folds(d, "grp", 3).groupBy("fold").count().collect())
    assert load[-1] == 50 and load[0] >= 21
    with pytest.raises(Exception):
        SP.internal_validation(spark.range(2), "id", 0.5).collect()
    assert {r["split"] for r in SP.hashed_fraction(d, "id", {"a": 0.5, "b": 0.5}).collect()} == {"a", "b"}


def test_allocation(spark):
    s = spark.createDataFrame([("a", 0.9, 5), ("b", 0.1, 50), ("c", -1.0, 50)], "rep string, score double, width long")
    assert {r["rep"]: r["n"] for r in L.allocate(s, 20).collect()} == {"a": 5, "b": 15, "c": 0}
    with pytest.raises(Exception):
        L.allocate(s.withColumn("score", F.lit(0.0)), 20).collect()


def test_selection_helpers(spark):
    x = np.random.default_rng(0).normal(size=(200, 4))
    x[:, 3] = x[:, 0] + 0.01 * x[:, 3]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    v = L.variance_inflation(d, "x")
    assert v[0] > 100 and v[1] < 1.2
    assert L.effective_dimensions(d, "x", (0.7, 0.999)) == {0.7: 2, 0.999: 3}
    c = np.abs(L.correlation_matrix(d, "x"))
    assert L.greedy_diversity(np.array([1, 0.2, 0.3, 0.99]), c, 2, 1.0) == [0, 2]
    assert L.greedy_relevance(np.array([1, 0.2, 0.3, 0.99]), c, 2) == [0, 2]


def test_noise_unknown_names(spark):
    d = spark.createDataFrame([(1, 1.0, 0.5, 2.0)], "id long, y double, score double, target double")
    for call in (lambda: Z.weights(d, method="x"), lambda: Z.smooth(d, method="x"), lambda: Z.estimate(d, d, "x")):
        with pytest.raises(ValueError):
            call()
    assert one(Z.weights(d))["weight"] == 1.0


def test_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4))
    y = 3 * x[:, 1] + 0.1 * rng.normal(size=150)
    d = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").cache()
    assert int(np.argmax(M.forest_importance(d, 10, 5))) == 1
    assert int(np.argmax(M.boosted_importance(d, 3))) == 1
    p = M.permutation_importance(d, [0, 1], 1)
    assert p[1] > 0.5 > p[0]
    assert M.ensemble_scores(d, 2).count() == 150
    scores = d.select("id", F.when(F.col("id") < 15, 10.0).otherwise(F.col("id") / 1000).alias("score"))
    assert {r["id"] for r in M.mixture_noise(scores).filter("is_noise").collect()} == set(range(15))


def test_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    ST.run_available(ST.windowed_potency(ST.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in ST.windowed_potency(e).collect()}
    assert got and got.items() <= want.items()  # windows that the watermark hasn't passed aren't out yet


def test_nearest_tanimoto_takes_whole_texts_and_all_documents(spark, tmp_path):
    rng = np.random.default_rng(6)
    same = "the same first letters of every text, which are more than sixty-one: "
    rows = [(i, same + " ".join(rng.choice(["abc", "Déjà", "漢字x", "noise", "q", "zz top"], 12))) for i in range(190, 260)] + [(300, ""), (301, None), (302, "ab")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in ((i, (t or "").lower()) for i, t in rows)}
    want = lambda m: {i: round(max(len(a & b) / max(1, len(a | b)) for j, b in sets.items() if j % m), 6) for i, a in sets.items() if i % m == 0}
    from lumenfold.plans import neighbors as plans

    assert {r["doc_id"]: r["best"] for r in plans.nearest_tanimoto(spark, str(tmp_path)).collect()} == want(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.lower("text").alias("text"))
    small = N.nearest_grams(docs.filter("doc_id % 5 = 0"), docs.filter("doc_id % 5 <> 0"), "doc_id", block_rows=7)
    assert {r["doc_id"]: round(r["best"], 6) for r in small.collect()} == want(5)


def test_string_queries_read_whole_texts(spark, tmp_path):
    import hashlib
    import re

    from lumenfold.functions import residues as R
    from lumenfold.plans import strings as plans

    rng = np.random.default_rng(8)
    texts = ["", "IVL", "acgU-x 1", "".join(rng.choice([*P.LETTERS, " ", "b", "u"], 3_000)), "G" * 500 + "ng c IIIIIII" + "k" * 90]
    strings(spark, *texts).toDF("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    cleaned = [re.sub("[^ACGT]", "N", re.sub("[^a-zA-Z]", "", t).upper().replace("U", "T")) for t in texts]
    assert [tuple(r) for r in plans.clean_sequences(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(i, len(c), hashlib.md5(c.encode()).hexdigest()) for i, c in enumerate(cleaned)]
    for r, text in zip(plans.developability(spark, str(tmp_path)).orderBy("doc_id").collect(), texts, strict=True):
        s = "".join(c for c in text.upper() if c in R.RESIDUES)
        v = np.array([R.RESIDUES[c] for c in s]).reshape(-1, 6)
        h = v[:, 0]
        stretch = max(h[i : i + 7].mean() for i in range(len(h) - 6)) if len(h) >= 7 else h.mean() if len(h) else 0
        want = [v[:, 1].sum(), h.mean() if s else 0, h.std() if s else 0, stretch, (h > 1.5).mean() if s else 0, (v[:, 2].sum() - max(0, len(s) - 1) * R.WATER) / 1000]
        want += [sum(s.count(m) for m in ms) for ms in (R.DEAMIDATION, R.ISOMERIZATION, R.OXIDATION)] + [len(re.findall(R.SEQUON, s)), s.count("C") % 2]
        assert np.allclose([*r][1:], want, rtol=1e-9, atol=6e-6), (r, want)
