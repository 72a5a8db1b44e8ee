"""Representations compared, property data sets, quartile splits of the remainder, counting within radii."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.operators import curation as C
from lumenfold.operators import evaluation as E
from lumenfold.operators import experiments as X
from lumenfold.operators import neighbors as N
from lumenfold.operators import selection as S
from lumenfold.operators import splits as SP
from lumenfold.operators.information import nearer
from lumenfold.sources import readers as R


def test_representations_are_ranked_by_test_score(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(size=(120, 3)), rng.normal(size=(120, 2))
    y = x @ [1.0, -2.0, 0.5] + 0.1 * rng.normal(size=120)
    d = spark.createDataFrame([(i, x[i].tolist(), noise[i].tolist(), float(y[i])) for i in range(120)], "id long, good array<double>, bad array<double>, y double")
    rows = {r["rep"]: r for r in X.evaluate_representations(d, ["bad", "good"], F.col("id") < 90, 3).collect()}
    assert rows["good"]["rank"] == 1 and rows["bad"]["rank"] == 2 and rows["good"]["n_features"] == 3

    def ridge(a, b):
        m, s = x[a].mean(0), x[a].std(0, ddof=1)
        z, w = (x[a] - m) / s, (x[b] - m) / s
        c = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[a] - y[a].mean()))
        return w @ c + y[a].mean()

    score = lambda p, b: 1 - ((y[b] - p) ** 2).sum() / ((y[b] - y[b].mean()) ** 2).sum()
    own, other = np.arange(90), np.arange(90, 120)
    p = ridge(own, other)
    folds = [score(ridge(np.setdiff1d(own, f), f), f) for f in np.split(own, 3)]
    r = rows["good"]
    want = [score(ridge(own, own), own), score(p, other), np.sqrt(np.mean((p - y[other]) ** 2)), np.mean(np.abs(p - y[other])), np.mean(folds), np.std(folds)]
    assert np.allclose([r[c] for c in ("r2_train", "r2_test", "rmse_test", "mae_test", "cv_mean", "cv_std")], want, atol=1e-4)


def test_report_of_constant_labels(spark):
    d = spark.createDataFrame([("a", s, 0, 1.0, 2.0) for s in ("train", "test")] + [("b", "test", 0, v, v) for v in (1.0, 2.0)], "rep string, split string, fold int, y_true double, y_pred double")
    rows = {r["rep"]: r for r in E.representation_report(d, d.filter("split = 'train'")).collect()}
    assert rows["a"]["r2_test"] is None and rows["a"]["rank"] == 2 and rows["b"]["r2_test"] == 1.0 and rows["b"]["cv_mean"] is None


def test_property_dataset(spark):
    d = spark.createDataFrame([("a", 2, "3.5", 1.0), ("a", 1, None, 2.0), ("a", 3, "9", 3.0), ("b", 1, "n/a", 4.0), ("c", 1, "1.5", 5.0), (None, 1, "2.5", 6.0)], "k string, place int, p string, q double")
    got = {r["k"]: r["y"] for r in C.property_dataset(d, ["k"], ["p", "q"], "p", [F.col("place")]).collect()}
    assert got == {"a": 3.5, "c": 1.5, None: 2.5}
    with pytest.raises(ValueError, match="unknown property"):
        C.property_dataset(d, ["k"], ["p"], "r", [F.col("place")])
    assert C.property_dataset(d.limit(0), ["k"], ["p"], "p", [F.col("place")]).count() == 0


def test_quartiles_of_the_remainder(spark):
    d = spark.createDataFrame([(i, float(i * i % 101)) for i in range(400)] + [(1000, None)], "id long, v double")
    out = SP.quartile_split(d, "id", "v", 0.1, 0.1)
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 401 and 36 <= n["test"] <= 40 and 36 <= n["validation"] <= 40
    means = [r["m"] for r in out.groupBy("split").agg(F.avg("v").alias("m")).collect()]
    assert max(means) - min(means) < 8


NUMBERS = st.lists(st.one_of(st.floats(-3, 3), st.sampled_from([0.0, 0.1, 0.2, 0.30000000000000004, 1.1])), min_size=1, max_size=30)


@given(NUMBERS, NUMBERS, st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.30000000000000004, 1e-9, 1.0]), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_counts_within_radii_are_those_of_differences(held, own, radii):
    s, v = np.sort(held), np.array(own)
    r = np.resize(radii, len(v))
    assert nearer(s, v, r).tolist() == [(np.abs(s - a) < b).sum() for a, b in zip(v, r, strict=True)]


def test_nearest_among_all_others(spark):
    rows = [(i, t) for i, t in enumerate(["abcdef", "abcdeg", "zzzz", "abcdef", "", None])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {(t or "")[k : k + 3] for k in range(len(t or "") - 2)} for i, t in rows}
    want = {i: max(len(a & b) / max(1, len(a | b)) for j, b in sets.items() if j != i) for i, a in sets.items()}
    for block_rows in (2, 100):
        assert {r["doc_id"]: r["best"] for r in N.nearest_grams(d, d, "doc_id", block_rows=block_rows).collect()} == pytest.approx(want)
    assert N.nearest_grams(d.limit(1), d.limit(1), "doc_id").count() == 0


def test_a_header_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "s.fasta").write_bytes(b">one|a>b|Heavy\r\nEV\r\nQ\r\n>two|L|Light\nD>Q\n>three")
    got = sorted(tuple(r) for r in R.load(spark, "fasta", str(tmp_path / "s.fasta")).collect())
    assert got == [("one", "a>b", "Heavy", "EVQ"), ("three", "", "", ""), ("two", "L", "Light", "D>Q")]


def test_allocation_takes_back_from_the_worst(spark):
    s = spark.createDataFrame([("a", 0.5, 9), ("b", 0.5, 9), ("c", 0.5, 9), ("d", 0.5, 9)], "rep string, score double, width long")
    assert {r["rep"]: r["n"] for r in S.allocate(s, 3).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}
