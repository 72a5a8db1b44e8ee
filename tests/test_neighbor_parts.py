"""The neighbour and radius joins by parts around pivots: exact against all pairs, and few rows move where rows cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import neighbors as N
from lumenfold.operators import tiles


def clustered(n, dims, centres, seed=0, zeros=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 10 + rng.normal(size=(n, dims)) * 0.3
    x[: n // 10] = x[0]  # copies
    x[n // 10 : n // 10 + zeros] = 0
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("metric", [m for m in N.METRICS if m != "braycurtis"])
def test_neighbors_against_all_pairs(spark, metric):
    x = clustered(240, 5, 6, zeros=9 if metric in N.ANGLES else 0)
    if metric == "correlation":
        x[40] = 3.0  # constant: at a right angle to all
    m = N._matrix(x, x, metric)
    np.fill_diagonal(m, np.inf)
    got = {}
    for r in N.neighbors(frame(spark, x), 4, metric, block_rows=15).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbor"], r["distance"]))
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), m[i]))[:4]
        mine = sorted(got[i])
        assert np.allclose([d for _, _, d in mine], m[i][order], atol=1e-9)
        if metric not in N.ANGLES:  # their ties hang on rounding
            assert [n for _, n, _ in mine] == order.tolist()


def test_few_rows_move_where_rows_cluster(spark):
    x = clustered(3_000, 8, 30, seed=4)
    d = frame(spark, x).select(F.col("id").alias("_id"), F.col("x").alias("_x"))
    blocks = 3_000 // 100
    asking, _, held = N.routed(d, 5, "euclidean", 100)
    own = held.groupBy("_part").count().selectExpr("sum(count * ceil(count / 100))").first()[0]
    assert held.count() == 3_000
    assert asking.count() + own < 3_000 * blocks / 4


def test_fewer_rows_than_neighbors(spark):
    got = N.neighbors(frame(spark, np.arange(6.0).reshape(3, 2)), 5, block_rows=1).collect()
    assert sorted((r["id"], r["rank"], r["neighbor"]) for r in got) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)]
    assert N.neighbors(frame(spark, np.arange(2.0).reshape(1, 2)), 5).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "braycurtis"])
def test_radius_join_against_all_pairs(spark, metric):
    x = np.abs(clustered(200, 4, 5, seed=2))
    radius = {"euclidean": 0.6, "cosine": 0.001, "braycurtis": 0.02}[metric]
    m = N._matrix(x, x, metric)
    np.fill_diagonal(m, np.inf)
    d = frame(spark, x).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    group = np.arange(200) % 3
    want = {(i, j) for i, j in zip(*np.nonzero(m < radius)) if group[i] == group[j]}
    got = N.pairs_within(d, radius, metric, groups=["g"], block_rows=12).collect()
    found = {(r["id"], r["neighbor"]) for r in got}
    if metric == "braycurtis":  # there blocks meet by equal groups, which nulls aren't
        want = {(i, j) for i, j in want if group[i]}
    assert found == want and len(got) == len(found)


def spread(n, dims, seed=1):
    """Directions that don't cluster; some rows are copies."""
    x = np.random.default_rng(seed).normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + 40] = x[:40]
    return x


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "braycurtis"])
def test_all_rows_stream_past_blocks(spark, metric):
    x = spread(700, 24)
    m = N._matrix(x, x, metric)
    if metric == "cosine":
        m = np.array([tiles.apart(np.broadcast_to(r, x.shape), x, metric) for r in x])
    np.fill_diagonal(m, np.inf)
    d = frame(spark, x)
    rows = d.select(F.col("id").alias("_id"), F.col("x").alias("_x"))
    assert N.open_share(rows, N.choose_pivots(rows, "euclidean", 700, 60), "euclidean", 6) > N.OPEN_SHARE
    got = {(r["id"], r["rank"]): (r["neighbor"], r["distance"]) for r in N.neighbors(d, 6, metric, block_rows=60, asking_rows=90).collect()}
    assert len(got) == 700 * 6
    for i in range(700):
        order = np.lexsort((np.arange(700), m[i]))[:6]
        assert [got[i, k][0] for k in range(1, 7)] == order.tolist()
        assert np.allclose([got[i, k][1] for k in range(1, 7)], m[i][order], atol=1e-12)


def test_radius_join_streams_within_groups(spark):
    x = spread(600, 24, seed=3)
    d = frame(spark, x).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    m = N._matrix(x, x, "euclidean")
    np.fill_diagonal(m, np.inf)
    group = np.arange(600) % 3
    want = set()
    for i in range(600):
        near = np.flatnonzero((m[i] < 1.35) & (group == group[i]))
        want |= {(i, int(j)) for j in near[np.lexsort((near, m[i][near]))][:7]}
    got = N.pairs_within(d, 1.35, groups=["g"], limit=7, block_rows=50, asking_rows=40).collect()
    assert {(r["id"], r["neighbor"]) for r in got} == want and len(got) == len(want)
    assert all((r["g"] or 0) == r["id"] % 3 for r in got)


@pytest.mark.parametrize("kind", ["offset", "outlier", "copies", "odd"])
def test_tiles_are_exact(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 7))
    if kind == "offset":
        x = x * 1e-3 + 1000
    elif kind == "outlier":
        x[5] *= 1e9
    elif kind == "copies":
        x[:400], x[500:560] = x[0], 0
    else:
        x[3, 2], x[4, 1] = np.nan, np.inf
        x[9] *= 1e200
    ids = rng.permutation(900) * 3
    for metric in ("euclidean", "cosine"):
        best = N.Best(ids, x, 5, metric)
        for s in range(0, 900, 250):
            best.see(ids[s : s + 250], x[s : s + 250])
        with np.errstate(all="ignore"):
            m = np.array([tiles.apart(np.broadcast_to(r, x.shape), x, metric) for r in x])
        m[~np.isfinite(m)] = np.inf
        np.fill_diagonal(m, np.inf)
        for i in range(900):
            order = np.lexsort((ids, m[i]))[:5]
            seen = np.isfinite(m[i][order])
            assert best.who[i][np.isfinite(best.far[i])].tolist() == ids[order][seen].tolist()


def test_registry_flags_search_once(spark, monkeypatch):
    from lumenfold.plans import modeling

    asked = []
    monkeypatch.setattr(N, "neighbors", lambda df, k, *a, f=N.neighbors: asked.append(k) or f(df, k, *a))
    assert modeling.noise_registry_flags(spark, "/root/testdata/sf0.001").count() == 4
    assert asked == [20]
