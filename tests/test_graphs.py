"""Refinement by joins equals refinement in rows; distances of the largest component against breadth-first search."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import graphs as G
from lumenfold.operators import splits as S


def both_ways(spark, links):
    return spark.createDataFrame([(g, a, b) for g, x, y in links for a, b in ((x, y), (y, x))], "g long, src long, dst long").distinct()


@pytest.fixture(scope="module")
def links():
    rng = random.Random(5)
    return sorted({(g, *sorted(rng.sample(range(14), 2))) for g in range(12) for _ in range(3 + g)})


def test_large_graphs_refine_by_joins(spark, links):
    e = both_ways(spark, links)
    labels = e.select("g", F.col("src").alias("node")).union(spark.createDataFrame([(0, 99), (50, 1)], "g long, node long")).distinct().withColumn("label", (F.col("node") % 3).cast("string"))
    whole = sorted(tuple(r) for r in G.refinement_histogram(e, labels, 3).collect())
    for most in (0, 20):
        assert sorted(tuple(r) for r in G.refinement_histogram(e, labels, 3, most).collect()) == whole
    assert {r[0] for r in whole} == {*range(12), 50}


def test_vocabulary_of_training_graphs(spark):
    d = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 5)], "g long, label string, n long")
    places = G.label_places(d.filter("g = 1"))
    assert sorted(tuple(r) for r in places.select("label", "place").collect()) == [("a", 0), ("b", 1)]
    test = spark.createDataFrame([(3, "b", 4), (3, "unseen", 9)], "g long, label string, n long")
    assert [tuple(r) for r in G.placed_counts(test, places).collect()] == [(3, 1, 4)]


def test_distances_of_the_largest_component(spark, links):
    got = {r["g"]: r for r in G.distance_features(G.hop_distances(both_ways(spark, links))).collect()}
    for g in {x[0] for x in links}:
        near = {}
        for h, a, b in links:
            if h == g:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        far = {}
        for start in near:
            seen, queue = {start: 0}, deque([start])
            while queue:
                v = queue.popleft()
                for u in near[v] - seen.keys():
                    seen[u] = seen[v] + 1
                    queue.append(u)
            far[start] = seen
        main = max(sorted(near), key=lambda v: len(far[v]))
        inside = far[main].keys()
        paths = [far[a][b] for a in inside for b in inside if a < b]
        ecc = [max(far[a].values()) for a in inside]
        r = got[g]
        assert (r["nodes"], r["path_max"], r["wiener"], r["periphery"], r["center"]) == (len(inside), max(paths), sum(paths), ecc.count(max(ecc)), ecc.count(min(ecc)))
        assert np.allclose([r["path_mean"], r["path_std"], r["ecc_mean"], r["ecc_std"]], [np.mean(paths), np.std(paths), np.mean(ecc), np.std(ecc)])


def test_no_graphs(spark):
    e = spark.createDataFrame([], "g long, src long, dst long")
    assert G.distance_features(G.hop_distances(e)).count() == 0
    assert G.refinement_histogram(e, spark.createDataFrame([], "g long, node long, label string")).count() == 0


def test_group_ids(spark):
    d = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "n long, g string")
    assert {r["n"]: r["group_id"] for r in S.group_ids(d, "g").collect()} == {1: 2, 2: 0, 3: 1, 4: 2}
