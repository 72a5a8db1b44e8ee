"""Groups dealt by runs of equal sizes, and average ranks by buckets, against row-by-row versions."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.operators import analytics as A
from lumenfold.operators import splits as S
from lumenfold.operators.ranks import with_sum_before

SIZES = st.lists(st.tuples(st.integers(1, 60), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda p: p[0]).map(lambda p: sorted(p, reverse=True))


def unrolled(pairs, turns):
    """What each group takes, one after another."""
    for (size, groups), runs in zip(pairs, turns, strict=True):
        assert [r[0] for r in runs] == [0, *(r[1] for r in runs[:-1])] and runs[-1][1] == groups
        for start, upto, names in runs:
            yield from ((size, names[i % len(names)]) for i in range(upto - start))


@given(SIZES, st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_folds_are_those_of_one_group_after_another(pairs, k):
    load = [0] * k
    for size, fold in unrolled(pairs, S.fold_turns(pairs, k)):
        assert fold == load.index(min(load))
        load[fold] += size


@given(SIZES, st.sampled_from([0.8, 0.5, 0.0]), st.sampled_from([0.1, 0.25, 0.0]))
@settings(max_examples=300, deadline=None)
def test_splits_are_those_of_one_group_after_another(pairs, train, validation):
    n = sum(a * b for a, b in pairs)
    held = {"train": 0, "validation": 0, "test": 0}
    for size, name in unrolled(pairs, S.split_turns(pairs, train, validation)):
        want = "train" if held["train"] + size <= n * train else "validation" if held["train"] + held["validation"] + size <= n * (train + validation) else "test"
        assert name == want
        held[name] += size


def test_many_groups_of_one_size(spark):
    """A hot group, a null group and 3,000 groups of one row: dealt by key among equals."""
    rows = [(i, None if i < 40 else "hot" if i < 2000 else f"g{i}") for i in range(5000)]
    d = spark.createDataFrame(rows, "id long, g string").repartition(7)
    got = {r["g"]: r["fold"] for r in S.group_folds(d, "g", 4).groupBy("g").agg(F.max("fold").alias("fold"), F.min("fold").alias("low")).filter("fold = low").collect()}
    order = ["hot", None, *sorted(g for _, g in rows[2000:])]
    load = [0] * 4
    for g in order:
        fold = load.index(min(load))
        assert got[g] == fold
        load[fold] += {"hot": 1960, None: 40}.get(g, 1)
    split = S.group_split(d, "g").groupBy("split").agg(F.count("*").alias("n")).collect()
    assert {r["split"]: r["n"] for r in split} == {"train": 4000, "validation": 500, "test": 500}


def test_repeats_differ_but_stay_whole(spark):
    d = spark.range(300).withColumn("g", (F.col("id") / 5).cast("long"))
    out = S.repeated_group_folds(d, "g", 3, 2)
    assert out.groupBy("repeat", "g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {(r["repeat"], r["fold"]): r["count"] for r in out.groupBy("repeat", "fold").count().collect()} == {(r, f): 100 for r in (0, 1) for f in (0, 1, 2)}
    moved = out.groupBy("id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count()
    assert moved > 50


def test_no_groups(spark):
    d = spark.createDataFrame([], "id long, g string, n string, place string")
    assert S.group_folds(d, "g").count() == 0 and S.group_split(d, "g").columns == ["id", "g", "n", "place", "split"]


def test_average_ranks_match_sorting(spark):
    """Ties, null, NaN and infinities, a hot group, names that clash."""
    rng = random.Random(3)
    values = [rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, *np.round(np.random.default_rng(1).normal(size=60), 1).tolist()]) for _ in range(900)]
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", v) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, "before long, n string, v double")
    got = {r["before"]: r["r"] for r in A.with_average_rank(d, "v", ["n"], "r").collect()}
    key = lambda v: (-1, 0.0) if v is None else (1, 0.0) if v != v else (0, v + 0.0)
    for i, g, v in rows:
        own = [key(x) for _, h, x in rows if h == g]
        assert got[i] == sum(x < key(v) for x in own) + (own.count(key(v)) + 1) / 2
    assert len(got) == len(rows)


def test_sums_before(spark):
    d = spark.range(5000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("w"))
    bad = with_sum_before(d, "v", "w", "s").filter(F.col("s") != F.expr("aggregate(sequence(0, v), 0L, (a, i) -> a + i % 7) - w")).count()
    assert bad == 0


def test_rank_tests_of_empty_tables(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert A.mann_whitney(d, "g", "v").count() == 0
    assert A.wilcoxon(spark.createDataFrame([], "k string, a double, b double"), ["k"], "a", "b").count() == 0
    one = A.binary_metrics(spark.createDataFrame([], "y int, p int, s double"), "y", "p", "s").first()
    assert one["tp"] == 0 and one["accuracy"] is None and one["auc"] is None
