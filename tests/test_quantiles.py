"""Quantiles by refined brackets equal sorted ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.quantiles import quantiles, with_quantile


@pytest.mark.parametrize("few,accuracy", [(50_000, 10_000), (10, 100), (3, 20)])
def test_against_numpy(spark, few, accuracy):
    rng = np.random.default_rng(few)
    groups = {None: rng.normal(size=300), "ties": rng.integers(0, 3, 500).astype(float), "one": np.full(200, 7.0), "wide": np.exp(rng.normal(size=700) * 20) * rng.choice([-1, 1], 700), "single": np.array([5.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.905, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(d, "v", shares, ["g"], few=few, accuracy=accuracy).collect()}
    assert got.pop("none") is None and set(got) == set(groups)
    for g, q in got.items():
        assert np.allclose(q, np.quantile(groups[g], shares), rtol=1e-12)
    whole = quantiles(d, F.col("v") * 2, [0.3], few=few, accuracy=accuracy).collect()
    assert np.isclose(whole[0]["q"][0], 2 * np.quantile(np.concatenate(list(groups.values())), 0.3)) and len(whole) == 1


def test_empty_and_column(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert quantiles(d, "v", [0.5]).first()["q"] is None and quantiles(d, "v", [0.5], ["g"]).count() == 0
    r = with_quantile(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double"), "c", "v", 0.75).collect()
    assert [x["c"] for x in r] == [3.0] * 3
