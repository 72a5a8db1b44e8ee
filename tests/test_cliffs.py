"""Activity cliffs against all pairs, by blocks that meet once."""

import numpy as np
import pytest

from lumenfold.operators import cliffs as C
from lumenfold.operators import tiles


@pytest.mark.parametrize("kind", ["spread", "copies"])
def test_cliffs_against_all_pairs(spark, kind):
    rng = np.random.default_rng(4)
    n = 420
    x = rng.normal(size=(n, 6))
    y = np.round(rng.normal(size=n), 2)
    if kind == "copies":
        x[50:250], x[300:350] = x[0], x[260:310]
    m = np.array([tiles.apart(np.broadcast_to(r, x.shape), x, "euclidean") for r in x])
    gap = np.abs(y[:, None] - y[None, :])
    near, wide = np.quantile(m[np.triu_indices(n, 1)], 0.3), np.quantile(gap, 0.8)
    want = ((m < near) & (gap > wide)).sum(axis=1)
    d = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "_id long, _x array<double>, _y double")
    got = {r["_id"]: r["n"] for r in C.activity_cliffs(d, 0.3, 0.8, block_rows=150, few=40).collect()}
    assert got == {i: int(t) for i, t in enumerate(want) if t}
