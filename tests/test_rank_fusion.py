"""Agreement of scores that are computed anew for each side of a join."""

import time

from lumenfold.operators import rank_fusion as R


def test_agreement_of_scores_whose_last_digits_change(spark):
    def unsteady(frames):  # as a sum on a cluster
        for pdf in frames:
            yield pdf.assign(score=pdf["score"] * (1 + (time.time_ns() // 1_000 % 10_007) * 1e-15))

    rows = [(m, i, float((i * 7 + k * 3) % 12 + 1)) for k, m in enumerate("abc") for i in range(12)]
    steady = spark.createDataFrame(rows, "method string, idx long, score double")
    want = {(r["m1"], r["m2"]): r for r in R.agreement(steady, top=4).collect()}
    got = {(r["m1"], r["m2"]): r for r in R.agreement(steady.mapInPandas(unsteady, steady.schema), top=4).collect()}
    assert got.keys() == want.keys() == {("a", "b"), ("a", "c"), ("b", "c")}
    for pair, r in want.items():
        assert abs(got[pair]["spearman"] - r["spearman"]) < 1e-12 and got[pair]["jaccard"] == r["jaccard"] and got[pair]["overlap"] == r["overlap"]


def test_ties_share_the_mean_of_their_places(spark):
    rows = [("a", i, s) for i, s in enumerate([1.0, 1.0, 2.0, 3.0])] + [("b", i, s) for i, s in enumerate([1.0, 2.0, 3.0, 4.0])]
    got = R.agreement(spark.createDataFrame(rows, "method string, idx long, score double"), top=2).first()
    assert abs(got["spearman"] - 4.5 / (4.5 * 5) ** 0.5) < 1e-12  # places 1.5, 1.5, 3, 4
