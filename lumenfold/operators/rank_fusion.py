"""Fusion of feature scores of several methods, over a long table (method, idx, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalized(s: DataFrame) -> DataFrame:
    """Adds ``norm``: min-max per method, 1 / n where a method's scores are all equal."""
    w = Window.partitionBy("method")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return s.withColumn("norm", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1 / F.count(F.lit(1)).over(w)))


def ranked(s: DataFrame) -> DataFrame:
    """Adds ``rank`` (0 is best) and ``ascending`` (0 is worst); ties by idx."""
    best = Window.partitionBy("method").orderBy(F.desc("score"), "idx")
    worst = Window.partitionBy("method").orderBy("score", F.desc("idx"))
    return s.withColumns({"rank": F.row_number().over(best) - 1, "ascending": F.row_number().over(worst) - 1})


def fuse(s: DataFrame, how: str, **options: float) -> DataFrame:
    """(idx, fused) by one of the methods of ``FUSIONS``."""
    if how not in FUSIONS:
        raise ValueError(f"unknown fusion {how!r}; known: {sorted(FUSIONS)}")
    return FUSIONS[how](s, **options)


def _by_idx(s: DataFrame, e) -> DataFrame:  # noqa: ANN001
    return s.groupBy("idx").agg(e.alias("fused"))


def _trimmed(s: DataFrame, share: float = 0.2) -> DataFrame:
    n = normalized(s)
    w = Window.partitionBy("idx").orderBy("norm", "method")
    n = n.withColumns({"_k": F.row_number().over(w), "_m": F.count(F.lit(1)).over(Window.partitionBy("idx"))})
    cut = F.floor(F.col("_m") * share)
    return _by_idx(n.filter((F.col("_k") > cut) & (F.col("_k") <= F.col("_m") - cut)), F.avg("norm"))


def _voting(s: DataFrame, top: int = 100, min_votes: int = 2) -> DataFrame:
    votes = F.count_if(F.col("rank") < top)
    return _by_idx(ranked(s), F.when(votes >= min_votes, votes).otherwise(0))


def _weighted(s: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    pairs = [F.lit(x) for kv in (weights or {}).items() for x in kv]
    w = F.coalesce(F.element_at(F.create_map(*pairs), F.col("method")), F.lit(1.0)) if pairs else F.lit(1.0)
    return _by_idx(normalized(s), F.sum(F.col("norm") * w) / F.sum(w))


def _stability(s: DataFrame, disagreement: bool) -> DataFrame:
    g = normalized(s).groupBy("idx").agg(F.avg("norm").alias("_m"), F.stddev_pop("norm").alias("_s"))
    top = F.max("_s").over(Window.partitionBy())
    d = F.when(top > 0, F.col("_s") / top).otherwise(0.0)
    return g.withColumn("disagreement", d).select("idx", (F.col("_m") * (1 - 0.5 * F.col("disagreement"))).alias("fused"), *(["disagreement"] if disagreement else []))


FUSIONS = {
    "average": lambda s: _by_idx(normalized(s), F.avg("norm")),
    "reciprocal_rank": lambda s, k=60: _by_idx(ranked(s), F.sum(1 / (k + F.col("rank") + 1))),
    "borda": lambda s: _by_idx(ranked(s), F.sum("ascending")),
    "voting": _voting,
    "weighted": _weighted,
    "median_rank": lambda s: _by_idx(ranked(s), -F.median("rank")),
    "geometric": lambda s: _by_idx(normalized(s), F.exp(F.avg(F.log(F.col("norm") + 1e-10)))),
    "trimmed": _trimmed,
    "rank_product": lambda s: _by_idx(ranked(s), -F.sum(F.log(F.col("rank") + 1))),
    "stable": lambda s: _stability(s, False),
    "disagreement": lambda s: _stability(s, True),
}


def mean_and_deviation(s: DataFrame) -> DataFrame:
    return s.groupBy("idx").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def agreement(s: DataFrame, top: int = 10) -> DataFrame:
    """Per pair of methods: rank correlation, Jaccard and overlap of their top sets.

    Average ranks are taken within the rows (a method has one for each feature), not joined by score:
    scores that are themselves sums come out in other last digits each time a cluster adds them up.
    """
    tied = F.count(F.lit(1)).over(Window.partitionBy("method", "score"))
    r = ranked(s.withColumn("_r", F.rank().over(Window.partitionBy("method").orderBy("score")) + (tied - 1) / 2))
    a, b = r.select(F.col("method").alias("m1"), "idx", F.col("_r").alias("r1"), F.col("rank").alias("k1")), r.select(F.col("method").alias("m2"), "idx", F.col("_r").alias("r2"), F.col("rank").alias("k2"))
    both = F.count_if((F.col("k1") < top) & (F.col("k2") < top))
    either = F.count_if((F.col("k1") < top) | (F.col("k2") < top))
    return a.join(b, "idx").filter("m1 < m2").groupBy("m1", "m2").agg(F.corr("r1", "r2").alias("spearman"), (both / either).alias("jaccard"), (both / top).alias("overlap"))


def kendall(s: DataFrame) -> DataFrame:
    """tau-b of every pair of methods, over all pairs of features (a matrix of features, so small by nature)."""
    a = s.select("method", F.col("idx").alias("i"), F.col("score").alias("si"))
    p = a.join(s.select("method", F.col("idx").alias("j"), F.col("score").alias("sj")), "method").filter("i < j").select("method", "i", "j", F.signum(F.col("si") - F.col("sj")).alias("d"))
    q = p.select(F.col("method").alias("m1"), "i", "j", F.col("d").alias("d1")).join(p.select(F.col("method").alias("m2"), "i", "j", F.col("d").alias("d2")), ["i", "j"]).filter("m1 < m2")
    return q.groupBy("m1", "m2").agg((F.sum(F.col("d1") * F.col("d2")) / F.sqrt(F.sum(F.abs("d1")) * F.sum(F.abs("d2")))).alias("tau"))
