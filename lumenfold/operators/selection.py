"""Feature selection and fusion over several representations.

Features stay in long form, (rep, pos, ...), so that filters, ranks and budgets are aggregations and
joins; arrays are sliced only when a selection is applied. What reaches the driver is one row per
representation or per feature of a matrix small enough to invert.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Zero share above which, and variance up to which, a feature goes; None keeps all.
FILTERS: dict[str, tuple[float | None, float | None]] = {"none": (None, None), "quality_only": (0.95, 0.01), "quality_strict": (0.90, 0.05)}


def long_form(df: DataFrame, key: str, vectors: list[str]) -> DataFrame:
    """(key, rep, pos, value), one row per component."""
    return df.select(key, F.explode(F.create_map(*(x for v in vectors for x in (F.lit(v), F.col(v))))).alias("rep", "_v")).select(key, "rep", F.posexplode("_v").alias("pos", "value"))


def feature_statistics(long: DataFrame) -> DataFrame:
    """Per (rep, pos): mean, population variance, share of zeros."""
    return long.groupBy("rep", "pos").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.avg((F.col("value") == 0).cast("double")).alias("zeros"))


def quality_filter(long: DataFrame, sparsity: float | None = 0.95, variance: float | None = 0.01) -> DataFrame:
    """The (rep, pos) that are neither too sparse nor too constant."""
    s = feature_statistics(long)
    if sparsity is not None:
        s = s.filter(F.col("zeros") <= sparsity)
    if variance is not None:
        s = s.filter(F.col("variance") > variance)
    return s.select("rep", "pos")


def vector_statistics(df: DataFrame, rep: str) -> list[tuple[float, float, float]]:
    """(mean, population variance, share of zeros) of each component, in one pass over the rows; nothing is exploded."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(rep).cast("array<double>"))
    s = df.agg(Summarizer.metrics("count", "mean", "variance", "numNonZeros").summary(v).alias("s")).first()["s"]
    n = s["count"]
    return [(float(m), float(u) * (n - 1) / n, 1 - float(k) / n) for m, u, k in zip(s["mean"], s["variance"], s["numNonZeros"], strict=True)]


def vector_quality(df: DataFrame, rep: str, sparsity: float | None = 0.95, variance: float | None = 0.01) -> set[int]:
    """``quality_filter`` of one array column: the places that are neither too sparse nor too constant."""
    found = vector_statistics(df, rep)
    return {i for i, (_, v, z) in enumerate(found) if (sparsity is None or z <= sparsity) and (variance is None or v > variance)}


def vector_correlations(df: DataFrame, rep: str, y: str) -> list[float]:
    """|correlation| of each component with the label, 0 for constant ones: two passes that sum an array, with neither explode nor join."""
    from lumenfold.operators.information import scatter

    d = df.select(F.concat(F.col(rep).cast("array<double>"), F.array(F.col(y).cast("double"))).alias("x"))
    found = vector_statistics(d, "x")
    mean, spread = np.array([m for m, _, _ in found]), np.sqrt([v for _, v, _ in found])
    label = np.zeros((len(mean), 1))
    label[-1] = 1
    together = scatter(d, mean, np.ones(len(mean)), label)[:-1, 0] / df.count()
    size = spread[:-1] * spread[-1]
    return [float(abs(c) / s) if s > 0 else 0.0 for c, s in zip(together, size, strict=True)]


def apply_filter(long: DataFrame, kept: DataFrame) -> DataFrame:
    """Fitted on training rows, applied to any rows."""
    return long.join(kept, ["rep", "pos"], "left_semi")


def top_features(scores: DataFrame, n: int, groups: list[str] | None = None) -> DataFrame:
    """The n features with the largest scores per group; ties to the larger position."""
    w = Window.partitionBy(*(groups or ["rep"])).orderBy(F.desc("score"), F.desc("pos"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def two_stage(screen: DataFrame, scores: DataFrame, budget: int, factor: int = 3) -> DataFrame:
    """(rep, pos, score, rank): a cheap score (rep, pos, score) screens ``factor * budget`` features, a better one ranks them."""
    order = [F.desc("score"), F.desc("rep"), F.desc("pos")]
    kept = screen.orderBy(*order).limit(factor * budget).select("rep", "pos")
    best = scores.join(kept, ["rep", "pos"], "left_semi").orderBy(*order).limit(budget)
    return best.select("rep", "pos", "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))  # ``budget`` rows


def allocate(scores: DataFrame, budget: int) -> DataFrame:
    """(rep, score, width, n): the budget shared by score, rounded half to even, capped by width.

    ``scores`` is (rep, score, width), one row per representation. What rounding leaves goes to the
    best with room, what it exceeds comes off the worst. Representations without a positive score
    get nothing; none with one is an error.
    """
    w = Window.partitionBy()
    s = scores.withColumn("_p", F.greatest("score", F.lit(0.0))).withColumn("_t", F.sum("_p").over(w))
    s = s.withColumn("_t", F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.raise_error(F.lit("no representation has a positive score")).cast("double")))
    s = s.withColumn("_n", F.least(F.bround(F.col("_p") / F.col("_t") * budget), F.col("width")).cast("long"))
    s = s.withColumn("_gap", F.lit(budget) - F.sum("_n").over(w))
    best, worst = Window.partitionBy().orderBy(F.desc("score"), "rep"), Window.partitionBy().orderBy("score", F.desc("rep"))
    room = F.when(F.col("_p") > 0, F.col("width") - F.col("_n")).otherwise(0)
    s = s.withColumn("_room", room).withColumns({"_up": F.sum("_room").over(best) - F.col("_room"), "_down": F.sum("_n").over(worst) - F.col("_n")})
    more = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_gap") - F.col("_up")))
    less = F.greatest(F.lit(0), F.least(F.col("_n"), -F.col("_gap") - F.col("_down")))
    return s.select("rep", "score", "width", (F.col("_n") + F.when(F.col("_gap") > 0, more).otherwise(0) - F.when(F.col("_gap") < 0, less).otherwise(0)).cast("long").alias("n"))


def select_by_allocation(scores: DataFrame, allocation: DataFrame) -> DataFrame:
    """The top n features of each representation, as many as it was allocated."""
    w = Window.partitionBy("rep").orderBy(F.desc("score"), F.desc("pos"))
    return scores.withColumn("rank", F.row_number().over(w)).join(F.broadcast(allocation.select("rep", "n")), "rep").filter(F.col("rank") <= F.col("n")).drop("n")  # one row per representation


def apply_selection(df: DataFrame, selection: dict[str, list[int]], name: str = "features") -> DataFrame:
    """One array of the selected components (0-based), in the selection's order."""
    return df.withColumn(name, F.concat(*(F.array(*(F.element_at(rep, i + 1) for i in idx)) for rep, idx in selection.items())))


def stack(df: DataFrame, vectors: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.concat(*vectors))


def importance_by_rep(scores: DataFrame) -> DataFrame:
    """Sum of |score| per representation and its share of the whole."""
    s = scores.groupBy("rep").agg(F.sum(F.abs("score")).alias("importance"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy()))


def correlation_scores(long: DataFrame, y: DataFrame, key: str) -> DataFrame:
    """(rep, pos, score): |correlation| of each feature with the label, 0 for constant ones."""
    c = F.try_divide(F.covar_pop("value", "y"), F.stddev_pop("value") * F.stddev_pop("y"))  # corr raises where one is constant
    return long.join(y, key).groupBy("rep", "pos").agg(F.abs(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))).alias("score"))


def correlation_matrix(df: DataFrame, vector: str) -> np.ndarray:
    """Pearson correlations of components (constant ones: 0); the matrix is as wide as a vector."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    c = Correlation.corr(df.select(array_to_vector(F.col(vector)).alias("v")), "v").first()[0].toArray()
    return np.nan_to_num(c)


def variance_inflation(df: DataFrame, vector: str) -> np.ndarray:
    """1 / (1 - R2) of each component on the others: the diagonal of the inverse correlation matrix, infinite if singular."""
    c = correlation_matrix(df, vector)
    np.fill_diagonal(c, 1.0)
    try:
        return np.diag(np.linalg.inv(c))
    except np.linalg.LinAlgError:
        return np.full(len(c), np.inf)


def effective_dimensions(df: DataFrame, vector: str, shares: tuple[float, ...] = (0.9, 0.95, 0.99)) -> dict[float, int]:
    """Principal components of the standardized components needed for each share of the variance."""
    values = np.sort(np.linalg.eigvalsh(correlation_matrix(df, vector)))[::-1].clip(0)
    upto = np.cumsum(values) / values.sum()
    return {s: int(np.searchsorted(upto, s - 1e-12) + 1) for s in shares}


def intrinsic_dimension(near: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Maximum-likelihood dimension from a k-neighbour table: mean over rows of (k - 1) / sum ln(T_k / T_j)."""
    far = near.groupBy(key).agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("_t"))
    d = near.filter(F.col("rank") < k).join(far, key).groupBy(key).agg(((k - 1) / F.sum(F.log(F.col("_t") / F.col("distance")))).alias("_d"))
    return d.agg(F.avg("_d").alias("dimension"), F.count(F.lit(1)).alias("n"))


def greedy_diversity(scores: np.ndarray, correlation: np.ndarray, budget: int, penalty: float = 0.5) -> list[int]:
    """Features one by one by score minus penalty * largest |correlation| with those taken."""
    taken: list[int] = []
    left = set(range(len(scores)))
    while left and len(taken) < budget:
        best = max(left, key=lambda i: (scores[i] - (penalty * np.abs(correlation[i, taken]).max() if taken else 0), -i))
        taken.append(best)
        left.remove(best)
    return taken


def greedy_relevance(relevance: np.ndarray, correlation: np.ndarray, budget: int) -> list[int]:
    """Minimum redundancy, maximum relevance: relevance minus mean |correlation| with those taken."""
    taken: list[int] = []
    left = set(range(len(relevance)))
    while left and len(taken) < budget:
        best = max(left, key=lambda i: (relevance[i] - (np.abs(correlation[i, taken]).mean() if taken else 0), -i))
        taken.append(best)
        left.remove(best)
    return taken


def stable_features(runs: DataFrame, budget: int, share: float = 0.6) -> DataFrame:
    """(rep, pos, frequency) of features in the top 2 * budget of at least this share of bootstrap runs (run, rep, pos, score)."""
    n = runs.select("run").distinct().count()
    return top_features(runs, 2 * budget, ["run"]).groupBy("rep", "pos").agg((F.count(F.lit(1)) / n).alias("frequency")).filter(F.col("frequency") >= share)


def vector_column(df: DataFrame, vectors: list[str]) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.concat(*vectors))
