"""Exact quantiles of a whole table or of each group, without a buffer of all values.

A quantile lies between two order statistics. A bounded sketch of each group proposes cuts around
them; counting the rows between and on the cuts tells which cut an order statistic is, or between
which two it lies. Rows strictly between those go on to the next round, a few in ten thousand at
first, until a bracket holds few enough to be sorted. What a task holds is a sketch and the counts of
its cuts; a value that many rows share is found by its count. The cuts only propose, the counts
decide, so results are exact whatever the sketch's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.ranks import fresh

#: Rows of a group (or bracket) that one buffer takes; accuracy of the sketch; cuts of a bracket in later rounds; groups whose cuts are broadcast, if they are counted to be no more.
FEW, ACCURACY, CUTS, BROADCAST_GROUPS = 250_000, 10_000, 64, 5_000


def quantiles(df: DataFrame, value: str | Column, shares: list[float], by: list[str] | None = None, name: str = "q", most: int | None = None, few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """(by, name): for each group the quantiles at ``shares``, interpolated between neighbouring values.

    Nulls don't count, NaN is the largest value; a group without values has a null, and so has an
    empty table without groups. A null is a group like others. ``most`` is how many rows a group has
    at most, where that is known without counting ``df``, which may be costly.
    """
    by = by or []
    d = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v"))
    out = d.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(name))
    if most is not None and most <= few:  # an aggregation buffer holds that many values at most
        return out
    most, groups = d.groupBy(*by).agg(F.count("_v").alias("_n")).agg(F.max("_n"), F.count(F.lit(1))).first()
    if (most or 0) <= few:
        return out
    d = d.withColumn("_g", F.to_json(F.struct(F.lit(0).alias("_0"), *by)))  # tells groups apart, nulls too
    keys = d.groupBy("_g").agg(*(F.first(c).alias(c) for c in by), F.count("_v").alias("_n"))
    places = [(s, i) for s in range(len(shares)) for i in (0, 1)]
    low = lambda s: F.floor((F.col("_n") - 1) * F.lit(shares[s]))
    wanted = F.array(*(F.struct(F.lit(2 * s + i).alias("t"), F.least(low(s) + i, F.col("_n") - 1).cast("long").alias("k")) for s, i in places))
    brackets = keys.filter("_n > 0").select("_g", F.lit(0).cast("long").alias("_j"), wanted.alias("_wanted"))
    rows = d.filter("_v is not null").select("_g", F.lit(0).cast("long").alias("_j"), "_v")
    grid = sorted({min(1.0, max(0.0, s + e * 2 / accuracy)) for s in shares for e in (-1, 1)})
    found = None
    while True:
        cuts = rows.groupBy("_g", "_j").agg(F.array_sort(F.array_distinct(F.percentile_approx("_v", F.array(*map(F.lit, grid)), accuracy))).alias("_cuts")).persist()
        # Twice the number of cuts below the value, one more on a cut.
        at = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        placed = rows.join(F.broadcast(cuts) if groups <= BROADCAST_GROUPS else cuts, ["_g", "_j"]).withColumn("_b", at)
        counts = placed.groupBy("_g", "_j", "_b").agg(F.count(F.lit(1)).alias("_c"))
        counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy("_g", "_j").orderBy("_b")) - F.col("_c"))
        hit = brackets.select("_g", "_j", F.explode("_wanted").alias("_w")).join(counts, ["_g", "_j"]).filter("_w.k >= _before and _w.k < _before + _c").join(cuts, ["_g", "_j"]).persist()
        exact = hit.filter("_b % 2 = 1").select("_g", F.col("_w.t").alias("_t"), F.element_at("_cuts", ((F.col("_b") + 1) / 2).cast("int")).alias("_v"))
        found = exact if found is None else found.union(exact)
        number = F.col("_j") * (2 * max(len(grid), CUTS) + 2) + F.col("_b")
        inside = hit.filter("_b % 2 = 0").groupBy("_g", "_j", "_b").agg(F.collect_list(F.struct(F.col("_w.t").alias("t"), (F.col("_w.k") - F.col("_before")).alias("k"))).alias("_wanted"), F.first("_c").alias("_c"))
        rows = placed.drop("_cuts").join(inside.select("_g", "_j", "_b"), ["_g", "_j", "_b"]).select("_g", number.alias("_j"), "_v")
        brackets = inside.select("_g", number.alias("_j"), "_wanted")
        largest, groups = inside.agg(F.max("_c"), F.count(F.lit(1))).first()
        if (largest or 0) <= few:
            break
        grid = [i / CUTS for i in range(1, CUTS)]
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_j").orderBy("_v")) - 1)
    rest = brackets.select("_g", "_j", F.explode("_wanted").alias("_w")).join(ranked, ["_g", "_j"]).filter("_k = _w.k").select("_g", F.col("_w.t").alias("_t"), "_v")
    told = found.union(rest).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_m"))  # two values a share

    def between(s: int) -> Column:
        a, b = F.col("_m")[2 * s], F.col("_m")[2 * s + 1]
        share = (F.col("_n") - 1) * F.lit(shares[s])
        return F.when(a == b, a).otherwise(a + (share - F.floor(share)) * (b - a))

    return keys.join(told, "_g", "left").select(*by, F.when(F.col("_m").isNotNull(), F.array(*map(between, range(len(shares))))).alias(name))


def with_quantile(df: DataFrame, name: str, value: str | Column, share: float | list[float], most: int | None = None) -> DataFrame:
    """Adds a quantile of all rows (of several shares: an array) as a column: one broadcast row."""
    shares = share if isinstance(share, list) else [share]
    own = fresh(df, "quantiles")[0]
    q = quantiles(df, value, shares, name=own, most=most)
    return df.crossJoin(F.broadcast(q.select(F.col(own).alias(name) if isinstance(share, list) else F.element_at(own, 1).alias(name))))
