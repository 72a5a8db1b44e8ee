"""Splits, folds and samples by hash order: the same in every run, engine and partitioning.

Exact sizes need exact ranks; they come from ``ranks``, bucket by bucket, so no task sees all rows.
``hashed_fraction`` gives approximate sizes without any shuffle, which is what very large tables want.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.quantiles import with_quantile
from lumenfold.operators.ranks import fresh, hash_ranked, key_ranked, name_ranked, order_key, tile


def hashed_fraction(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds ``split`` by the hash alone: sizes are near the fractions."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    out, upto = None, 0.0
    for name, share in fractions.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(list(fractions)[-1]))


def random_split(df: DataFrame, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """Adds ``split`` with exact sizes floor(n * share) per stratum; the rest is test."""
    n, place = fresh(df, "n", "place")
    upto = lambda share: F.floor(F.col(n) * share)
    split = F.when(F.col(place) < upto(train), "train").when(F.col(place) < upto(train) + upto(validation), "validation").otherwise("test")
    return hash_ranked(df, key, seed, place, n, strata).withColumn("split", split).drop(n, place)


def quartile_strata(df: DataFrame, value: str, name: str = "stratum") -> DataFrame:
    """Adds the quartile (0..3) of a value: right-open bins."""
    q = fresh(df, "quartiles")[0]
    return with_quantile(df, q, value, [0.25, 0.5, 0.75]).withColumn(name, F.size(F.filter(q, lambda e: e <= F.col(value)))).drop(q)


def quartile_split(df: DataFrame, key: str, value: str, test: float = 0.1, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``, each quartile of ``value`` in its share: test rows are drawn first, quartiles of the remainder then draw validation.

    Shares are of all rows; a stratum gives floor(its rows * share). A null value is in the lowest quartile.
    """
    n, place, stratum = fresh(df, "n", "place", "stratum")

    def drawn(d: DataFrame, share: float, seed: int) -> DataFrame:
        d = quartile_strata(d, value, stratum).withColumn(stratum, F.coalesce(F.col(stratum), F.lit(0)))
        return hash_ranked(d, key, seed, place, n, [stratum]).withColumn("split", F.when(F.col(place) < F.floor(F.col(n) * share), "drawn")).drop(n, place, stratum)

    first = drawn(df, test, seed)
    rest = drawn(first.filter("split is null").drop("split"), validation / (1 - test), seed + 1)
    return first.filter("split is not null").withColumn("split", F.lit("test")).unionByName(rest.withColumn("split", F.when(F.col("split").isNull(), "train").otherwise("validation")))


def internal_validation(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Adds ``is_validation``: the first max(floor(n * share), 1) rows in hash order; fewer than 2 training rows are an error."""
    n, place = fresh(df, "n", "place")
    k = F.greatest(F.floor(F.col(n) * share), F.lit(1))
    k = F.when(F.col(n) - k >= 2, k).otherwise(F.raise_error(F.lit("fewer than 2 training rows")).cast("long"))
    return hash_ranked(df, key, seed, place, n).withColumn("is_validation", F.col(place) < k).drop(n, place)


def folds(df: DataFrame, key: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Adds ``fold`` of equal sizes, by hash order or, without a seed, by (numeric) key."""
    n, place = fresh(df, "n", "place")
    d = key_ranked(df, key, place, n) if seed is None else hash_ranked(df, key, seed, place, n)
    return d.withColumn("fold", tile(F.col(place), F.col(n), k)).drop(n, place)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.withColumn("_h", order_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def bootstrap(df: DataFrame, key: str, runs: int) -> DataFrame:
    """(run, weight) per row: Poisson(1) weights by hash; out of bag where 0."""
    d = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return d.withColumn("weight", poisson_weight(F.col(key), F.col("run")))


def poisson_weight(key: Column, run: Column) -> Column:
    """How often a bootstrap run draws a row: Poisson(1), by hash, 8 at most."""
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("_"), run.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight, mass, upto = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        weight = weight + (u >= upto).cast("int")
        mass /= k
        upto += mass
    return weight


def learning_curve(df: DataFrame, key: str, sizes: list[int], seeds: list[int]) -> DataFrame:
    """(size, seed) subsets: the first ``size`` rows in each seed's hash order, nested within a seed.

    Sizes are parameters, so each seed keeps its first ``max(sizes)`` rows only, found by a partial top-n.
    """
    out = None
    for seed in seeds:
        h, place = fresh(df, "h", "place")
        first = df.withColumn(h, order_key(key, seed)).orderBy(h, key).limit(max(sizes)).drop(h)
        n = fresh(first, place, "n")[1]
        part = hash_ranked(first, key, seed, place, n).withColumn("seed", F.lit(seed)).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col(place) < F.col("size")).drop(place, n)
        out = part if out is None else out.unionByName(part)
    return out


#: Of the groups of one size: those from place ``start`` to before ``upto`` take the names by turns.
Turns = list[tuple[int, int, list]]


def _dealt(df: DataFrame, group: str, column: str, kind: str, deal: Callable[[list[tuple[int, int]]], Iterator[Turns]], seed: int | None = None) -> DataFrame:
    """Adds to each row what its group is dealt: groups go by size, largest first, equal sizes by key or, with a seed, by hash.

    ``deal`` sees (size, groups of that size) and says for each size what its groups take. n rows have
    at most sqrt(2 n) different sizes, so that table alone goes through one task; groups find their
    place among those of their size by ``ranks``.
    """
    g, n, place, total, turns = fresh(df, "g", "n", "place", "total", "turns")
    groups = df.groupBy(F.col(group).alias(g)).agg(F.count(F.lit(1)).alias(n))
    placed = name_ranked(groups, g, place, total, [n]) if seed is None else hash_ranked(groups, g, seed, place, total, [n])
    sizes = groups.groupBy(n).agg(F.count(F.lit(1)).alias(total)).repartition(1).sortWithinPartitions(F.col(n).desc())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [(int(a), int(b)) for pdf in frames for a, b in zip(pdf[n], pdf[total], strict=True)]
        for (size, _), found in zip(pairs, deal(pairs), strict=True):
            yield pd.DataFrame({n: [size], turns: [[{"start": a, "upto": b, "names": names} for a, b, names in found]]})

    plan = sizes.mapInPandas(run, f"`{n}` long, `{turns}` array<struct<start: long, upto: long, names: array<{kind}>>>")
    own = F.get(F.filter(turns, lambda t: F.col(place) < t["upto"]), F.lit(0))
    named = placed.join(plan, n).select(g, F.get(own["names"], (F.col(place) - own["start"]) % F.size(own["names"])).alias(column))
    return df.join(named, F.col(group).eqNullSafe(F.col(g))).drop(g)


def split_turns(pairs: list[tuple[int, int]], train: float, validation: float) -> Iterator[Turns]:
    """For each (size, groups) the split they go to: train while it fits, then validation, else test."""
    rows = sum(size * groups for size, groups in pairs)
    first, both = int(rows * train), int(rows * (train + validation))
    held = checked = 0
    for size, groups in pairs:
        a = min(groups, max(0, (first - held) // size))
        held += a * size
        b = min(groups - a, max(0, (both - held - checked) // size))
        checked += b * size
        yield [(x, y, [name]) for x, y, name in ((0, a, "train"), (a, a + b, "validation"), (a + b, groups, "test")) if x < y]


def fold_turns(pairs: list[tuple[int, int]], k: int) -> Iterator[Turns]:
    """For each (size, groups) the fold they go to: always the lightest, the first among equals.

    Groups of one size raise loads by equal steps. Counted in steps, a fold enters at the whole part
    of its load; from there on all that have entered take turns, by the rest of their load and number.
    """
    load = [0] * k
    for size, groups in pairs:
        enters = sorted({w // size for w in load})
        turns, start = [], 0
        for level, after in zip(enters, [*enters[1:], None], strict=True):
            inside = sorted((f for f in range(k) if load[f] // size <= level), key=lambda f: (load[f] % size, f))
            upto = groups if after is None else min(groups, start + (after - level) * len(inside))
            if start < upto:
                turns.append((start, upto, inside))
            start = upto
        for a, b, inside in turns:
            each, more = divmod(b - a, len(inside))
            for i, f in enumerate(inside):
                load[f] += (each + (i < more)) * size
        yield turns


def group_split(df: DataFrame, group: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds ``split``, whole groups each, largest first: train while it fits, then validation, else test.

    A group that doesn't fit goes on to the next split while smaller ones after it may still fit. Rows
    whose group is null are one group.
    """
    return _dealt(df, group, "split", "string", lambda pairs: split_turns(pairs, train, validation))


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Adds ``fold``: groups, largest first, each to the lightest fold (the first among equals); a seed shuffles groups of equal sizes."""
    return _dealt(df, group, "fold", "int", lambda pairs: fold_turns(pairs, k), seed)


def repeated_group_folds(df: DataFrame, group: str, k: int = 5, repeats: int = 3, seed: int = 42) -> DataFrame:
    """``group_folds`` once for each ``repeat``, groups of equal sizes in another order each time."""
    out = None
    for r in range(repeats):
        part = group_folds(df, group, k, seed + r).withColumn("repeat", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def group_ids(df: DataFrame, group: str, name: str = "group_id") -> DataFrame:
    """Adds a whole number for each group, from 0 in the groups' order; null is a group, the first."""
    g, n = fresh(df, "g", "n")
    ids = name_ranked(df.select(F.col(group).alias(g)).distinct(), g, name, n).drop(n)
    return df.join(ids, F.col(group).eqNullSafe(F.col(g))).drop(g)
