"""Exact global ranks without a single task: rows are dealt to buckets of their order, and buckets' sizes are added up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a hash (three hexadecimal digits), and cuts of a numeric key.
HASH_DIGITS, CUTS = 3, 200


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, in any case: the given ones, with underscores where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def order_key(key: str | Column, seed: object) -> Column:
    """The hash that stands for a random order: the same in every engine."""
    return F.md5(F.concat((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(f"_{seed}")))


def _same(columns: list[str], others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(columns, others, strict=True)))


def ranked(df: DataFrame, order: list[Column], bucket: Column, place: str, total: str, by: list[str] | None = None) -> DataFrame:
    """Adds the row's place (from 0) in ``order`` within ``by``, and the rows there.

    ``bucket`` must not fall where ``order`` rises. Rows are ranked within (by, bucket); what comes
    before a bucket is a running sum over the table of buckets, which holds a few thousand rows for
    each value of ``by`` whatever the number of rows.
    """
    by = by or []
    b, row, before = fresh(df, "bucket", "row", "before")
    keys = [*by, b]
    d = df.withColumn(b, bucket)
    other = fresh(d, *(f"{k}_of" for k in keys))
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    upto = F.sum(total).over(Window.partitionBy(*by).orderBy(b))
    sizes = sizes.withColumn(before, upto - F.col(total)).withColumn(total, F.sum(total).over(Window.partitionBy(*by)))
    sizes = sizes.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), before, total)
    d = d.withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return d.join(sizes, _same(keys, other)).withColumn(place, F.col(row) + F.col(before)).drop(*other, b, row, before)


def hash_ranked(df: DataFrame, key: str, seed: object, place: str, total: str, by: list[str] | None = None) -> DataFrame:
    """``ranked`` by hash order, ties by key."""
    h = order_key(key, seed)
    return ranked(df, [h, F.col(key)], F.substring(h, 1, HASH_DIGITS), place, total, by)


def _quantile_bucket(df: DataFrame, key: str) -> Column:
    """How many of a numeric key's approximate quantiles, ``CUTS`` numbers, lie below it."""
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))))).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(key))) if cuts else F.lit(0)


def key_ranked(df: DataFrame, key: str, place: str, total: str, by: list[str] | None = None) -> DataFrame:
    """``ranked`` by a numeric key."""
    return ranked(df, [F.col(key)], _quantile_bucket(df, key), place, total, by)


def name_ranked(df: DataFrame, key: str, place: str, total: str, by: list[str] | None = None) -> DataFrame:
    """``ranked`` by a key of any ordered type, null first: ``CUTS`` keys, the first by hash, cut the buckets."""
    cuts = [r[0] for r in df.select(key).filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(CUTS).collect()]
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
    return ranked(df, [F.col(key)], bucket, place, total, by)


def with_sum_before(df: DataFrame, value: str, weight: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds what ``weight`` sums to over the rows with a smaller (numeric) ``value`` within ``by``; null is least, NaN largest.

    ``value`` must not repeat within ``by``. Sums run within buckets of the value's order and over the
    table of buckets, at most ``CUTS`` rows for each value of ``by``: no task sees a whole group.
    """
    by = by or []
    _, b, before, all_of = fresh(df, name, "bucket", "before", "all")
    keys = [*by, b]
    d = df.withColumn(b, _quantile_bucket(df, value))
    other = fresh(d, *(f"{k}_of" for k in keys))
    sums = d.groupBy(*keys).agg(F.sum(weight).alias(all_of))
    sums = sums.withColumn(before, F.sum(all_of).over(Window.partitionBy(*by).orderBy(b)) - F.col(all_of))
    sums = sums.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), before)
    within = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value)) - F.col(weight)
    return d.withColumn(all_of, within).join(sums, _same(keys, other)).withColumn(name, F.col(all_of) + F.col(before)).drop(*other, b, all_of, before)


def tile(place: Column, total: Column, k: int) -> Column:
    """The number (from 0) of a place's part when rows are dealt into k runs of equal sizes, the first ones a row longer."""
    size, longer = F.floor(total / k), total % k
    edge = longer * (size + 1)
    return F.when(place < edge, F.floor(place / (size + 1))).otherwise(longer + F.floor((place - edge) / F.greatest(size, F.lit(1)))).cast("int")
