"""Curation of measurement tables: predicates, unit transforms, replicate aggregation, joins of annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def potency(nm: Column) -> Column:
    """9 - log10 of a concentration in nM; null for what isn't positive."""
    return F.when(nm > 0, 9 - F.log10(nm))


def concentration(p: Column) -> Column:
    return F.pow(F.lit(10.0), 9 - p)


def truthy(*columns: str) -> Column:
    """Neither null, nor empty text, nor zero."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "0.0") for c in columns))


def active(um: Column, threshold: float = 10.0) -> Column:
    """1 up to and including the threshold."""
    return (um <= threshold).cast("int")


def to_number(c: str) -> Column:
    """Null where the text is no number."""
    return F.expr(f"try_cast(`{c}` AS double)")


def mentions(columns: list[str], keywords: list[str]) -> Column:
    """Any keyword in any of the columns, case ignored."""
    pattern = "|".join(keywords)
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).rlike(pattern), F.lit(False)) for c in columns))


def clipped(x: Column, limit: float = 1e10) -> Column:
    """NaN as 0, the rest within the limits."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def finite_or_zero(x: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def log_label(y: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(y, F.lit(floor)))


def near(x: Column, target: float, tolerance: float = 0.05) -> Column:
    return F.abs(x - target) < tolerance


def category(name: Column, keywords: list[str], yes: str, no: str) -> Column:
    return F.when(F.lower(name).rlike("|".join(keywords)), yes).otherwise(no)


def normalized_name(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "- ", "__")


def mapped(value: Column, names: dict[str, str], default: str = "other") -> Column:
    """Look-up in a small constant map."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(default))


def replicate_summary(df: DataFrame, keys: list[str], value: str = "nm", assay: str = "assay") -> DataFrame:
    """Per compound: mean potency, geometric mean, replicates, spread, assays in order.

    One partial aggregation; rows without a potency are left out, as every statistic needs one.
    """
    p = df.withColumn("_p", potency(F.col(value))).filter("_p is not null")
    out = p.groupBy(*keys).agg(F.avg("_p").alias("p_mean"), F.count(F.lit(1)).alias("n"), (F.max("_p") - F.min("_p")).alias("spread"), F.array_join(F.array_sort(F.collect_set(F.col(assay).cast("string"))), ",").alias("assays"))
    return out.withColumn("nm_mean", concentration(F.col("p_mean")))


def curate(df: DataFrame, keys: list[str], value: str = "nm", assay: str = "assay", min_measurements: int = 1, max_spread: float | None = 1.0) -> DataFrame:
    """Replicate summaries that have enough measurements and agree with each other."""
    out = replicate_summary(df, keys, value, assay)
    if min_measurements > 1:
        out = out.filter(F.col("n") >= min_measurements)
    return out if max_spread is None else out.filter(F.col("spread") <= max_spread)


def median_dedupe(df: DataFrame, keys: list[str], value: str, max_std: float | None = 1.0) -> DataFrame:
    """Median and sample deviation per key; a single measurement (no deviation) stays."""
    out = df.groupBy(*keys).agg(F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))
    return out if max_std is None else out.filter(F.col("std").isNull() | (F.col("std") <= max_std))


def property_dataset(df: DataFrame, keys: list[str], properties: list[str], target: str, order: list[Column], train: Column | None = None) -> DataFrame:
    """(keys, y, z): one of several properties as the label, the first row in ``order`` of each key, z by the training rows.

    Rows whose target is null, not a number or infinite go before the first row is chosen; an unknown target is an error.
    """
    if target not in properties:
        raise ValueError(f"unknown property {target!r}; known: {sorted(properties)}")
    y = F.col(target).try_cast("double")
    d = df.withColumn("_y", y).filter(F.col("_y").isNotNull() & ~F.isnan("_y") & (F.abs("_y") < float("inf")))
    first = d.groupBy(*keys).agg(F.min_by("_y", F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)))).alias("y"))
    return standardized(first, "y", train)


def first_match(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, order: list[str]) -> DataFrame:
    """Inner join in which a left row meets only the first right row of its key."""
    ranked = right.withColumn("_k", right_key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1").drop("_n")
    return left.withColumn("_k", left_key).join(ranked, "_k").drop("_k")


def membership_label(df: DataFrame, key: str, zero: DataFrame, one: DataFrame) -> DataFrame:
    """label 0 for keys in ``zero``, else 1 for keys in ``one``; others are left out."""
    z, o = zero.select(key).distinct().withColumn("_z", F.lit(0)), one.select(key).distinct().withColumn("_o", F.lit(1))
    return df.join(z, key, "left").join(o, key, "left").withColumn("label", F.coalesce("_z", "_o")).filter("label is not null").drop("_z", "_o")


def presence_matrix(df: DataFrame, key: str, item: str, items: list[str]) -> DataFrame:
    """0/1 column per item: whether the key has it."""
    return df.groupBy(key).agg(*(F.max((F.col(item) == i).cast("int")).alias(i) for i in items))


def zero_filled(df: DataFrame, features: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """Left join of feature arrays; zeros where there are none."""
    return df.join(features, key, "left").withColumn(column, F.coalesce(column, F.array_repeat(F.lit(0.0), width)))


def standardized(df: DataFrame, value: str, train: Column | None = None) -> DataFrame:
    """z = (value - mean) / population deviation of the training rows (all by default); 0 where that is 0."""
    rows = df if train is None else df.filter(train)
    s = rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose key isn't in ``new``, and all of ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
