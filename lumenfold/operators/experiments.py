"""Grids of configurations: each is run once, its rows go to a table, and a stopped grid goes on where it was.

A grid's folder holds ``rows`` and ``state``, both partitioned by configuration. A configuration's rows
are written before its state, each by a commit that replaces its own partition, so one that a stop
caught half-way is run again and its rows are replaced; one that is done is never run again. A loop
here goes over configurations and folds, whose numbers are parameters; rows stay in Spark.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.ml.feature import StandardScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import models as M
from lumenfold.operators import noise as Z
from lumenfold.operators.evaluation import ranked_report
from lumenfold.operators.hybrid import create_hybrid, finite
from lumenfold.operators.noise_registry import detect
from lumenfold.operators.projection import fit_projection
from lumenfold.operators.splits import folds, group_folds
from lumenfold.sources.readers import cached, write_checkpoint

Config = dict[str, object]
STATE = "settings string, status string, error string, config string"


def grid(**axes: Iterable[object]) -> list[Config]:
    """Every combination of the axes' values, the last axis fastest."""
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def config_id(config: Config) -> str:
    """The same for equal settings, whatever their order."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not there yet
        return spark.createDataFrame([], schema)


def run_grid(spark: SparkSession, configs: Iterable[Config], run: Callable[[Config], DataFrame], path: str, schema: str) -> DataFrame:
    """The rows of every configuration of the folder, of this grid or an earlier one: ``schema``'s columns, ``config`` and ``settings`` (JSON).

    ``run`` gives a configuration's rows. One that raises is recorded as failed with its error,
    doesn't stop the others, and is tried again by the next run. Repeated configurations run once;
    one without rows is done all the same.
    """
    finished = {r["config"] for r in states(spark, path).filter("status = 'done'").select("config").collect()}  # a row per configuration
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    for c in configs:
        name = config_id(c)
        if name in finished:
            continue
        finished.add(name)
        status, error = "done", None
        try:
            write_checkpoint(run(c).select(*names).withColumn("config", F.lit(name)).coalesce(1), f"{path}/rows", "config")
        except Exception as e:  # noqa: BLE001  (a configuration may fail in any way; its error is kept)
            status, error = "failed", f"{type(e).__name__}: {e}"[:2000]
        state = spark.createDataFrame([(json.dumps(c, sort_keys=True, default=str), status, error, name)], STATE)
        write_checkpoint(state, f"{path}/state", "config")
    done = states(spark, path).filter("status = 'done'").select("config", "settings")
    return _table(spark, f"{path}/rows", f"{schema}, config string").join(done, "config")


def states(spark: SparkSession, path: str) -> DataFrame:
    """(settings, status, error, config) of the configurations that were run to their end."""
    return _table(spark, f"{path}/state", STATE)


def setting(name: str, kind: str = "string") -> F.Column:
    """A setting of the rows that ``run_grid`` gives."""
    return F.get_json_object("settings", f"$.{name}").cast(kind)


def ridge(alpha: float = 1.0) -> Callable[[DataFrame], object]:
    """Least squares with a penalty of ``alpha`` on the squared weights of the features as they are."""

    def fit(d: DataFrame) -> object:
        n, spread = d.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        # MLlib's penalty counts in labels over their deviation, and in means, not sums
        return LinearRegression(regParam=alpha * (spread or 0.0) / max(1, n), elasticNetParam=0.0, standardization=False).fit(d)

    return fit


#: Models by name: each takes assembled rows (features, label) and gives a fitted model.
MODELS: dict[str, Callable[[DataFrame], object]] = {"ridge": ridge(), "random_forest": lambda d: M.forest(100, 10).fit(d)}


def train_and_score(train: DataFrame, others: DataFrame, model: str = "ridge", vector: str = "x", y: str = "y") -> DataFrame:
    """One row: train_r2, r2, rmse, mae (of the other rows), n_features. Features are standardized by the training rows.

    R2 is null where labels don't differ, and all of the others' scores where there are none.
    """
    if model not in MODELS:
        raise ValueError(f"no model is called {model!r}; there are {', '.join(MODELS)}")
    both = M.assembled(train, vector, y).select("features", "label"), M.assembled(others, vector, y).select("features", "label")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(both[0])
    ready = [scaler.transform(d).select(F.col("scaled").alias("features"), "label") for d in both]
    fitted = MODELS[model](ready[0])
    width = scaler.mean.size
    told = fitted.transform(ready[0]).withColumn("held", F.lit(False)).union(fitted.transform(ready[1]).withColumn("held", F.lit(True)))
    e = F.col("label") - F.col("prediction")

    def of(held: bool, value: F.Column) -> F.Column:
        return F.when(F.col("held") == held, value)

    def r2(held: bool) -> F.Column:
        return 1 - F.try_divide(F.avg(of(held, e * e)), F.var_pop(of(held, F.col("label"))))

    return told.agg(r2(False).alias("train_r2"), r2(True).alias("r2"), F.sqrt(F.avg(of(True, e * e))).alias("rmse"), F.avg(of(True, F.abs(e))).alias("mae")).withColumn("n_features", F.lit(width).cast("long"))


FOLD_SCORES = "train_r2 double, r2 double, rmse double, mae double, n_features long, fold int"


def by_folds(d: DataFrame, k: int, score: Callable[[DataFrame, DataFrame], DataFrame], fold: str = "fold") -> DataFrame:
    """``score`` of (the other folds, the fold) for each fold, with its number."""
    out = None
    for i in range(k):
        part = score(d.filter(F.col(fold) != i), d.filter(F.col(fold) == i)).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_representations(df: DataFrame, reps: list[str], train: F.Column, k: int = 5, model: str = "ridge", key: str = "id", y: str = "y") -> DataFrame:
    """Per representation (a vector column) r2 on training rows, r2, rmse and mae on the others, and r2 over folds of the training rows; ranked by the others' r2.

    Rows for which ``train`` isn't true are the others. Folds are runs of the training rows' keys, the same for all.
    """
    rows = df.withColumn("_train", F.coalesce(train, F.lit(False)))
    own, others = rows.filter("_train"), rows.filter("not _train")
    dealt = folds(own, key, k)
    scores = cross = None
    for rep in reps:
        one = train_and_score(own, others, model, rep, y).select(F.lit(rep).alias("rep"), F.col("train_r2").alias("r2_train"), F.col("r2").alias("r2_test"), F.col("rmse").alias("rmse_test"), F.col("mae").alias("mae_test"), "n_features")
        each = by_folds(dealt, k, lambda a, b, rep=rep: train_and_score(a, b, model, rep, y)).select(F.lit(rep).alias("rep"), "fold", "r2")
        scores, cross = (one, each) if scores is None else (scores.unionByName(one), cross.unionByName(each))
    return ranked_report(scores, cross)


def _with_folds(df: DataFrame, group: str, k: int, path: str) -> DataFrame:
    """The rows with their fold, whole groups each: dealt once for all configurations."""
    return cached(df.sparkSession, f"{path}/folds-{k}", lambda: group_folds(df, group, k))


def hybrid_search(df: DataFrame, reps: list[str], configs: list[Config], path: str, group: str, k: int = 3, key: str = "id", y: str = "y", **options: object) -> DataFrame:
    """Scores by fold of hybrids: a configuration has ``model``, and ``create_hybrid``'s allocation, importance, budget and so on.

    Features are chosen on the other folds' rows and applied to the fold's; a group never falls apart
    into two folds. ``options`` go to every ``create_hybrid``.
    """
    d = _with_folds(df, group, k, path)

    def run(c: Config) -> DataFrame:
        def score(train: DataFrame, others: DataFrame) -> DataFrame:
            chosen = {n: v for n, v in c.items() if n != "model"}
            rows, found = create_hybrid(train, reps, key, y, **(options | chosen))
            return train_and_score(rows, found.apply(finite(others, [*found.selection, *found.augmentations])), str(c.get("model", "ridge")), "features", y)

        return by_folds(d, k, score)

    return run_grid(df.sparkSession, configs, run, path, FOLD_SCORES)


def search_summary(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(config, settings, keys, folds, score_mean, score_std, train_mean, gap, n_features), over folds; the deviation is the population's."""
    out = rows.groupBy("config", "settings").agg(F.count("r2").alias("folds"), F.avg("r2").alias("score_mean"), F.stddev_pop("r2").alias("score_std"), F.avg("train_r2").alias("train_mean"), F.floor(F.avg("n_features")).alias("n_features"))
    return out.withColumn("gap", F.col("train_mean") - F.col("score_mean")).withColumns({n: setting(n) for n in keys})


def generalization_gap(df: DataFrame, widths: list[int], models: list[str], path: str, group: str, k: int = 3, vector: str = "x", y: str = "y") -> DataFrame:
    """Scores by fold of models on the first principal components of standardized features, for each number of components.

    Components are fitted on all rows once, as many as the largest number asks for; they need no labels.
    """
    d = _with_folds(df, group, k, path)
    projected = cached(df.sparkSession, f"{path}/projected-{max(widths)}", lambda: fit_projection(d, max(widths), vector, standardize=True).apply(d, vector, "components").select("components", y, "fold"))

    def run(c: Config) -> DataFrame:
        first = projected.withColumn("x", F.slice("components", 1, int(c["components"])))
        return by_folds(first, k, lambda train, others: train_and_score(train, others, str(c["model"]), "x", y))

    return run_grid(df.sparkSession, grid(model=models, components=widths), run, path, FOLD_SCORES)


NOISE_SCORES = "r2_clean double, r2_noisy double, r2_cleaned double, rmse_cleaned double, mae_cleaned double, recovery double, precision double, recall double, f1 double, n_detected long, n_true long, n_after long"


def noise_grid(train: DataFrame, others: DataFrame, configs: list[Config], path: str, key: str = "id", model: str = "ridge") -> DataFrame:
    """What a detector gives back of the score that injected label noise takes; rows are (key, x, y).

    A configuration has ``method`` (a name of the registry), ``sigma``, ``seed``, ``strategy`` (legacy,
    if it has none) and options of the method. Rows whose label changed are the true noise. recovery
    is (cleaned - noisy) / (clean - noisy), 0 where these two are equal; precision, recall and f1 are
    0 without detections or noise. What configurations share (clean and noisy scores, noisy labels)
    is computed once and read again.
    """
    spark = train.sparkSession
    write = lambda name, make: cached(spark, f"{path}/{name}", make)
    rows = train.select(key, "x", "y")
    clean = write("clean", lambda: train_and_score(rows, others, model).select(F.col("r2").alias("r2_clean")))

    def run(c: Config) -> DataFrame:
        noise = {n: c[n] for n in ("sigma", "seed", "strategy") if n in c}
        name = config_id(noise)
        sigma, seed = float(c["sigma"]), str(c.get("seed", 0))
        noisy = write(f"noisy-{name}", lambda: Z.inject(rows, sigma, str(c.get("strategy", "legacy")), seed, key).select(key, "x", F.when(F.lit(sigma > 0), F.col("y_noisy")).otherwise(F.col("y")).alias("y"), F.col("y").alias("y_true")))
        bare = noisy.select(key, "x", "y")
        base = write(f"base-{name}", lambda: train_and_score(bare, others, model).select(F.col("r2").alias("r2_noisy")))
        flagged = write(f"flags-{config_id(c)}", lambda: detect(str(c["method"]), bare, key, **{n: v for n, v in c.items() if n not in ("method", *noise)}))
        told = noisy.join(flagged, key, "left").withColumn("is_noise", F.coalesce("is_noise", F.lit(False)))
        changed = F.col("y") != F.col("y_true")
        counts = told.agg(F.count_if("is_noise").alias("n_detected"), F.count_if(changed).alias("n_true"), F.count_if(F.col("is_noise") & changed).alias("hits"), F.count_if(~F.col("is_noise")).alias("n_after"))
        after = train_and_score(told.filter("not is_noise").select(key, "x", "y"), others, model).select(F.col("r2").alias("r2_cleaned"), F.col("rmse").alias("rmse_cleaned"), F.col("mae").alias("mae_cleaned"))
        one = clean.crossJoin(base).crossJoin(after).crossJoin(counts)  # one row each
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        one = one.withColumns({"recovery": share(F.col("r2_cleaned") - F.col("r2_noisy"), F.col("r2_clean") - F.col("r2_noisy")), "precision": share(F.col("hits"), F.col("n_detected")), "recall": share(F.col("hits"), F.col("n_true"))})
        return one.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

    return run_grid(spark, configs, run, path, NOISE_SCORES)
