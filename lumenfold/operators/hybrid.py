"""Building one feature vector from several representations: validate, filter, split, rank, allocate, select, augment.

Features keep their places in their representation throughout, so a filter needs no mapping back.
What reaches the driver is one row per chosen feature or representation; validation scores cost a
model fit each, and their number is bounded by budget, step and representations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import explain as E
from lumenfold.operators import models as M
from lumenfold.operators import selection as S
from lumenfold.operators.evaluation import check_labels
from lumenfold.operators.splits import internal_validation

Importance = Callable[[DataFrame, str, str, str], DataFrame]
Value = Callable[[DataFrame, DataFrame], float]
#: Values outside are cut off; what isn't a number counts as 0.
LIMIT = 1e10


@dataclass
class Hybrid:
    """What was chosen: places by representation (best first), features by representation, history of a greedy allocation, kept augmentations and their gains."""

    selection: dict[str, list[int]]
    allocation: dict[str, int]
    history: list[tuple[str, float]] = field(default_factory=list)
    augmentations: dict[str, list[int]] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Adds the chosen features of the representations, then of the kept augmentations."""
        return S.apply_selection(df, {k: v for k, v in (self.selection | self.augmentations).items() if v}, name)


def finite(df: DataFrame, reps: list[str]) -> DataFrame:
    """Components within +-LIMIT, 0 where they aren't numbers."""
    clean = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), v)))
    return df.withColumns({r: F.transform(F.col(r).cast("array<double>"), clean) for r in reps})


def correlation_importance(df: DataFrame, rep: str, key: str, y: str) -> DataFrame:
    """(rep, pos, score): |correlation| with the label."""
    return df.sparkSession.createDataFrame([(rep, i, c) for i, c in enumerate(S.vector_correlations(df, rep, y))], "rep string, pos int, score double")


def forest_importance(df: DataFrame, rep: str, key: str, y: str) -> DataFrame:
    """(rep, pos, score): decrease of impurity in a forest."""
    values = M.forest_importance(df.select(key, F.col(rep).alias("x"), F.col(y).alias("y")), 50, 10)
    return df.sparkSession.createDataFrame([(rep, i, float(v)) for i, v in enumerate(values)], "rep string, pos int, score double")


def explained_importance(explain: Callable[..., DataFrame]) -> Importance:
    """(rep, pos, score): the mean absolute contribution of each feature to a forest's predictions."""

    def score(df: DataFrame, rep: str, key: str, y: str) -> DataFrame:
        d = df.select(key, F.col(rep).alias("x"), F.col(y).alias("y"))
        values = E.mean_absolute(explain(d, M.forest(50, 10).fit(M.assembled(d)), key=key))
        return values.select(F.lit(rep).alias("rep"), "pos", "score")

    return score


def boruta_importance(df: DataFrame, rep: str, key: str, y: str) -> DataFrame:
    """(rep, pos, score): the largest rank of a shadow test less the feature's, plus one."""
    found = E.boruta(df, key=key, vector=rep, y=y)
    worst = max(v["rank"] for v in found.values())
    return df.sparkSession.createDataFrame([(rep, i, float(worst - v["rank"] + 1)) for i, v in found.items()], "rep string, pos int, score double")


def permuted_importance(df: DataFrame, rep: str, key: str, y: str) -> DataFrame:
    """(rep, pos, score): drop of R2 when a component is exchanged between rows."""
    found = M.permutation_importance(df.select(key, F.col(rep).alias("x"), F.col(y).alias("y")), key=key)
    return df.sparkSession.createDataFrame([(rep, i, float(v)) for i, v in found.items()], "rep string, pos int, score double")


IMPORTANCE: dict[str, Importance] = {
    "correlation": correlation_importance, "random_forest": forest_importance, "permutation": permuted_importance, "boruta": boruta_importance,
    "treeshap": explained_importance(E.tree_shap), "kernelshap": explained_importance(E.kernel_shap), "lime": explained_importance(E.lime),
}


def forest_value(train: DataFrame, validation: DataFrame) -> float:
    """R2 on the validation rows of a forest fitted to the others; both have (x, y)."""
    return M.r2(M.forest(20, 8).fit(M.assembled(train)).transform(M.assembled(validation)))


def importance_of(method: str | Importance) -> Importance:
    if callable(method):
        return method
    if method not in IMPORTANCE:
        raise NotImplementedError(f"importance {method!r}; known: {sorted(IMPORTANCE)}")
    return IMPORTANCE[method]


#: What parameters may be: a test, and how it reads.
BOUNDS: dict[str, tuple[Callable[[float], bool], str]] = {
    **dict.fromkeys(("budget", "step", "n_per_rep", "augmentation_budget", "patience"), (lambda v: v > 0, "above 0")),
    "validation": (lambda v: 0 < v < 1, "a share of the rows, neither none nor all"), "rows": (lambda v: v > 1, "two or more"),
}


def in_bounds(**values: float | None) -> None:
    """An error for the first value out of its bounds; None is no value."""
    for name, v in values.items():
        fits, wanted = BOUNDS[name]
        if v is not None and not fits(v):
            raise ValueError(f"{name}: {v} is not {wanted}")


def widths(df: DataFrame, reps: list[str]) -> dict[str, int]:
    """Each representation's number of features; an error if rows differ, or there are none, or too few rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(f(F.size(r)).alias(f"{r}_{n}") for r in reps for n, f in (("min", F.min), ("max", F.max)))).first()
    in_bounds(rows=row["n"])
    for r in reps:
        if row[f"{r}_min"] != row[f"{r}_max"]:
            raise ValueError(f"representation {r!r} has rows of {row[f'{r}_min']} to {row[f'{r}_max']} features")
        if row[f"{r}_max"] < 1:
            raise ValueError(f"representation {r!r} has no features")
    return {r: row[f"{r}_max"] for r in reps}


def ranked_features(train: DataFrame, reps: list[str], kept: dict[str, set[int]] | None, importance: Importance, most: int, key: str, y: str) -> dict[str, list[int]]:
    """The places of each representation's best features that a filter kept, best first, at most ``most``."""
    out = {}
    for r in reps:
        s = importance(train, r, key, y)
        if kept is not None:
            s = s.filter(F.col("pos").isin(*sorted(kept[r])))
        out[r] = [x["pos"] for x in s.orderBy(F.desc("score"), F.desc("pos")).limit(most).collect()]  # ``most`` rows
    return out


def _matrix(df: DataFrame, selection: dict[str, list[int]], y: str) -> DataFrame:
    return S.apply_selection(df, {r: p for r, p in selection.items() if p}, "x").select("x", F.col(y).alias("y"))


def greedy_forward(train: DataFrame, validation: DataFrame, ranked: dict[str, list[int]], budget: int, step: int, patience: int | None, value: Value, y: str) -> tuple[dict[str, int], list[tuple[str, float]]]:
    """Adds ``step`` features at a time to the representation that then validates best; the best allocation seen wins."""
    now, best, best_value, waited, history = dict.fromkeys(ranked, 0), {}, float("-inf"), 0, []
    while sum(now.values()) < budget and (patience is None or waited < patience):
        tries = []
        for r in ranked:
            more = min(step, len(ranked[r]) - now[r], budget - sum(now.values()))
            if more > 0:
                c = now | {r: now[r] + more}
                chosen = {q: ranked[q][: c[q]] for q in ranked}
                tries.append((value(_matrix(train, chosen, y), _matrix(validation, chosen, y)), r, c))
        if not tries:
            break
        v, r, now = max(tries, key=lambda t: t[0])
        history.append((r, v))
        best, best_value, waited = (now, v, 0) if v > best_value else (best, best_value, waited + 1)
    return best, history


def evaluate_augmentations(train: DataFrame, validation: DataFrame, base: dict[str, list[int]], candidates: dict[str, list[int]], threshold: float | None, value: Value, y: str) -> tuple[dict[str, list[int]], dict[str, float]]:
    """Augmentations one after another: kept if they raise the validation score (by the threshold, if there is one)."""
    kept: dict[str, list[int]] = {}
    score = value(_matrix(train, base, y), _matrix(validation, base, y))
    gains = {}
    for name, places in candidates.items():
        chosen = base | kept | {name: places}
        now = value(_matrix(train, chosen, y), _matrix(validation, chosen, y))
        gains[name] = now - score
        if gains[name] > 0 if threshold is None else gains[name] >= threshold:
            kept[name], score = places, now
    return kept, gains


def create_hybrid(
    df: DataFrame, reps: list[str], key: str = "id", y: str = "y", allocation: str = "greedy", importance: str | Importance = "random_forest", budget: int = 100, n_per_rep: int = 100, step: int = 10, patience: int | None = 3, validation: float = 0.2,
    filters: str | None = None, augmentations: tuple[str, ...] = (), augmentation: str = "none", augmentation_budget: int = 20, threshold: float | None = None, value: Value = forest_value,
) -> tuple[DataFrame, Hybrid]:
    """(rows with ``features``, what was chosen) from array columns ``reps`` and labels ``y``.

    Allocations: ``fixed`` (n_per_rep each), ``performance_weighted`` (the budget shared by each
    representation's own validation score), ``greedy`` (forward, ``step`` at a time), ``mrmr``
    (counts of a relevance-redundancy order over all features). Importance and allocation see the
    training rows only; the first ``validation`` of the rows in hash order validate. Augmentations
    are all added, or by ``greedy_ablation``. Bad labels, widths and parameters are errors.
    """
    if not reps:
        raise ValueError("no representations")
    in_bounds(budget=budget, step=step, n_per_rep=n_per_rep, augmentation_budget=augmentation_budget, validation=validation, patience=patience)
    if allocation not in ("fixed", "performance_weighted", "greedy", "mrmr"):
        raise ValueError(f"unknown allocation {allocation!r}")
    if augmentation not in ("none", "all", "greedy_ablation"):
        raise ValueError(f"unknown augmentation {augmentation!r}")
    score = importance_of(importance)
    check_labels(df, y)
    width = widths(df, [*reps, *augmentations])
    clean = finite(df, [*reps, *augmentations])
    kept = None
    if filters is not None:
        kept = {r: S.vector_quality(clean, r, *S.FILTERS[filters]) for r in reps}
        if empty := [r for r in reps if not kept[r]]:
            raise ValueError(f"all features of {empty} are filtered out")
    split = internal_validation(clean, key, validation)
    train, held = split.filter("not is_validation"), split.filter("is_validation")
    most = n_per_rep if allocation == "fixed" else budget
    ranked = ranked_features(train, reps, kept, score, most, key, y)
    history: list[tuple[str, float]] = []
    if allocation == "fixed":
        counts = {r: len(p) for r, p in ranked.items()}
    elif allocation == "performance_weighted":
        scores = [(r, float(value(_matrix(train, {r: p}, y), _matrix(held, {r: p}, y))), len(p)) for r, p in ranked.items()]
        counts = {x["rep"]: x["n"] for x in S.allocate(df.sparkSession.createDataFrame(scores, "rep string, score double, width long"), budget).collect()}
    elif allocation == "greedy":
        counts, history = greedy_forward(train, held, ranked, budget, step, patience, value, y)
    else:
        places = [(r, p) for r in reps for p in (sorted(kept[r]) if kept else range(width[r]))]
        both = S.apply_selection(train, {r: [p for q, p in places if q == r] for r in reps}, "x")
        c = S.correlation_matrix(both.withColumn("x", F.concat("x", F.array(F.col(y).cast("double")))), "x")
        taken = [places[i][0] for i in S.greedy_relevance(abs(c[-1, :-1]), c[:-1, :-1], budget)]
        counts = {r: taken.count(r) for r in reps}
    out = Hybrid({r: ranked[r][: counts.get(r, 0)] for r in reps}, {r: counts.get(r, 0) for r in reps}, history)
    if augmentations and augmentation != "none":
        rows = train if augmentation == "greedy_ablation" else split
        places = {a: list(range(width[a])) if width[a] <= augmentation_budget else ranked_features(rows, [a], None, score, augmentation_budget, key, y)[a] for a in augmentations}
        if augmentation == "all":
            out.augmentations = places
        else:
            out.augmentations, out.gains = evaluate_augmentations(train, held, out.selection, places, threshold, value, y)
    return out.apply(clean), out
