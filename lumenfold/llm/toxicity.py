"""Toxicity by a classifier chain over labelled categories.

The linear model of each category sees which of the chosen words and word beginnings a text
holds, a few shape ratios, and the log-odds of the categories before it. In training those
log-odds are out-of-fold predictions, so that a later model learns how good the earlier ones are on
texts they haven't seen; in scoring they come from the models fitted to all training rows.

Training uses at most ``MAX_TRAINING_ROWS`` labelled documents (hash order, a documented bound);
scoring is one pass over whole texts that shuffles nothing. Word counts for choosing features are
aggregated by Spark; the driver sees the chosen features (``MAX_FEATURES`` a category) and, of each
training row, which of them it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize, or_empty, read_table

MAX_TRAINING_ROWS = 20_000
MAX_FEATURES = 512
MIN_DOCUMENTS = 5
FOLDS = 5
BEGINNING = 5
SHAPES = 5
WORDS = re.compile(r"\w+")


def describe(text: str) -> tuple[set[str], list[float]]:
    """Words and marked word beginnings in lower case, and shape ratios; nothing for a text without words."""
    raw = WORDS.findall(text)
    if not raw:
        return set(), [0.0] * SHAPES
    different = set(raw)
    words = {w.lower() for w in different}
    shapes = [math.log1p(len(raw)) / 10, len(different) / len(raw), sum(map(str.isupper, different)) / len(different), text.count("!") / len(text) * 10, text.count("|") / len(text) * 10]
    return words | {f"{w[:BEGINNING]}*" for w in words if len(w) > BEGINNING}, shapes


@dataclass
class Sparse:
    """Rows of 0/1 features by index, beside dense columns."""

    row: np.ndarray
    col: np.ndarray
    dense: np.ndarray
    width: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=len(self.dense)) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, weights=r[self.row], minlength=self.width), r @ self.dense])

    def take(self, rows: np.ndarray) -> Sparse:
        at = np.full(len(self.dense), -1)
        at[rows] = np.arange(len(rows))
        keep = at[self.row] >= 0
        return Sparse(at[self.row[keep]], self.col[keep], self.dense[rows], self.width)


def fit_linear(x: Sparse, y: np.ndarray, decay: float = 5e-4, rounds: int = 150) -> np.ndarray:
    """Logistic regression with an L2 penalty, by accelerated gradient steps scaled per column."""
    n, dims = len(y), x.width + x.dense.shape[1]
    # Columns' step sizes: the curvature bound shared out over the features that a row holds.
    held = np.bincount(x.row, minlength=n) + (x.dense**2).sum(axis=1)
    bound = np.concatenate([np.bincount(x.col, weights=held[x.row], minlength=x.width), np.abs(x.dense).T @ (held / np.maximum(1, np.abs(x.dense).sum(axis=1)) * np.abs(x.dense).sum(axis=1))]) / (4 * n) + decay
    w, v, t = np.zeros(dims), np.zeros(dims), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(v), -30, 30)))
        step = v - (x.back(p - y) / n + decay * v) / bound
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = step + (t - 1) / nxt * (step - w), step, nxt
    return w


@dataclass
class Chain:
    """Categories in order, and of each its features' weights: [features..., shapes..., earlier log-odds..., intercept].

    ``cuts``: of each category the log-odds from which a text counts as in it.
    """

    categories: list[str]
    features: list[dict[str, float]] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)

    def log_odds(self, words: set[str], shapes: list[float]) -> list[float]:
        out: list[float] = []
        for weights, rest in zip(self.features, self.rest, strict=True):
            z = sum(weights[w] for w in words & weights.keys()) + float(np.dot(rest, [*shapes, *out, 1.0]))
            out.append(max(-30.0, min(30.0, z)))
        return out


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds at which the F1 measure of out-of-fold predictions is largest: midway to the next row below."""
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(z) + 1) + max(1.0, y.sum()))
    f1[:-1][z[order][1:] == z[order][:-1]] = -1  # no cut within a tie
    k = int(f1.argmax())
    return float((z[order][k] + z[order][k + 1]) / 2) if k + 1 < len(z) else float(z[order][k])


def choose_features(sample: DataFrame, categories: list[str]) -> list[list[str]]:
    """Of each category the features whose share of documents differs most between its classes, in standard errors."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seen, marked = Counter(), [Counter() for _ in categories]
            for text, *ys in zip(pdf["text"], *(pdf[c] for c in categories), strict=True):
                words = describe(text)[0]
                seen.update(words)
                for counter, y in zip(marked, ys, strict=True):
                    if y:
                        counter.update(words)
            words = list(seen)
            yield pd.DataFrame({"word": words, "n": [seen[w] for w in words]} | {c: [m[w] for w in words] for c, m in zip(categories, marked, strict=True)})

    totals = sample.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    counts = sample.mapInPandas(count, "word string, n long, " + ", ".join(f"`{c}` long" for c in categories)).groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories)).filter(F.col("n") >= MIN_DOCUMENTS)
    counts = materialize(counts, "word-counts")
    out = []
    for c in categories:
        one, zero = float(totals[c] or 0), float((totals["n"] or 0) - (totals[c] or 0))
        if not one or not zero:
            out.append([])
            continue
        share = F.col("n") / F.lit(one + zero)
        z = F.abs(F.col(c) / one - (F.col("n") - F.col(c)) / zero) / F.sqrt(share * (1 - share) * (1 / one + 1 / zero) + 1e-12)
        out.append([r["word"] for r in counts.orderBy(z.desc(), "word").limit(MAX_FEATURES).select("word").collect()])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_TRAINING_ROWS) -> Chain:
    """Fit the chain to at most ``max_rows`` documents, by hash of their ids.

    Rows with a null label are left out; repeated labels of a document count as their largest, and
    rows that repeat both doc_id and text count once. Labels of absent documents count for nothing.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in categories)).na.drop().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    picked = texts.select("doc_id", "text_key").join(y, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "text_key").limit(max_rows)
    picked = materialize(picked, "picked")
    sample = materialize(texts.join(F.broadcast(picked), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]), "training")  # at most max_rows rows are broadcast, and stay
    features = choose_features(sample, categories)
    index = {w: i for i, w in enumerate(sorted(set().union(*features)))}

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            told = [describe(t) for t in pdf["text"]]
            yield pd.DataFrame({"fold": pdf["fold"], "held": [[index[w] for w in words & index.keys()] for words, _ in told], "shapes": [s for _, s in told]} | {c: pdf[c] for c in categories})

    rows = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")).select("doc_id", "text", "fold", *categories)
    rows = rows.sortWithinPartitions("doc_id", "text").mapInPandas(held, "fold int, held array<int>, shapes array<double>, " + ", ".join(f"`{c}` int" for c in categories)).toPandas()  # max_rows rows at most
    chain = Chain(categories)
    if rows.empty:
        chain.features, chain.rest, chain.cuts = [{} for _ in categories], [np.array([0.0] * (SHAPES + k) + [-30.0]) for k in range(len(categories))], [0.0 for _ in categories]
        return chain
    lengths = rows["held"].map(len).to_numpy()
    row, col = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.asarray(h, dtype=np.int64) for h in rows["held"]])
    dense, fold = np.array(rows["shapes"].tolist()), rows["fold"].to_numpy()
    names = sorted(index, key=index.get)
    for category, own in zip(categories, features, strict=True):
        at = np.full(len(index), -1)
        at[[index[w] for w in own]] = np.arange(len(own))
        keep = at[col] >= 0 if len(col) else np.zeros(0, dtype=bool)
        x = Sparse(row[keep], at[col[keep]], np.column_stack([dense, np.ones(len(dense))]), len(own))
        y = rows[category].to_numpy().astype(float)
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            out = np.flatnonzero(fold == k)
            if len(out):
                inside = np.flatnonzero(fold != k)
                unseen[out] = np.clip(x.take(out).times(fit_linear(x.take(inside), y[inside])), -30, 30) if len(inside) else 0
        w = fit_linear(x, y)
        chain.features.append({names[index[o]]: float(v) for o, v in zip(own, w[: x.width], strict=True)})
        chain.rest.append(w[x.width :])
        chain.cuts.append(best_cut(unseen, y) if y.any() else 0.0)
        dense = np.column_stack([dense, unseen])
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and the probability of each category: one row per input row, by its whole text.

    A null text, or one without words, has probability 0 of every category.
    """
    names = [f"p_{c}" for c in chain.categories]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words, shapes = describe(text.as_py())
                out.append([1 / (1 + math.exp(-z)) for z in chain.log_odds(words, shapes)] if words else [0.0] * len(names))
            cols = np.array(out, dtype=float).reshape(-1, len(names))
            yield pa.record_batch([batch.column(0), *(pa.array(cols[:, k]) for k in range(len(names)))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), or_empty(F.col("text"))).mapInArrow(add, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows, with all their columns, that the chain's last category doesn't reject. Nothing is shuffled."""
    cut = chain.cuts[-1]

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        told = (describe(t) for t in texts)
        return pd.Series([bool(words) and chain.log_odds(words, shapes)[-1] >= cut for words, shapes in told])

    return docs.filter(~rejected(or_empty(F.col("text"))))


def label_categories(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The categories of the labels table in chain order: low quality, then toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, is_toxic: toxic from the chain's cut, which its out-of-fold predictions set."""
    y, categories = label_categories(labels)
    chain = train(docs, y, categories)
    return score(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= 1 / (1 + math.exp(-chain.cuts[-1])))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
