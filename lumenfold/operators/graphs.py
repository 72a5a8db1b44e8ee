"""Features of many small labelled graphs, given as an edge table (g, src, dst) with both directions.

Everything is grouped by graph, so graphs spread over tasks; refinement and distances are joins on
(g, node) repeated a fixed or checked number of times.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.ranks import name_ranked

#: Graphs with more rows than this (links and labelled nodes) are refined by joins, not as one row each.
ROW_GRAPH = 200_000


def refinement_histogram(edges: DataFrame, labels: DataFrame, rounds: int = 5, most: int = ROW_GRAPH) -> DataFrame:
    """(g, label, n): counts of the labels "round_label" that neighbourhood refinement gives.

    ``labels`` is (g, node, label). A round's label is the node's label and its neighbours' sorted
    labels, hashed so that its length stays bounded. Isolated nodes refine to their own label. A
    graph of at most ``most`` rows travels as one row, one shuffle for all rounds; larger ones are
    refined by joins, round by round, where one row holds a node's neighbours at most.
    """
    link = edges.select("g", F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(None).cast("string").alias("label")).alias("p"))
    node = labels.filter("label is not null").select("g", F.struct(F.col("node").cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("label").cast("string").alias("label")).alias("p"))
    large = edges.select("g").union(labels.filter("label is not null").select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("g")
    if large.isEmpty():
        return _refined_in_rows(link.union(node), rounds)
    within, beyond = (lambda d: d.join(large, "g", "left_anti")), (lambda d: d.join(large, "g", "left_semi"))
    return _refined_in_rows(within(link.union(node)), rounds).union(_refined_by_joins(beyond(edges), beyond(labels.filter("label is not null")), rounds))


def _refined_in_rows(parts: DataFrame, rounds: int) -> DataFrame:
    def refine(parts: list) -> Counter:
        now = {p["src"]: p["label"] for p in parts if p["label"] is not None}
        near: dict[int, list[int]] = {}
        for p in parts:
            if p["label"] is None and p["src"] in now and p["dst"] in now:
                near.setdefault(p["src"], []).append(p["dst"])
        found = Counter(f"0_{label}" for label in now.values())
        for r in range(1, rounds + 1):
            now = {v: hashlib.md5(f"{label}|{'_'.join(sorted(now[u] for u in near.get(v, ())))}".encode()).hexdigest() for v, label in now.items()}
            found.update(f"{r}_{label}" for label in now.values())
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(g, label, n) for g, parts in zip(pdf["g"], pdf["parts"], strict=True) for label, n in refine(parts).items()], columns=["g", "label", "n"])

    return parts.groupBy("g").agg(F.collect_list("p").alias("parts")).mapInPandas(run, "g long, label string, n long")


def _refined_by_joins(edges: DataFrame, labels: DataFrame, rounds: int) -> DataFrame:
    now = labels.select("g", F.col("node").cast("long").alias("node"), F.col("label").cast("string").alias("label"))
    links = edges.select("g", F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("dst"))
    counts = lambda d, r: d.groupBy("g", F.concat(F.lit(f"{r}_"), "label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = counts(now, 0)
    for r in range(1, rounds + 1):
        seen = links.join(now.select("g", F.col("node").alias("dst"), F.col("label").alias("other")), ["g", "dst"])
        around = seen.groupBy("g", "node").agg(F.array_join(F.sort_array(F.collect_list("other")), "_").alias("around"))
        now = now.join(around, ["g", "node"], "left").select("g", "node", F.md5(F.concat("label", F.lit("|"), F.coalesce("around", F.lit("")))).alias("label")).checkpoint()
        out = out.union(counts(now, r))
    return out.select(F.col("g").cast("long").alias("g"), "label", "n")


def label_places(histogram: DataFrame) -> DataFrame:
    """(label, place): the vocabulary of training graphs, places from 0 in the labels' order."""
    return name_ranked(histogram.select("label").distinct(), "label", "place", "n").drop("n")


def placed_counts(histogram: DataFrame, places: DataFrame) -> DataFrame:
    """(g, place, n): counts over a training vocabulary, for the same or other graphs; unseen labels are dropped."""
    return histogram.join(places, "label").select("g", "place", "n")


def vocabulary_counts(histogram: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts over a training vocabulary (label); unseen labels are dropped."""
    return histogram.join(vocabulary.select("label").distinct(), "label", "left_semi")


def degree_features(edges: DataFrame) -> DataFrame:
    """(g, nodes, edges, degree mean, max and population deviation, density)."""
    d = edges.groupBy("g", "src").agg(F.count(F.lit(1)).alias("_d"))
    out = d.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("_d") / 2).cast("long").alias("edges"), F.avg("_d").alias("degree_mean"), F.max("_d").alias("degree_max"), F.stddev_pop("_d").alias("degree_std"))
    return out.withColumn("density", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def clustering(edges: DataFrame) -> DataFrame:
    """(g, clustering): mean over nodes of the share of neighbour pairs that are linked; 0 for degrees under 2."""
    d = edges.groupBy("g", "src").agg(F.count(F.lit(1)).alias("_d"))
    a, b = edges.select("g", "src", F.col("dst").alias("_x")), edges.select("g", "src", F.col("dst").alias("_y"))
    closed = a.join(b, ["g", "src"]).filter("_x < _y").join(edges.select("g", F.col("src").alias("_x"), F.col("dst").alias("_y")), ["g", "_x", "_y"]).groupBy("g", "src").agg(F.count(F.lit(1)).alias("_t"))
    c = d.join(closed, ["g", "src"], "left").withColumn("_c", F.when(F.col("_d") > 1, F.coalesce("_t", F.lit(0)) * 2 / (F.col("_d") * (F.col("_d") - 1))).otherwise(0.0))
    return c.groupBy("g").agg(F.avg("_c").alias("clustering"))


def hop_distances(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(g, src, dst, hops) of pairs that a path links, at most ``max_hops`` long; a node is 0 from itself.

    A graph is small and travels as one row, so many are searched in one batch.
    """

    def search(links: list) -> list[tuple[int, int, int]]:
        near: dict[int, set[int]] = {}
        for e in links:
            near.setdefault(e["src"], set()).add(e["dst"])
        out = []
        for start in near:
            seen, front, h = {start: 0}, [start], 0
            while front and (max_hops is None or h < max_hops):
                h += 1
                front = [n for n in set().union(*(near.get(f, set()) for f in front)) if n not in seen]
                seen.update(dict.fromkeys(front, h))
            out += [(start, end, hops) for end, hops in seen.items()]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(g, *found) for g, links in zip(pdf["g"], pdf["links"], strict=True) for found in search(links)]
            yield pd.DataFrame(rows, columns=["g", "src", "dst", "hops"])

    whole = edges.groupBy("g").agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    return whole.mapInPandas(run, "g long, src long, dst long, hops int")


def path_features(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph (g, nodes): path mean, maximum and sum, eccentricity mean and deviation, periphery and centre sizes.

    Of a disconnected graph the diameter and radius are -1, as for a single node; the other
    features are over reachable pairs.
    """
    pairs = hops.filter("src <> dst")
    ecc = pairs.groupBy("g", "src").agg(F.max("hops").alias("_e"), F.count(F.lit(1)).alias("_r"))
    e = ecc.groupBy("g").agg(F.max("_e").alias("_d"), F.min("_e").alias("_m"), F.avg("_e").alias("ecc_mean"), F.stddev_pop("_e").alias("ecc_std"), F.min("_r").alias("_reach"))
    ends = ecc.join(e.select("g", "_d", "_m"), "g").groupBy("g").agg(F.count_if(F.col("_e") == F.col("_d")).alias("periphery"), F.count_if(F.col("_e") == F.col("_m")).alias("center"))
    p = pairs.groupBy("g").agg(F.avg("hops").alias("path_mean"), F.max("hops").alias("path_max"), (F.sum("hops") / 2).alias("wiener"))
    out = p.join(e, "g").join(ends, "g").join(nodes, "g")
    whole = (F.col("_reach") == F.col("nodes") - 1) & (F.col("nodes") > 1)
    return out.select("g", "path_mean", "path_max", "wiener", "ecc_mean", "ecc_std", "periphery", "center", F.when(whole, F.col("_d")).otherwise(-1).alias("diameter"), F.when(whole, F.col("_m")).otherwise(-1).alias("radius"))


def distance_features(hops: DataFrame) -> DataFrame:
    """Per graph, over its largest component (of equal ones that with the least node): nodes, path mean, maximum, sum and deviation, eccentricity mean and deviation, periphery and centre sizes.

    ``hops`` must reach as far as any path does. Nodes are summed by graph and component, then by
    their eccentricity: no join, and one shuffle by graph. Graphs without a link have no row.
    """
    h = F.col("hops").cast("long")
    by_node = hops.repartition("g").groupBy("g", "src").agg(F.min("dst").alias("_root"), F.max(h).alias("_e"), F.count(F.lit(1)).alias("_r"), F.sum(h).alias("_s"), F.sum(h * h).alias("_q"))
    by_ecc = by_node.groupBy("g", "_root", "_e").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col("_r") - 1).alias("_p"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    e, c = F.col("_e"), F.col("_c")
    parts = by_ecc.groupBy("g", "_root").agg(F.sum(c).alias("nodes"), F.sum("_p").alias("p"), F.sum("_s").alias("s"), F.sum("_q").alias("q"), F.sum(c * e).alias("es"), F.sum(c * e * e).alias("eq"), F.max(e).alias("path_max"), F.max_by(c, e).alias("periphery"), F.min_by(c, e).alias("center"))
    best = parts.groupBy("g").agg(F.max_by(F.struct("nodes", "p", "s", "q", "es", "eq", "path_max", "periphery", "center"), F.struct(F.col("nodes"), -F.col("_root"))).alias("b")).select("g", "b.*")
    deviation = lambda q, s, n: F.sqrt(F.greatest(F.lit(0.0), (F.col(q) * F.col(n) - F.col(s) * F.col(s)) / (F.col(n) * F.col(n))))  # noqa: E731  (whole numbers up to the division)
    return best.filter("nodes > 1").select("g", "nodes", (F.col("s") / F.col("p")).alias("path_mean"), "path_max", (F.col("s") / 2).alias("wiener"), deviation("q", "s", "p").alias("path_std"), (F.col("es") / F.col("nodes")).alias("ecc_mean"), deviation("eq", "es", "nodes").alias("ecc_std"), "periphery", "center")


def component_counts(hops: DataFrame) -> DataFrame:
    """(g, components), from hop distances that reach as far as any path does."""
    return hops.groupBy("g", "src").agg(F.min("dst").alias("_root")).groupBy("g").agg(F.count_distinct("_root").alias("components"))


def spectral_features(edges: DataFrame, k: int = 10) -> DataFrame:
    """(g, eigenvalues): the k smallest of the normalized Laplacian, 0 included, padded with zeros. One small matrix per graph."""

    def solve(links: list) -> np.ndarray:
        names, at = np.unique([e["src"] for e in links], return_inverse=True)
        a = np.zeros((len(names), len(names)))
        a[at, np.searchsorted(names, [e["dst"] for e in links])] = 1
        d = 1 / np.sqrt(a.sum(axis=1))
        values = np.linalg.eigvalsh(np.eye(len(names)) - d[:, None] * a * d[None, :])[:k]
        return np.pad(values, (0, k - len(values)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"g": pdf["g"], "eigenvalues": [solve(links) for links in pdf["links"]]})

    whole = edges.groupBy("g").agg(F.collect_set(F.struct("src", "dst")).alias("links"))
    return whole.mapInPandas(run, "g long, eigenvalues array<double>")


def token_vocabulary(tokens: DataFrame, size: int, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """(token, n, place): the ``size`` tokens in most documents; ties to the larger token."""
    return _most_frequent(tokens.select(doc, token).distinct().select(token), size, token)


def row_vocabulary(docs: DataFrame, size: int, tokens: str = "tokens", token: str = "token") -> DataFrame:
    """``token_vocabulary`` of documents that are a row each, with an array of tokens: repeats go before anything is shuffled."""
    return _most_frequent(docs.select(F.explode(F.array_distinct(tokens)).alias(token)), size, token)


def _most_frequent(held: DataFrame, size: int, token: str) -> DataFrame:
    n = held.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.orderBy(F.desc("n"), F.desc(token)).limit(size).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc(token))))


def sort_and_slice(tokens: DataFrame, vocabulary: DataFrame, doc: str = "doc_id", token: str = "token", binary: bool = False) -> DataFrame:
    """(doc, place, value): counts, or 0/1, of the vocabulary's tokens; others are dropped."""
    c = tokens.join(F.broadcast(vocabulary.select(token, "place")), token).groupBy(doc, "place").agg(F.count(F.lit(1)).alias("value"))  # the vocabulary's size is a parameter
    return c.withColumn("value", F.lit(1)) if binary else c
