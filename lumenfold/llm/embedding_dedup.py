"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

A table is a bundle of random one-dimensional projections. Its first projections cut the space into
cells (steps with a random shift); within a cell the vectors are sorted by the last projection, and
each vector collides with those in the window centred on it. (One projection's window meets at
best ``1 / sqrt(1 - threshold)``, 4.5 times, as many of a threshold pair's as of a strangers' pair,
so windows over the whole table would meet about as many pairs as there are, at any width; the
first projections, whose number grows with the logarithm of the number of vectors, leave a vector
about as many strangers in its cell at any size.) A pair collides at most once in a table. Pairs
with at least ``COUNT`` collisions are verified by their cosine. The number of tables is calibrated:
the smallest at which a pair right at the threshold reaches the count with probability ``RECALL``.

Sorting is by strips of a window's width within a cell; a strip also gets the rows of the next one,
where its windows end. A strip with many rows is cut into blocks that meet two by two, so no
task holds more than two blocks and what its windows give is passed on in batches. Equal vectors are
collapsed to one before anything is paired. The links of a dense group of different vectors are
counted one by one: their number is that of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, materialize, read_table

THRESHOLD = 0.95
RECALL = 0.97
COUNT = 2
#: Width of a step and half-width of a window, in standard deviations of a projection.
STEP, WINDOW = 1.0, 0.6
#: Rows of a strip in one block; rows and pairs that are worked on at once.
BLOCK_ROWS = 8_192
FLUSH_ROWS, LEFT_ROWS, PAIRS = 65_536, 65_536, 500_000
SEED = 11


def _same_step(sigma: float) -> float:
    """P(two points fall on the same step) when their difference is normal with this deviation."""
    x = (np.arange(20_000) + 0.5) / 20_000 * STEP
    return float(2 * ((1 - x / STEP) * np.exp(-((x / sigma) ** 2) / 2) / (sigma * math.sqrt(2 * math.pi))).sum() * STEP / 20_000)


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL, count: int = COUNT) -> tuple[int, int]:
    """(first projections in a table, tables) for n vectors."""
    far = _same_step(math.sqrt(2))
    steps = max(1, round(math.log(max(n, 2) / 12) / -math.log(far))) if n > 12 else 1
    sigma = math.sqrt(max(2 - 2 * threshold, 1e-9))
    p = _same_step(sigma) ** steps * math.erf(WINDOW / sigma / math.sqrt(2))
    tables = count
    while 1 - sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count)) < recall:
        tables += 1
    return steps, tables


def usable(x) -> F.Column:  # noqa: ANN001
    """Not null or empty, all components finite, not all zero."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def cosine(x, y, nx, ny):  # noqa: ANN001, ANN201
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / (nx * ny)


def meetings(classes: DataFrame, steps: int, tables: int, seed: int = SEED) -> DataFrame:
    """(rep, cell, at): each vector's place in each table. Vectors of other lengths never share a cell."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                x = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                rng = np.random.default_rng([seed, int(d)])
                places = x @ rng.standard_normal((d, tables * (steps + 1)))
                shift = rng.random((tables, steps))
                for t in range(tables):
                    own = places[:, t * (steps + 1) : (t + 1) * (steps + 1)]
                    key = np.full(len(rows), np.uint64((t + 1) * 0x9E3779B97F4A7C15 + int(d) & 0xFFFFFFFFFFFFFFFF))
                    for step in np.floor(own[:, :steps] / STEP + shift[t]).astype(np.int64).T:
                        key = (key ^ step.view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                        key ^= key >> np.uint64(32)
                    yield pa.record_batch([pa.array(reps[rows]), pa.array(key.view(np.int64)), pa.array(own[:, steps])], ["rep", "cell", "at"])

    return classes.select("rep", "x").mapInArrow(project, "rep long, cell long, at double")


def window_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs that collide, from rows (cell, strip, lo, hi, part, at, own, rep) sorted by all but the last two.

    In a group (cell, strip, lo, hi) each own row of block ``lo`` meets the rows of ``hi`` that are in
    its window, and the other way round if the blocks differ; of two rows the lower one finds the pair.
    """

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        cell, strip, lo, hi, part, at, own, rep = (c.to_numpy() for c in t.columns)
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (cell[1:] != cell[:-1]) | (strip[1:] != strip[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new)
        for mine, other in ((lo, hi), (hi, lo)):
            left, right = np.flatnonzero((part == mine) & own), np.flatnonzero(part == other)
            if mine is hi:
                left = left[lo[left] != hi[left]]
            # Groups lie apart on one axis, so that a sorted search stays within a group.
            place = group * (at.max() - at.min() + 2 * WINDOW) + at
            first, last = np.searchsorted(place[right], place[left] - 1e-9), np.searchsorted(place[right], place[left] + WINDOW + 1e-9)
            for k in range(0, len(left), LEFT_ROWS):
                f, n = first[k : k + LEFT_ROWS], (last - first)[k : k + LEFT_ROWS]
                edges = np.cumsum(n)
                for u, v in _slices(edges, PAIRS):
                    i = np.repeat(left[k + u : k + v], n[u:v])
                    j = right[np.repeat(f[u:v] - (edges[u:v] - n[u:v]) + (edges[u - 1] if u else 0), n[u:v]) + np.arange(n[u:v].sum())]
                    ahead = at[j] - at[i]
                    ok = ((ahead > 0) | ((ahead == 0) & (rep[j] > rep[i]))) & (ahead <= WINDOW)
                    x, y = rep[i[ok]], rep[j[ok]]
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FLUSH_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t.column(c).to_numpy() for c in range(4)]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from flush(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield from flush(pa.Table.from_batches(held).combine_chunks())


def _slices(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows, given the running sum of their sizes, where about ``most`` are together."""
    u = 0
    while u < len(edges):
        v = max(u + 1, int(np.searchsorted(edges, (edges[u - 1] if u else 0) + most, side="right")))
        yield u, v
        u = v


def collisions(meetings: DataFrame) -> DataFrame:
    """(a, b, n): pairs of vectors and the number of tables in which they collide, from (rep, cell, at)."""
    m = meetings.withColumn("strip", F.floor(F.col("at") / WINDOW))
    m = m.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1)))).select("rep", "cell", (F.col("strip") - F.col("_d")).alias("strip"), "at", (F.col("_d") == 0).alias("own"))
    size = m.groupBy("cell", "strip").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).filter("n > 1 and any")
    m = m.join(size, ["cell", "strip"])
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    m = m.withColumn("part", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.select("cell", "strip", F.least("part", "_other").alias("lo"), F.greatest("part", "_other").alias("hi"), "part", "at", "own", "rep")
    m = m.repartition("cell", "strip", "lo", "hi").sortWithinPartitions("cell", "strip", "lo", "hi", "at")
    return m.mapInArrow(window_pairs, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def links(classes: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, cosine) of linked vectors of ``classes`` (rep, x, norm), a < b."""
    steps, tables = calibrate(n, threshold)
    pairs = collisions(materialize(meetings(classes, steps, tables), "meetings")).filter(F.col("n") >= COUNT).select("a", "b")
    v = classes.select("rep", "x", "norm")
    both = pairs.join(v.toDF("a", "x", "nx"), "a").join(v.toDF("b", "y", "ny"), "b")
    return both.withColumn("cosine", cosine(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))).filter((F.size("x") == F.size("y")) & (F.col("cosine") >= threshold)).select("a", "b", "cosine")


def dedup(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    A vector that is null or empty, zero, or holds null or non-finite components has no links and
    is its own component. So is a row with a null vec_id, which other vectors don't count either.
    Each row counts as a vector of its own, also where ids or vectors repeat. An empty table gives
    no rows; other columns are left out.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    ok = usable(F.col("x")) & F.col("vec_id").isNotNull()
    key = lambda seed: F.when(ok, F.xxhash64(F.lit(seed), "x"))  # noqa: E731  two independent hashes name a vector by 128 bits
    largest = F.array_max(F.transform("x", F.abs))
    norm = largest * F.sqrt(F.aggregate(F.transform("x", lambda c: (c / largest) ** 2), F.lit(0.0), lambda s, c: s + c))
    v = v.withColumns({"h": key(1), "g": key(2)})
    classes = v.filter("h is not null").groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")).withColumn("norm", norm)
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    linked = materialize(links(classes, classes.count(), threshold), "links")
    sizes = classes.select("rep", "n")
    around = linked.select("a", "b").union(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes.toDF("b", "n"), "b").groupBy("a").agg(F.sum("n").alias("around"))
    components = connected_components(linked)
    told = classes.select("h", "g", "rep", "low", "n").join(around, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "rep"))
    lowest = told.groupBy("_c").agg(F.min("low").alias("component_id"))
    told = told.join(lowest, "_c").select("h", "g", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), "component_id")
    out = v.select("vec_id", "h", "g").join(told, ["h", "g"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
