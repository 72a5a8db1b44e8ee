"""Distances and exact nearest neighbours.

Neighbours within a metric go by parts around pivots where rows cluster: a row is shuffled once to be
found, and once for each block of a part that can hold one of its neighbours. Where a sample of rows
would have to ask most parts, and where no triangle inequality holds, every row meets every other:
blocks of asking rows stay in a task while held rows stream past them (``streamed``). What needs all
pairs goes block against block (``against_all``): rows are dealt into blocks of bounded size and every
pair of blocks is one group. No way makes a pair table; a task gives out the k best it has seen for
each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.tiles import ANGLES, METRICS, Best
from lumenfold.operators.tiles import matrix as _matrix
from lumenfold.sources.readers import scratch

BLOCK_ROWS = 2_000
#: Bytes of vectors, and rows, that a task holds of those that ask while held ones stream past; rows whose distances to pivots are a matrix at a time.
ASKING_BYTES, ASKING_ROWS, SLICE_ROWS = 16 << 20, 32_768, 1_000
#: Tasks for each core of a search of all rows, and at most; rows of the sample, and the share of parts it may ask, that decide how to search.
TASKS_PER_CORE, MAX_TASKS, SAMPLE_ROWS, OPEN_SHARE = 4, 20_000, 128, 0.25
#: Pivots at most: their distances to one another, and to a batch of rows, are held as matrices.
MAX_PIVOTS = 1_024
#: Share of a distance that rounding may take, with room.
SLACK = 1e-9


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _fold(x: Column, y: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)


def distance(x: Column, y: Column, metric: str = "euclidean") -> Column:
    """Distance of two array columns; cosine with a zero vector is 1."""
    if metric == "euclidean":
        return F.sqrt(_fold(x, y, lambda a, b: (a - b) * (a - b)))
    if metric == "manhattan":
        return _fold(x, y, lambda a, b: F.abs(a - b))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))
    if metric == "minkowski_3":
        return F.pow(_fold(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(3.0))), F.lit(1 / 3))
    if metric == "canberra":
        return _fold(x, y, lambda a, b: F.when(F.abs(a) + F.abs(b) > 0, F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0))
    if metric == "braycurtis":
        return _fold(x, y, lambda a, b: F.abs(a - b)) / _fold(x, y, lambda a, b: F.abs(a + b))
    if metric == "cosine":
        norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
        return F.when(norms > 0, 1 - _dot(x, y) / norms).otherwise(1.0)
    if metric == "correlation":
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / F.size(v)
        n, mx, my = F.size(x), mean(x), mean(y)
        return 1 - (_dot(x, y) - n * mx * my) / (F.sqrt(_dot(x, x) - n * mx * mx) * F.sqrt(_dot(y, y) - n * my * my))
    raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")


class Pivots:
    """Reference rows that cut a metric space into parts, each row to its nearest one (ties: the first).

    Cosine and correlation distances are half the square of a chord between unit vectors; a zero
    vector stands at a right angle to all others, on an axis of its own.
    """

    def __init__(self, rows: np.ndarray, metric: str) -> None:
        self.metric = metric
        self.points = np.unique(self.embedded(rows), axis=0)
        self.inner = "euclidean" if metric in ANGLES else metric
        self.between = _matrix(self.points, self.points, self.inner)

    def embedded(self, x: np.ndarray) -> np.ndarray:
        if self.metric not in ANGLES:
            return x
        x = x - x.mean(axis=1, keepdims=True) if self.metric == "correlation" else x
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x / np.where(norm > 0, norm, 1), norm == 0])

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        return _matrix(self.embedded(x), self.points, self.inner)

    def length(self, distance: np.ndarray) -> np.ndarray:
        """The space's length of a distance of rows."""
        return np.sqrt(2 * np.maximum(distance, 0)) if self.metric in ANGLES else distance

    def nearer(self, far: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(rows, parts): the least distance that a row can have to a row of each part, which reaches ``radius`` around its pivot."""
        away = far[np.arange(len(own)), own][:, None]
        least = np.maximum(far - radius, (far - away) / 2)
        if self.inner == "euclidean":  # the plane between two pivots
            gap = self.between[own]
            least = np.maximum(least, np.where(gap > 0, (far**2 - away**2) / (2 * np.where(gap > 0, gap, 1)), 0))
        return least - SLACK * (1 + far)


def choose_pivots(d: DataFrame, metric: str, rows: int, part_rows: int) -> Pivots:
    """Pivots from a hash sample of rows: one for about ``part_rows`` rows, ``MAX_PIVOTS`` at most."""
    n = min(MAX_PIVOTS, max(1, rows // part_rows))
    sample = d.orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(n).select("_x").collect()
    return Pivots(np.array([r["_x"] for r in sample], dtype=float).reshape(len(sample), -1), metric)


def sliced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of bounded size: a row's distances to pivots may take more room than the row."""
    for pdf in frames:
        for a in range(0, len(pdf), SLICE_ROWS):
            yield pdf.iloc[a : a + SLICE_ROWS]


def in_parts(d: DataFrame, pivots: Pivots) -> DataFrame:
    """Adds ``_part``, the nearest pivot, and ``_far``, the distance to it."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(frames):
            far = pivots.far(np.array(pdf["_x"].tolist(), dtype=float))
            yield pdf.assign(_part=far.argmin(axis=1), _far=far.min(axis=1))

    return d.mapInPandas(place, f"{_ddl(d)}, _part int, _far double")


def _ddl(d: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)


def visit(asking: DataFrame, held: DataFrame, make: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, groups: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``make(asking, held)`` for the rows of ``asking`` with the blocks of ``held`` that have their ``_part`` (and groups).

    A part's held rows are cut into blocks by its counted size, each held row is shuffled once, and
    rows that ask go to every block of the part. A task takes up one block and streams what asks it.
    Both sides have the same columns.
    """
    keys = [*(groups or []), "_part"]
    sizes = held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_m"))
    block = F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int")
    both = (
        held.join(sizes, keys).withColumns({"_b": block, "_q": F.lit(False)})
        .unionByName(asking.join(sizes, keys).withColumns({"_b": F.explode(F.sequence(F.lit(0), F.col("_m") - 1)), "_q": F.lit(True)})).drop("_m")
    )
    by = [*keys, "_b"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept = None, []
        for pdf in frames:
            for k, rows in pdf.groupby(by, sort=False, dropna=False):
                if k != key:
                    key, kept = k, []
                if (own := rows[~rows["_q"]]).size:
                    kept.append(own)
                if (asked := rows[rows["_q"]]).size and kept:
                    kept = [pd.concat(kept)]
                    yield make(asked, kept[0])

    return both.repartition(*by).sortWithinPartitions(*by, "_q", "_id").mapInPandas(run, schema)


def _nearest(k: int, metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        best = Best(asked["_id"].to_numpy(), np.array(asked["_x"].tolist(), dtype=float), k, metric)
        best.see(held["_id"].to_numpy(), np.array(held["_x"].tolist(), dtype=float))
        return pd.concat([pd.DataFrame({"_id": best.ids[r], "_n": who, "_d": far}) for r, who, far in best.told()])

    return nearest


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), -1)


def streamed(d: DataFrame, k: int, metric: str, within: float = np.inf, groups: list[str] | None = None, kept: list[str] | None = None, asking_rows: int | None = None) -> DataFrame:
    """(kept, _id, _n, _d): of all rows of (_id, _x) with equal ``groups``, whole numbers, the k nearest to each that a task sees, nearer than ``within``.

    Asking rows are dealt into blocks, held ones into stripes, by the counted size of their group; each
    task lets one stripe stream past one block. A row is shuffled once for each stripe and once for each
    block. ``kept`` columns of asking rows are given out too.
    """
    g, kept = groups or [], kept or []
    sizes = d.groupBy(*g).agg(F.count(F.lit(1)).alias("_c"))
    width = d.select(F.size("_x").alias("_w")).first()
    if width is None:
        return d.select(*kept, "_id", F.col("_id").alias("_n"), F.lit(0.0).alias("_d")).filter("false")
    most = asking_rows or max(1, min(ASKING_ROWS, ASKING_BYTES // (8 * max(1, width[0]))))
    wanted = TASKS_PER_CORE * d.sparkSession.sparkContext.defaultParallelism
    square = sizes.agg(F.sum(F.col("_c").cast("double") ** 2)).first()[0]
    own = F.least(F.lit(float(wanted)) * F.col("_c") ** 2 / square, F.col("_c"))  # tasks that a group should have
    sizes = sizes.withColumn("_a", F.greatest(F.ceil(F.col("_c") / most), F.ceil(F.sqrt(own)))).withColumn("_s", F.ceil(own / F.col("_a"))).drop("_c")
    tasks = min(MAX_TASKS, sizes.agg(F.sum(F.col("_a") * F.col("_s"))).first()[0])
    d = d.join(sizes, g) if g else d.crossJoin(F.broadcast(sizes))
    block, stripe = F.pmod(F.xxhash64("_id"), F.col("_a")), F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_s"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    both = (
        d.withColumn("_i", block).withColumn("_j", every("_s")).withColumn("_held", F.lit(False))
        .unionByName(d.withColumn("_j", stripe).withColumn("_i", every("_a")).withColumn("_held", F.lit(True)))
        .withColumn("_p", F.pmod(F.xxhash64(*(g or [F.lit(0)])) + F.col("_i") * F.col("_s") + F.col("_j"), F.lit(tasks)).cast("int"))
    ).drop("_a", "_s")
    by = [*g, "_i", "_j"]
    schema = ", ".join([*(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in kept), "_id long, _n long, _d double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, best = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            for r, who, far in best.told():
                own = [pa.concat_arrays([b.column(c) for b in asking]).take(pa.array(r)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(best.ids[r]), pa.array(who), pa.array(far)], names=[*kept, "_id", "_n", "_d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*by, "_held"]])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part, now, held = batch.slice(s, e - s), tuple(keys[s, :-1]), keys[s, -1]
                if now != key:
                    yield from told()
                    key, asking, best = now, [], None
                if not held:
                    asking.append(part)
                elif asking:
                    best = best or Best(np.concatenate([b.column("_id").to_numpy() for b in asking]), np.concatenate([_vectors(b.column("_x")) for b in asking]), k, metric, within)
                    best.see(part.column("_id").to_numpy(), _vectors(part.column("_x")))
        yield from told()

    return both.repartitionById(tasks, F.col("_p")).sortWithinPartitions(*by, "_held").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("_id").orderBy("_d", "_n"))).filter(F.col("rank") <= k)


def routed(d: DataFrame, k: int, metric: str, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For an exact k-neighbour search: rows with the parts they must ask (_id, _x, _part), the best of their own part (_id, _n, _d), all rows in their parts.

    A row looks in its own part first. The k-th distance found there, or what the parts' sizes around
    their pivots prove, bounds how far its neighbours can be; parts that the triangle inequality keeps
    farther away aren't asked. What reaches the driver is k + 1 distances for each pivot.
    """
    pivots = choose_pivots(d, metric, d.count(), block_rows)
    parts = in_parts(d, pivots)
    stats = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("_far"))).filter(F.col("_r") <= k + 1).groupBy("_part").agg(F.collect_list("_far").alias("near"))
    radius, shortest = np.full(len(pivots.points), -np.inf), np.full((len(pivots.points), k + 1), np.inf)
    for r in stats.join(parts.groupBy("_part").agg(F.max("_far").alias("most")), "_part").collect():
        radius[r["_part"]] = r["most"]
        shortest[r["_part"], : len(r["near"])] = sorted(r["near"])
    # Within this of a part's pivot there are k + 1 rows, so k others than the row itself.
    around = np.array([np.partition((gap[:, None] + shortest).ravel(), k)[k] for gap in pivots.between])
    held = parts.select("_id", "_x", "_part")
    own = _best(visit(held, held, _nearest(k, metric), "_id long, _n long, _d double", block_rows=block_rows), k)
    reach = own.groupBy("_id").agg(F.when(F.count(F.lit(1)) == k, F.max("_d")).alias("_kth"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(frames):
            x = np.array(pdf["_x"].tolist(), dtype=float)
            far, part = pivots.far(x), pdf["_part"].to_numpy()
            proven = pdf["_far"].to_numpy() + around[part]
            if metric in ANGLES:  # two zero vectors are no chord apart, but a right angle
                proven[pivots.embedded(x)[:, -1] > 0] = np.inf
            within = np.fmin(pivots.length(pdf["_kth"].to_numpy(dtype=float)), proven)
            open_to = pivots.nearer(far, part, radius) <= within[:, None] + SLACK * (1 + np.where(np.isfinite(within), within, 0))[:, None]
            open_to[np.arange(len(part)), part] = False
            i, j = np.nonzero(open_to & np.isfinite(radius))
            yield pd.DataFrame({"_id": pdf["_id"].to_numpy()[i], "_x": pdf["_x"].to_numpy()[i], "_part": j.astype("int32")})

    asking = parts.join(reach, "_id", "left").mapInPandas(route, "_id long, _x array<double>, _part int")
    return asking, own.select("_id", "_n", "_d"), held


def open_share(d: DataFrame, pivots: Pivots, metric: str, k: int = 1, length: float | None = None) -> float:
    """The share of parts that a hash sample of rows would have to ask: those behind which a row's k-th neighbour, or ``length``, reaches.

    The sample's k-th distances come from one pass over all rows.
    """
    rows = d.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(SAMPLE_ROWS).select("_id", "_x").collect()
    if not rows:
        return 0.0
    ids, x = np.array([r["_id"] for r in rows]), np.array([r["_x"] for r in rows], dtype=float)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, x, k, metric)
        for batch in batches:
            if batch.num_rows:
                best.see(batch.column("_id").to_numpy(), _vectors(batch.column("_x")))
        for r, _, far in best.told():
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(far)], names=["_r", "_d"])

    if length is None:
        found = d.select("_id", "_x").mapInArrow(look, "_r long, _d double").groupBy("_r").agg(F.element_at(F.array_sort(F.collect_list("_d")), F.least(F.lit(k), F.count(F.lit(1)).cast("int"))).alias("d"))
        kth = np.full(len(rows), np.inf)
        for r in found.collect():
            kth[r["_r"]] = r["d"]
        reach = pivots.length(kth)
    else:
        reach = np.full(len(rows), length)
    far = pivots.far(x)
    least = pivots.nearer(far, far.argmin(axis=1), np.full(len(pivots.points), np.inf))
    return float((least <= reach[:, None] * (1 + SLACK) + SLACK).mean())


def neighbors(df: DataFrame, k: int, metric: str = "euclidean", key: str = "id", vector: str = "x", block_rows: int = BLOCK_ROWS, asking_rows: int | None = None) -> DataFrame:
    """(key, neighbor, distance, rank) of the k nearest other rows; ties by key. Vectors have one length, no nulls.

    Rows are dealt to parts around pivots, and ask those parts only that can hold a neighbour (see
    ``routed``); where a sample would ask more than ``OPEN_SHARE`` of them, and for Braycurtis, which
    obeys no triangle inequality, all rows are asked (``streamed``). What is found of more than a block
    is written to the shared folder, so that whatever reads it again doesn't search again.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    d = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"))
    rows = d.count()
    if rows <= block_rows:  # one block has nothing to skip
        found = against_all(d, _nearest(k, metric), "_id long, _n long, _d double", block_rows)
    elif metric == "braycurtis" or open_share(d, choose_pivots(d, metric, rows, block_rows), metric, k) > OPEN_SHARE:
        found = streamed(d, k, metric, asking_rows=asking_rows)
    else:
        asking, own, held = routed(d, k, metric, block_rows)
        found = own.union(visit(asking, held, _nearest(k, metric), "_id long, _n long, _d double", block_rows=block_rows))
    best = _best(found, k).select(F.col("_id").alias(key), F.col("_n").alias("neighbor"), F.col("_d").alias("distance"), "rank")
    if rows <= block_rows:
        return best
    path = scratch(df.sparkSession, "neighbors")
    best.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(best.schema).parquet(path)


def against_all(df: DataFrame, make: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS, groups: list[str] | None = None, asked: Column | None = None) -> DataFrame:
    """``make(asked, held)`` for every two blocks of rows (with equal ``groups``): a block is bounded, so no task holds more than two.

    ``df`` has the column ``_id``. A group's number of blocks follows from its size, so a hot one is
    cut up. ``asked`` picks the rows that ask; all are held.
    """
    g = groups or []
    sizes = df.groupBy(*g).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_m"))
    d = (df.join(sizes, g) if g else df.crossJoin(F.broadcast(sizes))).withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_m")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    queries = (d if asked is None else d.filter(asked)).withColumns({"_i": F.col("_b"), "_j": F.col("_o"), "_q": F.lit(True)})
    rows = d.withColumns({"_i": F.col("_o"), "_j": F.col("_b"), "_q": F.lit(False)})
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, h = pdf[pdf["_q"]], pdf[~pdf["_q"]]
        return make(a, h) if len(a) and len(h) else pd.DataFrame({n: [] for n in names})

    return queries.unionByName(rows).drop("_b", "_o", "_m").groupBy(*g, "_i", "_j").applyInPandas(run, schema)


def pairs_within(df: DataFrame, radius: float, metric: str = "euclidean", groups: list[str] | None = None, key: str = "id", vector: str = "x", limit: int | None = None, block_rows: int = BLOCK_ROWS, asking_rows: int | None = None) -> DataFrame:
    """(groups, key, neighbor, distance) of pairs in a group closer than the radius, at most ``limit`` nearest per row.

    As in ``neighbors``, a row asks those parts only that reach within the radius, or all rows of its
    group where that would be most of them and ``limit`` bounds what is found; a null group is one
    like others.
    """
    g = groups or []

    def close(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([some(a.iloc[s : s + SLICE_ROWS], h) for s in range(0, len(a), SLICE_ROWS)])

    def some(a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        ai, hi = a["_id"].to_numpy(), h["_id"].to_numpy()
        m = _matrix(np.array(a["_x"].tolist(), dtype=float), np.array(h["_x"].tolist(), dtype=float), metric)
        m[ai[:, None] == hi[None, :]] = np.inf
        i, j = np.nonzero(m < radius)
        if limit is not None:  # of a block no more than the limit can be among the nearest
            order = np.lexsort((hi[j], m[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < limit], j[place < limit]
        return pd.DataFrame({c: a[c].to_numpy()[i] for c in g} | {key: ai[i], "neighbor": hi[j], "distance": m[i, j]})

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in g)
    schema = f"{kinds}{key} long, neighbor long, distance double"
    d = df.select(*g, F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"))
    if metric == "braycurtis":
        near = against_all(d, close, schema, block_rows, groups=g)
    else:
        numbers = [f"_g{i}" for i in range(len(g))]
        d = d.withColumns({n: F.xxhash64(c) for n, c in zip(numbers, g, strict=True)})  # a null joins, as a number
        rows = d.count()
        pivots = choose_pivots(d, metric, rows, block_rows)
        length = float(pivots.length(np.array([radius]))[0]) * (1 + SLACK) + SLACK
        if limit is not None and rows > block_rows and open_share(d, pivots, metric, length=length) > OPEN_SHARE:
            near = streamed(d, limit, metric, radius, numbers, g, asking_rows)
            near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "_id").orderBy("_d", "_n"))).filter(F.col("_r") <= limit)
            return near.select(*g, F.col("_id").alias(key), F.col("_n").alias("neighbor"), F.col("_d").alias("distance"))
        parts = in_parts(d, pivots)
        reach = np.full(len(pivots.points), -np.inf)
        for r in parts.groupBy("_part").agg(F.max("_far").alias("most")).collect():
            reach[r["_part"]] = r["most"]

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in sliced(frames):
                x, part = np.array(pdf["_x"].tolist(), dtype=float), pdf["_part"].to_numpy()
                least = pivots.nearer(pivots.far(x), part, reach)
                least[np.arange(len(part)), part] = -np.inf
                i, j = np.nonzero((least <= length) & np.isfinite(reach))
                yield pdf.iloc[i].assign(_part=j.astype("int32"))

        held = parts.drop("_far")
        near = visit(held.mapInPandas(route, _ddl(held)), held, close, schema, numbers, block_rows)
    if limit is None:
        return near
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*g, key).orderBy("distance", "neighbor"))).filter(F.col("_r") <= limit).drop("_r")


def pair_order_statistic(df: DataFrame, values: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], k: int, high: float, bins: int = 4_096, few: int = 100_000) -> float:
    """The k-th smallest (from 0) of what ``values`` gives for all pairs of rows, numbers from 0 to ``high``, exactly.

    The pairs are never kept: a pass counts them by bin, the bin that holds the k-th is the next
    pass's range, and once it holds ``few`` at most they are looked at.
    """
    lo, hi, closed = 0.0, high, True
    while np.nextafter(lo, np.inf) < hi:
        edges = np.linspace(lo, hi, bins + 1)

        def place(a: pd.DataFrame, h: pd.DataFrame, edges: np.ndarray = edges, closed: bool = closed) -> tuple[np.ndarray, np.ndarray]:
            v = values(a, h)
            v = v[(v >= edges[0]) & ((v <= edges[-1]) if closed else (v < edges[-1]))]
            return v, np.minimum(np.searchsorted(edges, v, side="right") - 1, bins - 1)

        def count(a: pd.DataFrame, h: pd.DataFrame, place=place) -> pd.DataFrame:  # noqa: ANN001
            at, n = np.unique(place(a, h)[1], return_counts=True)
            return pd.DataFrame({"bin": at, "n": n})

        found = against_all(df, count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()  # at most ``bins`` rows
        upto = found["n"].cumsum().to_numpy()
        at = int(np.searchsorted(upto, k, side="right"))
        b, n = int(found["bin"].iloc[at]), int(found["n"].iloc[at])
        k -= int(upto[at]) - n
        if n <= few:

            def inside(a: pd.DataFrame, h: pd.DataFrame, place=place, b: int = b) -> pd.DataFrame:  # noqa: ANN001
                v, i = place(a, h)
                return pd.DataFrame({"v": v[i == b]})

            return float(np.sort(against_all(df, inside, "v double").toPandas()["v"].to_numpy())[k])
        lo, hi, closed = float(edges[b]), float(edges[b + 1]), closed and b == bins - 1
    return lo


def pair_quantile(df: DataFrame, values: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], share: float, high: float, pairs: int) -> float:
    """The quantile of the values of ``pairs`` pairs, between neighbouring order statistics by linear interpolation."""
    place = (pairs - 1) * share
    k = int(place)
    low = pair_order_statistic(df, values, k, high)
    return low if place == k else low + (place - k) * (pair_order_statistic(df, values, k + 1, high) - low)


def activity_cliffs(df: DataFrame, distance_share: float = 0.1, label_share: float = 0.9, key: str = "id", vector: str = "x", y: str = "y") -> DataFrame:
    """(key, cliffs): for each row the others that are nearer than a quantile of all distances but whose label is farther than a quantile of all label gaps.

    Distances count each pair once, gaps every ordered pair and a row with itself. Work is quadratic
    by definition; it goes block against block, and no pair is kept.
    """
    from lumenfold.operators import cliffs

    d = df.select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_x"), F.col(y).cast("double").alias("_y"))
    if d.limit(2).count() < 2:
        return df.select(key, F.lit(0).cast("long").alias("cliffs")).filter("false")
    found = cliffs.activity_cliffs(d, distance_share, label_share)
    return found.select(F.col("_id").cast(df.schema[key].dataType).alias(key), F.col("n").alias("cliffs"))


def whitened(df: DataFrame, vector: str = "x") -> DataFrame:
    """Vectors times the inverse root of their sample covariance: Euclidean distances between them are Mahalanobis distances.

    The covariance, as wide as a vector, comes from one pass of partial sums.
    """
    from lumenfold.operators.information import covariance

    _, c = covariance(df, vector)
    values, axes = np.linalg.eigh(c)
    root = axes @ np.diag(np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)) @ axes.T
    rows = F.array(*(F.array(*map(F.lit, map(float, r))) for r in root))
    return df.withColumn(vector, F.transform(rows, lambda r: _dot(r, F.col(vector))))


def standardize_vectors(df: DataFrame, vector: str = "x", weights: list[float] | None = None) -> DataFrame:
    """Components minus their mean over their population deviation (0 where that is 0), times the root of a weight."""
    stats = df.select(F.posexplode(vector).alias("_p", "_v")).groupBy("_p").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_s"))
    arrays = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m", "_s"))), lambda s: F.struct(s["_m"].alias("m"), s["_s"].alias("s"))).alias("_stats"))  # one row: as wide as a vector
    z = F.zip_with(vector, "_stats", lambda v, s: F.when(s["s"] > 0, (v - s["m"]) / s["s"]).otherwise(0.0))
    if weights is not None:
        z = F.zip_with(z, F.array(*(F.lit(w**0.5) for w in weights)), lambda v, w: v * w)
    return df.crossJoin(F.broadcast(arrays)).withColumn(vector, z).drop("_stats")


def gram_codes(text: str, n: int = 3) -> np.ndarray:
    """The set of a text's n-grams (n at most 3), sorted, each as one exact number."""
    letters = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(letters) < n:
        return np.zeros(0, dtype=np.int64)
    code = letters[: len(letters) - n + 1].copy()
    for i in range(1, n):
        code = (code << 21) | letters[i : len(letters) - n + 1 + i]
    return np.unique(code)


def _shared(asked: list[np.ndarray], held: list[np.ndarray]) -> np.ndarray:
    """Numbers of shared codes, held by asked: those that many asked sets hold by a matrix product, others by postings."""
    q, codes = np.repeat(np.arange(len(asked)), [len(a) for a in asked]), np.concatenate([*asked, np.zeros(0, dtype=np.int64)])
    order = np.argsort(codes, kind="stable")
    q, codes = q[order], codes[order]
    words, start, n = np.unique(codes, return_index=True, return_counts=True)
    common = n * 16 > len(asked)
    place = np.cumsum(common) - 1
    wide = np.zeros((len(asked), int(common.sum())), dtype=np.float32)
    of_common = np.repeat(common, n)
    wide[q[of_common], np.repeat(place, n)[of_common]] = 1
    mine, out = np.zeros((len(held), wide.shape[1]), dtype=np.float32), np.zeros((len(held), len(asked)), dtype=np.int64)
    for k, h in enumerate(held):
        at = np.searchsorted(words, h)
        inside = at < len(words)
        at = at[inside][words[at[inside]] == h[inside]]
        mine[k, place[at[common[at]]]] = 1
        rare = at[~common[at]]
        if len(rare):
            many = n[rare]
            first = np.repeat(start[rare] - (np.cumsum(many) - many), many)
            out[k] = np.bincount(q[first + np.arange(many.sum())], minlength=len(asked))
    return out + (mine @ wide.T).astype(np.int64)


def nearest_grams(asked: DataFrame, held: DataFrame, key: str = "id", text: str = "text", n: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, best): the largest Tanimoto similarity of each asked row's n-gram set with a held row's, 0 for empty sets.

    Held rows with the asked row's own key don't count. Whole texts, every asked row with every held row, block against block as in ``neighbors``.
    """
    of = lambda d: max(1, -(-d.count() // block_rows))
    ni, nj = of(asked), of(held)
    place = lambda m: F.pmod(F.xxhash64("_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kept = lambda d, q: d.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.lit(q).alias("_q"))
    both = kept(asked, True).withColumn("_i", place(ni)).withColumn("_j", every(nj)).union(kept(held, False).withColumn("_j", place(nj)).withColumn("_i", every(ni)).select("_id", "_t", "_q", "_i", "_j"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, h = pdf[pdf["_q"]], pdf[~pdf["_q"]]
        if a.empty or h.empty:
            return pd.DataFrame({"_id": [], "best": []}).astype({"_id": "int64", "best": "float64"})
        ga, gh = [gram_codes(t, n) for t in a["_t"]], [gram_codes(t, n) for t in h["_t"]]
        shared = _shared(ga, gh)
        union = np.array([len(x) for x in gh])[:, None] + np.array([len(x) for x in ga])[None, :] - shared
        own = h["_id"].to_numpy()[:, None] == a["_id"].to_numpy()[None, :]
        best = np.where(own, -1.0, shared / np.maximum(union, 1)).max(axis=0)
        return pd.DataFrame({"_id": a["_id"].to_numpy(), "best": best})[best >= 0]

    found = both.groupBy("_i", "_j").applyInPandas(best, "_id long, best double")
    return found.groupBy(F.col("_id").alias(key)).agg(F.max("best").alias("best"))


def tanimoto(x: Column, y: Column) -> Column:
    """Shared share of two sets given as arrays."""
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
