"""Exact Lloyd rounds over integer vectors, filtered by ball trees.

Each task builds trees of at most ``TREE_ROWS`` of its own rows and they are written once: a node
holds its centre, radius, count and integer sum, leaves hold the vectors. A round ships the
centroids to the tasks. A ball with centre m and radius r is nobody else's than centroid a's when
for every other centroid b d(m, b) - r > d(m, a) + r; then its count and sum go to a at once.
Otherwise the centroids that this rules out are dropped and its children are looked at, down to the
leaves, where integer distances decide (ties: the smaller number). A task gives out one row for each
centroid and component, whatever it read, so a round's shuffle and what reaches the driver are
bounded by centroids times components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, materialize, read_table

#: Vectors of a tree; of a leaf.
TREE_ROWS, LEAF_ROWS = 8_192, 32
#: Up to the first size products are exact in doubles, up to the second distances are in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 1 << 20, 1 << 27
#: Share of a distance that rounding may take, with room.
SLACK = 1e-9
TREE = "ids array<long>, points binary, begin binary, stop binary, child binary, centre binary, radius binary, total binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


class Tree:
    """A ball tree: node i covers points begin[i]:stop[i]; its children are child[i] and child[i] + 1, -1 for a leaf."""

    def __init__(self, points: np.ndarray, begin: np.ndarray, stop: np.ndarray, child: np.ndarray, centre: np.ndarray, radius: np.ndarray, total: np.ndarray) -> None:
        self.points, self.begin, self.stop, self.child, self.centre, self.radius, self.total = points, begin, stop, child, centre, radius, total

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of integral doubles, and the order its points are in."""
        n, dims = points.shape
        order, nodes = np.arange(n), [[0, n, -1, None, np.inf, None]]
        exact = np.abs(points).max(initial=0) <= EXACT_LONG  # else one leaf: sums and radii wouldn't be
        i = 0
        while i < len(nodes):
            a, b = nodes[i][:2]
            p = points[order[a:b]]
            nodes[i][3] = centre = p.mean(axis=0) if exact else np.zeros(dims)
            nodes[i][5] = p.sum(axis=0) if exact else np.zeros(dims)
            if exact:
                away = np.sqrt(((p - centre) ** 2).sum(axis=1))
                nodes[i][4] = away.max()
                if b - a > LEAF_ROWS and (p.max(axis=0) > p.min(axis=0)).any():
                    one = p[away.argmax()]
                    other = p[((p - one) ** 2).sum(axis=1).argmax()]
                    order[a:b] = order[a:b][np.argsort(p @ (other - one), kind="stable")]
                    nodes[i][2], half = len(nodes), (a + b) // 2
                    nodes += [[a, half, -1, None, np.inf, None], [half, b, -1, None, np.inf, None]]
            i += 1
        begin, stop, child, centre, radius, total = zip(*nodes, strict=True)
        ints = (np.array(x, dtype=np.int32) for x in (begin, stop, child))
        return cls(points[order], *ints, np.array(centre), np.array(radius), np.array(total).astype(np.int64)), order

    def parts(self) -> list[bytes]:
        return [x.tobytes() for x in (self.points, self.begin, self.stop, self.child, self.centre, self.radius, self.total)]

    @classmethod
    def read(cls, parts: list, dims: int) -> Tree:
        points, begin, stop, child, centre, radius, total = (np.frombuffer(p, t) for p, t in zip(parts, ("f8", "i4", "i4", "i4", "f8", "f8", "i8"), strict=True))
        return cls(points.reshape(-1, dims), begin, stop, child, centre.reshape(-1, dims), radius, total.reshape(-1, dims))

    def settle(self, centroids: np.ndarray, whole: Callable[[int, int], None], some: Callable[[int, int, np.ndarray], None]) -> None:
        """Calls ``whole(node, centroid)`` for balls of one centroid, ``some(begin, stop, centroids)`` for leaves' rows."""
        places = centroids.astype(float)
        nodes, open_to = np.zeros(1, dtype=np.int64), np.ones((1, len(places)), dtype=bool)
        while len(nodes):
            far, r = np.sqrt(((self.centre[nodes][:, None] - places) ** 2).sum(axis=2)), self.radius[nodes][:, None]
            slack = SLACK * (far + r + 1)
            most = np.where(open_to, far + r + slack, np.inf).min(axis=1, keepdims=True)
            open_to = open_to & ~(far - r - slack > most)  # a bound that isn't a number rules nothing out
            one, leaf = open_to.sum(axis=1) == 1, self.child[nodes] < 0
            for node, row in zip(nodes[one], open_to[one]):
                whole(int(node), int(row.argmax()))
            for node, row in zip(nodes[~one & leaf], open_to[~one & leaf]):
                some(int(self.begin[node]), int(self.stop[node]), assign(self.points[self.begin[node] : self.stop[node]], centroids, np.flatnonzero(row)))
            deeper = ~one & ~leaf
            nodes, open_to = np.concatenate([self.child[nodes[deeper]], self.child[nodes[deeper]] + 1]), np.concatenate([open_to[deeper]] * 2)


def integers(points: np.ndarray) -> np.ndarray:
    """Integral doubles as 64-bit integers where squares of differences sum up in those, else as Python's."""
    if np.abs(points).max(initial=0) <= EXACT_LONG:
        return points.astype(np.int64)
    return np.array([[int(x) for x in row] for row in points], dtype=object)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integral doubles to integer centroids, a column each."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if most <= EXACT_DOUBLE:
        c = centroids.astype(float)
        return ((points**2).sum(axis=1)[:, None] - 2 * (points @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    p, c = (integers(points), centroids) if most <= EXACT_LONG else (integers(points).astype(object), centroids.astype(object))
    return np.stack([((p - x) ** 2).sum(axis=1) for x in c], axis=1)


def assign(points: np.ndarray, centroids: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    return candidates[distances(points, centroids[candidates]).argmin(axis=1)]  # the first of equals


def build_trees(vectors: DataFrame, dims: int, scale: float, rows: int = TREE_ROWS) -> DataFrame:
    """Trees over floor(scale * x) of ``vectors`` (vec_id, vector), as many rows each as ``rows``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def tree() -> pa.RecordBatch:
            points = np.floor(scale * np.concatenate(held).astype(float))
            made, order = Tree.build(points)
            named = pa.array([ids[i] for i in order], pa.int64())
            columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), named), *(pa.array([x], pa.binary()) for x in made.parts())]
            return pa.record_batch(columns, [c.split()[0] for c in TREE.split(", ")])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for a in range(0, batch.num_rows, rows):
                ids += batch.column(0)[a : a + rows].to_pylist()
                held.append(flat[a : a + rows])
                if len(ids) >= rows:
                    yield tree()
                    ids, held = [], []
        if ids:
            yield tree()

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>")).mapInArrow(build, TREE)


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, Tree.read([batch.column(c)[i].as_buffer() for c in range(1, 8)], dims)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of their vectors' mean in each component; empty ones stay."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, np.zeros((k, dims), dtype=object)
        for _, tree in _trees(batches, dims):

            def whole(node: int, c: int, tree: Tree = tree) -> None:
                counts[c] += int(tree.stop[node] - tree.begin[node])
                totals[c] += tree.total[node]

            def some(begin: int, stop: int, labels: np.ndarray, tree: Tree = tree) -> None:
                points = integers(tree.points[begin:stop])
                for c in np.unique(labels):
                    counts[c] += int((labels == c).sum())
                    totals[c] += points[labels == c].sum(axis=0)

            tree.settle(centroids, whole, some)
        rows = [(c, i, counts[c], Decimal(int(x) >> 64), Decimal(int(x) & (1 << 64) - 1)) for c in range(k) if counts[c] for i, x in enumerate(totals[c])]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["c", "i", "n", "high", "low"])

    out = centroids.astype(object)
    sums = trees.mapInArrow(add, "c int, i int, n long, high decimal(38,0), low decimal(38,0)").groupBy("c", "i").agg(*(F.sum(x).alias(x) for x in ("n", "high", "low")))
    for r in sums.collect():  # k * dims rows at most
        out[r["c"], r["i"]] = ((int(r["high"]) << 64) + int(r["low"])) // r["n"]
    return _narrow(out)


def _narrow(centroids: np.ndarray) -> np.ndarray:
    return centroids.astype(np.int64) if max(map(abs, centroids.flat), default=0) <= EXACT_LONG else centroids


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector; a distance beyond 64 bits is null."""
    dims = centroids.shape[1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dims):
            labels = np.zeros(len(ids), dtype=np.int32)

            def whole(node: int, c: int, tree: Tree = tree, labels: np.ndarray = labels) -> None:
                labels[tree.begin[node] : tree.stop[node]] = c

            def some(begin: int, stop: int, found: np.ndarray, labels: np.ndarray = labels) -> None:
                labels[begin:stop] = found

            tree.settle(centroids, whole, some)
            far = np.zeros(len(ids), dtype=object)
            for c in np.unique(labels):
                far[labels == c] = distances(tree.points[labels == c], centroids[c : c + 1])[:, 0]
            yield pa.record_batch([ids, pa.array(labels), pa.array([int(x) if x < 1 << 63 else None for x in far], pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(label, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """``vectors`` (vec_id, vector) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite component are left out,
    and an empty table gives no rows. The first centroids are those whose id's hash is smallest
    (fewer, if there are fewer vectors; a null id is never one, equal ids go by their vectors).
    Repeated rows and ids are vectors of their own, a null id stays. Distances and sums beyond 64
    bits are null, assignments are exact all the same.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).filter(usable(F.col("vector"), dims))
    ranked = good.filter("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = ranked.orderBy("hash", "vector").select("vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = _narrow(np.array([[int(np.floor(scale * x)) for x in r["vector"]] for r in first], dtype=object))
    trees = materialize(build_trees(good, dims, scale), "trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    labelled = materialize(assigned(trees, centroids), "assigned")
    discard(trees)
    inertia = {r["cluster"]: r["s"] for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: None if x is None or x >= 1 << 63 else int(x)
    total = fits(None if None in inertia.values() else sum(inertia.values()))
    stats = [(c, fits(s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in inertia.items()]
    return labelled.join(F.broadcast(spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*(c.split()[0] for c in RESULT.split(", ")))


def op13_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same by joins of every vector with every centroid, a component a row."""
    parts = [
        """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT r, vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM e),
v AS (SELECT r, vec_id, i, floor(64 * x)::BIGINT AS x FROM u WHERE r NOT IN (SELECT r FROM u WHERE x IS NULL OR NOT isfinite(x))),""",
        f"c0 AS (SELECT c, i, x FROM v JOIN (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT r, vec_id FROM v) QUALIFY c < {k}) USING (r)),",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"d{n} AS (SELECT r, c, sum((v.x - k.x) * (v.x - k.x)) AS d FROM v JOIN c{n} k USING (i) GROUP BY ALL), a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r),"
            f"\ns{n} AS (SELECT a.c, i, sum(v.x) AS s, count(*) AS n FROM v JOIN a{n} a USING (r) GROUP BY ALL),"
            f"\nc{n + 1} AS (SELECT c, i, coalesce((s - (s % n + n) % n) // n, k.x)::BIGINT AS x FROM c{n} k LEFT JOIN s{n} USING (c, i)),"
        )
    n = rounds
    parts.append(f"""h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{n} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{n} JOIN (SELECT DISTINCT r, vec_id FROM v) USING (r) JOIN h USING (c)""")
    return "\n".join(parts)


OP13_SQL = _sql()
