"""Activity cliffs: near rows with far labels, near and far being quantiles over all pairs.

Rows are dealt into blocks; each two blocks meet in one task, whose distances are tiles of matrix
products (``tiles.Products``). A pass counts the pairs below each of some bounds, exactly: pairs that
rounding leaves open are computed anew in double precision. No pair is kept but the few between the
last two bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.tiles import ASKING, HELD, PAIRS, Products, apart

#: Rows of a block, tasks for each core, bounds of a pass over distances and over label gaps, pairs that are looked at, rows of the sample that proposes the first bounds and the share of pairs it may be wrong by.
BLOCK, TASKS_PER_CORE, BOUNDS, GAP_BOUNDS, FEW, SAMPLE, WRONG = 16_384, 5, 256, 64, 100_000, 1_500, 0.02

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def dealt(d: DataFrame, n: int, block_rows: int = BLOCK) -> tuple[DataFrame, int]:
    """Rows (_id, _x, _y) once for each pair of blocks that theirs is of; a pair is one partition, ``_first`` tells its blocks apart."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    m = max(-(-n // block_rows), min(n, int(np.ceil(np.sqrt(2 * TASKS_PER_CORE * cores)))))
    own, other = F.col("_b"), F.col("_o")
    low, high = F.least(own, other), F.greatest(own, other)
    out = d.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(m))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    out = out.withColumns({"_p": (high * (high + 1) / 2 + low).cast("int"), "_first": own <= other, "_same": own == other})
    return out.drop("_b", "_o").repartitionById(m * (m + 1) // 2, F.col("_p")), m


def met(rows: DataFrame, make: Callable[[Rows, Rows | None], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``make(first, second)`` for each pair of blocks; ``second`` is None for a block with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        ids, y = table["_id"].to_numpy(), table["_y"].to_numpy()
        x = np.asarray(table["_x"].chunk(0).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(ids), -1)
        first, same = table["_first"].to_numpy(), bool(table["_same"][0].as_py())
        a, b = (ids[first], x[first], y[first]), None if same else (ids[~first], x[~first], y[~first])
        if len(a[0]) and (same or len(b[0])):
            out = make(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.values()], names=list(out))

    return rows.select("_id", "_x", "_y", "_first", "_same").mapInArrow(run, schema)


def tiles(a: Rows, b: Rows | None) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """(row, column, least squares of distances, how much more they may be, scale) of each tile; of a block with itself the pairs of a row and a later one."""
    by, held = Products(a[1], "euclidean"), a[1] if b is None else b[1]
    if not by.sound.all():
        raise ValueError("vectors must be finite")
    for c in range(0, len(held), HELD):
        view, size, sound = by.view(held[c : c + HELD])
        if not sound.all():
            raise ValueError("vectors must be finite, and not a million times as long as others")
        for r in range(0, len(a[0]) if b is not None else min(len(a[0]), c + HELD), ASKING):
            rows = slice(r, min(r + ASKING, len(a[0])))
            p = by.rows[rows] @ view.T
            p *= -2
            p += (by.size[rows, None] ** 2).astype(np.float32)
            doubt = 2 * float(by.doubt(rows, float(size.max())).max()) + 16 * by.unit * float(by.size[rows].max() ** 2 + size.max() ** 2 + 1e-30)
            p -= np.float32(doubt / 2)
            if b is None and c < rows.stop:
                p[np.arange(r, rows.stop)[:, None] >= np.arange(c, c + p.shape[1])[None, :]] = np.inf
            yield r, c, p, 2 * doubt, by.scale


def open_pairs(p: np.ndarray, more: float, scale: float, low: float, high: float) -> tuple[np.ndarray, int]:
    """Cells of a tile whose distances may be from ``low`` to below ``high``, and how many are surely below ``low``."""
    under = p < np.float32(np.float64(low / scale) ** 2 * (1 - 1e-6) - more) if low > 0 else np.zeros(p.shape, dtype=bool)
    reach = p <= np.float32(np.float64(high / scale) ** 2 * (1 + 1e-6))
    return np.flatnonzero(reach & ~under), int(np.count_nonzero(under))


def distances(a: Rows, b: Rows | None, r: int, c: int, cells: np.ndarray, width: int) -> np.ndarray:
    """The distances of a tile's cells, in double precision."""
    held, out = a[1] if b is None else b[1], np.empty(len(cells))
    for s in range(0, len(cells), PAIRS):
        i, j = np.divmod(cells[s : s + PAIRS], width)
        out[s : s + PAIRS] = apart(a[1][i + r], held[j + c], "euclidean")
    return out


def nearer_than(edges: np.ndarray) -> Callable[[Rows, Rows | None], dict[str, np.ndarray]]:
    """Counts pairs whose distance is below each of the edges."""

    def count(a: Rows, b: Rows | None) -> dict[str, np.ndarray]:
        found = np.zeros(len(edges) + 1, dtype=np.int64)
        for r, c, p, more, scale in tiles(a, b):
            cells, under = open_pairs(p, more, scale, edges[0], edges[-1])
            found[0] += under
            square = p.ravel()[cells].astype(float)
            least = scale * np.sqrt(np.maximum(square * (1 - 1e-6), 0)), scale * np.sqrt(np.maximum(square + more, 0) * (1 + 1e-6))
            bins, upto = np.searchsorted(edges, least[0], side="right"), np.searchsorted(edges, least[1], side="right")
            unsure = np.flatnonzero(bins != upto)
            bins[unsure] = np.searchsorted(edges, distances(a, b, r, c, cells[unsure], p.shape[1]), side="right")
            found += np.bincount(bins, minlength=len(edges) + 1)
        return {"e": np.arange(len(edges)), "n": found.cumsum()[:-1]}

    return count


def distances_between(low: float, high: float) -> Callable[[Rows, Rows | None], dict[str, np.ndarray]]:
    def inside(a: Rows, b: Rows | None) -> dict[str, np.ndarray]:
        out = [np.zeros(0)]
        for r, c, p, more, scale in tiles(a, b):
            d = distances(a, b, r, c, open_pairs(p, more, scale, low, high)[0], p.shape[1])
            out.append(d[(d >= low) & (d < high)])
        return {"v": np.concatenate(out)}

    return inside


def gaps_under(edges: np.ndarray) -> Callable[[Rows, Rows | None], dict[str, np.ndarray]]:
    """Counts ordered pairs, a row with itself too, whose labels differ by less than each of the edges."""

    def count(a: Rows, b: Rows | None) -> dict[str, np.ndarray]:
        from lumenfold.operators.information import nearer

        mine, held = np.sort(a[2]), np.sort(a[2] if b is None else b[2])
        n = [int(nearer(held, mine, np.full(len(mine), e)).sum()) if e > 0 else 0 for e in edges]
        return {"e": np.arange(len(edges)), "n": np.array(n, dtype=np.int64) * (1 if b is None else 2)}

    return count


def gaps_between(low: float, high: float) -> Callable[[Rows, Rows | None], dict[str, np.ndarray]]:
    def inside(a: Rows, b: Rows | None) -> dict[str, np.ndarray]:
        held, room = np.sort(a[2] if b is None else b[2]), 4 * np.spacing(np.abs(a[2]).max() + high)
        out = [np.zeros(0)]
        for sign in (1, -1) if low > 0 else (0,):  # labels above and below a row's; together where the gap may be 0
            lo, hi = (a[2] + sign * low, a[2] + sign * high) if sign else (a[2] - high, a[2] + high)
            start, stop = np.searchsorted(held, np.minimum(lo, hi) - room), np.searchsorted(held, np.maximum(lo, hi) + room, side="right")
            for s in range(0, len(start), ASKING):
                n = stop[s : s + ASKING] - start[s : s + ASKING]
                at = np.repeat(start[s : s + ASKING] - (n.cumsum() - n), n) + np.arange(n.sum())
                v = np.repeat(a[2][s : s + ASKING], n) - held[at]
                g = np.abs(v)
                out.append(g[(g >= low) & (g < high) & ((v * sign <= 0) if sign else True)])
        return {"v": np.repeat(np.concatenate(out), 1 if b is None else 2)}

    return inside


def order_statistic(k: int, edges: np.ndarray, top: float, below: Callable[[np.ndarray], np.ndarray], between: Callable[[float, float], np.ndarray], few: int = FEW) -> float:
    """The k-th smallest (from 0) of numbers from 0 to below ``top``: ``below`` counts those under each edge, ``between`` gives those in a range.

    The first edges only propose; where they miss it, what lies below or above them is next.
    """
    bounds = len(edges) - 1
    if edges[0] == 0:
        edges = np.insert(edges, 1, np.nextafter(0.0, 1.0))
    while True:
        upto = below(edges)
        if k < upto[0]:
            low, high, n, before = 0.0, float(edges[0]), int(upto[0]), 0
        elif k >= upto[-1]:
            low, high, n, before = float(edges[-1]), top, few + 1, int(upto[-1])
        else:
            b = int(np.searchsorted(upto, k, side="right")) - 1
            low, high, n, before = float(edges[b]), float(edges[b + 1]), int(upto[b + 1] - upto[b]), int(upto[b])
        if np.nextafter(low, np.inf) >= high:
            return low
        if n <= few:
            return float(np.sort(between(low, high))[k - before])
        edges = np.linspace(low, high, bounds + 1)
        if low == 0:  # copies: 0 has a place of its own
            edges = np.insert(edges, 1, np.nextafter(0.0, 1.0))


def activity_cliffs(d: DataFrame, distance_share: float, label_share: float, block_rows: int = BLOCK, few: int = FEW) -> DataFrame:
    """(_id, n) of rows (_id, _x, _y) with n > 0, see ``neighbors.activity_cliffs``."""
    size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
    row = d.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"), (F.max("_y") - F.min("_y")).alias("gap")).first()
    n = row["n"]
    sample = np.array([r["_x"] for r in d.orderBy(F.xxhash64("_id", F.lit(5)), "_id").limit(SAMPLE).select("_x").collect()], dtype=float)
    blocks, _ = dealt(d, n, block_rows)
    blocks = blocks.persist(StorageLevel.DISK_ONLY)
    seen: dict[tuple, np.ndarray] = {}

    def counted(kind: Callable, edges: np.ndarray) -> np.ndarray:
        if (key := (kind, *edges.tolist())) not in seen:
            t = met(blocks, kind(edges), "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).orderBy("e").collect()
            seen[key] = np.array([r["n"] for r in t])
        return seen[key]

    def between(kind: Callable, low: float, high: float) -> np.ndarray:
        if (key := (kind, low, high)) not in seen:
            seen[key] = np.array([r["v"] for r in met(blocks, kind(low, high), "v double").collect()])  # ``few`` at most
        return seen[key]

    def quantile(share: float, of: int, edges: np.ndarray, top: float, count: Callable, inside: Callable) -> float:
        place = (of - 1) * share
        k = int(place)
        at = lambda k: order_statistic(k, edges, top, lambda e: counted(count, e), lambda a, b: between(inside, a, b), few)
        low = at(k)
        return low if place == k else low + (place - k) * (at(k + 1) - low)

    try:
        half = len(sample) // 2 * 2
        told = np.concatenate([apart(sample[:half], np.roll(sample[:half], s, axis=0), "euclidean") for s in range(1, half // 2 or 1, max(1, half // 200))]) if half > 2 else np.zeros(1)
        low, high = np.quantile(told, [max(0.0, distance_share - WRONG), min(1.0, distance_share + WRONG)])
        top = float(np.nextafter(2 * row["size"] * (1 + 1e-9), np.inf))
        edges = np.linspace(low, high, BOUNDS + 1) if low < high else np.linspace(0.0, top, BOUNDS + 1)
        near = quantile(distance_share, n * (n - 1) // 2, edges, top, nearer_than, distances_between)
        top = float(np.nextafter(row["gap"] * (1 + 1e-15), np.inf))
        wide = quantile(label_share, n * n, np.linspace(0.0, top, GAP_BOUNDS + 1), top, gaps_under, gaps_between)
    finally:
        blocks.unpersist()

    def count(a: Rows, b: Rows | None) -> dict[str, np.ndarray]:
        other = a if b is None else b
        mine, theirs = np.zeros(len(a[0]), dtype=np.int64), np.zeros(len(other[0]), dtype=np.int64)
        for r, c, p, more, scale in tiles(a, b):
            cells, _ = open_pairs(p, more, scale, 0.0, near)
            i, j = np.divmod(cells, p.shape[1])
            far = np.abs(a[2][i + r] - other[2][j + c]) > wide
            cells, i, j = cells[far], i[far], j[far]
            sure = (np.maximum(p.ravel()[cells].astype(float), 0) + more) * (1 + 1e-6) < (near / scale) ** 2
            unsure = np.flatnonzero(~sure)
            sure[unsure] = distances(a, b, r, c, cells[unsure], p.shape[1]) < near
            mine += np.bincount(i[sure] + r, minlength=len(mine))
            theirs += np.bincount(j[sure] + c, minlength=len(theirs))
        ids, times = (a[0], mine + theirs) if b is None else (np.concatenate([a[0], b[0]]), np.concatenate([mine, theirs]))
        return {"_id": ids[times > 0], "n": times[times > 0]}

    return met(dealt(d, n, block_rows)[0], count, "_id long, n long").groupBy("_id").agg(F.sum("n").alias("n"))
