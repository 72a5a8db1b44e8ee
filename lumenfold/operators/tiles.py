"""The nearest of many rows in bounded memory: matrix products rule pairs out, double precision decides.

Asking rows meet held ones tile by tile. Euclidean distances and angles of a tile are one matrix
product in single precision, to which the most that rounding can take is added for each pair; where
that tells too few pairs apart, it is one in double precision. Pairs that still may be near enough are
computed anew in double precision, from their two rows alone, so that equal rows are equally far.
Other metrics go pair by pair throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ANGLES = ("cosine", "correlation")
#: Metrics whose tiles are matrix products.
PRODUCTS = ("euclidean", *ANGLES)
METRICS = ("euclidean", "manhattan", "cosine", "chebyshev", "canberra", "correlation", "braycurtis", "minkowski_3")
#: Rows of a tile (asking, held), and pairs that are computed anew at a time.
ASKING, HELD, PAIRS = 1_024, 4_096, 16_384
#: Held rows so many times as long as the longest asking one don't go through products; rows that tell where the middle is; the share of a tile's pairs beyond which its product is taken in double precision.
LONGEST, MIDDLE, MANY = 1e6, 1_001, 1 / 16


def matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b``."""
    if metric in ANGLES:
        if metric == "correlation":
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        norms = na[:, None] * nb[None, :]
        return np.where(norms > 0, 1 - (a @ b.T) / np.where(norms > 0, norms, 1), 1.0)
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = np.abs(b - row)
        if metric == "euclidean":
            out[i] = np.sqrt((d * d).sum(axis=1))
        elif metric == "manhattan":
            out[i] = d.sum(axis=1)
        elif metric == "chebyshev":
            out[i] = d.max(axis=1)
        elif metric == "minkowski_3":
            out[i] = (d**3).sum(axis=1) ** (1 / 3)
        elif metric == "canberra":
            s = np.abs(b) + np.abs(row)
            out[i] = np.where(s > 0, d / np.where(s > 0, s, 1), 0).sum(axis=1)
        elif metric == "braycurtis":
            out[i] = d.sum(axis=1) / np.abs(b + row).sum(axis=1)
        else:
            raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
    return out


def apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of ``a`` to those of ``b`` beside them."""
    if metric == "euclidean":
        d = a - b
        return np.sqrt((d * d).sum(axis=1))
    if metric == "correlation":
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.where(norms > 0, 1 - (a * b).sum(axis=1) / np.where(norms > 0, norms, 1), 1.0)


def marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few true cells of a contiguous mask."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class Products:
    """Asking rows to be multiplied with held ones' ``view``: the product is the larger, the nearer the held row is.

    For Euclidean distances of rows z (moved to a common centre, over a common scale) it is
    za zb - zb zb / 2, which is (za za - d d) / 2; for angles it is 1 - d. ``fault`` times the sizes of
    what is multiplied bounds the rounding of it, and is added.
    """

    def __init__(self, x: np.ndarray, metric: str, kind: type = np.float32) -> None:
        self.metric, self.kind, self.unit = metric, kind, float(np.finfo(kind).eps) / 2
        self.fault = 1.05 * (x.shape[1] + 12) * self.unit
        self.centre, self.scale = 0.0, 1.0
        if metric == "euclidean":
            sound = np.isfinite(x).all(axis=1)
            self.centre = np.median(x[sound][:: -(-int(sound.sum()) // MIDDLE)], axis=0) if sound.any() else np.zeros(x.shape[1])
            with np.errstate(all="ignore"):
                size = np.sqrt(((x - self.centre) ** 2).sum(axis=1))
            size = size[np.isfinite(size)]
            self.scale = float(size.max()) if len(size) and size.max() > 0 else 1.0
        z, self.size, self.sound = self._moved(x)
        self.rows = np.hstack([z, np.ones((len(z), 1)), self.fault * self.size[:, None]]).astype(kind)

    def _moved(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows moved and scaled, their sizes, and which of them can be multiplied."""
        with np.errstate(all="ignore"):
            if self.metric == "euclidean":
                z = (x - self.centre) / self.scale
                size = np.sqrt((z * z).sum(axis=1))
            else:
                z = x - x.mean(axis=1, keepdims=True) if self.metric == "correlation" else x
                norm = np.sqrt((z * z).sum(axis=1))
                z = z / np.where(norm > 0, norm, 1)[:, None]
                size = np.where(np.isfinite(norm), 1.0, np.inf)
        sound = size <= LONGEST
        return (z, size, sound) if sound.all() else (np.where(sound[:, None], z, 0), np.where(sound, size, 0), sound)

    def view(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Held rows to be multiplied with, their sizes, and which of them are sound."""
        z, size, sound = self._moved(x)
        half = size**2 / 2 if self.metric == "euclidean" else np.zeros(len(z))
        last = self.fault * half - half + (0 if self.metric == "euclidean" else self.fault)
        return np.hstack([z, last[:, None], size[:, None]]).astype(self.kind), size, sound

    def least(self, rows: slice, distance: np.ndarray) -> np.ndarray:
        """What the products of pairs within these distances reach at least."""
        with np.errstate(all="ignore"):  # without a limit it is -inf
            p = (self.size[rows] ** 2 - (distance * (1 + 1e-12) / self.scale) ** 2) / 2 if self.metric == "euclidean" else 1 - distance
            return np.where(self.sound[rows], p - 4 * self.unit * np.abs(p) - 1e-30, np.inf).astype(self.kind)

    def doubt(self, rows: slice, longest: float) -> np.ndarray:
        """Twice the most that rounding can change in a row's products with held rows up to this size."""
        size = self.size[rows]
        return 2.2 * self.fault * (size * longest + (longest**2 / 2 if self.metric == "euclidean" else 1))


class Best:
    """The k nearest held rows of each asking row, of those nearer than ``within``; ties by id, a row itself left out.

    Held rows come in batches of any size (``see``). What is kept is k ids and distances a row, and a tile.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str, within: float = np.inf) -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; known: {METRICS}")
        self.ids, self.x, self.k, self.metric, self.within = ids, x, k, metric, within
        self.far = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.single = Products(x, metric) if metric in PRODUCTS else None
        self.double: Products | None = None
        self.odd = np.flatnonzero(~self.single.sound) if self.single else np.arange(len(ids))
        self.recounted = 0

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), HELD):
            i, h = ids[at : at + HELD], x[at : at + HELD]
            self._exact(self.odd, i, h)
            if self.single is None:
                continue
            view, size, sound = self.single.view(h)
            if not sound.all():
                self._exact(np.flatnonzero(self.single.sound), i[~sound], h[~sound])
                i, h, view, size = i[sound], h[sound], view[sound], size[sound]
            if not len(i):
                continue
            out = np.empty((min(ASKING, len(self.ids)), len(i)), dtype=np.float32)
            for a in range(0, len(self.ids), ASKING):
                self._tile(slice(a, min(a + ASKING, len(self.ids))), i, h, view, float(size.max()), out)

    def _limit(self, rows: slice | np.ndarray) -> np.ndarray:
        return np.minimum(self.far[rows, -1], self.within)

    def _exact(self, asking: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(asking), ASKING):
            rows = asking[a : a + ASKING]
            with np.errstate(all="ignore"):
                m = matrix(self.x[rows], x, self.metric)
            m[(self.ids[rows, None] == ids[None, :]) | ~np.isfinite(m)] = np.inf
            limit = self._limit(rows)
            if m.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(m, self.k - 1, axis=1)[:, self.k - 1])
            r, c = np.nonzero((m <= limit[:, None]) & np.isfinite(m))
            self._take(rows[r], ids[c], m[r, c])

    def _near(self, by: Products, p: np.ndarray, rows: slice, ids: np.ndarray, longest: float) -> np.ndarray:
        """Which pairs of a tile may be among the k best."""
        least = by.least(rows, self._limit(rows))
        near = p >= least[:, None]
        if np.count_nonzero(near) > (4 * self.k + 64) * len(p) and len(ids) > self.k:  # what the tile's own k best reach is a limit too
            p[self.ids[rows, None] == ids[None, :]] = -np.inf
            kth = np.partition(p, len(ids) - self.k, axis=1)[:, len(ids) - self.k].astype(float)
            with np.errstate(invalid="ignore"):
                least = np.fmax(least, kth - by.doubt(rows, longest) - 4 * by.unit * np.abs(kth)).astype(by.kind)
            near = p >= least[:, None]
        return near

    def _tile(self, rows: slice, ids: np.ndarray, x: np.ndarray, view: np.ndarray, longest: float, out: np.ndarray) -> None:
        p = np.matmul(self.single.rows[rows], view.T, out=out[: rows.stop - rows.start])
        near = self._near(self.single, p, rows, ids, longest)
        if np.count_nonzero(near) > MANY * near.size:
            self.double = self.double or Products(self.x, self.metric, np.float64)
            near &= self._near(self.double, self.double.rows[rows] @ self.double.view(x)[0].T, rows, ids, longest)
        at = marked(near)
        for s in range(0, len(at), PAIRS):
            r, c = np.divmod(at[s : s + PAIRS], len(ids))
            r += rows.start
            self._take(r, ids[c], apart(self.x[r], x[c], self.metric))
        self.recounted += len(at)

    def _take(self, r: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        last, who = self.far[r, -1], self.who[r, -1]
        keep = np.isfinite(d) & (d < self.within) & ((d < last) | ((d == last) & (ids < who))) & (self.ids[r] != ids)
        r, ids, d = r[keep], ids[keep], d[keep]
        if not len(r):
            return
        u, own = np.unique(r, return_inverse=True)
        k = self.k
        row = np.concatenate([np.repeat(np.arange(len(u)), k), own])
        far, who = np.concatenate([self.far[u].ravel(), d]), np.concatenate([self.who[u].ravel(), ids])
        order = np.lexsort((who, far, row))
        row = row[order]
        kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        self.far[u], self.who[u] = far[kept].reshape(-1, k), who[kept].reshape(-1, k)

    def told(self, rows_at_once: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of asking rows, ids of the rows near them, distances; in pieces."""
        for a in range(0, len(self.ids), rows_at_once):
            r, c = np.nonzero(np.isfinite(self.far[a : a + rows_at_once]))
            yield r + a, self.who[r + a, c], self.far[r + a, c]
