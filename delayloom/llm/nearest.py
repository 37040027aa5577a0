"""Nearest neighbours by collision counting over single random projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orthogonal_axes(dim: int, count: int, seed: int) -> np.ndarray:
    """``count`` unit axes as columns: random orthonormal bases one after the other, the last one cut off.

    Axes of one basis never look the same way twice, so as many axes as
    dimensions keep all of a vector, which as many free Gaussian axes don't.
    """
    rng, bases = np.random.default_rng(seed), []
    while len(bases) * dim < count:
        bases.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.hstack(bases)[:, :count]


class CollisionIndex:
    """Sorted arrays of one block's projections, searched by windows that grow around the query.

    Inner products become distances by one more coordinate that gives all rows
    of the block one norm. Each projection is kept as one sorted array; a row
    collides with a query where it lies in the query's window. Widening all
    windows by the same factor is virtual rehashing: nothing is hashed anew.
    The first width is the one at which a few of the block's own rows are about
    to find ``enough`` others. Rows are scaled before they are squared, so that
    no finite vector overflows.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, projections: int, threshold: float, enough: int, seed: int = 5, first: float = 0.01, factor: float = 1.15, probes: int = 16):
        small = x / np.abs(x).max()
        norm = np.sqrt((small * small).sum(1))
        top = norm.max()
        lifted = np.hstack([small, np.sqrt(np.maximum(top**2 - norm**2, 0))[:, None]]) / top
        self.axes = orthogonal_axes(lifted.shape[1], projections, seed)
        p = lifted @ self.axes
        self.order = np.ascontiguousarray(np.argsort(p, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(p, self.order.T, 0).T
        self.x, self.ids = x, ids
        self.need, self.enough, self.factor, self.first = int(np.ceil(threshold * projections)), enough, factor, first
        if len(ids) > enough:
            ends = [r for _, _, r in self.candidates(p[:: max(1, len(ids) // probes)])]
            self.first = max(first, min(ends) / factor)

    def candidates(self, at: np.ndarray):
        """(query row, rows of the block over the collision threshold, last width) per projected query."""
        n, count = len(self.ids), np.zeros((len(at), len(self.ids)), np.int16)
        enough = min(self.enough, n)
        low = np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, at.T, strict=True)], 1)
        high, busy, r = low.copy(), np.arange(len(at)), self.first
        while len(busy):
            a = np.stack([np.searchsorted(s, v) for s, v in zip(self.sorted, at[busy].T - r, strict=True)], 1)
            b = np.stack([np.searchsorted(s, v, side="right") for s, v in zip(self.sorted, at[busy].T + r, strict=True)], 1)
            open_ = []
            for i, lo, hi in zip(busy, a.tolist(), b.tolist(), strict=True):
                if sum(hi) - sum(lo) >= enough * self.need:
                    new = [o[x:y] for o, l, h, u, v in zip(self.order, lo, hi, low[i].tolist(), high[i].tolist(), strict=True) for x, y in ((l, u), (v, h)) if y > x]
                    if new:
                        count[i] += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
                    low[i], high[i] = lo, hi
                    found = np.flatnonzero(count[i] >= self.need)
                    if len(found) >= enough:
                        yield i, found, r
                        continue
                open_.append(i)
            busy, r = np.array(open_, np.int64), r * self.factor

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, together: int = 64):
        """Per query the best ``k`` verified rows of the block: (query row, ids, scores); ``together`` bounds the counters held at once."""
        small = queries / np.abs(queries).max(1)[:, None]
        at = np.hstack([small / np.sqrt((small * small).sum(1))[:, None], np.zeros((len(queries), 1))]) @ self.axes
        for start in range(0, len(at), together):
            for i, found, _ in self.candidates(at[start : start + together]):
                q = queries[start + i]
                score = self.x[found] @ q
                own = self.ids[found] != query_ids[start + i]
                found, score = found[own], score[own]
                if len(score) > k:
                    floor = np.partition(score, -k)[-k]
                    found = found[~(score < floor - 1e-9 * max(1.0, abs(floor)))]
                score = np.array([_dot(self.x[j], q) for j in found])
                best = np.lexsort((self.ids[found], -score))[:k]
                yield start + i, self.ids[found][best], score[best]


def norm_layers(x: np.ndarray, enough: int, ratio: float = 1.05) -> list[np.ndarray]:
    """Rows of a block by norm, longest first: norms of a layer are within ``ratio``, or it has at most ``enough`` rows.

    Lifted to the largest norm of all, rows that are shorter look alike to the
    projections; inside such a layer the lift is small, and a layer of
    ``enough`` rows is verified in full.
    """
    small = x / np.abs(x).max()
    norm = np.sqrt((small * small).sum(1))
    order, low, out = np.argsort(-norm, kind="stable"), 0, []
    falling = -norm[order]
    while low < len(order):
        high = int(np.searchsorted(falling, falling[low] / ratio, side="right"))
        high = max(high, min(low + enough, len(order)))
        out.append(np.sort(order[low:high]))
        low = high
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """The same sum in the same order wherever the pair meets, so that equal vectors tie."""
    return float(np.add.reduce(a * b))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite, not all zero components, as ``vec_id, embedding(array<double>)``."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, chunk: int = 16384, projections: int = 64, threshold: float = 0.8, share: float = 0.05) -> DataFrame:
    """query_id, rank, vec_id, score: about the ``k`` rows of ``vectors`` with largest inner product per query.

    Every row is indexed, in blocks of about ``block`` rows; queries go in
    chunks of about ``chunk`` and each (block, chunk) pair is one group, so
    memory is bounded by the two sizes: a row is shipped once per chunk of
    queries, a query once per block. A block is searched in layers of about
    equal norm. Vectors have ``projections`` axes, or as many as dimensions if
    those are more. Windows widen until 8 k rows and ``share`` of the layer
    reach the collision threshold (all rows, where the layer has no more);
    these are verified exactly.

    Vectors that are null, zero or hold null or non-finite components
    take no part; vectors of another length than the query's are no
    candidates; ties go to the smaller id; repeated ids are never their own
    neighbours. Of several vectors under one id the least (component by
    component) asks; all of them are candidates. Extra columns are left
    behind; an empty table has no neighbours.
    """
    data = usable(vectors)
    asks = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, m = data.count(), queries.count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-m // chunk))
    deal = lambda of, parts, salt: F.pmod(F.xxhash64(of, F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dim = F.size("embedding").alias("dim")
    left = data.select(dim, deal("vec_id", blocks, "block").alias("b"), every(chunks).alias("c"), "vec_id", "embedding")
    right = asks.select(dim, deal("vec_id", chunks, "chunk").alias("c"), every(blocks).alias("b"), "vec_id", "embedding")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [[np.array([], np.int64)], [np.array([], np.int64)], [np.array([], float)]]
        if len(rows) and len(asked):
            rows, asked = rows.sort_values("vec_id", kind="stable"), asked.sort_values("vec_id")
            x, q, q_ids = np.stack(rows["embedding"].to_numpy()).astype(np.float64), np.stack(asked["embedding"].to_numpy()).astype(np.float64), asked["vec_id"].to_numpy()
            for layer in norm_layers(x, 8 * k):
                index = CollisionIndex(x[layer], rows["vec_id"].to_numpy()[layer], max(projections, x.shape[1]), threshold, 8 * k + int(share * len(layer)))
                for i, ids, score in index.search(q, q_ids, k):
                    for to, v in zip(out, (np.full(len(ids), q_ids[i]), ids, score), strict=True):
                        to.append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = left.groupBy("dim", "b", "c").cogroup(right.groupBy("dim", "b", "c")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
