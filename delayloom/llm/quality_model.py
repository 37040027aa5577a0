"""Histogram gradient-boosted trees over document statistics, scored from flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import labelled_sample
from .rules import FEATURES, profile


@dataclass
class Boosted:
    """Complete binary trees: node i has children 2i+1 and 2i+2; ``cut`` is +inf where a node passes all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all trees at once per level."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 1.0) -> Boosted:
    """Logistic boosting on histograms: each feature is cut into quantile bins once, a node's split is the best bin edge."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    width, n_inner = bins, 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    start = float(np.log(mean / (1 - mean)))
    raw = np.full(len(x), start)
    flat = np.arange(x.shape[1]) * width
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf), np.zeros(len(x), np.int64)
        for node in range(n_inner):
            rows = np.flatnonzero(at == node)
            if len(rows) >= 2:
                where = (code[rows] + flat).ravel()
                hg = np.bincount(where, np.repeat(g[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1)
                hh = np.bincount(where, np.repeat(h[rows], x.shape[1]), width * x.shape[1]).reshape(-1, width).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
                gain[(hh < least) | (th - hh < least)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    f, b = divmod(best, width)
                    feature[node], cut[node] = f, edges[f][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        at -= n_inner
        leaf = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        raw += leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Boosted(np.array(features), np.array(cuts), np.array(leaves), start, depth)


def fit_quality_model(documents: DataFrame, labels: DataFrame, limit: int = 15_000) -> Boosted:
    """Model from at most about ``limit`` labelled documents outside the held-out fifth; the bound is what reaches the driver."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def local(batches):
        for b in batches:
            x = np.array([profile(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", "quality", *names])

    sample = labelled_sample(documents, labels, limit, "boosted").select("doc_id", "text", F.col("quality").cast("int"))
    rows = sample.mapInArrow(local, "doc_id long, quality int, " + ", ".join(f"{c} double" for c in names)).toPandas().sort_values("doc_id")
    if not len(rows):
        return fit_boosted(np.zeros((2, len(FEATURES))), np.array([0.0, 1.0]), trees=1)
    return fit_boosted(rows[names].to_numpy(), rows["quality"].to_numpy().astype(float))


def score_documents(documents: DataFrame, model: Boosted) -> DataFrame:
    """doc_id and score (0 to 1) for every row of ``documents(doc_id, text)``.

    Null and empty texts have zero statistics and are scored like any other;
    ids may be null or repeated, a row's score is that of its text alone. Extra
    columns are left behind; an empty table gives no row.
    """

    def local(batches):
        for b in batches:
            x = np.array([profile(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, "doc_id long, score double")
