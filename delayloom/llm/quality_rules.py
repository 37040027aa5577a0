"""Isolation forest over rule statistics: odd documents end in short random paths."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running
from .rules import FEATURES, profile, rule_counts
from .scratch import Scratch, hash_below

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees in flat arrays: feature (-1 at leaves), cut, left child (right is next), leaf depth."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    scale: float
    threshold: float = 1.0
    use: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies, 0.5 and less for usual rows."""
        x = x if self.use is None else x[:, self.use]
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, depth in zip(self.feature, self.cut, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(busy := rows[feature[at] >= 0]):
                f = feature[at[busy]]
                at[busy] = left[at[busy]] + (x[busy, f] > cut[at[busy]])
            total += depth[at]
        return np.exp2(-total / len(self.feature) / self.scale)


def _limit(sample: int) -> int:
    return max(1, math.ceil(math.log2(max(sample, 2))) + 2)


def _grow(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """One tree over ``x[rows]``, a line ``feature, cut, left, depth`` per node; splits are uniform between a feature's extremes."""
    nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, rows, 0)]
    while todo:
        at, rows, depth = todo.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(open_):
            nodes[at][3] = depth + _mean_path(len(rows))
            continue
        f = int(rng.choice(open_))
        c = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] > c
        nodes[at][:3] = [f, c, len(nodes)]
        todo += [(len(nodes), rows[~right], depth + 1), (len(nodes) + 1, rows[right], depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    return np.array(nodes)


def _flat(trees: list[np.ndarray], sample: int) -> Forest:
    width = max(map(len, trees))
    pad = np.stack([np.vstack([t, np.tile([-1.0, 0, 0, 0], (width - len(t), 1))]) for t in trees])
    return Forest(pad[:, :, 0].astype(np.int64), pad[:, :, 1], pad[:, :, 2].astype(np.int64), pad[:, :, 3], _mean_path(sample) or 1.0)


def fit_forest(x: np.ndarray, trees: int = 150, sample: int = 256, seed: int = 11) -> Forest:
    """Trees over random subsamples of rows at hand; for tables see ``grow_forest``."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    return _flat([_grow(x, rng.choice(len(x), sample, replace=False), rng, _limit(sample)) for _ in range(trees)], sample)


def grow_forest(rows: DataFrame, names: list[str], n: int, trees: int = 150, sample: int = 256, seed: int = 11) -> Forest:
    """Forest over the columns ``names`` of ``rows``, ``n`` of them, each tree grown in a task of its own.

    A tree takes ``sample`` rows, as isolation forests do, each drawn by hash
    from all ``rows``. A row is offered to as many trees as give each about
    three times its sample; where there are more rows than that needs, a hash
    of the row decides which are offered, so a group stays that small.
    """
    sample, wanted = min(sample, n), 3 * trees * sample
    row = F.xxhash64(*names, "doc_id", F.lit(seed))
    drawn = rows.select(*names, row.alias("row")).filter(hash_below(F.xxhash64("row", F.lit("offered")), wanted / n))
    offers = math.ceil(wanted / n)
    of = F.sequence(F.lit(0), F.lit(trees - 1)) if offers >= trees else F.array_distinct(F.array(*[F.pmod(F.xxhash64("row", F.lit(j)), F.lit(trees)).cast("int") for j in range(offers)]))
    drawn = drawn.withColumn("tree", F.explode(of)).withColumn("turn", F.xxhash64("row", F.col("tree").cast("long")))

    def grow(key, group):
        x = group.sort_values("turn", kind="stable").head(sample)[names].to_numpy()
        nodes = _grow(x, np.arange(len(x)), np.random.default_rng([seed, int(key[0])]), _limit(sample))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "depth"])
        return out.assign(tree=int(key[0]), node=np.arange(len(nodes)))

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, feature double, cut double, left double, depth double").toPandas()
    return _flat([t.sort_values("node")[["feature", "cut", "left", "depth"]].to_numpy() for _, t in grown.groupby("tree")], sample)


def _apart(chance: np.ndarray, least: float) -> np.ndarray:
    found = np.flatnonzero(np.abs(chance - 0.5) >= least)
    return found if len(found) else np.arange(len(chance))


def telling(x: np.ndarray, good: np.ndarray, least: float) -> np.ndarray:
    """Statistics in which labelled good and bad rows differ: a bad row's value is above a good one's with a chance ``least`` from one half. All, if none is."""
    g, b = np.sort(x[good], axis=0), x[~good]
    if not len(g) or not len(b):
        return np.arange(x.shape[1])
    return _apart(np.array([(np.searchsorted(g[:, i], b[:, i]) + np.searchsorted(g[:, i], b[:, i], side="right")).mean() / 2 / len(g) for i in range(x.shape[1])]), least)


def telling_of(rows: DataFrame, names: list[str], n_good: int, n_bad: int, scratch: Scratch, least: float) -> np.ndarray:
    """``telling`` for the columns ``names`` of a table ``rows(good, ...)``, over all its rows: running counts of good ones along each column's values."""
    if not n_good or not n_bad:
        return np.arange(len(names))
    each = rows.select("good", F.posexplode(F.array(*names)).alias("at", "value")).groupBy("at", "value")
    counted = each.agg(F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((~F.col("good")).cast("long")).alias("n_bad"))
    placed = running(counted, scratch, "values", "at", [F.col("value")], "n_good")
    met = placed.groupBy("at").agg(F.sum(F.col("n_bad") * (2.0 * F.col("before_") + F.col("n_good"))).alias("met")).collect()
    chance = np.zeros(len(names))
    chance[[r["at"] for r in met]] = [r["met"] / 2 / n_good / n_bad for r in met]
    return _apart(chance, least)


def calibrate(scored: DataFrame, n_good: int, n_bad: int, scratch: Scratch, may_lose: float) -> float:
    """The score above which rows of ``scored(score, good)`` go: the best cut between the classes that loses at most ``may_lose`` of the good rows.

    Every row counts: the quantile is that of all good rows, and every score above it is tried.
    """
    if not n_good:
        return 1.0
    counted = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((~F.col("good")).cast("long")).alias("n_bad")).withColumn("all_", F.lit(0))
    placed = running(counted, scratch, "scores", "all_", [F.col("score")], "n_good")
    placed = placed.select("all_", "score", "n_bad", (F.col("before_") + F.col("n_good")).alias("good_to"))
    place = (n_good - 1) * (1 - may_lose)
    low, high = math.floor(place), math.ceil(place)
    r = placed.agg(*[F.min(F.when(F.col("good_to") > k, F.col("score"))).alias(name) for k, name in ((low, "low"), (high, "high"))]).first()
    floor = r["low"] + (r["high"] - r["low"]) * (place - low)
    if not n_bad:
        return floor
    # the last score up to the floor splits the rows as the floor does
    summed = running(placed, scratch, "scores-bad", "all_", [F.col("score")], "n_bad")
    gain = (n_bad - F.col("before_") - F.col("n_bad")) / F.lit(float(n_bad)) - (n_good - F.col("good_to")) / F.lit(float(n_good))
    cuts = summed.select(F.greatest("score", F.lit(floor)).alias("cut"), "score", gain.alias("gain"))
    cuts = cuts.groupBy("cut").agg(F.max_by("gain", "score").alias("gain"))
    return cuts.agg(F.max(F.struct("gain", (-F.col("cut")).alias("less"))).alias("top")).first()["top"]["less"] * -1.0


def usable_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality``: rows whose crc32(doc_id) mod 5 is 0 stay out for measuring; ids and labels without a value don't count, of repeated ones the larger does."""
    return labels.filter("doc_id is not null and quality is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def labelled_sample(documents: DataFrame, labels: DataFrame, limit: int, seed: str) -> DataFrame:
    """At most about ``limit`` labelled documents, by a hash of the id: ``doc_id, text, quality``. Only the labels of documents at hand count (``usable_labels``)."""
    use = usable_labels(labels)
    n = use.count()
    if n > limit:
        use = use.filter(hash_below(F.xxhash64("doc_id", F.lit(seed)), limit / n))
    return documents.select("doc_id", "text").join(use, "doc_id")


def fit_quality_forest(documents: DataFrame, labels: DataFrame, may_lose: float = 0.01, tell: float = 0.2) -> Forest:
    """Forest over all labelled documents that pass the base rules, with a threshold that loses at most ``may_lose`` of the good ones.

    Good and bad rows grow the trees, so that a statistic that never varies
    among good rows can split; only statistics that tell the labels apart
    (``telling_of``) are used. Statistics, these and the threshold are counted
    over every labelled row; a tree takes 256 rows drawn from all of them
    (``grow_forest``), and only the trees reach the driver. With fewer than two
    good rows nothing is called odd (threshold 1). Null and repeated labels:
    see ``usable_labels``.
    """
    names = [f"f{i}" for i in range(len(FEATURES))]
    scratch = Scratch(documents.sparkSession, "quality-forest")

    def local(batches):
        for b in batches:
            text, q = b.column(1).to_pylist(), b.column(2)
            counts = [rule_counts(t) for t in text]
            x = np.array([profile(t, c) for t, c in zip(text, counts, strict=True)]).reshape(-1, len(FEATURES))
            passed = pa.array([not base_failed(c[0], c[4]) for c in counts], pa.bool_())
            good = pa.array([v == 1 for v in q.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), good, *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", "good", *names]).filter(passed)

    marked = usable_labels(labels).withColumn("quality", F.col("quality").cast("int"))
    known = documents.select(F.col("doc_id").cast("long"), "text").join(marked.hint("merge"), "doc_id")
    rows = scratch.save(known.mapInArrow(local, "doc_id long, good boolean, " + ", ".join(f"{c} double" for c in names)), "labelled")
    n, n_good = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    if n_good < 2:
        scratch.drop()
        return fit_forest(np.zeros((2, len(FEATURES))))
    use = telling_of(rows, names, n_good, n - n_good, scratch, tell)
    forest = grow_forest(rows, [names[i] for i in use], n)
    forest.use = use

    def score(batches):
        for b in batches:
            x = np.stack([b.column(2 + i).to_numpy() for i in range(len(names))], 1)
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), b.column(1)], ["score", "good"])

    scored = scratch.save(rows.mapInArrow(score, "score double, good boolean"), "scored")
    forest.threshold = calibrate(scored, n_good, n - n_good, scratch, may_lose)
    scratch.drop()
    return forest


def quality_verdicts(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the rule counts, base_failed, anomaly and kept for every row of ``documents(doc_id, text)``.

    Null and empty texts have no words and fail the base rules. Ids may be
    null or repeated; each row is judged on its own text. Extra columns are
    left behind; an empty table gives no row.
    """

    def local(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            counts = [rule_counts(t) for t in text]
            failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
            score = forest.score(np.array([profile(t, c) for t, c in zip(text, counts, strict=True)]).reshape(-1, len(FEATURES)))
            table = np.array(counts, np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(table[:, i]) for i in range(table.shape[1])], pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.threshold))], ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, schema)


def passing(documents: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns, in one pass over the texts; nulls and repeated rows as in ``quality_verdicts``."""
    names = documents.columns
    at = names.index("text")

    def local(batches):
        for b in batches:
            text = b.column(at).to_pylist()
            counts = [rule_counts(t) for t in text]
            failed = np.array([base_failed(c[0], c[4]) for c in counts], bool)
            score = forest.score(np.array([profile(t, c) for t, c in zip(text, counts, strict=True)]).reshape(-1, len(FEATURES)))
            yield b.filter(pa.array(~failed & (score <= forest.threshold)))

    return documents.mapInArrow(local, documents.schema)
