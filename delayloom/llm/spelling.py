"""Spelling variants: words one edit apart, found in FM-indexes of vocabulary shards by search schemes."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(documents: DataFrame, rewrite: Callable[[object, str], str] | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n`` of all letter runs of ``documents(doc_id, text)`` with at least so many code points and occurrences.

    Runs are maximal stretches of A-Z, a-z and U+00C0 to U+00FF of whole texts,
    A-Z in lower case. ``rewrite(doc_id, run)`` may change a run before it is
    counted. Each task adds up what it reads and hands on its sums whenever it
    holds 200 000 words, so a word on every line is shuffled as a few rows.
    """

    def local(batches):
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                runs = Counter(RUN.findall(text.encode().lower().decode()))
                if rewrite is None:
                    total.update(runs)
                else:
                    for run, n in runs.items():
                        total[rewrite(doc_id, run)] += n
                if len(total) > 200_000:
                    yield flush()
                    total.clear()
        yield flush()

    counted = documents.select("doc_id", F.col("text").cast("string")).mapInArrow(local, "word string, n long")
    return counted.filter(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


class FMIndex:
    """FM-index of distinct words, each between delimiters, that is searched from the words' first code point to the last.

    Backward search lengthens a pattern at its front, so the text holds the
    words reversed. A step from one interval of suffix ranks to the next is
    two binary searches in one sorted array of (symbol, rank in the transform).
    """

    def __init__(self, words: list[str]):
        points, lengths = _codes(words)
        self.alphabet = np.unique(points)
        ends = np.cumsum(lengths + 1)
        text = np.ones(ends[-1] + 2, np.int64)  # 1 is the delimiter, 0 the end
        text[-1] = 0
        of = np.repeat(np.arange(len(words)), lengths)
        inside = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[ends[of] - 1 - inside] = np.searchsorted(self.alphabet, points) + 2
        order = self._suffix_order(text)
        self.n, self.transform = len(text), text[order - 1]
        self.keys = np.sort(self.transform * (self.n + 1) + np.arange(self.n))
        # of the suffixes that start with a delimiter, which word follows
        self.word = np.searchsorted(ends - lengths - 1, order[1 : len(words) + 2])

    @staticmethod
    def _suffix_order(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling."""
        n, rank, width = len(text), text, 1
        while True:
            key = rank * (n + int(rank.max()) + 2)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1 or width >= n:
                return order

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol; symbols that the words lack give empty ones."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.keys, base + low), np.searchsorted(self.keys, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which state can go on with which letter: letters of small intervals are read, of large ones all are tried."""
        sigma = len(self.alphabet)
        small = high - low <= sigma
        few, many = np.flatnonzero(small), np.flatnonzero(~small)
        size = (high - low)[few]
        state = np.repeat(few, size)
        at = np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size) + low[state]
        found = np.unique(state * (sigma + 2) + self.transform[at])
        state, symbol = found // (sigma + 2), found % (sigma + 2)
        state = np.concatenate([state[symbol > 1], np.repeat(many, sigma)])
        return state, np.concatenate([symbol[symbol > 1], np.tile(np.arange(2, sigma + 2), len(many))])

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (query, word) exactly one edit apart whose first ``exact`` code points agree."""
        points, lengths = _codes(queries)
        symbols = np.append(np.where(np.isin(points, self.alphabet), np.searchsorted(self.alphabet, points) + 2, len(self.alphabet) + 2), 0)
        first = np.cumsum(lengths) - lengths
        q, low, high = np.arange(len(queries)), np.ones(len(queries), np.int64), np.full(len(queries), 1 + len(self.word), np.int64)
        eq, el, eh = (np.zeros(0, np.int64) for _ in range(3))  # states whose error is spent
        found: list[np.ndarray] = []
        for t in range(int(lengths.max(initial=0)) + 1):
            nq, nl, nh = [], [], []  # what gets its error here and is past the symbol
            open_ = np.flatnonzero(exact[q] <= t)
            if len(open_):
                state, letter = self.branches(low[open_], high[open_])
                state = open_[state]
                bl, bh = self.step(letter, low[state], high[state])
                own = np.where(t < lengths[q[state]], symbols[np.minimum(first[q[state]] + t, len(symbols) - 1)], -1)
                swap = (own >= 0) & (own != letter)
                nq.append(q[state][swap]), nl.append(bl[swap]), nh.append(bh[swap])
                eq, el, eh = np.concatenate([eq, q[state]]), np.concatenate([el, bl]), np.concatenate([eh, bh])  # a letter put in
                left_out = open_[t < lengths[q[open_]]]
                nq.append(q[left_out]), nl.append(low[left_out]), nh.append(high[left_out])
            over = lengths[eq] == t
            l, h = self.step(np.ones(over.sum(), np.int64), el[over], eh[over])
            hit = l < h
            found.append(np.stack([eq[over][hit], self.word[l[hit] - 1]]))
            eq, el, eh = eq[~over], el[~over], eh[~over]
            el, eh = self.step(symbols[first[eq] + t], el, eh)
            eq, el, eh = np.concatenate([eq, *nq]), np.concatenate([el, *nl]), np.concatenate([eh, *nh])
            alive = el < eh
            eq, el, eh = eq[alive], el[alive], eh[alive]
            more = lengths[q] > t
            q, low, high = q[more], low[more], high[more]
            low, high = self.step(symbols[first[q] + t], low, high)
            alive = low < high
            q, low, high = q[alive], low[alive], high[alive]
            if not len(q) and not len(eq):
                break
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


def _near_in_shard(back: bool):
    """Index one shard and look up its queries; ``back``: words are reversed, and the exact part is the second half."""

    def local(shard: pa.Table, asked: pa.Table) -> pa.Table:
        words, counts, queries = shard.column("word").to_pylist(), shard.column("n").to_numpy(), asked.column("word").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        index = FMIndex(words) if words and queries else None
        for i in range(0, len(queries) if index else 0, 20_000):
            part = queries[i : i + 20_000]
            half = np.array([len(w) // 2 for w in part])
            exact = np.array([len(w) for w in part]) - half if back else half
            for a, b in zip(*(x.tolist() for x in index.one_error(part, exact)), strict=True):
                w, near = (part[a][::-1], words[b][::-1]) if back else (part[a], words[b])
                if not back or near[: len(w) // 2] != w[: len(w) // 2]:  # the other direction has found those
                    out[0].append(w), out[1].append(near), out[2].append(counts[b])
        return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})

    return local


def _direction(vocabulary: DataFrame, scratch: Scratch, shards: int, shard_words: int, back: bool) -> DataFrame:
    """``word, near, near_n`` of pairs whose first half (``back``: second half) agrees."""
    name = "back" if back else "ahead"
    words = vocabulary.select(F.reverse("word").alias("word"), "n") if back else vocabulary
    dealt = scratch.save(words.repartitionByRange(shards, "word").withColumn("shard", F.spark_partition_id()), f"{name}-shards")
    bounds = sorted(dealt.groupBy("shard").agg(F.min("word"), F.max("word")).collect())
    ids, lows, highs = ([r[i] for r in bounds] for i in range(3))

    def routes(batches):
        for b in batches:
            asked = b.column(0).to_pylist()
            exact = [w[: len(w) - len(w) // 2] if back else w[: len(w) // 2] for w in asked]
            spans = [ids[bisect_left(highs, x) : bisect_right(lows, x + "\U0010ffff")] for x in exact]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["word", "shards"])

    asked = scratch.save(dealt.select("word").mapInArrow(routes, "word string, shards array<int>").select("word", F.explode("shards").alias("shard")), f"{name}-routes")
    pieces = asked.groupBy("shard").agg(F.ceil(F.count("*") / (2 * shard_words)).cast("int").alias("pieces"))
    asked = asked.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")).select("word", "shard", "piece")
    copies = dealt.join(pieces, "shard").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("word", "n", "shard", "piece")
    key = ["shard", "piece"]
    return copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_near_in_shard(back), "word string, near string, near_n long")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` of every word of ``forms(word, form)``: forms followed to the last, twice as far each round."""
    ends = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.save(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{step}")
        changed = moved.filter("moved").limit(1).count()
        scratch.drop(f"roots-{step - 1}")
        ends = moved.select("word", "root")
        if not changed:
            return ends


def spelling_variants(vocabulary: DataFrame, ratio: int = 2, shard_words: int = 200_000) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocabulary(word, n)``, whose words are distinct.

    Two words are near if one inserted, deleted or replaced code point makes
    one the other. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` times its
    own; its root is where forms lead, the word itself if it has none.

    Of two near words the first halves agree, or the second ones. So each word
    is matched exactly over its first half and with one error from there on,
    and likewise from its end: two directions of one search. In each the
    vocabulary is range-partitioned into shards of about ``shard_words`` words,
    and a shard has an index of its own; a word asks only the shards that hold
    its exact half, mostly one. The driver sees two words a shard. A shard that
    many words ask is copied, so that no task has more than about four times
    ``shard_words`` rows.

    Null words are left out. Empty words are near to those of one code point.
    Forms have at least ``ratio`` (2 or more) times the count, so they never
    go round in circles. Extra columns are left behind; an empty table gives
    no row.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 or more")
    scratch = Scratch(vocabulary.sparkSession, "spelling")
    words = scratch.save(vocabulary.select(F.col("word").cast("string"), F.col("n").cast("long")).filter("word is not null"), "words")
    shards = max(1, -(-words.count() // shard_words))
    pairs = _direction(words, scratch, shards, shard_words, False).unionByName(_direction(words, scratch, shards, shard_words, True))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = scratch.save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")), "near")
    is_form = F.col("near_n") >= ratio * F.col("n")
    formed = near.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    roots = _roots(formed.filter("form is not null"), scratch)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
