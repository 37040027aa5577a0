"""Periodic runs of words: maximal repetitions from Lyndon roots, extended by suffix-tree look-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RUNS = "array<struct<start:long,length:long,period:long>>"
#: Odd multipliers of the window hash that only chooses where trees are built.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class SuffixTree:
    """Suffix tree of a sequence of small integers whose last one occurs nowhere else.

    It is built online (Ukkonen's way): leaves grow by themselves, and suffix
    links lead from the place of one suffix to that of the next. Edges lie in
    one dictionary by node and first symbol.
    """

    def __init__(self, seq: list[int], width: int):
        self.n, self.width = len(seq), width
        size = self.n
        start, end, link, edges = [0], [0], [0], {}
        node = length = pending = at = 0
        get = edges.get
        for i, c in enumerate(seq):
            pending += 1
            last = 0
            while pending:
                if not length:
                    at = i
                key = node * width + seq[at]
                child = get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[child]
                    edge = end[child] - begin
                    if length >= edge and end[child] <= i:
                        node, length, at = child, length - edge, at + edge
                        continue
                    if seq[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += (begin, i)
                    end += (begin + length, size)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * width + c] = split + 1
                    start[child] = begin + length
                    edges[split * width + seq[begin + length]] = child
                    if last:
                        link[last] = split
                    last = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - pending + 1
        self.start, self.end, self.edges = start, end, edges

    def tours(self, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order of symbols (ascending, descending) the leaves' suffixes and the smallest depth between each leaf and the one before.

        This is the Euler tour with what lies between two leaves cut down to
        its minimum, for only leaves are asked about. The end of the sequence
        comes first in either order.
        """
        count, size, width = len(self.start), self.n, self.width
        keys = np.fromiter(self.edges.keys(), np.int64, count - 1)
        kids = np.fromiter(self.edges.values(), np.int64, count - 1)
        parent, symbol = keys // width, keys % width
        span = (np.asarray(self.end) - np.asarray(self.start)).tolist()
        leaf = (np.asarray(self.end) == size).tolist()
        found = []
        for order in range(orders):
            placed = np.lexsort((symbol if not order else np.where(symbol, -symbol, -width), parent))
            ranked = kids[placed].tolist()
            bounds = np.searchsorted(parent[placed], np.arange(count + 1)).tolist()
            suffixes, lows, stack, low = [], [], [], 0
            node, depth = 0, 0
            while True:
                a, b = bounds[node], bounds[node + 1]
                if b > a:
                    for k in range(b - 1, a, -1):
                        stack.append((ranked[k], depth))
                    node = ranked[a]
                    depth += span[node]
                    if not leaf[node]:
                        continue
                suffixes.append(size - depth)
                lows.append(low)
                if not stack:
                    break
                node, low = stack.pop()
                depth = low + span[node]
            found.append((np.array(suffixes), np.array(lows)))
        return found


class CommonPrefixes:
    """Longest common prefixes of suffixes: the lowest depth between two leaves of a tour, in constant time each."""

    def __init__(self, suffixes: np.ndarray, lows: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.levels = [lows.astype(np.int32)]
        width = 1
        while 2 * width <= len(lows):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different suffixes."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        power = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(power):
            of = power == k
            level = self.levels[k]
            out[of] = np.minimum(level[a[of]], level[b[of] - (1 << int(k))])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """Where the next suffix of lower rank starts: the longest Lyndon word from each place ends there."""
    n = len(rank)
    found, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            found[i] = stack[-1]
        stack.append(i)
    return found


def maximal_runs(symbols: np.ndarray, least: int) -> np.ndarray:
    """Rows of start, length and smallest period of all runs of ``symbols`` with length of at least ``least`` and two periods.

    Every run holds a longest Lyndon word, by the order of symbols or its
    reverse, as long as its period. Each such word is held against itself one
    period on: to the right in the suffix tree, to the left in that of the
    reversal.
    """
    n = len(symbols)
    kinds, codes = np.unique(symbols, return_inverse=True)
    width = len(kinds) + 1
    forward = SuffixTree([*(codes + 1).tolist(), 0], width).tours(2)
    backward = SuffixTree([*(codes[::-1] + 1).tolist(), 0], width).tours(1)
    ahead, behind = CommonPrefixes(*forward[0]), CommonPrefixes(*backward[0])
    starts, ends = [], []
    for suffixes, _ in forward:
        rank = np.empty(n + 1, np.int64)
        rank[suffixes] = np.arange(n + 1)
        smaller = np.array(_next_smaller(rank.tolist())[:n])
        within = np.flatnonzero(smaller < n)
        starts.append(within)
        ends.append(smaller[within])
    i, j = np.concatenate(starts), np.concatenate(ends)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    # the reversal's suffix at n - i is the text before i, read backwards
    left, right = behind(n - i, n - j), ahead(i, j)
    start, period = i - left, j - i
    length = j + right - start
    keep = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([start[keep], period[keep], length[keep]], axis=1), axis=0)[:, [0, 2, 1]]


def repeating_stretches(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches outside which no run lies.

    A run of at least ``least`` words and two periods is covered by windows of
    least // 2 words that occur in it twice. So words whose windows occur once
    leave, and again what has no second window in its own stretch. Equal hashes
    of different windows only keep more.
    """
    size, n = max(1, least // 2), len(words)
    if n < max(least, 2):
        return []
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ words[k : n - size + 1 + k].astype(np.uint64)) * _MIX[0]
        h ^= h >> np.uint64(31)
    at, stretch = np.arange(len(h)), np.zeros(len(h), np.uint64)
    while True:
        key = h[at] ^ (stretch * _MIX[1])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        if not again.any():
            return []
        done = again.all()
        at = at[again]
        # windows whose words touch are one stretch
        new = np.concatenate([[True], at[1:] > at[:-1] + size])
        stretch = np.cumsum(new).astype(np.uint64)
        if done:
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            return [(int(at[a]), int(at[b]) + size) for a, b in zip(first, last, strict=True) if at[b] + size - at[a] >= least]


def document_runs(words: list, least: int = 12) -> np.ndarray:
    """Rows of start, length and period of all runs of a list of words, by start and period."""
    if len(words) < max(least, 2):
        return np.zeros((0, 3), np.int64)
    seen: dict = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    parts, at, used = [], [], 0
    stretches = repeating_stretches(codes, least)
    if not stretches:
        return np.zeros((0, 3), np.int64)
    for k, (a, b) in enumerate(stretches):
        parts += [codes[a:b], [len(seen) + k]]  # a symbol of its own between stretches: nothing repeats across it
        at.append((used, a))
        used += b - a + 1
    found = maximal_runs(np.concatenate(parts), least)
    place = np.searchsorted([x for x, _ in at], found[:, 0], side="right") - 1
    found[:, 0] += np.array([a - x for x, a in at])[place]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """``words`` with each run cut down to its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(change)[:-1] == 0
    return [w for w, kept in zip(words, stay.tolist(), strict=True) if kept]


def periodic_runs(documents: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row of ``documents(doc_id, text)``.

    A run is a stretch of words (between ASCII white space) with smallest
    period q and at least max(``least``, 2 q) words that no neighbouring word
    extends; runs come by start and period. ``collapsed`` has the words left,
    joined by one space, when each run keeps its first period only.

    Documents are independent: no row leaves its task, and a lost executor
    costs its own rows again. Trees are built over stretches that may hold a
    run (``repeating_stretches``), so the memory of a task is that of a batch
    and of the trees of one document.

    Null and empty texts have no words, no runs and an empty collapsed text.
    Null ids and repeated rows are rows like any other; extra columns are left
    behind; an empty table gives no row.
    """

    def local(batches):
        for b in batches:
            n, runs, texts = [], [], []
            for text in b.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = document_runs(words, least)
                n.append(len(words))
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in found.tolist()])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", documents["text"].cast("string")).mapInArrow(local, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
