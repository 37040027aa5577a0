"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LongestMatch:
    """Counts greedy longest-match pieces of a word in one pass over its bytes.

    A trie of the vocabulary has at each node a failure link and the number of
    pieces that are popped when the link is taken: those the greedy matcher
    would have cut from the node's string. Following links never looks back,
    so the work is linear in the word and no piece is ever built. A word that
    the vocabulary can't cover counts as one unknown piece.
    """

    def __init__(self, pieces: list[bytes], remember: int = 400_000):
        goto: dict[int, int] = {}
        final, depth_first = [False], [[]]
        for piece in pieces:
            at = 0
            for c in piece:
                to = goto.get(at * 256 + c)
                if to is None:
                    to = goto[at * 256 + c] = len(final)
                    final.append(False)
                    depth_first.append([])
                    depth_first[at].append((c, to))
                at = to
            final[at] = final[at] or bool(piece)
        link, pops = [-1] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in depth_first[u]:
                queue.append(v)
                if final[v]:
                    link[v], pops[v] = 0, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and (z * 256 + c) not in goto:
                    n, z = n + pops[z], link[z]
                if z >= 0:
                    link[v], pops[v] = goto[z * 256 + c], n
        self.goto, self.link, self.pops = goto, link, pops
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def count(self, word: bytes) -> int:
        goto, link, pops = self.goto, self.link, self.pops
        at = n = 0
        for c in word:
            while (to := goto.get(at * 256 + c)) is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 1
            at = to
        while at > 0:
            n += pops[at]
            at = link[at]
        return 1 if at < 0 else n

    def text(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of a text; each word is matched with a leading space."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.count(b" " + w)
        n = sum(map(known.__getitem__, words))
        if len(known) > self.remember:
            known.clear()
        return len(words), n


@lru_cache(maxsize=2)
def _automaton(rank_file: str) -> LongestMatch:
    """One automaton per worker process and vocabulary."""
    with open(rank_file, "rb") as f:
        return LongestMatch([base64.b64decode(x.split()[0]) for x in f if x.strip()])


def count_tokens(documents: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``documents(doc_id, text)``.

    ``rank_file`` lists the vocabulary, one base64 piece a line; pieces that
    begin with a space start a word, others continue it. Null and empty texts
    have no tokens; ids may be null or repeated; extra columns are left behind;
    an empty table gives no row.
    """

    def local(batches):
        machine = _automaton(rank_file)
        for b in batches:
            n = np.array([machine.text(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[:, 0]), pa.array(n[:, 1])], ["doc_id", "n_words", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, "doc_id long, n_words long, n_tokens long")
