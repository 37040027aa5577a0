"""Harmonic packing of tokenized documents into sequences of fixed capacity."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running
from .scratch import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, per_bin long"
#: White space at which words can't be told apart by single spaces and line ends alone.
ODD_SPACE = re.compile(r"[^\S \n]|[ \n]{2}|^[ \n]|[ \n]$")


class Encoder:
    """Byte-level BPE ids of texts as little-endian 32-bit bytes, with words kept between texts.

    ``tokenizer_file`` says what the ids are. A text that holds one of its
    added tokens goes through that tokenizer as a whole. All others are encoded
    from the same vocabulary's rank file, which gives the same ids in less
    time: the vocabulary's pattern never joins letters across a single space or
    line end, so a text of such words is the concatenation of its words' ids.
    Any other white space sends the text to the rank encoder as a whole. At
    most ``remember`` words are held, then the store starts anew.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str, remember: int = 700_000):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.remember, self.spaced, self.bare = remember, {}, {}
        self.line_end = self.plain("\n")

    def plain(self, text: str) -> bytes:
        if self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._rank(text)

    def _rank(self, text: str) -> bytes:
        return array("I", self.ordinary(text)).tobytes()

    def _line(self, line: str) -> bytes:
        head, *rest = line.split(" ")
        bare, spaced = self.bare, self.spaced
        if (first := bare.get(head)) is None:
            first = bare[head] = self._rank(head)
        try:
            return first + b"".join(map(spaced.__getitem__, rest))
        except KeyError:
            for w in rest:
                if w not in spaced:
                    spaced[w] = self._rank(f" {w}")
            return first + b"".join(map(spaced.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text) or self.added.search(text):
            return self.plain(text)
        ids = self.line_end.join([self._line(x) for x in text.split("\n")])
        if len(self.spaced) + len(self.bare) > self.remember:
            self.spaced, self.bare = {}, {}
        return ids


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, rank_file: str, pattern: str) -> Encoder:
    """One encoder per worker process, so that later tasks find its words."""
    return Encoder(tokenizer_file, rank_file, pattern)


def cut(n: int, capacity: int, fine: int) -> list[tuple[int, int]]:
    """(length, pieces per bin) of a document of ``n`` ids.

    Full sequences first, then pieces of exactly capacity/j for the smallest j
    that fits, until at most capacity/fine is left; that rest goes to the class
    of the reciprocal above it.
    """
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    while n > capacity // fine:
        j = -(-capacity // n)
        out.append((capacity // j, j))
        n -= capacity // j
    return [*out, (n, capacity // n)] if n else out


def document_pieces(documents: DataFrame, tokenizer_file: str, rank_file: str, pattern: str, end_id: int, capacity: int = 2048, fine: int = 16) -> DataFrame:
    """Pieces of ``documents(doc_id, text)`` with their class: how many of them fill one bin."""

    def local(batches):
        encode, end = _encoder(tokenizer_file, rank_file, pattern), array("I", [end_id]).tobytes()
        for b in batches:
            cols = [array("q") for _ in range(5)]
            ids_of = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, at = memoryview(encode(text or "") + end), 0
                total = len(raw) // 4
                for length, per_bin in cut(total, capacity, fine):
                    ids_of.append(doc_id)
                    for c, v in zip(cols, (at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), total, per_bin), strict=True):
                        c.append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), *[pa.array(np.frombuffer(c, np.int64)) for c in cols]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "per_bin"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, PIECES)


def _best_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for the few pieces that fill no bin of their class: best fit, longest first."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "per_bin"], ascending=[False, True, True, True]).reset_index(drop=True)
    room, open_bins, bins, offsets = [], [[] for _ in range(capacity + 1)], [], []
    for length in pieces["length"]:
        left = next((r for r in range(length, capacity + 1) if open_bins[r]), None)
        if left is None:
            k, left = len(room), capacity
            room.append(capacity)
        else:
            k = open_bins[left].pop()
        bins.append(k)
        offsets.append(capacity - left)
        room[k] = left - length
        open_bins[room[k]].append(k)
    return pieces.assign(sequence_id=np.array(bins, np.int64), offset=np.array(offsets, np.int64))


def harmonic_bins(pieces: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """``pieces(doc_id, start, length, per_bin, ...)`` with ``sequence_id`` and ``offset``.

    Class j holds lengths in (capacity/(j+1), capacity/j] and puts exactly j
    pieces in a bin, so bins follow from a piece's place in its class. Each
    class leaves fewer than j pieces over; there are as many classes as
    reciprocals, whatever the number of documents, and these leftovers are put
    together in one small group.
    """
    names = pieces.columns
    ranked = scratch.save(running(pieces, scratch, "classes", "per_bin", [F.col("doc_id"), F.col("start")], "length"), "ranked")
    classes = ranked.groupBy("per_bin").agg(F.floor(F.count("*") / F.col("per_bin")).alias("bins"))
    order = Window.orderBy("per_bin")
    classes = scratch.save(classes.select("per_bin", "bins", F.coalesce(F.sum("bins").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_bin")), "bins")
    placed = ranked.join(F.broadcast(classes), "per_bin").withColumn("own_", F.floor(F.col("rank_") / F.col("per_bin")))
    whole = placed.filter("own_ < bins")
    bin_id = F.col("first_bin") + F.col("own_")
    inside = Window.partitionBy("sequence_id").orderBy("rank_").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("sequence_id", bin_id).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    left = placed.filter("own_ >= bins").select(*names, F.lit(0).alias("all_")).groupBy("all_").applyInPandas(lambda p: _best_fit(p.drop(columns="all_"), capacity), schema)
    after = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("after_"))
    left = left.crossJoin(F.broadcast(after)).withColumn("sequence_id", F.col("sequence_id") + F.col("after_"))
    return whole.select(*names, "sequence_id", "offset").unionByName(left.select(*names, "sequence_id", "offset"))


def pack_documents(documents: DataFrame, tokenizer_file: str, rank_file: str, pattern: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Pack ``documents(doc_id, text)`` into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. The ids are those of ``tokenizer_file`` without added
    special tokens (those that stand in a text count); ``rank_file`` holds the
    same vocabulary's ranks. A null or empty text is its end id alone; repeated
    rows are packed as often as they occur; extra columns are left behind; an
    empty table gives no piece.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    pieces = scratch.save(document_pieces(documents, tokenizer_file, rank_file, pattern, end_id, capacity), "pieces")
    return harmonic_bins(pieces, scratch, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
