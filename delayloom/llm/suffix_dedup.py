"""Removal of repeated 100-byte strings by a partitioned suffix sort; every removal is held against the bytes of both places."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running
from .scratch import Scratch, hash_below

#: Bytes of an anchor string; every 100-byte string holds one that its own bytes decide.
ANCHOR = 50
#: Seeds of the hashes that are tried before an error is raised; one is enough unless two different strings have one hash.
ATTEMPTS = 4
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a hash base and of its inverse modulo 2^64; each seed has an odd base of its own."""
    known = len(_POWERS[seed][0]) if seed in _POWERS else 1
    if known <= n:
        base = (int(_BASE) * (2 * seed + 1)) % 2**64
        size = max(n + 1, 2 * known)
        _POWERS[seed] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _U(v))])) for v in (base, pow(base, -1, 2**64)))
    return _POWERS[seed]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def prefix_hashes(raw: np.ndarray, seed: int = 0) -> np.ndarray:
    """Running polynomial hash; differences give the hash of any substring."""
    up, _ = _powers(len(raw), seed)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    down = _powers(len(prefix), seed)[1]
    return _mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(raw: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring ``size``-byte strings that share their anchor.

    The anchor of a string is its leftmost substring of ``ANCHOR`` bytes with
    the smallest hash, so equal strings have equal anchors at equal offsets.
    Returns per run the anchor's hash, the hash of all the run's bytes, the
    first string's start and the number of strings.
    """
    prefix = prefix_hashes(raw, seed)
    at = np.arange(len(raw) - ANCHOR + 1)
    h = substring_hashes(prefix, at, at + ANCHOR, seed)
    low = _sliding_min((h & ~_U(0xFFFFF)) | (at & 0xFFFFF).astype(np.uint64), size - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(first, len(low)))
    where = first + (((low[first] & _U(0xFFFFF)).astype(np.int64) - first) & 0xFFFFF)
    return h[where], substring_hashes(prefix, first, first + count - 1 + size, seed), first, count


def _splitters(sample: DataFrame, keys: list[str], parts: int, scratch: Scratch, name: str) -> list[tuple]:
    """At most ``parts - 1`` evenly spaced rows of a sample, in order.

    The sample is ranked by Spark; only the splitters themselves reach the
    driver, as every task that deals rows needs them. A sample of fewer rows
    than buckets gives all its rows.
    """
    if parts < 2:
        return []
    ranked = scratch.save(running(sample.select(F.lit(0).alias("all_"), *keys), scratch, f"{name}-sample", "all_", [F.col(c) for c in keys]), name)
    n = ranked.count()
    cut = F.floor(F.col("rank_") * parts / n) > F.floor((F.col("rank_") - 1) * parts / n)
    rows = ranked.filter(F.col("rank_") > 0).filter(cut).select(*keys).distinct().collect()
    scratch.drop(name, f"{name}-sample")
    return sorted(tuple(r) for r in rows)


def _bucket(cols: list[np.ndarray], splitters: list[tuple]) -> np.ndarray:
    """How many splitters are at or below each row."""
    table = np.array(splitters, np.int64).reshape(-1, len(cols))
    low, high = np.searchsorted(table[:, 0], cols[0], side="left"), np.searchsorted(table[:, 0], cols[0], side="right")
    open_ = np.flatnonzero(low < high)
    while len(open_):  # binary search among splitters with the row's first word
        middle = (low[open_] + high[open_]) // 2
        below, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k, c in enumerate(cols):
            split, row = table[middle, k], c[open_]
            below |= equal & (split < row)
            equal &= split == row
        below |= equal
        low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low.astype(np.int32)


def _batch(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _with_last(batches):
    """Columns of each batch behind the last row of the batch before, and whether there was none before."""
    last = None
    for b in batches:
        if b.num_rows:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            yield (cols if last is None else [np.concatenate(x) for x in zip(last, cols, strict=True)]), last is None
            last = [c[-1:].copy() for c in cols]


def _differs(cols: list[np.ndarray], first: bool) -> np.ndarray:
    """Rows that differ from the row before in any column; ``first`` says so of the first row."""
    return np.concatenate([[first], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])


def _deal(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    return rows.repartitionById(len(splitters) + 1, F.col("bucket"))


def _parts(n: float, each: int) -> int:
    return max(1, int(np.ceil(n / each)))


def repeated_spans(documents: DataFrame, scratch: Scratch, size: int, bucket_rows: int, sample_docs: int, max_buckets: int, seed: int, bits: int) -> DataFrame:
    """``doc, body, a, b, from_doc, from_body, shift``: byte ranges of ``documents(doc, body, text)`` covered by strings of ``size`` bytes that start earlier too, at ``a + shift`` of the other document.

    1. Every document is cut into runs of strings with a common anchor, about
       one per 26 bytes. Sampled splitters deal the runs by anchor; a bucket
       sorts locally. A run whose bytes all occur earlier is covered; the first
       of several different runs with one anchor may hold repeats in part.
    2. Only the strings of those runs become suffixes: they are dealt by their
       16 leading bytes (two words, then the hash of all ``size`` bytes, then
       the place) and sorted. A suffix equal to its predecessor in ``size``
       bytes starts later, so it is covered; the first suffix of a bucket is
       held against the last ones of other buckets.

    Equality past the first 16 bytes of a suffix, and of a whole run, is that
    of hashes of ``bits`` bits here, so equal strings are never missed, but
    different ones could be taken for equal: the caller compares the bytes.
    Each range comes with the place just before it in sort order; if strings
    of one hash differ, then two of them that follow each other do.

    ``doc`` and ``body`` together name a document and order it. Documents and
    places are part of every splitter, so that no number of equal strings can
    fill one bucket. Buckets hold about ``bucket_rows`` rows as long as there
    are no more than ``max_buckets`` of them, which bounds the splitters that
    driver and tasks hold; then they grow. A bucket is sorted by Spark, which
    spills, and read as a stream with one row carried on, so no bucket has to
    fit in memory. The sample takes at least 400 rows per bucket, and
    ``sample_docs`` documents, before it is thinned to 100.
    """
    mask = _U(2**bits - 1)
    run_names, run_keys = ["bucket", "anchor", "context", "doc", "body", "start", "count"], ["anchor", "context", "doc", "body", "start"]

    def runs_of(splitters):
        def local(batches):
            for b in batches:
                cols = [[] for _ in range(6)]
                for doc, body, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                    if len(raw) >= size:
                        a, c, first, count = anchors(raw, size, seed)
                        for to, v in zip(cols, ((a & mask).view(np.int64), (c & mask).view(np.int64), np.full(len(a), doc, np.int64), np.full(len(a), body, np.int64), first, count), strict=True):
                            to.append(v)
                if cols[0]:
                    cols = [np.concatenate(c) for c in cols]
                    yield _batch(run_names, [_bucket(cols[:5], splitters), *cols])

        return local

    schema = "bucket int, anchor long, context long, doc long, body long, start long, count long"
    n_docs, n_bytes = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, max(sample_docs / max(n_docs, 1), 400 / bucket_rows))

    def sampled(rows: DataFrame, make, n: float, keys: list[str], name: str) -> list[tuple]:
        parts = min(max_buckets, _parts(n, bucket_rows))
        some = rows.filter(hash_below(F.xxhash64("doc", "body", F.lit("sample")), share)).mapInArrow(make, schema)
        return _splitters(some.filter(hash_below(F.xxhash64(*keys), min(1.0, 100 * parts / max(n * share, 1)))), keys, parts, scratch, name)

    split = sampled(documents, runs_of([]), n_bytes / 26, run_keys, "run-splitters")
    lead = np.array(sorted({s[0] for s in split}), np.int64)

    def sort_runs(batches):
        names = ["doc", "body", "start", "count", "open", "from_doc", "from_body", "from_start"]
        held, n_new = None, 0  # the first run under the anchor that goes on, as long as it is the only one, and how many there were
        for cols, fresh in _with_last(batches):
            _, anchor, context, doc, body, start, count = cols
            new_a, new = _differs([anchor], fresh), _differs([anchor, context], fresh)
            group = np.cumsum(new_a) - int(fresh)
            total = np.bincount(group, new).astype(np.int64)
            total[0] += n_new
            several = (total[group] > 1) | np.isin(anchor, lead)
            keep = np.flatnonzero((~new | several) & _differs([anchor, context, doc, body, start], fresh))
            before = np.maximum(keep - 1, 0)
            if held is not None and total[0] > 1:
                yield _batch(names, [*held, np.array([True]), *held[:3]])
            if len(keep):
                yield _batch(names, [doc[keep], body[keep], start[keep], count[keep], new[keep], doc[before], body[before], start[before]])
            if group[-1] or fresh:
                at = np.flatnonzero(new_a)[-1:]
                held = [c[at].copy() for c in (doc, body, start, count)]
            n_new = total[-1]
            if n_new > 1 or several[-1]:
                held = None

    runs = _deal(documents.mapInArrow(runs_of(split), schema), split).sortWithinPartitions(*run_keys)
    found = runs.mapInArrow(sort_runs, "doc long, body long, start long, count long, open boolean, from_doc long, from_body long, from_start long")
    found = scratch.save(found, "runs")
    source = ["from_doc", "from_body", (F.col("from_start") - F.col("start")).alias("shift")]
    whole = found.filter("not open").select("doc", "body", F.col("start").alias("a"), (F.col("start") + F.col("count") - 1 + size).alias("b"), *source)
    open_runs = scratch.save(found.filter("open").groupBy("doc", "body").agg(F.collect_list(F.struct("start", "count")).alias("runs")).join(documents, ["doc", "body"]).select("doc", "body", "text", "runs"), "open")
    string = ["lead", "next", "all"]
    suffix_keys = [*string, "doc", "body", "start"]
    suffix_names = ["bucket", *suffix_keys]

    def suffixes_of(splitters):
        def local(batches):
            for b in batches:
                for doc, body, text, runs in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    prefix = prefix_hashes(raw, seed)
                    at = np.concatenate([np.arange(r["start"], r["start"] + r["count"]) for r in runs])
                    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 16)[at]).view(">u8").astype(np.uint64)
                    words = (words ^ _U(2**63)).view(np.int64)  # signed words in the order of their bytes
                    cols = [words[:, 0].copy(), words[:, 1].copy(), (substring_hashes(prefix, at, at + size, seed) & mask).view(np.int64), np.full(len(at), doc, np.int64), np.full(len(at), body, np.int64), at]
                    yield _batch(suffix_names, [_bucket(cols, splitters), *cols])

        return local

    schema = "bucket int, lead long, next long, all long, doc long, body long, start long"
    n_suffixes = found.filter("open").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    n_docs = open_runs.count()
    share = min(1.0, max(sample_docs / max(n_docs, 1), 400 / bucket_rows))
    split2 = sampled(open_runs, suffixes_of([]), n_suffixes, suffix_keys, "suffix-splitters")

    def sort_suffixes(batches):
        part, last = TaskContext.get().partitionId(), None

        def rows(kind, at, cols, before):
            # Strings are needed only at the ends of a bucket.
            string_of = [c[at] if kind else np.zeros(len(at), np.int64) for c in cols[:3]]
            head = [np.full(len(at), v, np.int32) for v in (part, kind)]
            return _batch(["part", "kind", *suffix_keys, "from_doc", "from_body", "from_start"], [*head, *string_of, *[c[at] for c in cols[3:]], *[c[before] for c in cols[3:]]])

        for cols, fresh in _with_last(batches):
            cols = cols[1:]
            same = np.flatnonzero(~_differs(cols[:3], True) & _differs(cols[3:], False))
            if fresh:
                yield rows(1, [0], cols, [0])
            if len(same):
                yield rows(0, same, cols, same - 1)
            last = [c[-1:].copy() for c in cols]
        if last:
            yield rows(2, [0], last, [0])

    suffixes = _deal(open_runs.mapInArrow(suffixes_of(split2), schema), split2).sortWithinPartitions(*suffix_keys)
    hit = suffixes.mapInArrow(sort_suffixes, f"part int, kind int, {', '.join(f'{c} long' for c in [*suffix_keys, 'from_doc', 'from_body', 'from_start'])}")
    hit = scratch.save(hit, "suffixes")
    scratch.drop("open")
    # A bucket's first suffix repeats one before it if an earlier bucket ends with the same string.
    last = hit.filter("kind = 2").groupBy(*string).agg(F.min(F.struct("part", F.col("doc").alias("from_doc"), F.col("body").alias("from_body"), F.col("start").alias("from_start"))).alias("ended"))
    first = hit.filter("kind = 1").drop("from_doc", "from_body", "from_start").join(last, string).filter("ended.part < part").select("doc", "body", "start", "ended.*")
    names = ["doc", "body", "start", "from_doc", "from_body", "from_start"]
    strings = hit.filter("kind = 0").select(*names).union(first.select(*names))
    return whole.union(strings.select("doc", "body", F.col("start").alias("a"), (F.col("start") + size).alias("b"), *source))


def stretches(spans: DataFrame) -> DataFrame:
    """``spans`` with ranges that touch and have the same other document and shift made one, and a number ``id`` for each."""
    along = Window.partitionBy("doc", "body", "from_doc", "from_body", "shift").orderBy("a")
    reach = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.repartition("doc", "body").withColumn("new", (F.col("a") > F.coalesce(reach, F.lit(-1))).cast("int"))
    cut = cut.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy("doc", "body", "from_doc", "from_body", "shift", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.drop("part").withColumn("id", F.monotonically_increasing_id())


def keep_unrepeated(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the ranges, bytes removed, and maximal removed runs."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def dedup_suffixes(documents: DataFrame, size: int = 100, bucket_rows: int = 400_000, sample_docs: int = 2000, max_buckets: int = 20_000, first_bits: int = 64) -> DataFrame:
    """Take out of every text the bytes covered by a ``size``-byte string that also starts earlier.

    Earlier: smaller doc_id (among different texts under one id: smaller hash
    of the text), or same document and smaller start; strings are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans and kept
    (binary: the remaining bytes; a cut may split a character).

    Strings are found by hashes and sorting (``repeated_spans``). Every range
    found is then held against its other place by SHA-256 of the bytes of both;
    if a pair differs, different strings had one hash, and all is found again
    with another hash. The first attempt keeps ``first_bits`` bits of it.

    Null texts are empty; null ids come before all others; rows that share id
    and text are one document and fare alike, rows that share an id but not a
    text are several. Extra columns are left behind; an empty table gives no row.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    for seed in range(ATTEMPTS):
        scratch = Scratch(spark, "suffix-dedup")
        spans = repeated_spans(rows.select("doc", "body", "text"), scratch, size, bucket_rows, sample_docs, max_buckets, seed, 64 if seed else first_bits)
        found = scratch.save(stretches(spans), "stretches")
        scratch.drop("runs", "suffixes")
        out = scratch.save(_cut_out(rows, found), "cut")
        scratch.drop("stretches")
        # One row per stretch and place: the digests of the two places must agree.
        digests = out.select(F.explode(F.arrays_zip("ids", "digests")).alias("x")).select("x.*")
        if digests.groupBy("ids").agg((F.min("digests") != F.max("digests")).alias("wrong")).filter("wrong").isEmpty():
            return out.drop("ids", "digests")
        scratch.drop()
    raise RuntimeError(f"different strings had equal hashes under each of {ATTEMPTS} seeds")


def _cut_out(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` without the bytes of the stretches ``found``, with SHA-256 digests of the bytes of each stretch that the row holds or is the other place of."""
    other = found.select(F.col("from_doc").alias("doc"), F.col("from_body").alias("body"), (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"), "id", F.lit(False).alias("own"))
    both = found.select("doc", "body", "a", "b", "id", F.lit(True).alias("own")).union(other)
    pieces = both.groupBy("doc", "body").agg(F.collect_list(F.struct("a", "b", "id", "own")).alias("pieces"))
    p = F.col("pieces")
    joined = rows.join(pieces, ["doc", "body"], "left").select("doc_id", "text", p["a"].alias("a"), p["b"].alias("b"), p["id"].alias("id"), p["own"].alias("own"))

    def local(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for text, a, b, ids, own in zip(*[batch.column(i).to_pylist() for i in range(1, 6)], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                mine = np.array(own or [], bool)
                kept = keep_unrepeated(raw, np.array(a)[mine], np.array(b)[mine]) if mine.any() else (raw, 0, 0)
                digests = [hashlib.sha256(raw[x:y]).digest() for x, y in zip(a or [], b or [], strict=True)]
                for to, v in zip(out, (len(raw), kept[1], kept[2], kept[0], ids or [], digests), strict=True):
                    to.append(v)
            types = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "ids", "digests"])

    return joined.mapInArrow(local, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, ids array<long>, digests array<binary>")
