"""Near-duplicates by MinHash: documents are posted under signature coordinates and collisions counted."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

COORDINATES = 64
#: Equal coordinates that make a candidate. A pair of similarity 0.75 has 48 on average; fewer than 28 has a chance below 1e-7.
MATCHES = 28
#: Hash classes in which common shingles are counted to bound what a pair can share.
CLASSES = 64
_U = np.uint64
_RNG = np.random.default_rng(77)
_MULTIPLY = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words, each computed once; starts anew beyond a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z in lower case.

    With fewer words than ``size`` the whole sequence is the one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    s = np.full(n, min(len(words), size), np.uint64)
    for i in range(min(size, len(words))):
        s = (s * _STEP) ^ h[i : n + i]
        s = s ^ (s >> _U(29))
    return np.unique(s * _STEP)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of ``COORDINATES`` hashes over a shingle set."""
    out = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096, None] * _MULTIPLY + _ADD
        out = np.minimum(out, (part >> _U(32)).min(0))
    return out.astype(np.uint32)


def _sketches(batches):  # doc_id, text, body
    hashes = _WordHashes()
    for b in batches:
        n, digest, sig = [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, hashes)
            n.append(len(s))
            digest.append(hashlib.sha256(s.tobytes()).digest())
            sig.append(signature(s).view(np.int32).tolist() if len(s) else None)
            if len(hashes) > 400_000:
                hashes.clear()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "body", "n_shingles", "digest", "sig"])


def _sets(batches):
    hashes = _WordHashes()
    for b in batches:
        sets = [shingle_set(t, hashes).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _common(batches):
    count = lambda x: np.bincount(x.values.to_numpy().view(np.uint64) % _U(CLASSES), minlength=CLASSES) if x.is_valid else 0
    for b in batches:
        rows = [(count(all_) - count(own)).astype(np.int32) for all_, own in zip(b.column(1), b.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["node", "common"])


def _linked(percent: int):
    def local(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return local


def _mixed(entries: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The entries of those lists of ``entries(key, component, ...)`` that hold several components."""
    keys = scratch.save(entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), name)
    return entries.join(keys, "key")


def _partnered(rest: DataFrame, percent: int) -> DataFrame:
    """The entries of ``rest(key, n_shingles, sum_a, ...)`` that can be linked to any entry of their list at all, by size and by shingles they share.

    A link asks ``(100 + percent) * common >= percent * (n + m)`` of sizes n and m, so an entry's shared shingles
    bound its partner's size: ``reach``. It needs an entry no larger than its reach whose own reach is no smaller
    than the entry. A running maximum over the sizes and reaches of a list answers that, each value once
    however many entries bear it, so no two entries meet.
    """
    reach = F.floor(F.col("sum_a") * (100 + percent) / percent + 1e-9).cast("long") - F.col("n_shingles")
    rest = rest.withColumn("reach", reach)
    held = rest.groupBy("key", F.col("n_shingles").alias("at")).agg(F.max("reach").alias("far"))
    asked = rest.select("key", F.col("reach").alias("at"), F.lit(None).cast("long").alias("far")).distinct()
    up_to = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    found = held.union(asked).select("key", "at", F.max("far").over(up_to).alias("far")).distinct().withColumnRenamed("at", "reach")
    return rest.join(found, ["key", "reach"]).filter("far >= n_shingles").drop("reach", "far")


def _close_pairs(rest: DataFrame, scratch: Scratch, percent: int, block: int = 500) -> DataFrame:
    """Pairs ``(a, b)`` of one list of ``rest(key, doc_id, n_shingles, component, common, sum_a)`` that can be linked.

    Entries of a list's largest component have no pair among themselves: they
    stay where they are, and only the others visit them and each other. Sizes
    of linked sets differ by a factor of 100 / percent at most: a list falls
    into bands of that width, and an entry visits its own band and both next
    to it. A band's entries come in blocks of about ``block``, each a key of
    its own, so no list is one task's; of its pairs only those are written
    whose counts of common shingles allow a link.
    """
    band = F.floor(F.log(F.col("n_shingles")) / math.log(100 / percent) + 1e-9).alias("band") if percent < 100 else F.col("n_shingles").alias("band")
    parts = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    banded = scratch.save(rest.join(largest, "key").select(*rest.columns, band, (F.col("component") == F.col("largest")).alias("stays")), "banded")
    blocks = scratch.save(banded.groupBy("key", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "blocks")
    hosts = banded.join(blocks, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    guests = banded.filter("not stays").select("key", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("component").alias("cb"), F.col("common").alias("ob"), F.col("sum_a").alias("sum_b"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    guests = guests.join(blocks, ["key", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    most = "aggregate(zip_with(common, ob, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
    near = F.expr(f"""(stays or doc_id < b) and component <> cb and 100 * least(n_shingles, nb) >= {percent} * greatest(n_shingles, nb)
        and least(sum_a, sum_b) * {100 + percent} >= {percent} * (n_shingles + nb) and {most} * {100 + percent} >= {percent} * (n_shingles + nb)""")
    return hosts.join(guests, ["key", "band", "block"]).filter(near).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))


class _Search:
    """Links among candidate documents: equal coordinates first, then full sets, each made once for all rounds."""

    def __init__(self, texts: DataFrame, heads: DataFrame, candidates: DataFrame, scratch: Scratch, percent: int):
        self.scratch, self.percent, self.round = scratch, percent, 0
        near = scratch.save(heads.join(candidates.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "doc_id", "body", "sig"), "signatures")
        self.sig = near.select("node", "sig")
        # repeated rows meet before the shuffle; the join then needs no other
        once = texts.groupBy("doc_id", "body").agg(F.first("text").alias("text"))
        self.sets = scratch.save(once.join(near.select("doc_id", "body", "node").hint("merge"), ["doc_id", "body"]).select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"), "sets")

    def common_shingles(self, rest: DataFrame) -> DataFrame:
        """``node, common``: per hash class, how many of a document's shingles another document of ``rest`` has too.

        Two documents have at most the sum of the classes' smaller counts in common.
        """
        sets = self.scratch.save(self.sets.join(rest.select("node").distinct().hint("merge"), "node", "left_semi"), "rest-sets")
        seen = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"))
        own = seen.filter("n = 1").groupBy("node").agg(F.collect_list("shingle").alias("own"))
        return sets.join(own, "node", "left").mapInArrow(_common, "node long, common array<int>")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that have enough equal coordinates and then are linked on their full sets."""
        self.round += 1
        k = self.round
        left = self.sig.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
        right = self.sig.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        close = self.scratch.save(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").filter(equal >= MATCHES).select("a", "b"), f"close-{k}")
        x = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge")
        y = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge")
        full = close.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        linked = self.scratch.save(full.mapInArrow(_linked(self.percent), "a long, b long, linked boolean").filter("linked").select("a", "b"), f"linked-{k}")
        self.scratch.drop(f"close-{k}")
        return linked


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``documents(doc_id, text)``.

    Documents are linked where 100 * intersection >= percent * union of their
    sets of five-word shingles; component_id is the smallest id reachable.

    Equal sets (by the SHA-256 of all their shingles) are one node. It is posted under each coordinate and
    value of its signature. Lists with one entry are skipped; of the others a
    pair with ``MATCHES`` equal coordinates must meet in the rarest few of
    each side (prefix), so the long lists are not merged but looked up in the
    signatures. In a list all entries are first held against the entry whose
    coordinates are shared most, as a source is by its edited copies; linked
    entries become one component. Of lists that still hold several components
    entries without a possible partner leave (``_partnered``), the others are
    held against the one that shares most of its shingles, and only then are
    entries of different components paired, no pair whose sizes ask for more
    common shingles than the two can have (``_close_pairs``). Every pair is
    confirmed on full sets.

    Texts without words have empty sets and no links; null ids have no links
    and a null component. Repeated rows fare alike. Rows that share an id but
    not a text are one document: each text keeps its own links, and the id joins
    them. Extra columns are left behind; an empty table gives no row.
    """
    scratch = Scratch(documents.sparkSession, "near-dedup")
    text = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("body"))
    every = scratch.save(text.mapInArrow(_sketches, "doc_id long, body long, n_shingles long, digest binary, sig array<int>"), "sketches")
    named = every.filter("doc_id is not null and n_shingles > 0")
    one = named.groupBy("digest").agg(F.min(F.struct("doc_id", "body")).alias("who"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    heads = scratch.save(one.select(F.monotonically_increasing_id().alias("node"), "digest", "who.doc_id", "who.body", "n_shingles", "sig"), "heads")
    links = _links(text.filter("doc_id is not null"), heads, scratch, percent)
    links = scratch.save(links.union(_shared_ids(named, heads)), "links")
    labels = connected_components(links, scratch, "components")
    of = heads.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = scratch.save(of.join(least, "component").select("digest", "component_id"), "known")
    whole = every.join(known, "digest", "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return whole.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _shared_ids(named: DataFrame, heads: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the nodes of ids that stand for several sets."""
    ids = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc_id", "low")
    met = named.join(ids, "doc_id").filter("digest <> low").select("low", "digest").distinct()
    a = heads.select(F.col("digest").alias("low"), F.col("node").alias("a"))
    return met.join(a, "low").join(heads.select("digest", F.col("node").alias("b")), "digest").select("a", "b")


def _links(texts: DataFrame, heads: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links ``(a, b)`` between nodes that leave no linked pair in different components."""
    posts = heads.select("node", "n_shingles", F.posexplode("sig").alias("k", "v")).select("node", "n_shingles", (F.shiftleft(F.col("k").cast("long"), 32) + (F.col("v").cast("long") + 2**31)).alias("key"))
    often = scratch.save(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    shared = posts.join(often, "key")
    mine = Window.partitionBy("node")
    ranked = shared.withColumn("m", F.count("*").over(mine)).withColumn("score", F.sum("n").over(mine)).filter(F.col("m") >= MATCHES).withColumn("r", F.row_number().over(mine.orderBy("n", "key")))
    prefix = scratch.save(ranked.filter(F.col("r") <= F.col("m") - MATCHES + 1).select("key", "node", "n_shingles", "score"), "prefix")
    scratch.drop("often")
    search = _Search(texts, heads, prefix, scratch, percent)
    leaders = scratch.save(prefix.groupBy("key").agg(F.max(F.struct("score", (-F.col("node")).alias("order"), "node", "n_shingles")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("key", F.col("top.node").alias("a"), F.col("top.n_shingles").alias("na")), "leaders")
    sized = f"100 * n_shingles >= {percent} * na and 100 * na >= {percent} * n_shingles"
    star = scratch.save(prefix.join(leaders, "key").filter(f"a <> node and {sized}").select("a", F.col("node").alias("b")).distinct(), "star")
    links = search.verify(star)
    tagged = scratch.save(_labelled(prefix.drop("score"), connected_components(links, scratch, "first")), "tagged")
    rest = scratch.save(_mixed(tagged, scratch, "mixed"), "rest")
    total = F.aggregate("common", F.lit(0), lambda s, x: s + x).alias("sum_a")
    rest = scratch.save(rest.join(search.common_shingles(rest).select("*", total), "node"), "bounded")
    rest = scratch.save(_mixed(scratch.save(_partnered(rest, percent), "partnered"), scratch, "mixed-partnered"), "rest-partnered")
    # once more an entry for all of a list: the one that shares most of its shingles
    heart = rest.groupBy("key").agg(F.max(F.struct("sum_a", (-F.col("node")).alias("order"), "node", "n_shingles", "component")).alias("top")).select("key", F.col("top.node").alias("a"), F.col("top.n_shingles").alias("na"), F.col("top.sum_a").alias("sum_b"), F.col("top.component").alias("ca"))
    fits = f"component <> ca and least(sum_a, sum_b) * {100 + percent} >= {percent} * (n_shingles + na)"
    met = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hearts = rest.join(heart, "key").filter(fits).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    hearts = scratch.save(hearts.join(met, ["a", "b"], "left_anti"), "hearts")
    links = scratch.save(links.union(search.verify(hearts)), "links-twice")
    rest = scratch.save(_labelled(rest.drop("component"), connected_components(links, scratch, "second")), "tagged-twice")
    rest = scratch.save(_mixed(rest, scratch, "mixed-twice"), "rest-twice")
    pairs = _close_pairs(rest.withColumnRenamed("node", "doc_id"), scratch, percent).distinct()
    pairs = scratch.save(pairs.join(met.union(hearts), ["a", "b"], "left_anti"), "pairs")
    return links.union(search.verify(pairs))


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``entries(node, ...)`` with the component of each node: its own number where it has no link."""
    return entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
