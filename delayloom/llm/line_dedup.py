"""Repeated line runs by a suffix array over line ids, built by prefix doubling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .scratch import Scratch

PLACE = ["doc", "body", "pos"]


def _ranks(keyed: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``keys`` that occur at least twice with their rank in sort order, from 0.

    Occurrences are counted before anything is sorted, so a frequent key is
    one row here. Sampled range partitions are numbered locally and then
    shifted by the totals of those before.
    """
    repeated = keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys)
    spread = scratch.save(repeated.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), f"{name}-spread")
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    local = spread.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1)
    return scratch.save(local.join(shift, "part").select(*keys, (F.col("local") + F.col("shift")).cast("long").alias("rank")), name)


def _reach(counts: Column, least: int) -> Column:
    """How many leading elements of a word-count array it takes to reach ``least`` words; null if all don't."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"))
    step = lambda a, x: F.when(a["s"] >= least, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s")))
    return F.aggregate(counts, zero, step, lambda a: F.when(a["s"] >= least, a["n"]))


def line_blocks(documents: DataFrame, min_words: int) -> DataFrame:
    """One row per line with a word: its place, raw line number, line id, and the shortest runs of ``min_words`` words from it and up to it."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("at"), word_count(x).alias("words"))), lambda x: x["words"] > 0)
    rows = documents.select(F.col("doc"), F.col("body"), lines.alias("lines")).filter(F.size("lines") > 0)
    rows = rows.withColumn("w", F.col("lines.words")).select("doc", "body", "w", F.posexplode("lines").alias("pos", "x"))
    low = F.greatest(F.lit(0), F.col("pos") + 1 - min_words)
    return rows.select(
        *PLACE, F.col("x.at").alias("at"),
        F.xxhash64("x.line").alias("id1"), F.xxhash64(F.lit("line"), F.col("x.line")).alias("id2"),
        _reach(F.slice("w", F.col("pos") + 1, F.lit(min_words)), min_words).alias("ahead"),
        _reach(F.reverse(F.slice("w", low + 1, F.col("pos") + 1 - low)), min_words).alias("back"),
    )


def _maximal(later: DataFrame) -> DataFrame:
    """``doc, body, start, stop`` and the earlier place of each longest run that ``later(doc, body, pos, len, from_doc, from_body, from_pos)`` makes up.

    Runs of one document that repeat the same earlier document at the same
    distance and touch have one common prefix: from the first line on, all
    lines to the end of the last run are equal in both places.
    """
    pair = ["doc", "body", "from_doc", "from_body", "distance"]
    along = Window.partitionBy(*pair).orderBy("pos", "len")
    rows = later.withColumn("distance", F.col("pos") - F.col("from_pos")).withColumn("reach", F.max(F.col("pos") + F.col("len")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum((F.col("pos") > F.coalesce("reach", F.lit(-1))).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*pair, "run").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("stop"), F.min("from_pos").alias("from_start")).drop("run", "distance")


def repeated_runs(documents: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """Maximal runs of lines of ``documents(doc, body, text)`` that also start earlier: ``doc, body, start, stop, from_doc, from_body, from_start``.

    Level k gives each position the rank of its 2^k lines among all such
    strings; pairs of ranks give level k + 1. Positions whose string is unique
    leave, as no longer string from there can repeat. A run of l lines is two
    overlapping strings of the largest level in l: runs with equal ranks form
    the interval of the suffix array with a common prefix of l lines, and its
    earliest member is the one that stays. Every line of a repeated run lies in
    a shortest repeated run from some line on or up to the line itself, so only
    those shortest runs look for their interval; what touches in both places
    then adds up to the longest common prefix with the earlier place (a run is
    parted where its lines have another, still earlier source). Numbers count
    lines with a word. The places of all lines stay in the table "lines".
    """
    lines = scratch.save(line_blocks(documents, min_words), "lines")
    ids = _ranks(lines, ["id1", "id2"], scratch, "ids")
    at = scratch.save(lines.join(ids, ["id1", "id2"]).select(*PLACE, "at", "ahead", "back", "rank").distinct(), "level-0")
    back = at.filter("back is not null").select("doc", "body", (F.col("pos") + 1 - F.col("back")).alias("pos"), F.col("back").alias("len"))
    runs = scratch.save(at.filter("ahead is not null").select("doc", "body", "pos", F.col("ahead").alias("len")).union(back).distinct(), "runs")
    spans, level, longest = [], 0, runs.agg(F.max("len")).first()[0] or 0
    while True:
        width = 2**level
        rank = at.select(*PLACE, F.col("rank").alias("head"))
        tail = at.select("doc", "body", (F.col("pos")).alias("last"), F.col("rank").alias("tail"))
        keyed = scratch.save(runs.filter(f"len >= {width} and len < {2 * width}").join(rank, PLACE).withColumn("last", F.col("pos") + F.col("len") - width).join(tail, ["doc", "body", "last"]).select(*PLACE, "len", "head", "tail"), f"runs-{level}")
        first = scratch.save(keyed.groupBy("len", "head", "tail").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1").drop("n"), f"first-{level}")
        later = keyed.join(first, ["len", "head", "tail"]).filter(F.struct(*PLACE) > F.col("first"))
        spans.append(scratch.save(later.select("doc", "body", "pos", "len", F.col("first.doc").alias("from_doc"), F.col("first.body").alias("from_body"), F.col("first.pos").alias("from_pos")), f"later-{level}"))
        scratch.drop(f"runs-{level}", f"first-{level}")
        if longest < 2 * width:
            break
        ahead = Window.partitionBy("doc", "body").orderBy("pos").rangeBetween(width, width)
        pairs = scratch.save(at.withColumn("next", F.max("rank").over(ahead)).filter("next is not null"), f"pairs-{level}")
        named = _ranks(pairs.select(F.col("rank").alias("head"), F.col("next").alias("tail")), ["head", "tail"], scratch, f"names-{level}")
        old = f"level-{level}"
        level += 1
        longer = named.select(F.col("head").alias("rank"), F.col("tail").alias("next"), F.col("rank").alias("new"))
        at = scratch.save(pairs.join(longer, ["rank", "next"]).select(*PLACE, F.col("new").alias("rank")), f"level-{level}")
        scratch.drop(old, f"pairs-{level - 1}", f"names-{level - 1}", f"names-{level - 1}-spread")
    every = spans[0]
    for s in spans[1:]:
        every = every.union(s)
    return _maximal(every)


def repeated_lines(documents: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """``doc, body, gone``: raw numbers of the lines that lie in ``repeated_runs``."""
    found = repeated_runs(documents, scratch, min_words)
    covered = found.select("doc", "body", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct()
    lines = documents.sparkSession.read.parquet(f"{scratch.path}/lines")
    return covered.join(lines.select(*PLACE, "at"), PLACE).groupBy("doc", "body").agg(F.collect_set("at").alias("gone"))


def dedup_lines(documents: DataFrame, min_words: int = 30) -> DataFrame:
    """``documents`` with later copies of repeated line runs taken out of ``text``; adds n_lines and n_removed.

    A line goes if it lies in a run of consecutive lines with at least
    ``min_words`` words together that starts earlier too (smaller doc_id, or
    same document, earlier line). Lines without a word aren't part of runs and
    stay. Input is judged as it came, not what is left of it.

    Null ids come before all others; a null text stays null and has no lines;
    rows with equal id and text are one document and fare alike. All columns
    of the input stay, except that n_lines and n_removed are set anew. An empty
    table gives no row.
    """
    scratch = Scratch(documents.sparkSession, "line-dedup")
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("body"))
    gone = scratch.save(repeated_lines(keyed.select("doc", "body", F.col("row.text").alias("text")).filter("text is not null"), scratch, min_words), "gone")
    scratch.drop("lines")
    joined = keyed.join(gone.hint("merge"), ["doc", "body"], "left")
    text = F.col("row.text")
    stay = lambda n: F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    # The one-element array binds the split text to a name, so that it is split once and not per line.
    cut = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.array_join(F.transform(stay(F.size(x)), lambda i: F.get(x, i)), "\n"))[0]
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = {"text": F.when(F.col("gone").isNull(), text).otherwise(cut)}
    return joined.select(*[out.get(c, F.col("row")[c]).alias(c) for c in names], n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
