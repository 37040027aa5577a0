"""Weighted fair queueing: mix sources so that each gets its target share of a total budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running
from .scratch import Scratch

#: Bytes that part words: space and the five ASCII control spaces.
SPACE = r"[\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Words of a packet, the unit in which the queues are served.
PACKET = 64


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null: none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def water_levels(sources: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` with ``place``, ``weight`` and ``target``.

    Weights 1, 2, 3 repeat in code-point order of the source, null last. The
    targets share the total of all sizes by weight; none exceeds ``cap`` times
    its source, the excess going to the others by weight. One row per source:
    the table of sources, not of documents, is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("place", F.row_number().over(order) - 1)
    w = w.withColumn("weight", (F.col("place") % 3 + 1).cast("long")).withColumn("most", F.col("source_size") * cap)
    up = Window.orderBy((F.col("most").cast("double") / F.col("weight")).asc(), F.col("place").asc())
    ahead, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(ahead), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double"))
    fits = F.when(F.col("level") <= F.col("most").cast("double") / F.col("weight"), F.col("level"))
    w = w.withColumn("level", F.max(F.struct(fits.isNotNull().alias("ok"), (-F.col("most").cast("double") / F.col("weight")).alias("r"), (-F.col("place")).alias("p"), fits.alias("v"))).over(everything)["v"])
    share = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return w.select("source", "source_size", "place", "weight", F.coalesce(share, F.col("most").cast("double")).alias("target"))


def mix_sources(rows: DataFrame, packet: int = PACKET, seed: str = "mix") -> DataFrame:
    """The mix of ``rows(doc_id, source, size, ...)``: one row per row and turn that it takes words of.

    Rows of a source queue in shuffled order (a hash of id and seed), and the
    whole queue may come round three times. A row enters as packets of at most
    ``packet`` words. A packet's virtual finish time is the source's cumulative
    words, this packet included, over its target. All packets are sorted by it
    over all sources, and the mix is cut where their running sum reaches the
    total of all sizes; the packet at the cut is taken in part. So the budget
    is met to the word, and a source misses its target by less than a packet
    and rounding. Ahead of a packet that starts a packet for each source or more
    past its source's target lie all that source's words before it and, of
    every other one, its target less a packet: the budget at least. So packets
    from there on are never made. Adds source_size, target, turn, finish (of the last packet
    taken), taken and mix_offset (words before the first packet).

    Null ids and sources queue like values (null source: last place); rows of
    size zero never enter; repeated rows count one by one. Ties in finish time
    go by source place, then place in the queue. Input columns with names of
    added ones are replaced. An empty table gives an empty mix.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "mixing")
    names = [c for c in rows.columns if c not in ("row_", "source_size", "target", "turn", "finish", "taken", "mix_offset")]
    rows = scratch.save(rows.select(*names, F.monotonically_increasing_id().alias("row_")), "rows")
    levels = scratch.save(water_levels(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "levels")
    budget, sources = levels.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    shuffle = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    tagged = rows.filter("size > 0").join(levels, rows["source"].eqNullSafe(levels["source"])).select("row_", "doc_id", "size", "source_size", "target", "place", shuffle.alias("shuffle_"))
    queued = running(tagged, scratch, "queue", "place", [F.col("shuffle_"), F.col("doc_id"), F.col("size")], "size")
    turns = queued.select("row_", "place", "size", "source_size", "target", "before_", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("turn"))
    turns = turns.withColumn("first_", F.col("turn") * F.col("source_size") + F.col("before_"))
    reach = F.floor("target") + 1 + sources * packet - F.col("first_")  # what lies further on can't be taken
    packets = turns.filter(reach > 0).withColumn("at_", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("size"), reach) - 1, F.lit(packet).cast("long"))))
    packets = packets.withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("at_"))).withColumn("start_", F.col("first_") + F.col("at_"))
    packets = packets.select("row_", "place", "turn", "start_", "words", ((F.col("start_") + F.col("words")) / F.col("target")).alias("finish"), F.lit(0).alias("all_"))
    sent = running(packets, scratch, "packets", "all_", [F.col("finish"), F.col("place"), F.col("start_")], "words").filter(F.col("before_") < budget)
    taken = F.least(F.col("words"), budget - F.col("before_"))
    kept = scratch.save(sent.groupBy("row_", "turn").agg(F.max("finish").alias("finish"), F.sum(taken).alias("taken"), F.min("before_").alias("mix_offset")), "kept")
    scratch.drop("queue", "packets")
    full = rows.join(kept, "row_").join(levels.select("source", "source_size", "target"), rows["source"].eqNullSafe(levels["source"]))
    return full.select(*[rows[c] for c in names], "source_size", "target", "turn", "finish", "taken", "mix_offset")


def mix_report(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text, source)`` what the mix takes of it, all turns together.

    Null texts have size zero; null ids and repeated rows are rows like any
    other; extra columns are left behind; an empty table gives no row.
    """
    scratch = Scratch(documents.sparkSession, "mix-report")
    sized = scratch.save(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("key")), "sized")
    kept = mix_sources(sized).groupBy("key").agg(F.sum("taken").alias("taken"))
    levels = water_levels(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    full = sized.join(kept, "key", "left").join(levels, sized["source"].eqNullSafe(levels["source"]))
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
