"""From raw documents to packed training sequences: five stages, each on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delayloom.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from delayloom.llm.queries import vocabulary
from delayloom.llm.scratch import Scratch
from delayloom.session import ship


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the rules and the isolation forest.

    Every row is judged on its own text, repeated rows and null ids like any
    other; null and empty texts fail the rules. An empty table stays empty.
    """
    ship(spark)
    forest = quality_rules.fit_quality_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.passing(docs, forest)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; documents of which no word is left go with them. n_chars follows the text.

    Rows that share id and text are one document and fare alike; null ids come
    before all others; null texts have no lines and stay.
    """
    ship(spark)
    out = line_dedup.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    chars = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id, and once if it is repeated. Rows without an id stay."""
    ship(spark)
    groups = Scratch(spark, "pipeline-near").save(near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = docs.join(groups.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    key = [F.col("doc_id"), F.xxhash64("text").alias("body_")]
    again = docs.filter("doc_id is not null").groupBy(*key).agg(F.count("*").alias("n_")).filter("n_ > 1").select("doc_id", "body_")
    again = Scratch(spark, "pipeline-again").save(again, "again")
    if not again.limit(1).count():
        return left
    keyed = left.withColumn("body_", key[1])
    first = keyed.join(again, ["doc_id", "body_"], "left_semi").select("doc_id", "text", _row(docs).alias("row")).groupBy("doc_id", "text").agg(F.min("row").alias("row"))
    return keyed.join(again, ["doc_id", "body_"], "left_anti").select(*docs.columns).unionByName(first.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row appears once per turn of its queue that takes at least half of its words.

    Documents stay whole, so a source misses its target by at most half of its
    largest document and a packet. Rows are told apart by a number that is
    written once: null and repeated ids count like any other. Null and empty
    texts have no words and never enter.
    """
    ship(spark)
    scratch = Scratch(spark, "pipeline-mix")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("key"), _row(docs).alias("row")), "rows")
    report = mixing.mix_sources(rows.select("key", "row.doc_id", "row.source", mixing.word_count(F.col("row.text")).alias("size")))
    turns = report.filter("2 * taken >= size").groupBy("key").agg(F.count("*").alias("turns"))
    turns = scratch.save(turns, "turns")
    joined = rows.join(turns.hint("merge"), "key")
    return joined.select(F.explode(F.array_repeat("row", F.col("turns").cast("int"))).alias("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens; repeated rows are packed as often as they occur, null ids like any other."""
    ship(spark)
    return packing.pack_documents(docs, *vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: Learned rules and iterative packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
