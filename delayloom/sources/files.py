"""Files in and out: polled batches, timetables, archives, monthly exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import file_system, shared_folder

#: Published columns of a reading, in order.
OBSERVATION = "observed_at timestamp, train_id string, station_code string, actual_or_expected_time timestamp, time_kind string, delay_minutes double, source string, train_number string, event string, cancelled boolean, less_accurate boolean, batch_id string"
RAW = "source string, url string, fetched_at timestamp, status_code int, content_type string, body string, batch_id string"
BLOCK = "block_id string, block_date date, line string, from_station string, to_station string, start_s int, end_s int, tracks string, direction string, source string, summary string"


def read_observation_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batch files under ``path``, by column name; columns a file lacks are null."""
    return spark.read.schema(OBSERVATION).option("recursiveFileLookup", True).parquet(path)


def load_new_batches(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of batches that aren't loaded yet."""
    return incoming.join(existing.select("batch_id").distinct(), "batch_id", "left_anti").select(*incoming.columns)


def read_timetable_csv(spark: SparkSession, path: str) -> DataFrame:
    """Timetable rows: ``#`` comments, a byte-order mark, and headers in any case and order are fine; cells are trimmed."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.replace("﻿", "").strip().lower()) for c in raw.columns])


def read_raw_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).json(path)


def _published(obs: DataFrame) -> DataFrame:
    """Real readings by month, published columns only, exact repeats dropped."""
    keep = [c.split(" ")[0] for c in OBSERVATION.split(", ") if c.split(" ")[0] in obs.columns]
    return obs.filter("source <> 'synthetic'").select(*keep).distinct().withColumn("month", F.date_format("observed_at", "yyyy-MM"))


#: Bytes of stored rows that one task of a monthly export writes.
FILE_BYTES = 128 * 2**20


def _write_months(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Months as folders of sorted files; months that aren't in ``rows`` stay.

    The rows are stored once, and their bytes say how many files there will be:
    rows are range-partitioned by month and the fixed order of rows, so a task
    writes about ``file_bytes``, a large month has many files, one after the
    other in that order, and many small months share a task.
    """
    spark = rows.sparkSession
    order = ["month", *[c for c in ("observed_at", "source", "train_number", "station_code", "event", "batch_id", "time_kind") if c in rows.columns]]
    held = shared_folder(spark, "months")
    rows.write.parquet(held)
    fs, at = file_system(spark, held)
    files = max(1, -(-fs.getContentSummary(at).getLength() // file_bytes))
    stored = spark.read.schema(rows.schema).parquet(held)
    stored.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").option("compression", "zstd").parquet(path)
    fs.delete(at, True)


def export_monthly(obs: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """One folder per UTC month of real readings, exact repeats dropped, sorted, zstd; a file for about ``file_bytes`` of stored rows."""
    _write_months(_published(obs), path, file_bytes)


def monthly_counts(obs: DataFrame) -> DataFrame:
    """What an export holds per month, and the repeats it dropped."""
    real = obs.filter("source <> 'synthetic'")
    keep = [c for c in real.columns if c != "id"]
    month = F.date_format("observed_at", "yyyy-MM").alias("month")
    return real.groupBy(month).agg(F.count("*").alias("all_rows")).join(real.select(*keep).distinct().groupBy(month).agg(F.count("*").alias("rows")), "month").select("month", "rows", (F.col("all_rows") - F.col("rows")).alias("duplicates"))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def compact_batches(spark: SparkSession, source: str, target: str, staging: str, current_month: str) -> DataFrame:
    """Fold finished months' batch files of ``source`` into the monthly layout of ``target``; late files join what is there.

    Months with new files are merged with what ``target`` holds of them and
    written to the fresh folder ``staging``. Only when that reads back with the
    same rows are they copied over the target's months, so a lost job leaves
    the old months or the staged ones. Returns month, rows and added.
    """
    new = _published(read_observation_batches(spark, source)).filter(F.col("month") < current_month)
    names = [c for c in new.columns if c != "month"]
    held = spark.read.schema(OBSERVATION + ", month string").parquet(target) if _exists(spark, target) else spark.createDataFrame([], OBSERVATION + ", month string")
    touched = held.join(new.select("month").distinct(), "month", "left_semi").select(*names, "month")
    merged = touched.unionByName(new).distinct()
    _write_months(merged, staging)
    written = spark.read.schema(OBSERVATION + ", month string").parquet(staging).select(*names, "month")
    check = same_rows(merged, written).first()
    if not check["same"]:
        raise RuntimeError(f"{staging} did not read back with the rows written to it: {check}")
    before = touched.groupBy("month").agg(F.count("*").alias("before")).collect()  # one row per month
    _write_months(written, target)
    known = spark.createDataFrame(before, "month string, before long")
    return written.groupBy("month").agg(F.count("*").alias("rows")).join(known, "month", "left").select("month", "rows", (F.col("rows") - F.coalesce("before", F.lit(0))).alias("added"))


def same_rows(a: DataFrame, b: DataFrame, buckets: int = 4096, every: bool = False) -> DataFrame:
    """Rows of each side that the other lacks, and whether both hold the same rows as often.

    A fingerprint of each side's rows, whatever their order, is added up per
    bucket of a row's hash: their number and the sums of two hashes. That moves
    ``buckets`` small rows a task. Only rows of buckets that differ are then
    compared themselves (``every``: all rows, should hashes not be trusted).
    """
    cols = [F.col(f"`{c}`") for c in a.columns]
    told = [*cols, *[c.isNull() for c in cols]]  # a null leaves a hash as it is
    keyed = lambda df: df.select(*cols, F.pmod(F.xxhash64(*told), F.lit(buckets)).alias("bucket_"))
    total = lambda *parts: F.sum(F.xxhash64(*told, *map(F.lit, parts)).cast("decimal(20,0)"))
    print_of = lambda df: keyed(df).groupBy("bucket_").agg(F.count("*").alias("n"), total(1).alias("one"), total(2).alias("two"))
    p, q = print_of(a), print_of(b)
    same = F.col("p.n").eqNullSafe(F.col("q.n")) & F.col("p.one").eqNullSafe(F.col("q.one")) & F.col("p.two").eqNullSafe(F.col("q.two"))
    differ = p.alias("p").join(q.alias("q"), F.col("p.bucket_") == F.col("q.bucket_"), "full").filter(~same).select(F.coalesce("p.bucket_", "q.bucket_").alias("bucket_"))
    part = lambda df: df.select(*cols) if every else keyed(df).join(differ, "bucket_", "left_semi").select(*cols)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(part(a).exceptAll(part(b)), "only_a").crossJoin(n(part(b).exceptAll(part(a)), "only_b"))
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from files of one JSON array each."""
    return spark.read.schema(BLOCK).option("multiLine", True).json(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks as one JSON array. They are typed in by people, a few a week, so one file holds them."""
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    rows = F.sort_array(F.collect_list(F.struct("block_date", *[c for c in names if c != "block_date"])))
    blocks.agg(F.to_json(rows).alias("value")).write.mode("overwrite").text(path)


def save_blocks(blocks: DataFrame, incoming: DataFrame) -> DataFrame:
    """Blocks by id, stored ones first; where a day and line have a block that says where or when, those that don't go."""
    both = blocks.withColumn("new_", F.lit(0)).unionByName(incoming.withColumn("new_", F.lit(1)))
    first = Window.partitionBy("block_id").orderBy("new_")
    one = both.withColumn("r_", F.row_number().over(first)).filter("r_ = 1")
    told = F.coalesce("from_station", "to_station", F.col("start_s").cast("string"), F.col("end_s").cast("string")).isNotNull()
    detailed = F.max("told_").over(Window.partitionBy("block_date", "line"))
    return one.withColumn("told_", told).withColumn("d_", detailed).filter("told_ OR NOT d_").select(*blocks.columns)


def list_blocks(blocks: DataFrame, from_date: str | None = None) -> DataFrame:
    """Stored blocks, from a day on if one is given, by day, line and start."""
    kept = blocks if from_date is None else blocks.filter(F.col("block_date") >= F.lit(from_date).cast("date"))
    return kept.orderBy("block_date", "line", "start_s", "block_id")
