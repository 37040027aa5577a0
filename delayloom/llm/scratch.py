"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a Parquet table and reading it
back, so a lost executor costs one stage and never a whole loop.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def hash_below(hashed: Column, share: float) -> Column:
    """True for ``share`` of all values of a 64-bit hash, however small the share."""
    return F.lit(True) if share >= 1 else hashed < F.lit(int(-(2**63) + share * 2**64))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and Spark runs in one process (tests) a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="delayloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def _shuffle_files_dropped(spark: SparkSession):
    """A finished write needs its shuffle files no more: let Spark remove them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Folders of this process that may still hold tables.
_FOLDERS: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete all tables that operators of this process left behind; how many folders. For when their results have been written or read."""
    n = len(_FOLDERS)
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())
    return n


class Scratch:
    """Named tables under one fresh folder of the shared root.

    An operator drops tables that nothing reads any more. Those that its
    result still reads stay until ``clear_scratch``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _FOLDERS.append(self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        with _shuffle_files_dropped(self.spark):
            df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; with no name, all of them."""
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            _delete(self.spark, at)
