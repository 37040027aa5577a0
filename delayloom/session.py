"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders of this process that may still hold tables; the temporary root of a process without a checkpoint folder.
_FOLDERS: list[str] = []
_ROOT: list[str] = []


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are the same process; ``local-cluster`` has several."""
    return spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under ``spark.checkpoint.dir``; only in one process (tests) may that be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root and not one_process(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root and not _ROOT:
        _ROOT.append(tempfile.mkdtemp(prefix="delayloom-"))
    _FOLDERS.append(f"{root or _ROOT[0]}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def clear_shared(spark: SparkSession) -> int:
    """Delete all shared folders of this process; how many. For when the results that read them have been written or read."""
    n = len(_FOLDERS)
    while _FOLDERS:
        fs, at = file_system(spark, _FOLDERS.pop())
        fs.delete(at, True)
    return n


@contextmanager
def _shuffle_files_dropped(spark: SparkSession):
    """A finished write needs its shuffle files no more: let Spark remove them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for what several joins need; the shuffle files of the write go."""
    path = shared_folder(df.sparkSession, name)
    with _shuffle_files_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable by Python workers, whatever their path; pin the session to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="delayloom-")) / "delayloom_package.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(at))
        _SHIPPED.add(app)
    return spark
