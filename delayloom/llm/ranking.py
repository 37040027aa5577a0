"""Ranks and running sums inside keys, without one task per key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch


def running(df: DataFrame, scratch: Scratch, name: str, key: str, order: list[Column], value: str | None = None) -> DataFrame:
    """``df`` with ``rank_`` (0-based place within ``key``) and ``before_`` (sum of ``value`` ahead of the row).

    Rows are range-partitioned by key and order, so a key that holds a third of
    all rows spreads over a third of the partitions. Each partition counts for
    itself; totals per partition and key (a few rows per partition) are then
    added up. ``key`` is an integer column without nulls, ``value`` an integer column without nulls.
    """
    names = df.columns

    def local(batches):
        part, last, n, s = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            k = b.column(names.index(key)).to_numpy(zero_copy_only=False)
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64) if value else np.zeros(len(k), np.int64)
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            at = np.repeat(first, np.diff(np.append(first, len(k))))
            cum = np.cumsum(v) - v
            rank, before = np.arange(len(k)) - at, cum - cum[at]
            if last is not None and k[0] == last:
                head = at == 0
                rank, before = rank + n * head, before + s * head
            last, n, s = k[-1], int(rank[-1]) + 1, int(before[-1] + v[-1])
            extra = [pa.array(np.full(len(k), part, np.int32)), pa.array(rank.astype(np.int64)), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*names, "part_", "rank_", "before_"])

    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("rank_", T.LongType()), T.StructField("before_", T.LongType())])
    placed = scratch.save(df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).mapInArrow(local, schema), name)
    amount = F.col(value).cast("long") if value else F.lit(0).cast("long")
    totals = placed.groupBy(key, "part_").agg(F.count("*").alias("n_"), F.sum(amount).alias("s_"))
    ahead = Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "part_", F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("n_"), F.coalesce(F.sum("s_").over(ahead), F.lit(0)).alias("s_"))
    return placed.join(offsets, [key, "part_"]).select(*[F.col(f"`{c}`") for c in names], (F.col("rank_") + F.col("n_")).alias("rank_"), (F.col("before_") + F.col("s_")).alias("before_"))
