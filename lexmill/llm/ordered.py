"""Sums over everything that comes earlier in a global order, whatever one group holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.sources.workdir import materialize


def sums_before(batches, group: str, value: str):
    """The batches of one task, sorted by group, with the sum of the earlier values of the group in this task."""
    last, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, values = batch.column(group).to_numpy(), batch.column(value).to_numpy()
        upto = np.cumsum(values)
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        before = upto - values
        before -= np.repeat(before[first], np.diff(np.append(first, len(groups))))
        if groups[0] == last:
            before[: first[1] if len(first) > 1 else len(groups)] += carried
        last, carried = groups[-1], int(before[-1] + values[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "_local"])


def running(rows: DataFrame, group: str, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over the rows of the same ``group`` that come earlier in ``order``.

    ``group`` and ``value`` are LONGs without nulls. Rows are sorted over the cluster by range of
    group and order, so a group that holds most rows is dealt out over many tasks; each task adds
    up its own rows as they stream by, and the sums of whole tasks are added afterwards. Rows that
    are equal in all of ``order`` come in any order among themselves. ``rows`` should read a
    written table. Runs a job.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", `_local` bigint"
    summed = dealt.mapInArrow(lambda batches: sums_before(batches, group, value), schema)
    written = materialize(summed.withColumn("_task", F.spark_partition_id()), "ordered")
    # One row per task and per group that begins in it.
    tasks_of = written.groupBy(group, "_task").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks_of.select(group, "_task", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    joined = written.join(offsets, [group, "_task"])
    return joined.select(*rows.columns, (F.col("_local") + F.col("_earlier")).alias(name))
