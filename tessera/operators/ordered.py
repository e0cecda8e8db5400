"""Running values along the events of a key, without a task per key.

Events are range-partitioned by key and order, so a key of any size is spread over partitions; each partition is read
as a sorted stream, and what the partitions before it carry over is a table of one row per key and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle

_LOW = -(1 << 62)


def _local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds, within the partition and key, the sum of costs, the running maximum of at - sum before, and both of the row before."""
    key, total, peak = None, 0, _LOW
    for rows in parts:
        if rows.empty:
            continue
        keys, at, cost = rows["_key"].to_numpy(), rows["_at"].to_numpy(np.int64), rows["_cost"].to_numpy(np.int64)
        sums, peaks = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        before_sums, before_peaks = np.empty(len(rows), np.int64), np.full(len(rows), _LOW)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        known = np.zeros(len(rows), bool)
        for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
            if keys[a] != key:
                key, total, peak = keys[a], 0, _LOW
                known[a + 1 : b] = True
            else:
                known[a:b] = True
            sums[a:b] = total + np.cumsum(cost[a:b])
            before_sums[a:b] = sums[a:b] - cost[a:b]
            peaks[a:b] = np.maximum(np.maximum.accumulate(np.where(at[a:b] == _LOW, _LOW, at[a:b] - before_sums[a:b])), peak)
            before_peaks[a:b] = np.r_[peak, peaks[a : b - 1]]
            total, peak = int(sums[b - 1]), int(peaks[b - 1])
        yield rows.assign(_sum=sums, _peak=peaks, _sum_before=before_sums, _peak_before=before_peaks, _known=known)


def running(df: DataFrame, key: str, order: list[str], at: Column, cost: Column | int = 0) -> DataFrame:
    """``df`` with ``reached`` and ``reached_before`` of each row: reached = max(reached before, at) + cost, in order within ``key``.

    With cost 0 that is the running maximum of ``at``. A null ``at`` changes nothing; ``reached_before`` is null at the
    first row of a key. Key and order must not be null; ``at`` and ``cost`` are bigints. The result is settled on the way.
    """
    cost = F.lit(cost) if isinstance(cost, int) else cost
    names = df.columns
    rows = df.withColumn("_key", F.col(key).cast("string")).withColumn("_at", F.coalesce(at, F.lit(_LOW)).cast("bigint")).withColumn("_cost", cost.cast("bigint"))
    rows = rows.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _sum bigint, _peak bigint, _sum_before bigint, _peak_before bigint, _known boolean"
    rows = settle(rows.mapInPandas(_local, schema).withColumn("_part", F.spark_partition_id()))
    each = rows.groupBy("_key", "_part").agg(F.max("_sum").alias("_all"), F.max("_peak").alias("_top"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    each = each.withColumn("_offset", F.sum("_all").over(before))
    low = lambda peak, offset: F.when(peak == _LOW, _LOW).otherwise(peak - offset)
    each = each.withColumn("_carried", F.max(low(F.col("_top"), F.coalesce("_offset", F.lit(0)))).over(before)).select("_key", "_part", "_offset", "_carried")
    rows = rows.join(each, ["_key", "_part"])
    offset, carried = F.coalesce("_offset", F.lit(0)), F.coalesce("_carried", F.lit(_LOW))

    def reached(total: Column, peak: Column) -> Column:
        top = F.greatest(carried, low(peak, offset))
        return F.when(top != _LOW, offset + total + top)

    first = ~F.col("_known") & F.col("_offset").isNull()
    return rows.select(*names, reached(F.col("_sum"), F.col("_peak")).alias("reached"), F.when(~first, reached(F.col("_sum_before"), F.col("_peak_before"))).alias("reached_before"))


def segments(df: DataFrame, key: str, order: list[str], fresh: Column) -> DataFrame:
    """``df`` (with ``reached_before`` where ``fresh`` names it) with ``segment``: key and the first ``order`` value of the run that a fresh row begins.

    ``order[0]`` must be a bigint that rises along the key.
    """
    marked = df.withColumn("_start", F.when(fresh, F.col(order[0]))).drop("reached", "reached_before")
    run = running(marked, key, order, F.col("_start"))
    return run.withColumn("segment", F.concat_ws(" ", F.col("reached").cast("string"), F.col(key).cast("string"))).withColumn("segment_start", F.col("reached")).drop("reached", "reached_before", "_start")
