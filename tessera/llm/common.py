"""Building blocks of the operators: dense ordinals, bounded broadcasts, connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle

#: A table with at most so many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, hinted for broadcast only if a count shows that it is small; ``df`` should be settled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_ordinals(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the rank of each row (from 0) within its ``group`` by ``order``, without a task per group.

    Rows are range-partitioned by (group, order): a group of any size is spread over partitions. The rank is the
    row's place in its partition plus the group's rows in the partitions before. The result is settled.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = settle(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    per_part = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    joined = joined.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
    return settle(joined)
