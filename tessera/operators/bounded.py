"""Joins whose one side is broadcast only if a count shows that it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import settle

#: A table of keys with at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def settled_keys(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a narrow table of keys, written once and hinted for broadcast only if it has at most ``rows`` rows."""
    keys = settle(df)
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many partitions as there are cores, if it is so small that its scan has fewer.

    Spark cuts files no finer than ``spark.sql.files.openCostInBytes``; an expensive map over less than that for each
    core would leave cores idle. Larger tables stay where they are read, unshuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    finest = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * finest else df
