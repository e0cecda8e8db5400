"""Landed tables: one Parquet file or folder per table below a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import make_importable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The landed table ``name``; column pruning and filters reach the Parquet scan."""
    make_importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
