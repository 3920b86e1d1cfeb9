"""Access to the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
