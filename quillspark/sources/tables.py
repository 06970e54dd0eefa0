"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
