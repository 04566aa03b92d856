"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` (one file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
