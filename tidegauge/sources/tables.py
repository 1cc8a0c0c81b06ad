"""Parquet tables of one folder, read with only the columns that a plan names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``folder``; ``columns`` prunes the scan by hand where a Python stage would hide it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
