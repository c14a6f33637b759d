"""Reads of the given tables for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketflow.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table through Spark's own reader (any file system), named columns only.

    The package's Python files are sent to the executors, whose workers import them.
    """
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
