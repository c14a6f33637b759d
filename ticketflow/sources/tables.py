"""Readers for the driver's Parquet tables (explicit column pruning).

A table of at most ``SMALL_FILES`` files (one Parquet row group is one task,
whatever its size) is dealt out round-robin to the cores; a table of more files
is read as it is, so no large table is ever shuffled for it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

FACT_TABLES = {"events", "documents", "conversations", "pages", "lineitem", "orders"}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


SMALL_FILES = 4


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition of a table of a few files, fewer than there are cores."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < min(target, SMALL_FILES + 1):
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Read one table; when columns are named only those reach the scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*cols) if cols else df
    return spread(df) if name in FACT_TABLES else df
