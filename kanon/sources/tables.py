"""Readers for the driver parquet tables.

Every reader is a plain ``spark.read.parquet``; projection and filters placed on
the result are pushed into the scan by Catalyst (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain scan; parallelism comes from the file layout and ``spark.sql.files.maxPartitionBytes``."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
