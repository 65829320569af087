"""Reading the input tables.

Parquet is the at-rest format; scans stay lazy so Catalyst prunes columns
and pushes filters into the reader (see ``PushedFilters`` / ``ReadSchema``
in ``explain``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one driver table."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose tables as temp views for ``spark.sql`` users."""
    for n in names:
        p = table_path(sf_dir, n)
        if os.path.exists(p):
            load_table(spark, sf_dir, n).createOrReplaceTempView(n)
