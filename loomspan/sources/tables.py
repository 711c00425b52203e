"""Loaders of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters asked of it reach the scan."""
    if name not in NAMES:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
