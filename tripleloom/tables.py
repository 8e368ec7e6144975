"""Reading the tables of a data folder (``<folder>/<name>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the schema comes from the Parquet footer, so nothing is inferred from rows."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
