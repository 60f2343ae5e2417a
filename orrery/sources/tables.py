"""Table access. A table is a Parquet file or folder `{dir}/{name}.parquet`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views of the named tables."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
