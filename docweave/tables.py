"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.session import ship


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a folder of parts) of `data_dir`."""
    ship(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
