"""Reading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one Parquet file or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Make the tables available to ``spark.sql``."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
