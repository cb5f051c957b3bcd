"""Access to the parquet tables of one input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; makes sure that Python workers know this package, as every query begins here."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
