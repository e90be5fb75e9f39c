"""Table access. Inputs may carry zoned or zoneless timestamps; both become UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` in ``folder``; zoneless times are read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df

