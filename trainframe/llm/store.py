"""Intermediate tables in the shared folder, so that lineage is cut and a lost executor loses nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trainframe.session import scratch


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
