"""Stored tables, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def named(df: DataFrame, name: str) -> DataFrame:
    """Give a result a name that later ``spark.sql`` statements and joins can use."""
    df.createOrReplaceTempView(name)
    return df.alias(name)


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """The same table as a stream, one micro-batch per ``files_per_batch`` files.

    A stream source takes a folder or a pattern, not the path of one file: the
    bracket makes the path a pattern that matches the file or folder of that name.
    """
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parque[t]")
