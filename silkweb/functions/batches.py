"""Batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession | None = None) -> None:
    """Bound what goes to a Python worker at once by bytes, since rows may hold very long texts."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
