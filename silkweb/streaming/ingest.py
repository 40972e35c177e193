"""Pages as a stream: new files of a folder, first URL wins within a day, records appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkweb.functions.html import extract_text_column
from silkweb.functions.urls import normalize_url
from silkweb.plans.config import REMOVED_ELEMENTS


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Distinct pages (url, html, seen_at) from Parquet files that arrive in a folder, once per URL within a day."""
    pages = spark.readStream.schema("page_id BIGINT, url STRING, html STRING").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    seen = pages.select(normalize_url(F.col("url")).alias("url"), "html", F.current_timestamp().alias("seen_at")).where("url IS NOT NULL")
    return seen.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["url"])


def stream_records(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Start the query that appends the records of arriving pages to a table; it ends when what is there is done."""
    records = page_stream(spark, folder).select("url", extract_text_column(F.col("html"), REMOVED_ELEMENTS).alias("content"))
    hashed = records.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    return hashed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
