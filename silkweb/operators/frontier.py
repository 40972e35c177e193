"""The crawl's queue as a table: states, first discovery, numbering, requeueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkweb.sources.shared import written

QUEUE = "seq BIGINT, url STRING, file STRING, status INT, error STRING, skipped STRING, referrer STRING, depth INT"


def state() -> Column:
    """crawled, error, skipped or pending: the first that a row's fields show."""
    return F.when(F.col("file").isNotNull(), "crawled").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("pending")


def state_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy(state().alias("state")).agg(F.count("*").alias("n"))


def last_file_number(queue: DataFrame) -> DataFrame:
    """Greatest N of the files N.json, 0 if there is none."""
    number = F.nullif(F.regexp_extract("file", r"(\d+)\.json$", 1), F.lit(""))
    return queue.agg(F.coalesce(F.max(number.cast("bigint")), F.lit(0).cast("bigint")).alias("n"))


def first_of_each(found: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Of ``found`` (url, referrer, depth, parent, pos), the first row of each URL.

    Rows below ``max_depth`` go before they count as found. The least (parent, pos) of a URL combines before the
    shuffle, so a URL that every page links to costs a row per task.
    """
    if max_depth is not None:
        found = found.where(F.col("depth") <= max_depth)
    return found.groupBy("url").agg(F.min(F.struct("parent", "pos", "referrer", "depth")).alias("f")).select("url", "f.*")


def first_discovered(found: DataFrame, known: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The first row of each URL that ``known`` doesn't have."""
    return first_of_each(found, max_depth).join(known.select("url"), "url", "left_anti")


def numbered(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """``df`` with the rows' positions from ``start`` on in the given order, without sorting in one task."""
    code = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_code", code), "numbered")
    part = F.shiftright("_code", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = rows.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.lit(start) + F.col("_before") + F.col("_code").bitwiseAND(F.lit((1 << 33) - 1))).drop("_code", "_part", "_before")


def requeued(queue: DataFrame, which: str) -> DataFrame:
    """The queue with its rows of a state (error or skipped) pending again, after all others."""
    last = queue.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    again = queue.where(state() == which)
    rest = queue.where(state() != which)
    back = numbered(again.drop("error", "skipped", "status"), ["seq"], last + 1, "_seq")
    back = back.select(F.col("_seq").alias("seq"), "url", "file", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("skipped"), "referrer", "depth")
    return rest.unionByName(back)


def page_cutoff(results: DataFrame, max_pages: int) -> DataFrame:
    """Rows (seq, ok) up to the one that completes ``max_pages`` successes, in order of seq.

    Successes are counted within range partitions, on top of what the partitions before them hold.
    """
    spread = results.where("seq IS NOT NULL").repartitionByRange("seq").withColumn("_part", F.spark_partition_id())
    rows = written(spread.withColumn("_one", F.col("ok").cast("int")), "cutoff")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = rows.groupBy("_part").agg(F.sum("_one").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(offsets.where(F.col("_before") < max_pages)), "_part")
    done = F.col("_before") + F.coalesce(F.sum("_one").over(within), F.lit(0))
    return placed.withColumn("_done", done).where(F.col("_done") < max_pages).drop("_done", "_before", "_part", "_one")
