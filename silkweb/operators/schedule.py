"""When the URLs of a frontier may be fetched: a host's turns, spaced by a delay, of which a wave takes a lease."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkweb.functions.urls import authority_of
from silkweb.sources.shared import written


def turns(frontier: DataFrame) -> DataFrame:
    """``frontier`` (seq, url and more) with ``host`` and ``turn``, the row's place from 0 among its host's by seq.

    Rows are cut into ranges of (host, seq), so a host that holds most of them is counted by many tasks. What earlier
    ranges hold of a host that goes on in a later one is a row for each range at most.
    """
    rows = written(frontier.withColumn("host", authority_of(F.col("url"))).repartitionByRange("host", "seq").withColumn("_part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("host").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("host", "_part").count().select("host", "_part", F.sum("count").over(before).alias("_before")).where("_before > 0")
    within = F.row_number().over(Window.partitionBy("_part", "host").orderBy("seq")) - 1
    placed = rows.withColumn("_within", within).join(F.broadcast(carried), ["host", "_part"], "left")
    return placed.withColumn("turn", F.col("_within") + F.coalesce("_before", F.lit(0))).drop("_within", "_before", "_part")


def leased(frontier: DataFrame, delay: int, lease: int | None = None, due: DataFrame | None = None) -> DataFrame:
    """``frontier`` with host, turn and ``start``: milliseconds from now at which a request may start at the earliest.

    ``due`` (host, due) says when hosts that were asked before may be asked again. With ``lease``, only what may start
    before it ends: the rest of a long host is for a later wave, so a wave's length doesn't follow its longest host.
    """
    rows = turns(frontier)
    if lease is not None:
        rows = rows.where(F.col("turn") * delay < lease)  # no host is long any more where it meets the table of due times
    first = F.lit(0)
    if due is not None:
        rows, first = rows.join(due.select("host", "due"), "host", "left"), F.greatest(F.coalesce("due", F.lit(0)), F.lit(0))
    rows = rows.withColumn("start", (first + F.col("turn") * delay).cast("bigint")).drop("due")
    return rows if lease is None else rows.where(F.col("start") < lease)
