"""Global shuffle into shards in two passes, with DataFrame operations only.

Pass one scatters records by a seeded hash of their key into as many buckets as keep each within a memory bound. Pass
two shuffles each bucket by Fisher-Yates (Spark's ``shuffle`` of an array) and lays the buckets end to end; records are
then dealt to the shards in turn, so counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkweb.llm.common import partitions

SHARDS = 8
SEED = 20_261
BUCKET_BYTES = 32 << 20


def shuffled(df: DataFrame, key: str = "doc_id", size: str = "size", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with shard (0 to shards - 1) and slot (gapless from 0 within the shard), replacing columns of these names.

    ``size`` is a column of bytes per record; there are enough buckets for an even share of them to stay under
    ``bucket_bytes``, and at least one per shuffle partition. A record's bucket comes from all its columns, so records
    that share a key spread; records that are equal in all columns and more than a quarter of a bucket's share spread by
    where they lie. Ties don't matter: within a bucket, records start in the order of their values, so, but for such
    equal records, the result depends on the records, the partition count and the seed only. Maps can't be ordered: pack
    them first. An empty table gives no rows.
    """
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    n = max(partitions(spark), -(-int(total or 0) // bucket_bytes))
    code = F.xxhash64(F.lit(seed), F.col(key), *[F.col(f"`{c}`") for c in df.columns])
    record = F.struct(F.col(key).alias("_key"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(df.columns)])
    coded = df.select(code.alias("code"), record.alias("record"))
    many = max(64, rows // (4 * n))
    often = F.broadcast(df.select(code.alias("code")).groupBy("code").count().where(F.col("count") > many).select("code", F.lit(True).alias("often")))  # 4n at most
    salted = coded.join(often, "code", "left").withColumn("salt", F.when(F.col("often"), F.monotonically_increasing_id()))
    scattered = salted.select(F.pmod(F.xxhash64("code", "salt"), F.lit(n)).cast("int").alias("bucket"), "record")
    spread = scattered.repartition(n, "bucket") if n > partitions(spark) else scattered  # few buckets in a task
    # The order of buckets within a task fixes what each takes from the random generator, also when a task runs again.
    packed = spread.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records")).sortWithinPartitions("bucket")
    dealt = packed.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one short row per bucket
    offsets = scattered.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    at = dealt.join(offsets, "bucket").select("offset", F.posexplode("records").alias("k", "record"))
    place = F.col("offset") + F.col("k")
    return at.select(
        *[F.col(f"record._{k}").alias(c) for k, c in enumerate(df.columns)],
        (place % shards).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
    )


def _sized(df: DataFrame, text: str) -> DataFrame:
    """The columns as c0, c1, ... and size, so that none of them can clash."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.withColumn("size", (F.octet_length(F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit(""))) + 1).cast("long"))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every record; size is the text's bytes and one.

    Whole rows go through the shuffle; size and CRC are taken from the texts that come out of it.

    The law that holds is ``rows``: counts of shards differ by one at most. Groups of equal texts therefore aren't kept
    together: a group may hold more rows than a shard. A null text has no bytes and the CRC of none.
    """
    placed = shuffled(_sized(df, text), f"c{df.columns.index(key)}", "size")
    plain = F.coalesce(F.col(f"c{df.columns.index(text)}"), F.lit(""))
    size = (F.octet_length(plain) + 1).cast("long").alias("size")
    return placed.select(F.col(f"c{df.columns.index(key)}").alias(key), size, F.crc32(plain.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", rows_per_file: int = 200_000, **options) -> None:
    """Shuffle whole records and write them under ``path`` as Parquet, a folder per shard, files in slot order.

    Columns named shard or slot give way to those of the shuffle; the folders' second name is ``file``, or that with
    underscores where a column has it."""
    df = df.drop("shard", "slot")
    file = "file"
    while file in df.columns:
        file += "_"
    placed = shuffled(_sized(df, text), f"c{df.columns.index(key)}", "size", **options).drop("size").toDF(*df.columns, "shard", "slot")
    placed = placed.withColumn(file, F.floor(F.col("slot") / rows_per_file))
    placed.repartition("shard", file).sortWithinPartitions("shard", file, "slot").write.partitionBy("shard", file).parquet(path)
