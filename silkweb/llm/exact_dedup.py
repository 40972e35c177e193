"""Exact duplicates by sorting contents, with DataFrame operations only.

Sampled splitters range-partition the normalised texts, every part is sorted (spilling where it exceeds memory) so that
equal contents lie side by side, and each is compared in full with the one before it. Splitters go by content and then
by row, so a large group of copies lies in several parts that follow each other; what such a group has in each is put
together over the first and last rows of the parts alone.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkweb.llm.common import partitions
from silkweb.sources.shared import written

#: Characters that don't count when texts are compared.
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Leading characters of a content that splitters hold, so that they stay small for any text. Contents that begin alike
#: follow each other by their digest; that only orders them, equality is told by comparing neighbours in full.
SPLITTER_CHARS = 48
#: Bytes of text in a part, about, and the most parts: beyond, parts grow and sort by spilling.
PART_BYTES = 64 << 20
MOST_PARTS = 1 << 16
#: Rows sampled for each splitter, about.
SAMPLED = 16


def normalised(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), IGNORED, F.coalesce(text, F.lit("")))


def _in_parts(df: DataFrame, text: Column, key: Column, columns: list[Column]) -> DataFrame:
    """``columns`` of all rows with id, place (in the order of all contents) and part, dealt to tasks by part.

    Places are unique: copies follow by code points, the most first, then by key, null last, then by row.
    """
    spark = df.sparkSession
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    parts = min(MOST_PARTS, max(partitions(spark), int(size or 0) // PART_BYTES))
    content = normalised(text)
    place = F.struct(
        F.substring(content, 1, SPLITTER_CHARS).alias("lead"),
        F.sha2(content, 256).alias("digest"),
        (-F.char_length(F.coalesce(text, F.lit("")))).alias("order"),
        key.isNull().alias("none"),
        key.alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ).alias("place")
    placed = df.select(*columns, place)
    share = min(1.0, SAMPLED * parts / max(rows, 1))
    # At most SAMPLED * MOST_PARTS rows of some 150 bytes, about.
    sample = df.sample(share, seed=1).select(place).orderBy("place").select(F.to_json("place", {"ignoreNullFields": "false"})).collect()
    splitters = [sample[len(sample) * k // parts][0] for k in range(1, parts)] if sample else []
    step = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[k : k + step] for k in range(0, len(splitters), step)]
    kind = placed.schema["place"].dataType.simpleString()
    # Literals, found in two steps: the block of splitters, then the splitter in it.
    firsts = F.from_json(F.lit(json.dumps([json.loads(b[0]) for b in blocks])), f"array<{kind}>")
    held = F.from_json(F.lit(json.dumps([[json.loads(x) for x in b] for b in blocks])), f"array<array<{kind}>>")
    below = F.size(F.filter(firsts, lambda s: s <= F.col("place")))
    within = F.size(F.filter(F.element_at(held, below), lambda s: s <= F.col("place")))
    part = F.when(below == 0, 0).otherwise((below - 1) * step + within)
    # The windows below need rows of a part together, which this exchange already gives.
    return placed.withColumn("part", part.cast("int")).repartitionById(parts, F.col("part"))


def _runs(ranged: DataFrame, content: Column, columns: list[str]) -> DataFrame:
    """``columns`` with part, place, run (number of equal neighbours within the part) and edge: the content of the first
    and the last row of each part."""
    ranged = ranged.select(*columns, "part", "place", content.alias("content"))
    # Contents with one digest are sorted by themselves, so equal ones are neighbours whatever a digest is worth.
    side_by_side = Window.partitionBy("part").orderBy("place.lead", "place.digest", "content", "place")
    before, after = F.lag("content").over(side_by_side), F.lead("content").over(side_by_side)
    compared = ranged.withColumns({"first": before.isNull() | (before != F.col("content")), "edge": F.when(before.isNull() | after.isNull(), F.col("content"))})
    run = F.sum(F.col("first").cast("long")).over(side_by_side.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return compared.withColumn("run", run).select(*columns, "part", "place", "run", "edge")


def _across(runs: DataFrame) -> DataFrame:
    """(part, run, group) of the runs that go on from part to part; runs of one group have equal contents.

    From the first and the last rows of parts; what the single window holds is a short row per part.
    """
    edges = runs.where("edge IS NOT NULL")
    ends = edges.groupBy("part").agg(F.max("run").alias("run"))
    in_order = Window.orderBy("part")
    ends = ends.select("part", "run", F.lag("part").over(in_order).alias("prior"))
    first = edges.where("run = 1").groupBy("part").agg(F.min_by("edge", "place").alias("head"))
    last = edges.groupBy(F.col("part").alias("prior")).agg(F.max_by("edge", "run").alias("tail"))
    joined = ends.join(first, "part").join(last, "prior", "left").select("part", "run", "prior", F.coalesce(F.col("head") == F.col("tail"), F.lit(False)).alias("goes_on"))
    # A part's last run begins its own group, unless it is also the first one and goes on from the part before.
    begins = F.when(~((F.col("run") == 1) & F.col("goes_on")), F.col("part"))
    grouped = joined.withColumn("group", F.last(begins, ignorenulls=True).over(in_order))
    grouped = grouped.withColumns({"from": F.lag("group").over(in_order), "continued": F.coalesce(F.lead("goes_on").over(in_order), F.lit(False))})
    tails = grouped.where("continued OR (run = 1 AND goes_on)").select("part", "run", "group")
    heads = grouped.where("goes_on AND run > 1").select("part", F.lit(1).cast("long").alias("run"), F.col("from").alias("group"))
    return tails.union(heads)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``IGNORED``; null counts as empty. Of equal texts the row
    with the most code points stays, then the smallest key (null last). Rows that repeat key and text are all listed;
    they share keep_id, so each repetition of the staying row is marked kept. An empty table gives no rows; other
    columns don't matter.

    Whole texts are shuffled once, by part.
    """
    ranged = _in_parts(df.select(F.col(key).alias("id"), F.col(text).alias("text")), F.col("text"), F.col("id"), [F.col("id"), normalised(F.col("text")).alias("content")])
    runs = _runs(ranged, F.col("content"), ["id"])
    # Still dealt by part: only short columns are sorted again.
    of_run = Window.partitionBy("part", "run")
    sized = runs.select("id", "part", "run", "place", "edge", F.count("*").over(of_run).alias("n"), F.min("place").over(of_run).alias("best"))
    rows = written(sized.select("id", "part", "run", "edge", "n", F.col("place.digest").alias("digest"), F.struct("best.order", "best.none", "best.id").alias("best"), F.col("place"), (F.col("place") == F.col("best")).alias("heads")), "content-runs")
    across = written(_across(rows.select("part", "run", "edge", "place")), "content-across")
    parts = rows.where("heads").join(F.broadcast(across), ["part", "run"]).groupBy("group").agg(F.sum("n").alias("whole"), F.min("best").alias("whole_best"))
    # Two rows per part at most, of some 60 bytes.
    merged = across.join(parts, "group").select("part", "run", "whole", "whole_best")
    out = rows.select("id", "part", "run", "n", "best", "digest").join(F.broadcast(merged), ["part", "run"], "left")
    best = F.coalesce("whole_best", "best")
    return out.select(
        F.col("id").alias(key),
        best["id"].alias("keep_id"),
        F.coalesce("whole", "n").alias("group_size"),
        F.col("id").eqNullSafe(best["id"]).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each group one, also where rows repeat key and text.

    Whole rows go through the sort, so nothing is joined back by key.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("row")
    ranged = _in_parts(df, F.col(text), F.col(key), [row])
    at = f"c{df.columns.index(text)}"
    runs = _runs(ranged, normalised(F.col("row")[at]), ["row"])
    firsts = runs.withColumn("nth", F.row_number().over(Window.partitionBy("part", "run").orderBy("place"))).where("nth = 1 OR edge IS NOT NULL")
    rows = written(firsts, "content-firsts")
    across = _across(rows.select("part", "run", "edge", "place"))
    # Of a group in several parts, the run of its first part has the first row of all.
    later = across.withColumn("k", F.row_number().over(Window.partitionBy("group").orderBy("part"))).where("k > 1").select("part", "run")
    stay = rows.where("nth = 1").join(F.broadcast(later), ["part", "run"], "left_anti")
    return stay.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns)])


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC NULLS LAST
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
