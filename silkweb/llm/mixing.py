"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

The documents of each source, in a seeded shuffle, form one stream of words that is cut in blocks of equal size. A
schedule of slots follows: slot k takes from the source in whose share of the cumulative blocks due the golden-ratio
point frac(k * phi), computed in whole numbers, falls, so every stretch of the mix holds the sources close to their weights. The r-th slot of a
source takes block r of its stream, starting over when the stream ends. At the end each source's remainder is settled:
it takes the blocks that it still lacks, and of its last one as many words as are due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silkweb.llm.common import SPACE, n_words, numbered, partitions, running_sum
from silkweb.sources.shared import written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its words.
MOST_PASSES = 3
#: Words of a block: the grain of the schedule. Sources keep close to their weights from some tens of blocks on; what
#: each gives in all is exact for any size.
BLOCK_WORDS = 1024
SEED = 7
#: The golden ratio's fractional part in POINTS of a turn, and the same after STRIDE slots: products stay below 2**63 up
#: to POINTS slots.
POINTS, STRIDE = 1 << 42, 1 << 20
GOLDEN = 2_718_142_227_965
#: Cells of [0, 1) that points and shares are matched by.
CELLS = 4096
SLOTS_PER_CHUNK = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """``sizes`` (source, source_size) with source_no, weight and target: shares of all words by weight, none above
    ``most_passes`` times its source, the excess shared again by weight.

    Sources count by code point, null last. The table has a row per source; the windows run over it whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    # Sources by the level at which they are full; of the first of them that isn't, what remains is the level of all.
    by_level = Window.orderBy(F.col("full") / F.col("weight"), "source_no")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = numbered.withColumns({"weight": weight.cast("double"), "full": (F.col("source_size") * most_passes).cast("double")})
    left = filled.withColumns(
        {
            "words_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("words_left") / F.col("weight_left"))
    # The first that the level doesn't fill has it; later rows count it as full, so their levels mean nothing.
    open_rows = F.when(F.col("full") > F.col("level") * F.col("weight"), F.struct(F.col("full") / F.col("weight"), "source_no", "level"))
    level = F.min(open_rows).over(everything)["level"]
    return left.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("full")), F.col("full"))).select("source", "source_size", "source_no", "weight", "target")


def schedule(spark, sources: DataFrame) -> DataFrame:
    """(source_no, slot, block, pass) of every slot that takes a block; ``sources`` as ``in_blocks`` returns them.

    A source has as many slots as it takes blocks: those that the points give it beyond that are left out, and those
    that it lacks (few, as the points are even) follow after the last point.
    """
    whole = Window.partitionBy()
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    some = sources.where("takes > 0")
    slots = some.agg(F.sum("takes")).first()[0] or 0
    low = some.select("source_no", "blocks", "takes", (F.coalesce(F.sum("share").over(before), F.lit(0.0)) / F.sum("share").over(whole)).alias("low"))
    shares = low.withColumn("high", F.coalesce(F.lead("low").over(Window.orderBy("source_no")), F.lit(1.0)))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("long")))))
    far, near = F.expr(f"slot div {STRIDE}") * (GOLDEN * STRIDE % POINTS) % POINTS, F.col("slot") % STRIDE * GOLDEN % POINTS
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", (far + near) % POINTS / POINTS)
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    taken = points.join(cells, "cell").where("u >= low AND u < high").select("source_no", "blocks", "takes", "slot", F.lit(1).alias("one"), F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    ranked = running_sum(taken, ["source_no"], "chunk", [F.col("slot")], "one", "rank").where("rank < takes")
    given = taken.groupBy("source_no").agg(F.count("*").alias("given"))
    lacking = some.join(given, "source_no", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < takes")
    lacking = lacking.select("source_no", "blocks", F.explode(F.sequence(F.col("given"), F.col("takes") - 1)).alias("rank"))
    slot = F.lit(slots) + F.col("rank")
    every = ranked.select("source_no", "blocks", "slot", "rank").union(lacking.select("source_no", "blocks", slot, "rank"))
    return every.select("source_no", "slot", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("pass"))


def in_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """``sources`` (as ``targets`` returns them) with due, the words to take; blocks, how many equal ones its stream is
    cut in; share, the blocks that its due words make; and takes, those with the last, of which a part may be taken.

    Block k holds the words from floor(k * source_size / blocks) on, so sizes differ by a word at most.
    """
    due = F.least(F.round("target").cast("long"), F.col("source_size") * MOST_PASSES)
    cut = sources.where("source_size > 0").withColumns({"due": due, "blocks": F.ceil(F.col("source_size") / block_words)})
    cut = cut.withColumn("share", F.col("due") * F.col("blocks") / F.col("source_size"))
    # The block of the last word that is due, in its pass.
    last = F.expr("(due - 1) div source_size * blocks + (((due - 1) % source_size + 1) * blocks - 1) div source_size")
    return cut.withColumn("takes", F.when(F.col("due") > 0, last + 1).otherwise(F.lit(0).cast("long")))


def passes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """A row per document and pass that takes words of it, or one with null pass where none does: source_no, start (in
    the source's stream of words), row (the column ``row``, else any number), id, size, source_size, target, pass, first (word), words.

    A document's words of one pass lie together, as a pass takes blocks in their order. Null texts and those without
    words have size 0 and are never taken; null keys and repeated rows are documents of their own.
    """
    spark = df.sparkSession
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = written(df.select(number.alias("row"), F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-sources")
    rows = sized.count()
    digits = 2
    while 16**digits < max(partitions(spark), rows // 20_000):
        digits += 1
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    named = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.row", "d.id", "d.size", "s.source_no", "s.source_size", "s.target")
    cut = in_blocks(sources, block_words)
    mixed = named.where("size > 0").join(cut.select("source_no", "due", "blocks"), "source_no").withColumn("code", code).withColumn("bucket", F.substring("code", 1, digits))
    placed = running_sum(mixed, ["source_no"], "bucket", [F.col("code"), F.col("id"), F.col("size")], "size", "start")
    pieces = placed.withColumn("block", F.explode(F.expr("sequence(((start + 1) * blocks - 1) div source_size, ((start + size) * blocks - 1) div source_size)")))
    pieces = pieces.withColumn("first", F.expr("greatest(0L, block * source_size div blocks - start)"))
    pieces = pieces.withColumn("upto", F.expr("least(size, (block + 1) * source_size div blocks - start)"))
    slots = schedule(spark, cut)
    same = pieces.join(slots, ["source_no", "block"], "left")
    # In the pass that its due words end in, a source gives those before the end.
    ended = F.least(F.col("upto"), F.col("due") - F.col("pass") * F.col("source_size") - F.col("start"))
    same = same.withColumn("words", F.when(F.col("pass").isNotNull(), ended).otherwise(F.col("upto")) - F.col("first")).withColumn("pass", F.when(F.col("words") > 0, F.col("pass")))
    out = same.groupBy("source_no", "start", "row", "id", "size", "source_size", "target", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    unworded = named.where("size = 0").selectExpr("source_no", "CAST(NULL AS BIGINT) AS start", "row", "id", "size", "source_size", "target", "CAST(NULL AS BIGINT) AS pass", "0L AS first", "0L AS words")
    return out.select(*unworded.columns).union(unworded)


def digest(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """key, size, source_size, target, taken of every document, as the contract of the mix names them."""
    rows = passes(df, key, **options).withColumn("taken", F.when(F.col("pass").isNotNull(), F.col("words")).otherwise(F.lit(0).cast("long")))
    columns = [F.col("id").alias(key), "size", "source_size", "target", "taken"]
    worded = rows.where("size > 0").groupBy("source_no", "start", "row", "id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return worded.select(*columns).union(rows.where("size = 0").select(*columns))


def _cut(text: Column, first: Column, words: Column) -> Column:
    kept = F.split(F.regexp_replace(text, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+")
    return F.array_join(F.slice(kept, (first + 1).cast("int"), words.cast("int")), " ")


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Rows of ``df`` as often as the mix takes them, with all columns; where a pass takes part of a document, its text
    is those words, joined by spaces. Rows that the mix never takes are gone. Rows may share keys: each is a document
    of its own."""
    place = {c: f"c{k}" for k, c in enumerate(df.columns)}
    rows = numbered(df.toDF(*place.values()), "mix-rows")
    taken = passes(rows, place[key], place[text], place[source], row="row", **options).where("pass IS NOT NULL").select("row", "size", "first", "words")
    whole = F.col(place[text])
    part = F.when(F.col("words") < F.col("size"), _cut(whole, F.col("first"), F.col("words"))).otherwise(whole)
    return rows.join(taken.hint("merge"), "row").withColumn(place[text], part).select(*[F.col(p).alias(c) for c, p in place.items()])


#: As a source gives its due words in the order of its stream, what is taken of a document follows from where it starts.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (3 * source_size)::DOUBLE AS full_size FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(full_size) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level FROM w
  WINDOW before AS (ORDER BY full_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT arg_min(level, (full_size / weight, no)) AS level FROM l WHERE full_size > level * weight),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM o) * weight, full_size), full_size) AS target FROM w),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, least(round(t.target)::BIGINT, 3 * t.source_size) AS due,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (due // source_size) * size + greatest(0, least(size, due % source_size - start)) END::BIGINT AS taken FROM p
"""
