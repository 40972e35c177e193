"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Normalised vectors are projected on random Gaussian directions, shifted and cut in cells; the cells of several
directions together name a bucket, and several tables of buckets give similar vectors several chances to meet. Within
buckets, in blocks of bounded size, cosines are computed in double precision. A pair counts in the first table only
where both its vectors share a bucket, so links are counted once without listing pairs.

Equal unit vectors form a class, of which one is hashed and compared; classes go by numbers of their own, so keys may
repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.llm.common import components, mix, numbered, partitions, small_batches, spread_join
from silkweb.sources.shared import written

COSINE = 0.9
#: Cell width, about where the fewest tables are needed for links against chance meetings.
WIDTH = 2.0
#: Unrelated vectors that one meets in a table, about, where there are more than LEAST_DIRECTIONS leave room for.
STRANGERS = 4096
#: Directions of a bucket, at least: up to some 1.3 million vectors the number of tables doesn't change.
LEAST_DIRECTIONS = 8
#: Chance that a pair right at the least cosine meets in some table.
RECALL = 0.93
#: Bytes of vectors in a block; a bucket that holds more is compared block against block.
BLOCK_BYTES = 4 << 20
#: Bytes of vectors of small buckets that are compared in one go, about.
BIN_BYTES = 4 << 20
#: Cosines that are in memory at once.
STEP_COSINES = 1 << 22
SEED = 11


def meets(distance: float, width: float = WIDTH) -> float:
    """Chance that vectors at a distance fall in the same cell of one direction (Datar et al., 2004)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def sized(n: int) -> tuple[int, int]:
    """(directions of a bucket, tables) for n vectors.

    With n come directions, so that buckets hold STRANGERS unrelated vectors at most, and the tables that RECALL then
    needs: their number grows as n to the power 0.27.
    """
    directions = max(LEAST_DIRECTIONS, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(meets(math.sqrt(2)))))
    near = meets(math.sqrt(2 - 2 * COSINE)) ** directions
    return directions, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near)))


def _rows(column) -> list[np.ndarray | None]:
    """Unit vectors of an Arrow list column; None for null, empty, zero and what holds null or non-finite components."""
    import pyarrow as pa

    column = column.cast(pa.large_list(pa.float64()))
    values = column.values
    flat = values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    gap = np.concatenate(([0], np.cumsum(~np.isfinite(flat)))) if len(flat) else np.zeros(1, int)
    out: list[np.ndarray | None] = []
    ends = column.offsets.to_numpy()
    for k in range(len(column)):
        lo, hi = int(ends[k]), int(ends[k + 1])
        out.append(None)
        if valid[k] and hi > lo and gap[hi] == gap[lo]:
            x = flat[lo:hi]
            top = np.abs(x).max()
            if top > 0:
                x = x / top
                out[-1] = x / np.sqrt((x * x).sum())
    return out


def _digests(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, vector) with digest, null for vectors that link with nothing, and size, their length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            units = _rows(batch.column(2))
            made = [None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in units]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary()), pa.array([0 if x is None else len(x) for x in units], pa.int32())], names=[*batch.schema.names, "digest", "size"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType())]))


def _directions(size: int, directions: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([SEED, size])
    return draw.standard_normal((size, tables * directions)), draw.uniform(0, WIDTH, tables * directions)


def _codes(units: np.ndarray, made: tuple[np.ndarray, np.ndarray], directions: int) -> np.ndarray:
    """Bucket codes of unit vectors of one length, a column for each table."""
    onto, shift = made
    cell = np.floor((units @ onto + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), -1, directions)
    code = np.full(cell.shape[:2], units.shape[1], np.uint64)
    for d in range(directions):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, d])
    return code.view(np.int64)


def _coded(reps: DataFrame, directions: int, tables: int) -> DataFrame:
    """``reps`` (row, size, copies, vector) with the bucket code of each table."""

    def run(batches):
        import pyarrow as pa

        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            units = _rows(batch.column(3))
            codes = np.empty((len(units), tables), np.int64)
            sizes = np.array([len(x) for x in units])
            for size in np.unique(sizes):
                if size not in made:
                    made[size] = _directions(int(size), directions, tables)
                where = np.flatnonzero(sizes == size)
                codes[where] = _codes(np.stack([units[k] for k in where]), made[size], directions)
            ends = np.arange(0, codes.size + 1, tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))], names=[*batch.schema.names, "codes"])

    return reps.mapInArrow(run, T.StructType([*reps.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[k] and b[k] for all k; ``root`` names the least node of each node's tree."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _bucket(units: np.ndarray, codes: np.ndarray, t: int, copies: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each vector of a bucket of table t: its linked vectors that no table before t brings together
    with it, copies counted, and the first vector that links reach. Where ``side`` differs, only across."""
    m = len(units)
    links, root = np.zeros(m, np.int64), np.arange(m)
    across = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(m), np.arange(m))
    step = max(1, STEP_COSINES // max(1, len(right)))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        a, b = np.nonzero(units[rows] @ units[right].T >= COSINE)
        a, b = rows[a], right[b]
        new = np.ones(len(a), bool) if across else a != b
        for earlier in range(t):
            new &= codes[a, earlier] != codes[b, earlier]
        a, b = a[new], b[new]
        links += np.bincount(a, copies[b], m).astype(np.int64)
        if across:
            links += np.bincount(b, copies[a], m).astype(np.int64)
        _joined(root, a, b)
    return links, root


def _compared(directions: int, tables: int):
    def run(batch):
        """Links within buckets, or across two blocks of one: per vector their number and one of its component."""
        import pyarrow as pa

        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        t, code, ids, copies, side = (batch.column(c).to_numpy() for c in ("t", "code", "row", "copies", "side"))
        order = np.lexsort((ids, code, t))
        t, code, ids, copies, side = (x[order] for x in (t, code, ids, copies, side))
        units = _rows(batch.column("vector").combine_chunks())
        edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (code[1:] != code[:-1]), [True])))
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            if hi - lo < 2:
                continue
            x = np.stack([units[k] for k in order[lo:hi]])  # a bucket's code holds the length
            size = x.shape[1]
            if size not in made:
                made[size] = _directions(size, directions, tables)
            links, root = _bucket(x, _codes(x, made[size], directions), int(t[lo]), copies[lo:hi], side[lo:hi])
            some = np.flatnonzero(links)
            found.append((ids[lo:hi][some], links[some], ids[lo:hi][root[some]]))
        columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3)]
        return pa.table(dict(zip(("id", "n", "root"), columns)), schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; keys are whole numbers.

    Vectors are linked where their cosine is COSINE or more. n_links counts other rows linked directly; component_id is
    the least key that links reach; kept tells whether it is the row's own. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, and so do rows with a null key (component_id null, kept) and
    vectors of different lengths. Equal vectors are compared once and counted as often as they are there. Rows that
    repeat a key are rows of their own, each with the links of its own vector. Other columns don't matter.
    """
    spark = df.sparkSession
    small_batches(spark)
    named = numbered(df.select(F.col(key).alias("id"), F.col(vector).alias("vector")), "vector-rows").select("row", "id", "vector")
    made = written(_digests(named).select("row", "id", "digest", "size"), "vector-digests")
    known = made.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("least"), F.first("size").alias("size")), "vector-classes")
    n, longest = classes.agg(F.count("*"), F.max("size")).first()
    directions, tables = sized(n)
    reps = named.join(classes.select(F.col("rep").alias("row"), "size", "copies").hint("merge"), "row").select("row", "size", "copies", "vector")
    coded = written(_coded(reps, directions, tables), "vector-codes")
    places = coded.select("row", "size", "copies", "vector", F.posexplode("codes").alias("t", "code"))
    width = 8 * max(1, longest or 1)
    rows = max(2, BLOCK_BYTES // width)
    # Buckets of several blocks: at most n * tables / rows, and rows of three numbers.
    large = written(places.groupBy("t", "code").agg(F.count("*").alias("n")).where(F.col("n") > rows).select("t", "code", F.ceil(F.col("n") / rows).cast("int").alias("blocks")), "vector-buckets")
    if large.count() <= 1 << 20:
        large = F.broadcast(large)
    met = places.join(large, ["t", "code"], "left").withColumn("own", F.pmod(F.xxhash64("row", "t"), F.col("blocks")).cast("int"))
    # Small buckets share bins, so that a task compares many at a time; of a large one, each block meets each.
    bins = max(partitions(spark), n * tables * width // BIN_BYTES)
    small = F.col("blocks").isNull()
    met = met.withColumn("other", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    sent = met.select(
        F.when(small, F.pmod(F.xxhash64("t", "code"), F.lit(bins))).alias("bin"),
        F.when(~small, F.struct("t", "code")).alias("bucket"),
        F.when(~small, F.least("own", "other")).alias("low"),
        F.when(~small, F.greatest("own", "other")).alias("high"),
        F.coalesce((F.col("own") > F.col("other")).cast("int"), F.lit(0)).alias("side"),
        "t", "code", "row", "copies", "vector",
    )
    links = written(sent.groupBy("bin", "bucket", "low", "high").applyInArrow(_compared(directions, tables), "id long, n long, root long"), "vector-links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components")
    of_class = classes.join(counts, F.col("rep") == F.col("id"), "left").join(found, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("digest", "copies", "least", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_class = written(of_class, "vector-linked")
    least = written(of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "vector-least")
    of_class = written(spread_join(of_class.select("digest", "copies", "component", "n_links"), least, "component", size="size"), "vector-classed")
    linkable = made.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = spread_join(linkable, of_class, "digest", "left", "copies")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: The same by comparing all pairs, for tables of some thousand rows.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = e.vec_id
"""
