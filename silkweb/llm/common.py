"""What several operators share: batches, word hashing on buffers, running sums, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silkweb.functions.batches import small_batches  # noqa: F401, for the operators
from silkweb.sources.shared import written

#: White space between words: \x20 and \x09-\x0D.
SPACE = r"\x20\x09-\x0D"
#: Text that one numpy step holds, in bytes; longer texts are taken in slices.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none. Counts word starts without building the words."""
    starts = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{SPACE}]+[{SPACE}]*", "w")
    return F.length(F.regexp_replace(starts, rf"[{SPACE}]", "")).cast("long")


def distinct(*parts: np.ndarray) -> np.ndarray:
    """The different values of arrays, in order."""
    every = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return every[np.concatenate(([True], every[1:] != every[:-1]))] if len(every) else every


# --- words of UTF-8 buffers, hashed without making strings -------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1
#: A second sum, modulo a prime: sums modulo 2**64 alone have known collisions (Thue-Morse words), whatever the base.
_PRIME, _PRIME_BASE = (1 << 31) - 1, 48_271
#: Bytes whose products with powers below _PRIME add up within 64 bits.
_EXACT = 1 << 24


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, _PRIME)) % np.uint64(_PRIME)
        done += step
    return out


class _Powers:
    """Powers of both bases and of their inverses, grown when a longer buffer comes."""

    size, made = 0, ()

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, ...]:
        if cls.size < n:
            size = max(1 << 12, 1 << int(n - 1).bit_length())
            cls.made = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size), _prime_powers(_PRIME_BASE, size), _prime_powers(pow(_PRIME_BASE, -1, _PRIME), size)
            cls.size = size
        return cls.made


def _prime_sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running sums of values times powers modulo _PRIME, from 0; up to multiples of it."""
    out = np.zeros(len(values) + 1, np.uint64)
    for k in range(0, len(values), _EXACT):
        part = out[k + 1 : k + 1 + _EXACT]
        np.cumsum(values[k : k + _EXACT] * powers[k : k + len(part)], out=part)
        part += out[k] % np.uint64(_PRIME)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words in a buffer of bytes, A-Z lower-cased."""
    return hashed_words(data)[:2]


def hashed_words(data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with a number made of the last two bytes of each word; ``lower`` False leaves A-Z as they are."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space)) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [n]))
    start, end = edge[::2], edge[1::2]
    up, down, prime_up, prime_down = _Powers.upto(n + 1)
    values = (_LOWER if lower else _SAME)[data].astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    prime, other = np.uint64(_PRIME), _prime_sums(values, prime_up)
    second = (other[end] % prime + prime - other[start] % prime) % prime * prime_down[start] % prime
    tail = values[end - 1].astype(np.int64) * 256 + np.where(end - start > 1, values[end - 2].astype(np.int64), 0)
    first = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(first ^ mix(second)), start, tail


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def _slices(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Cut [lo, hi) in steps that end before white space, or at the end of a word that is longer than a step."""
    while lo < hi:
        cut = min(hi, lo + STEP_BYTES)
        if cut < hi:
            back = np.flatnonzero(_IS_SPACE[data[lo:cut]])
            if len(back) and back[-1] > 0:
                cut = lo + int(back[-1])
            else:
                while cut < hi and not _IS_SPACE[data[cut]]:
                    cut += 1
        yield lo, cut
        lo = cut


def row_words(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, words per row) of runs of rows, about a step of bytes each.

    A row that is longer than a step is a run of its own, hashed slice by slice.
    """
    for row, upto, words, counts, _ in row_words_and_tails(data, at):
        yield row, upto, words, counts


def row_words_and_tails(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``row_words``, with the words' last bytes as ``hashed_words`` gives them."""
    row, rows = 0, len(at) - 1
    while row < rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + STEP_BYTES, "right")) - 1)
        lo, hi = int(at[row]), int(at[upto])
        if upto == row + 1 and hi - lo > STEP_BYTES:
            parts = [hashed_words(data[a:b]) for a, b in _slices(data, lo, hi)]
            words, tails = (np.concatenate([x[k] for x in parts]) for k in (0, 2))
            yield row, upto, words, np.array([len(words)]), tails
        else:
            # A space after each row keeps words of neighbours apart.
            ends = at[row + 1 : upto + 1] - lo
            run = np.insert(data[lo:hi], ends, 32)
            words, start, tails = hashed_words(run)
            yield row, upto, words, np.diff(np.searchsorted(start, np.concatenate(([0], ends + np.arange(1, len(ends) + 1))))), tails
        row = upto


# --- texts in batches that meet counts in shards -----------------------------------------------------------------------

bundled = "shard long, batch long, kind long, payload binary"


def bundles(batches: Iterator, text: int, size: int) -> Iterator[tuple[int, list]]:
    """(number, Arrow batches) of about ``size`` bytes of text in column ``text``, the same at every reading."""
    from pyspark import TaskContext

    number, held, rows = TaskContext.get().partitionId() << 24, 0, []
    for batch in batches:
        rows.append(batch)
        _, at = texts_of(batch.column(text))
        held += int(at[-1] - at[0])
        if held > size:
            yield number, rows
            number, held, rows = number + 1, 0, []
    if rows:
        yield number, rows


def packed_row(shard: int, batch: int, kind: int, payload: bytes):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"shard": [shard], "batch": [batch], "kind": [kind], "payload": [payload]}, schema=pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("kind", pa.int64()), ("payload", pa.binary())]))


def _is_stored(df: DataFrame) -> bool:
    """Whether ``df`` but reads, filters and projects stored files, whose partitions hold the same rows at every reading.

    How files are cut depends on the number of cores, which changes when executors come and go: it is fixed here.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    nodes, plain = [df._jdf.queryExecution().optimizedPlan()], True
    while nodes:
        node = nodes.pop()
        plain &= node.nodeName().split(" ")[0] in ("Project", "Filter", "LogicalRelation")
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return plain


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` where its partitions hold the same rows at every reading; else written."""
    return df if _is_stored(df) else written(df, name)


# --- relational helpers ------------------------------------------------------------------------------------------------


def least_hashes(df: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows: those whose ``by`` has the least hashes, the same ones on every run.

    A cut by hash, from the number of rows, leaves little more than n before they are sorted, however many there are.
    """
    rows = df.count()
    share = 1.0 if rows <= n else min(1.0, (n + 10 * n**0.5 + 10) / rows)
    cut = int(share * 2**62) * 2 - 2**62 if share < 1 else 2**63 - 1
    code = F.xxhash64(by) if share >= 1 else F.shiftright(F.xxhash64(by), 1)
    return df.where(code <= F.lit(cut)).orderBy(F.xxhash64(by), *df.columns).limit(n)


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row within ``keys``, in the order (bucket, order).

    Two levels: sums of buckets run over one short list per key, rows only within their bucket, so a hot key is
    spread over as many tasks as it has buckets.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    left, right = rows.alias("l"), sums.alias("r")
    on = F.lit(True)
    for k in (*keys, bucket):
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, on).select("l.*", (F.col("r._before") + F.col("l._within")).alias(name)).drop("_within")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", size: str | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has a row per key, however unevenly the keys of ``left`` lie.

    Rows of ``right`` whose key has more rows in ``left`` than a quarter of a partition's share are broadcast: at most
    four for each partition. The others meet by shuffle. ``left`` is read twice; ``size`` is the column of ``right`` with
    the number of its key's rows in ``left``, where that is known (else they are counted).
    """
    many = max(64, left.count() // (4 * partitions(left.sparkSession)))
    if size is None:
        counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        hot = right.join(F.broadcast(counts.where(F.col("_n") > many).select(key)), key, "left_semi")
    else:
        hot = right.where(F.col(size) > many)
    met = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    found = met.where("_hot").drop("_hot")
    rest = met.where("_hot IS NULL").select(*left.columns)
    return found.unionByName(rest.join(right.hint("merge"), key, how))


def components(links: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as rows (a, b) of longs; component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder. Rows per
    round never exceed the links; nothing but row counts reaches the driver. Nodes without links don't appear. What a
    node with very many links learns goes to its rows by broadcast, so that no task holds all of them.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    many = max(64, edges.count() // (2 * partitions(links.sparkSession)))

    def lowest(rows: DataFrame, low: DataFrame) -> DataFrame:
        hot = F.broadcast(low.where(F.col("n") > many).select("u", F.col("m").alias("hot")))  # few, as each has many rows
        met = rows.join(hot, "u", "left")
        rest = met.where("hot IS NULL").select("u", "v").join(low.select("u", "m").hint("merge"), "u")
        return met.where("hot IS NOT NULL").select("u", "v", F.col("hot").alias("m")).union(rest)

    for k in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = written(lowest(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lowest(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), f"{name}-small{k}")
        # Settled when every node has one link at most, to a node that has none.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def numbered(df: DataFrame, name: str, column: str = "row") -> DataFrame:
    """``df`` with a number for each row, unique and the same at every reading; written unless it is read from stored
    files. Numbers follow no order."""
    rows = df.withColumn(column, F.monotonically_increasing_id())
    return rows if _is_stored(df) else written(rows, name)
