"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function gives every shingle a value, and a document's sketch is its k least values. Inverted lists of the
retained values show which documents overlap; the share that two sketches have in common of the least k values of
their union estimates the similarity and filters the pairs; exact Jaccard similarity of the full shingle sets, computed
from the texts, confirms them.

Documents with the same shingle set form a class, of which one stands for all. The inverted lists hold only the rarer
half of each sketch: two sketches whose estimate is half or more share a value there, so shared passages, whose values
are frequent, make no candidates by themselves.

No list is turned into all its pairs. In rounds, one member of each list is compared with the others that aren't known
to belong to its component; a list is done when all its members belong together. So a group of copies costs a pair for
each copy. What is still open after STARS rounds, lists of many documents that share values but aren't similar, is
compared in blocks of bounded size by matrix products, which return spanning links.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.llm.common import components, mix, numbered, partitions, row_words, small_batches, spread_join, texts_of
from silkweb.sources.shared import written

WORDS = 5
#: Similarity as a fraction, numerator and denominator, to compare in whole numbers.
SIMILAR = (75, 100)
#: Values that a sketch retains.
K = 64
#: Estimate below which a pair isn't verified: 4.6 standard deviations under the least similarity that links, so about
#: one link in a million on the very threshold is missed.
LEAST_ESTIMATE = 0.5
#: Rounds of comparing one member of each list with the others.
STARS = 1
#: Shingles that a block of documents holds, about.
BLOCK_SHINGLES = 60_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes; of a short sequence, the hash of it whole."""
    size = min(len(words), WORDS)
    if not size:
        return np.empty(0, np.uint64)
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * _STEP + words[k : k + n])
    return np.unique(out)


def _sets(column):
    """Shingle sets of the texts of an Arrow column, in order."""
    data, at = texts_of(column)
    for _, _, words, counts in row_words(data, at):
        end = 0
        for n in counts:
            yield shingles(words[end : end + n])
            end += n


def sketches(rows: DataFrame) -> DataFrame:
    """``rows`` (row, id, text) with n_shingles and digest of each text's shingle set and sketch, its K least hashes in
    order, in place of the text."""
    small_batches(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size, digest, sketch = [], [], []
            for s in _sets(batch.column(2)):
                size.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append((s[:K] ^ _TOP).view(np.int64))  # the same order in signed numbers
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sketch]))).astype(np.int32)
            values = pa.array(np.concatenate(sketch) if sketch else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _lists(stands: DataFrame) -> DataFrame:
    """(value, node) of the inverted lists: of each sketch's rarer half, the values that others retain too."""
    values = stands.select("node", F.explode("sketch").alias("value"), F.size("sketch").alias("size"))
    shared = written(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-values")
    # Values of a large group of copies are few: they go to the rows.
    many = max(64, (stands.count() * K) // (4 * partitions(stands.sparkSession)))
    often = F.broadcast(shared.where(F.col("df") > many).withColumnRenamed("df", "often"))
    met = values.join(often, "value", "left")
    rare = met.where("often IS NULL").select("node", "value", "size").join(shared.hint("merge"), "value").select("node", "size", "value", "df")
    both = met.where("often IS NOT NULL").select("node", "size", "value", F.col("often").alias("df")).union(rare)
    ranked = both.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))  # K at most
    # Values that nobody else retains come first in the order by frequency.
    room = F.floor(F.col("size") * (1 - LEAST_ESTIMATE)) + 1 - (F.col("size") - F.size("found"))
    held = ranked.where(room > 0).select("node", F.explode(F.slice("found", F.lit(1), room.cast("int"))).alias("v"))
    return held.select("v.value", "node")


def _common(sets: list[np.ndarray], most_sparse: int = 24) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(m), [len(s) for s in sets])[order]
    values = values[order]
    start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.empty(0, int)
    n = np.diff(np.concatenate((start, [len(values)])))
    for d in np.unique(n[(n > 1) & (n <= most_sparse)]):
        at = start[n == d]
        for k in range(0, len(at), max(1, 500_000 // (d * d))):
            who = owner[at[k : k + max(1, 500_000 // (d * d)), None] + np.arange(d)]
            out += np.bincount((who[:, :, None] * m + who[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    often = np.flatnonzero(n > most_sparse)
    for k in range(0, len(often), 2048):
        part = often[k : k + 2048]
        has = np.zeros((m, len(part)), np.float32)
        for c, i in enumerate(part):
            has[owner[start[i] : start[i] + n[i]], c] = 1
        out += has @ has.T
    return out


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric boolean matrix: each node with the first of its component."""
    left, a, b = np.ones(len(linked), bool), [], []
    for first in range(len(linked)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            a.append(front)
            b.append(np.full(len(front), first))
    return np.concatenate(a), np.concatenate(b)


def estimates(sketch: np.ndarray, held: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the least K values of the union that both sketches hold, for pairs (a, b) of rows of ``sketch``, of
    which ``held`` values count."""
    out = np.empty(len(a))
    for k in range(0, len(a), 4_096):
        i, j = a[k : k + 4_096], b[k : k + 4_096]
        counts = np.concatenate([np.arange(sketch.shape[1]) < held[i, None], np.arange(sketch.shape[1]) < held[j, None]], 1)
        both = np.concatenate([sketch[i], sketch[j]], 1)
        order = np.argsort(np.where(counts, both, np.uint64(2**64 - 1)), 1, kind="stable")
        both, counts = np.take_along_axis(both, order, 1), np.take_along_axis(counts, order, 1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = (both[:, 1:] == both[:, :-1]) & counts[:, 1:] & counts[:, :-1]
        rank = np.cumsum(counts & ~again, 1)
        least = np.minimum(rank[:, -1], K)
        out[k : k + 4_096] = (again & (rank <= least[:, None])).sum(1) / np.maximum(least, 1)
    return out


def links_within(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that span the components of similar sets. ``side``: sets of a pair of blocks are compared only across,
    0 with 1; sets of one block (all 0) with each other."""
    none = np.empty(0, int), np.empty(0, int)
    across = side[:, None] != side[None, :] if side.any() else ~np.eye(len(sets), dtype=bool)
    held = np.array([min(len(s), K) for s in sets])
    sketch = np.zeros((len(sets), K), np.uint64)
    for k, s in enumerate(sets):
        sketch[k, : held[k]] = s[:K]
    # No estimate exceeds the overlap's share of the larger sketch.
    maybe = across & (_common([s[:K] for s in sets]) >= LEAST_ESTIMATE * np.maximum(held[:, None], held[None, :]))
    a, b = np.nonzero(np.triu(maybe))
    passed = estimates(sketch, held, a, b) >= LEAST_ESTIMATE
    maybe[:] = False
    maybe[a[passed], b[passed]] = maybe[b[passed], a[passed]] = True
    some = np.flatnonzero(maybe.any(axis=1))
    if not len(some):
        return none
    size = np.array([len(sets[k]) for k in some], np.float64)
    both = _common([sets[k] for k in some]).astype(np.float64)
    a, b = _spanning(maybe[np.ix_(some, some)] & (SIMILAR[1] * both >= SIMILAR[0] * (size[:, None] + size[None, :] - both)))
    return some[a], some[b]


def _candidates(pairs: DataFrame, stands: DataFrame) -> DataFrame:
    """``pairs`` (head, member) with n, the shingles of both, whose sizes allow a link and whose estimate is high enough."""
    of = stands.select(F.col("node").alias("member"), F.col("n_shingles").alias("nm"), F.col("sketch").alias("sm"))
    half = written(pairs.join(of.hint("merge"), "member"), "near-half")  # a member has half of K heads at most
    both = spread_join(half, of.toDF("head", "nh", "sh"), "head")
    # The intersection is the smaller set at most, the union the larger one at least.
    alike = both.where(SIMILAR[1] * F.least("nh", "nm") >= SIMILAR[0] * F.greatest("nh", "nm"))
    least = alike.withColumn("least", F.slice(F.array_sort(F.array_union("sh", "sm")), 1, K))
    shared = F.filter(F.array_intersect("sh", "sm"), lambda v: v <= F.element_at("least", -1))
    return least.where(F.size(shared) >= LEAST_ESTIMATE * F.size("least")).select("head", "member", (F.col("nh") + F.col("nm")).alias("n"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (head, member, n) whose full sets are similar. A text goes to a task once for each of its heads
    at most; the pairs of a head are split where they hold more than BLOCK_SHINGLES."""
    weight = pairs.groupBy("head").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("blocks > 1")
    bins = max(partitions(pairs.sparkSession), int(pairs.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES)
    placed = pairs.join(weight, "head", "left").select(
        "head",
        "member",
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("head"), F.lit(bins))).otherwise(F.col("head")).alias("group"),
        F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("member"), F.col("blocks"))).alias("block"),
    )
    placed = written(placed, "near-placed")
    members = placed.groupBy(F.col("member").alias("row"), "group", "block").agg(F.collect_set("head").alias("heads"))  # half of K at most
    heads = placed.select(F.col("head").alias("row"), "group", "block").distinct().withColumn("heads", F.array().cast("array<bigint>"))
    sent = members.union(heads).join(texts.select("row", "text").hint("merge"), "row")

    def compare(batch):
        import pyarrow as pa

        rows, heads = batch.column("row").to_pylist(), batch.column("heads").to_pylist()
        of_head = np.array([not h for h in heads])
        text = batch.column("text").combine_chunks()
        known = dict(zip((r for r, h in zip(rows, heads) if not h), _sets(text.filter(pa.array(of_head)))))
        a, b = [], []
        for k, own in zip(np.flatnonzero(~of_head), _sets(text.filter(pa.array(~of_head)))):
            for h in heads[k]:
                other = known[h]
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                both = int((other[at] == own).sum())
                if SIMILAR[1] * both >= SIMILAR[0] * (len(own) + len(other) - both):
                    a.append(h)
                    b.append(rows[k])
        return pa.table({"a": a, "b": b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return sent.groupBy("group", "block").applyInArrow(compare, "a long, b long")


def _in_blocks(lists: DataFrame, texts: DataFrame, stands: DataFrame) -> DataFrame:
    """Pairs (a, b) that span the components of similar documents among those that lists connect."""
    heads = written(lists.groupBy("value").agg(F.min("node").alias("head"), F.count("*").alias("size")), "near-heads")
    cluster = components(spread_join(lists, heads, "value", size="size").select(F.col("node").alias("a"), F.col("head").alias("b")), "near-clusters")
    members = written(cluster.join(stands.select("node", "n_shingles"), "node"), "near-members")
    blocks = written(members.groupBy("component").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("size")).select("component", "weight", "size", F.ceil(F.col("weight") / BLOCK_SHINGLES).cast("int").alias("blocks")), "near-blocks")
    small = blocks.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    bins = max(partitions(texts.sparkSession), -(-int(small) // BLOCK_SHINGLES))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    # A small cluster lies in one bin; a large one in blocks, of which each meets each.
    placed = spread_join(members, blocks.select("component", "blocks", "size"), "component", size="size").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        F.col("node").alias("row"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("group"),
        F.when(F.col("blocks") == 1, F.lit(-1)).otherwise(F.least("own", "other")).alias("low"),
        F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    rows = placed.join(texts.select("row", "text").hint("merge"), "row")

    def compare(batch):
        import pyarrow as pa

        ids = batch.column("row").to_numpy()
        order = np.argsort(ids, kind="stable")
        sets = list(_sets(batch.column("text")))
        a, b = links_within([sets[k] for k in order], batch.column("side").to_numpy()[order])
        return pa.table({"a": ids[order][a], "b": ids[order][b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.groupBy("group", "low", "high").applyInArrow(compare, "a long, b long")


def _linked(lists: DataFrame, texts: DataFrame, stands: DataFrame) -> DataFrame | None:
    """(node, component) of the documents that links connect; None without links."""
    links = done = found = None
    entries = lists.withColumn("component", F.col("node"))
    for k in range(STARS + 1):
        entries = written(entries, "near-lists")
        parts = entries.groupBy("value", "component").agg(F.count("*").alias("n"), F.min("node").alias("head"))
        # The rarest component of a list compares itself with the others.
        stars = parts.groupBy("value").agg(F.min(F.struct("n", "component", "head")).alias("h"), F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1")
        stars = written(stars.select("value", F.col("h.component").alias("own"), F.col("h.head").alias("head"), "size"), "near-stars")
        if stars.isEmpty():
            break
        met = written(spread_join(entries, stars, "value", size="size"), "near-met")
        if k == STARS:
            more = written(_in_blocks(met.select("value", "node"), texts, stands), "near-links")
        else:
            pair = F.struct(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).alias("pair")
            pairs = met.where("component <> own").groupBy(pair).agg(F.min("head").alias("head"))
            pairs = pairs.select("head", F.when(F.col("head") == F.col("pair.a"), F.col("pair.b")).otherwise(F.col("pair.a")).alias("member"))
            tried = written(_candidates(pairs, stands), "near-candidates")
            more = written(_verified(tried if done is None else tried.join(done, ["head", "member"], "left_anti"), texts), "near-links")
            now = tried.select("head", "member").union(tried.select(F.col("member").alias("head"), F.col("head").alias("member")))
            done = now if done is None else done.union(now)
        links = more if links is None else links.union(more)
        found = written(components(links, "near-components"), "near-found")
        if k < STARS:
            left = met.where("node <> head").select("value", "node")
            entries = left.join(found.hint("merge"), "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    return found


def _grouped(texts: DataFrame) -> DataFrame:
    """(row, id, n_shingles, head) of ``texts`` (row, id, text): head is the (id, row) that stands for the component, the
    least one; null for rows that link with nothing by rule."""
    made = written(sketches(texts), "near-sketches")
    known = made.where("n_shingles > 0 AND id IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("copies")), "near-classes")
    stands = made.join(classes.select(F.col("least.row").alias("row")).hint("merge"), "row", "left_semi")
    stands = written(stands.select(F.col("row").alias("node"), "n_shingles", "sketch"), "near-stands")
    found = _linked(_lists(stands), texts, stands)
    of_class = classes.withColumn("node", F.col("least.row"))
    of_class = of_class.withColumn("component", F.col("node")) if found is None else of_class.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = written(of_class.select("digest", "least", "copies", "component"), "near-classed")
    heads = written(of_class.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("size")), "near-least")
    of_class = written(spread_join(of_class.select("digest", "copies", "component"), heads, "component", size="size").select("digest", "copies", "head"), "near-of-class")
    rows = made.select("row", "id", "n_shingles", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest")).alias("digest"))
    return spread_join(rows, of_class, "digest", "left", "copies").select("row", "id", "n_shingles", "head")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; keys are whole numbers.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set is its distinct shingles of WORDS words,
    or its whole sequence if that is shorter. Two documents are linked if their sets' Jaccard similarity is 0.75 or
    more; component_id is the least key that links reach and kept tells whether it is the row's own. Texts that are
    null or without words have no shingles and link with nothing; rows with a null key neither (component_id null,
    kept). Rows that repeat a key are documents of their own. Other columns don't matter.
    """
    out = _grouped(numbered(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "near-rows").select("row", "id", "text"))
    component = F.coalesce("head.id", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of each component one row, of the least key, and all rows
    that link with nothing."""
    rows = numbered(df.toDF(*[f"c{k}" for k in range(len(df.columns))]), "near-rows")
    id_, text_ = (f"c{df.columns.index(c)}" for c in (key, text))
    gone = _grouped(rows.select("row", F.col(id_).alias("id"), F.col(text_).alias("text"))).where("head.row <> row").select("row")
    return rows.join(gone.hint("merge"), "row", "left_anti").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)])


#: The same from all pairs that share a shingle, for tables of some thousand rows.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 4)) AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared.n >= 75 * (na.n + nb.n - shared.n)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(r.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS b FROM reached GROUP BY a) r ON r.a = d.doc_id
"""
