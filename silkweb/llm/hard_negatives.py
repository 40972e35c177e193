"""Hard negatives of anchors by product quantisation with exact bounds.

Vectors are whole numbers. A codebook of whole-numbered centroids for every pair of dimensions is trained on a bounded
sample; the index keeps each row's codes and the norm of what they leave over. A look-up table per anchor gives the exact
score with the coded vector, and by Cauchy and Schwarz the row's own score is no further from it than the product of the
two norms. Rows whose upper bound is below the last one kept, or whose interval misses the window, can't be in a result;
the others are scored exactly. So results are those of comparing all pairs.

Rows stay where they are: blocks of anchors, bounded in bytes, go to all tasks, and a task sends back no more than the
first few rows of each window. Groups of equal vectors and labels keep their least keys only, as many as any result can
hold, so a vector that a third of all rows share costs as much as another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silkweb.llm.common import least_hashes, small_batches
from silkweb.llm.whole import whole_vectors
from silkweb.sources.shared import written

POSITIVES, NEGATIVES = 5, 3
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 50, 7, 10
#: A negative's score in hundredths of the positive's, from and to.
LEAST, MOST = 50, 95
#: Dimensions of a codebook and its centroids; rows that the codebooks are trained on, and rounds.
PART, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 6
#: Bytes of the anchors that go to all tasks at once, and anchors whose tables are in memory at once.
BLOCK_BYTES, TABLES = 16 << 20, 256
#: Rows that are compared at once; each task begins with FEWEST, until there are bounds to filter by.
STEP, FEWEST = 4096, 64
SEED = 5
_NONE = -(1 << 62)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, parts, PART): vectors cut in parts, filled up by zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART))).reshape(len(x), -1, PART)


def trained(sample: np.ndarray) -> np.ndarray:
    """(parts, CENTROIDS, PART): whole-numbered centroids of the sample's parts by k-means."""
    cut, draw = _parts(sample).astype(float), np.random.default_rng(SEED)
    books = np.empty((cut.shape[1], CENTROIDS, PART))
    for m in range(cut.shape[1]):
        points = cut[:, m]
        books[m] = points[draw.choice(len(points), CENTROIDS, replace=len(points) < CENTROIDS)]
        for _ in range(ROUNDS):
            code = _nearest(points, books[m])
            n = np.bincount(code, minlength=CENTROIDS)
            for d in range(PART):
                books[m, n > 0, d] = np.bincount(code, points[:, d], CENTROIDS)[n > 0] / n[n > 0]
    return np.rint(books).astype(np.int64)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * (points @ book.T)).argmin(axis=1)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the residuals, rounded up) of whole-numbered vectors."""
    cut = _parts(x)
    codes = np.stack([_nearest(cut[:, m].astype(float), books[m].astype(float)) for m in range(len(books))], axis=1).astype(np.uint8)
    left = cut - books[np.arange(len(books)), codes]
    return codes, np.sqrt((left.astype(float) ** 2).sum(axis=(1, 2))) * (1 + 1e-9)


def _indexed(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (id, label, x) with codes and residual norm."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                codes, rest = coded(_matrix(batch.column(2)).astype(np.int64), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], names=["id", "label", "x", "codes", "rest"])

    return rows.mapInArrow(run, "id long, label long, x array<int>, codes binary, rest double")


class Tables:
    """Look-up scores of a few anchors with coded rows, and how far from the exact scores they may be."""

    def __init__(self, anchors: np.ndarray, books: np.ndarray) -> None:
        self.anchors, cut = anchors, _parts(anchors)
        norms = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
        coded_norm = np.sqrt((books.astype(float) ** 2).sum(axis=2).max(axis=1).sum())
        top = norms.max(initial=0) * coded_norm  # no sum of parts exceeds it
        self.kind = np.float32 if top < 1 << 23 else np.float64 if top < 1 << 52 else np.int64
        error = 1e-6 if self.kind is np.float32 else 1e-12
        self.norms, self.error = norms, error * coded_norm
        self.tables = [(books[m] @ cut[:, m].T).astype(self.kind) for m in range(len(books))]

    def bounds(self, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, largest differences from the exact scores), a row for each coded row and a column for each anchor."""
        score = self.tables[0][codes[:, 0]]
        for m in range(1, len(self.tables)):
            score += self.tables[m][codes[:, m]]
        kind = np.float32 if self.kind is np.float32 else np.float64
        wide = np.outer((rest * (1 + 1e-5) + self.error).astype(kind), self.norms.astype(kind)) + kind(2)
        return score, wide

    def exact(self, x: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of rows with anchors, pair by pair."""
        out = np.empty(len(row), np.int64)
        for k in range(0, len(row), 1 << 16):
            at = slice(k, k + (1 << 16))
            out[at] = np.einsum("ij,ij->i", x[row[at]], self.anchors[anchor[at]])
        return out


def _best(n: int, k: int, key: np.ndarray, score: np.ndarray, ids: np.ndarray, had: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the first k of each of n keys, of what it ``had`` and of new rows: high scores, then low ids."""
    old = np.flatnonzero(had[0].ravel() > _NONE)
    key, score, ids = np.concatenate((old // k, key)), np.concatenate((had[0].ravel()[old], score)), np.concatenate((had[1].ravel()[old], ids))
    order = np.lexsort((ids, -score, key))
    key, score, ids = key[order], score[order], ids[order]
    place = np.arange(len(key)) - np.searchsorted(key, key)
    first = place < k
    scores, names = np.full((n, k), _NONE), np.zeros((n, k), np.int64)
    scores[key[first], place[first]], names[key[first], place[first]] = score[first], ids[first]
    return scores, names


def _steps(batches: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, labels, vectors, codes, residual norms) of a few rows, then of more and more."""
    size = FEWEST
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size)
            at, size = at + size, min(2 * size, STEP)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)).astype(np.int64), codes, part.column(4).to_numpy()


def _found(anchor, place, score, ids):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict(
        {"anchor": anchor, "place": place, "score": score, "id": ids}, schema=pa.schema([("anchor", pa.int64()), ("place", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
    )


_FOUND = "anchor long, place long, score long, id long"


def _positives(index: DataFrame, shared, k: int) -> DataFrame:
    """The first k rows of each anchor's label in each task; ``place`` is 0."""

    def run(batches: Iterator) -> Iterator:
        ids, labels, vectors, books = shared.value
        kept = np.full((len(ids), k), _NONE), np.zeros((len(ids), k), np.int64)
        of_label = {v: np.flatnonzero(labels == v) for v in np.unique(labels)}
        for row_ids, row_labels, x, codes, rest in _steps(batches):
            for label in np.unique(row_labels):
                rows = np.flatnonzero(row_labels == label)
                own = of_label.get(label, ())
                for lo in range(0, len(own), TABLES):
                    at = own[lo : lo + TABLES]
                    tables = Tables(vectors[at], books)
                    score, wide = tables.bounds(codes[rows], rest[rows])
                    r, a = np.nonzero(score + wide >= kept[0][at, k - 1])
                    r = rows[r]
                    itself = (row_ids[r] == ids[at[a]]) & (x[r] == vectors[at[a]]).all(axis=1) if len(r) else np.zeros(0, bool)
                    r, a = r[~itself], a[~itself]
                    kept[0][at], kept[1][at] = _best(len(at), k, a, tables.exact(x, r, a), row_ids[r], (kept[0][at], kept[1][at]))
        anchor, place = np.nonzero(kept[0] > _NONE)
        yield _found(anchor, np.zeros(len(anchor), np.int64), kept[0][anchor, place], kept[1][anchor, place])

    return index.mapInArrow(run, _FOUND)


def _negatives(index: DataFrame, shared, k: int) -> DataFrame:
    """The first k rows of other labels in each anchor's windows in each task; ``place`` is the window's."""

    def run(batches: Iterator) -> Iterator:
        labels, vectors, low, high, books = shared.value
        n, windows = low.shape
        kept = np.full((n * windows, k), _NONE), np.zeros((n * windows, k), np.int64)
        for row_ids, row_labels, x, codes, rest in _steps(batches):
            for lo in range(0, n, TABLES):
                at = np.arange(lo, min(n, lo + TABLES))
                tables = Tables(vectors[at], books)
                score, wide = tables.bounds(codes, rest)
                keys = slice(lo * windows, (lo + len(at)) * windows)
                last = kept[0][keys, k - 1].reshape(-1, windows)
                need = np.maximum(low[at], last)  # of a window without places, low is beyond every score
                fits = (score + wide >= need.min(axis=1)) & (score - wide <= high[at].max(axis=1)) & (row_labels[:, None] != labels[at])
                r, a = np.nonzero(fits)
                exact = tables.exact(x, r, a)
                pair, w = np.nonzero((exact[:, None] >= need[a]) & (exact[:, None] <= high[at][a]))
                kept[0][keys], kept[1][keys] = _best(len(at) * windows, k, a[pair] * windows + w, exact[pair], row_ids[r[pair]], (kept[0][keys], kept[1][keys]))
        key, place = np.nonzero(kept[0] > _NONE)
        yield _found(key // windows, key % windows, kept[0][key, place], kept[1][key, place])

    return index.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(spark, index: DataFrame, anchors: DataFrame, books: np.ndarray, name: str) -> DataFrame:
    """Results of one block of anchors, which the driver and every task hold."""
    held = anchors.toArrow().combine_chunks()
    if not held.num_rows:
        return None
    ids, labels, vectors = held.column("id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("x").combine_chunks()).astype(np.int64)
    first = _ranked(_positives(index, spark.sparkContext.broadcast((ids, labels, vectors, books)), POSITIVES), POSITIVES).toArrow()
    anchor, rank, score, positive = (first.column(c).to_numpy() for c in ("anchor", "rank", "score", "id"))
    low, high = np.full((len(ids), POSITIVES), 1 << 62), np.full((len(ids), POSITIVES), _NONE)
    scores, positives = np.zeros_like(low), np.zeros_like(low)
    scores[anchor, rank - 1], positives[anchor, rank - 1] = score, positive
    good = score >= 0  # below 0 the window's ends change places, and nothing lies between
    # Least and greatest whole numbers s with LEAST * p <= 100 * s <= MOST * p.
    low[anchor[good], rank[good] - 1], high[anchor[good], rank[good] - 1] = -(-LEAST * score[good] // 100), MOST * score[good] // 100
    some = np.flatnonzero((low <= high).any(axis=1))
    found = _negatives(index, spark.sparkContext.broadcast((labels[some], vectors[some], low[some], high[some], books)), NEGATIVES)
    named = spark.sparkContext.broadcast((ids[some], positives[some], scores[some]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            anchor_ids, of, p = named.value
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor_ids[a]), pa.array(of[a, w]), batch.column("rank"), batch.column("id"), pa.array(p[a, w]), batch.column("score")],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return written(_ranked(found, NEGATIVES).mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), name)


def mined(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): first negatives of each positive.

    Vectors become whole numbers floor(256 c), scores are inner products; every SHIFT_EVERY-th key's label moves on by
    one. Anchors are the rows whose key ANCHOR_EVERY divides; their positives are the first other rows of their label,
    by score and then key; negatives are the first rows of other labels with LEAST to MOST hundredths of the positive's
    score. Rows without key, label or vector take no part, nor do those whose vector is empty, holds null or non-finite
    components or one beyond 65,536, or isn't as long as most are. Rows that repeat key, label and vector count once; rows
    that share a key only are rows of their own, and so are their anchors. Positives below zero have no negatives. An
    empty table has no results. Other columns don't matter.
    """
    spark = df.sparkSession
    small_batches(spark)
    named = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).where("id IS NOT NULL AND label IS NOT NULL")
    whole = whole_vectors(named, "vector").withColumn("x", F.col("x").cast("array<int>"))
    moved = F.when(F.col("id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = written(whole.select("id", moved.alias("label"), "x").distinct(), "negatives-rows")
    alike = Window.partitionBy("label", "x").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= max(POSITIVES + 1, NEGATIVES)).drop("n")
    sample = least_hashes(rows, "id", SAMPLE).select("x").toArrow()
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not sample.num_rows:
        return none
    books = trained(_matrix(sample.column("x").combine_chunks()).astype(np.int64))
    index = written(_indexed(kept, books), "negatives-index")
    anchors = rows.where(F.col("id") % ANCHOR_EVERY == 0)
    blocks = -(-anchors.count() * 8 * books.shape[0] * PART // BLOCK_BYTES)
    out = none
    for b in range(blocks):
        part = _block(spark, index, anchors.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(blocks)) == b), books, f"negatives-{b}")
        out = out if part is None else part if out is none else out.union(part)
    return out


#: The same by comparing all pairs, for tables of some thousand rows.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS "rank",
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 3
"""
