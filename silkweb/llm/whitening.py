"""Whitening of embeddings: singular vectors of centred rows by MLlib, their values by the divisor n.

Components become whole numbers, of which sums and deviations are exact. Each different vector counts once: the centred
rows are distributed, computeSVD finds their leading singular vectors, and a squared singular value over n is the
variance along one. Total variance comes from the exact deviations instead, so the shares need no further components.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.llm.common import small_batches
from silkweb.llm.whole import whole_vectors
from silkweb.sources.shared import written

COMPONENTS = 4
#: Variance below this share of the first component's counts as none.
LEAST_SHARE = 1e-12

#: With as many different vectors, n times a component no longer fits 64 bits.
MOST_ROWS = 1 << 38


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S): rows and exact sums by dimension. Each task adds its batches up, so a row a task reaches the driver."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    parts = fit.select("x").mapInArrow(run, "n long, s array<long>")
    each = parts.select("n", F.posexplode("s").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = each.orderBy("d").collect()  # a row for each dimension
    return (int(rows[0]["n"]) if rows else 0), [int(r["s"]) for r in rows]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sums over dimensions of (n * x - S)**2, exact, as an array of Python's whole numbers where 64 bits don't hold them."""
    if n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(sums).max(initial=0)) < 1 << 31:
        off = x * n - sums
        if (off.astype(float) ** 2).sum(axis=1).max(initial=0) < 1 << 62:
            return (off * off).sum(axis=1)
    off = x.astype(object) * n - sums.astype(object)
    return (off * off).sum(axis=1)


def _projected(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray, scale: np.ndarray) -> DataFrame:
    """``rows`` (with x) with deviation as a decimal and whitened as an array, a number for each axis."""
    total = np.array(sums, np.int64)  # below n * 2**24
    at = rows.columns.index("x")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            # The exact numerator first: x - S/n has one rounding.
            white = (x * n - total).astype(float) / n @ axes / scale
            ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            exact = pa.array(map(str, _deviations(x, n, total)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, exact, pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))], names=[*batch.schema.names, "exact", "white"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("exact", T.StringType()), T.StructField("white", T.ArrayType(T.DoubleType()))]))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """(n, S, axes, variances) of rows of whole vectors ``x``, different from each other and of one length.

    ``axes`` has a unit column for each component, by falling variance; components without variance are left out.
    """
    n, sums = _sums(fit)
    if n < 2:
        return n, sums, np.zeros((len(sums), 0)), np.zeros(0)
    if n >= MOST_ROWS:
        raise ValueError(f"{n} different vectors: their sums don't fit 64 bits")
    centred = fit.select(array_to_vector(F.zip_with("x", F.array(*[F.lit(s) for s in sums]), lambda x, s: (x * F.lit(n) - s).cast("double") / n)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(sums))
    # All dimensions are asked for, as MLlib then solves the Gram matrix in full and to double precision; for a few of
    # many it would iterate to 1e-10.
    found = matrix.computeSVD(len(sums), computeU=False, rCond=1e-9)
    values = found.s.toArray() ** 2 / n
    kept = [k for k in range(min(components, len(values))) if values[k] > LEAST_SHARE * values[0] > 0]
    return n, sums, found.V.toArray()[:, kept], values[kept]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Vectors become whole numbers x = floor(256 c); rows go whose vector is null or empty, holds null or non-finite
    components or one beyond 65,536, or isn't as long as most are. Each different x counts once among the n that the
    components are found from, so repeated rows have the same result each and don't weigh; null keys stay. ``deviation``
    is exact, null where 64 bits don't hold it. Components without variance (equal vectors, fewer than two, fewer
    dimensions) have no rows, so an empty table gives none. Where two variances are equal any axes of theirs serve. Other
    columns don't matter.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = written(whole_vectors(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "x"), "whole-vectors")
    fit = written(rows.select("x").distinct(), "different-vectors")
    n, sums, axes, values = fitted(fit, components)
    scale = np.sqrt(values)
    done = written(_projected(fit, n, sums, axes, scale), "whitened-fit") if len(values) else None
    trace, error = 1.0, 0.0
    if done is not None:
        pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
        spread = done.agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("t"), *[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        trace = int(spread["t"]) / n**3
        error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    out = _projected(rows, n, sums, axes, scale) if len(values) else rows.limit(0).select("*", F.lit("0").alias("exact"), F.array().cast("array<double>").alias("white"))
    out = out.select("key", "exact", F.posexplode("white").alias("k", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(exact AS BIGINT)").alias("deviation"),
        "whitened", shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"),
    )
