"""Vectors as whole numbers: what the operators on embeddings count in exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components become whole numbers of at most this magnitude, so that sums of 32,768 products fit 64 bits.
LARGEST = 1 << 24


def whole_vectors(df: DataFrame, vector: str, name: str = "x") -> DataFrame:
    """``df`` with ``name``, floor(256 c) of each component c of ``vector`` in double precision, as array<long>.

    Rows go whose vector is null or empty, holds null or non-finite components or one beyond LARGEST, or isn't as long as
    most vectors are (of equally frequent lengths the greatest). A column called ``name`` is replaced.
    """
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * 256)
    fits = F.forall(scaled, lambda c: F.coalesce(~F.isnan(c) & (c >= -LARGEST) & (c <= LARGEST), F.lit(False)))
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fits)
    lengths = usable.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    top = lengths.agg(F.max(F.struct("n", "length")).alias("m")).first()["m"]
    rows = usable.where(F.size(vector) == (top["length"] if top else 0))
    return rows.withColumn(name, F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * 256).cast("long")))
