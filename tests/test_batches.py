"""What goes to Python workers at once, and how often."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.plans import crawl_queries, output, queries
from tests.same import SF


@pytest.fixture
def largest(spark):
    """Bytes and rows of the largest batch that a Python worker gets."""
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.unset(name)

    def measured():
        size = F.pandas_udf(lambda s: s.map(len) * 0 + int(s.map(len).sum()), T.LongType())
        rows = F.pandas_udf(lambda s: s * 0 + len(s), T.LongType())
        long = spark.range(0, 3000, 1, 1).select(size(F.concat(F.col("id").cast("string"), F.lit("x" * 10_000))).alias("n"))
        return long.agg(F.max("n")).first()[0], spark.range(0, 12_000, 1, 1).select(rows("id").alias("n")).agg(F.max("n")).first()[0]

    yield measured
    for name, value in kept.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["faulty_pages", "parsed_bodies", "extract_text", "discover_links", "parse_json_pretty", "parse_sitemap"])
def test_batches_are_bounded_by_bytes(spark, largest, name):
    (crawl_queries if name == "parsed_bodies" else queries).queries()[name](spark, SF)
    size, rows = largest()
    assert size < 6 << 20 and rows <= 4096


def test_batches_of_records_are_bounded(spark, largest):
    frame = spark.range(1).select(F.lit("f").alias("file"), F.lit("u").alias("url"), F.col("id").alias("seq"), *(F.lit(None).cast("string").alias(c) for c in ("content", "data")), F.lit(None).cast("map<string,string>").alias("extra"))
    output.rendered(frame, "json")
    assert largest()[1] <= 4096


def test_urls_of_files_are_normalised_once(spark, monkeypatch):
    frames, plain = [], output.format_records

    def format_records(records, *rest):
        frames.append(records)
        return plain(records, *rest)

    monkeypatch.setattr(output, "format_records", format_records)
    assert queries.output_json(spark, SF).count() > 0
    assert "ArrowEvalPython" not in frames[0]._jdf.queryExecution().executedPlan().toString()
