"""The registered queries over the driver's small tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from silkweb.llm import queries as llm
from tests.same import SF, same

ROWS = {"op4_vector_dedup": "embeddings", "op5_url_filter": "pages", "op12_whitening": "embeddings"}
PER_ROW = {"op12_whitening": 4}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(name, spark):
    if name in llm.oracle_sql():
        same(llm.queries()[name], llm.oracle_sql()[name], spark)
    else:
        table = ROWS.get(name, "documents")
        assert llm.queries()[name](spark, SF).count() == PER_ROW.get(name, 1) * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_all_are_registered():
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{k}" for k in range(1, 14)}
    assert {*llm.queries(), "pipeline"} <= set(entry.queries())


def test_pipeline_against_its_operators(spark):
    """Each stage keeps what its operator's query keeps, the mix takes near its targets, and ids decode to the texts."""
    import public_tokenizers

    from silkweb.llm import bpe, exact_dedup, minhash, mixing, quality
    from silkweb.sources.shared import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda frame: sorted(r[0] for r in frame.select("doc_id").collect())
    frame, want = docs, [lambda d: quality.judged(d, labels).where("kept"), lambda d: exact_dedup.groups(d).where("kept"), lambda d: minhash.near_duplicates(d).where("kept")]
    for (_, stage), kept in zip(corpus_pipeline.STAGES, want):
        after = written(stage(spark, frame, SF), "test-stage")
        assert ids(after) == ids(kept(frame)) and after.columns == docs.columns and after.count() < frame.count() + 1
        frame = after
    mixed = written(corpus_pipeline.mix_sources(spark, frame, SF), "test-stage")
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.digest(frame).collect() if r["taken"]}
    assert set(ids(mixed)) == set(taken)
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    out = corpus_pipeline.encode(spark, mixed, SF)
    decoded = bpe.decode(out, llm.RANKS, public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in decoded.collect()) == texts
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in out.collect())
