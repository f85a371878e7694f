import pytest

import corpus_pipeline
from assay.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from assay.llm.queries import QUERIES, SQL
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf, duck, name):
    assert compare(QUERIES[name](spark, sf), duck, SQL[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_keep_exactly_what_they_should(spark, sf):
    """Each stage against the operator's own verdict on all rows of its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = {
        "toxicity": lambda d: toxicity.scored(d, labels, ~toxicity.held_out()).where(f"score < {toxicity.THRESHOLD}"),
        "language_id": lambda d: language_id.identified(d, ~language_id.held_out()).where("not rejected"),
        "exact_dedup": lambda d: exact_dedup.duplicate_classes(d).where("kept"),
        "ngram_join": lambda d: ngram_join.linked(d, words=5, num=80, den=100).where("doc_id = component_id"),
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*judged, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns
        got = {r.doc_id for r in kept.collect()}
        assert got == {r.doc_id for r in judged[name](docs).collect()} and 0 < len(got) <= docs.count()
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == got and max(r.offset + r.length for r in packed) <= packing.WINDOW
