"""What workers hold of texts, and what they keep for the next stage."""

from __future__ import annotations

import plans
import pytest

from corpus_pipeline import piece_model
from lanewise.llm.common import worker_cache
from lanewise.llm.ngram_join import ngram_components
from lanewise.llm.sentencepiece_bpe import encode_texts
from lanewise.llm.toxicity import drop_toxic, toxicity_scores

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, f"word {i} and another {i % 3}") for i in range(40)], "doc_id long, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")


def test_a_worker_drops_what_another_operator_remembered():
    worker_cache("a")["model"] = [1]
    assert worker_cache("a") == {"model": [1]}
    assert worker_cache("b") == {}
    assert worker_cache("a") == {}


def test_texts_reach_python_few_rows_at_a_time(spark, docs, labels):
    for work in (
        lambda: toxicity_scores(docs, labels),
        lambda: ngram_components(docs, 5, 80),
        lambda: encode_texts(docs, piece_model()),
    ):
        try:
            spark.conf.set(BATCH, "10000")
            work()
            assert spark.conf.get(BATCH) == "1000"
            spark.conf.set(BATCH, "300")
            work()
            assert spark.conf.get(BATCH) == "300"
        finally:
            spark.conf.unset(BATCH)


def test_texts_are_scored_once(docs, labels):
    kept = drop_toxic(docs, labels)
    assert "MapInArrow" in plans.text(toxicity_scores(docs, labels))
    assert "MapInArrow" not in plans.text(kept)
    bad = {r.doc_id for r in toxicity_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == set(range(40)) - bad
