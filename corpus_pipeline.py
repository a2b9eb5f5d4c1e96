"""Documents to token ids: toxic documents go, one of each group of near copies stays, documents with benchmark items go, the rest is encoded."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm.common import staged, table
from lanewise.llm.decontamination import drop_contaminated
from lanewise.llm.ngram_join import one_of_each
from lanewise.llm.sentencepiece_bpe import encode_texts
from lanewise.llm.toxicity import drop_toxic


def piece_model() -> str:
    """The piece file: ``LANEWISE_PIECE_MODEL``, or that of the installed tokenizer files."""
    if path := os.environ.get("LANEWISE_PIECE_MODEL"):
        return path
    found = importlib.util.find_spec("public_tokenizers")
    if found is None:
        raise ValueError("set LANEWISE_PIECE_MODEL to a SentencePiece BPE model file")
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labelled rows, does not predict toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return one_of_each(docs, size=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=5, share=80)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids."""
    return encode_texts(docs, piece_model()).drop("decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
