"""A corpus pipeline of five stages over the documents table; each stage's result is written and read by the next.

Stages take (spark, docs, sf_dir): docs is what the stage before kept, sf_dir holds the other tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnwave.llm import common, decontaminate, near_dedup, pii, piece_codec, toxicity

#: Least score that a document is rejected for.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below TOXIC. The tagger learns from the labelled rows of docs that aren't held out."""
    tagger = toxicity.fit_tagger(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, tagger, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def clean_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without personal data."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids: doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256."""
    return piece_codec.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", clean_personal_data),
    ("sentencepiece", encode),
]

#: Trained models and tokenizers can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
