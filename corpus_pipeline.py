"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all that the one before it kept; its result is written as Parquet into the shared folder and read
again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import mixing, near_dedup, packing, quality_classifier, secrets
from tidewire.llm.common import bounded_batches, discard, mark, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged by their zero statistics."""
    bounded_batches(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays; null and empty texts are in no group."""
    return near_dedup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay, those of null texts too."""
    bounded_batches(spark)
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; the one at a source's budget is cut there. Those without words go; null sources are one source."""
    return mixing.mixed_corpus(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places, from which the sequences are read off."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("source_mix", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier and the tokenizer can't be written in SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table. What a stage leaves behind is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = mark()
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before, mark() - 1)
    return docs
