"""From documents to packed sequences, stage by stage. Each stage's rows are written and read again for the next.

Nulls, empty and very long texts, repeated rows and empty tables are handled as each stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import minhash, packing, pii, quality_classifier, quality_rules
from tessera.llm.common import cut, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Their references are the labelled good texts of the whole table of documents."""
    references = quality_rules.fit(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.keep(docs, references)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. It learns from the labels over the whole table of documents: what the
    rules left holds too few bad ones."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.keep(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words to a shingle, a similarity of at least 0.8."""
    return minhash.keep(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows."""
    return pii.redact(docs, length_column="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens and 64 pieces. The stages before have left workers
    and compiled code behind, so the tokenizer's cache is half the usual one."""
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), cache=250_000), max_docs=64)


STAGES = [("quality_rules", rules), ("quality_classifier", classify), ("minhash_dedup", dedup), ("pii", redact), ("packing", pack)]
ORACLE_SQL = None  # trained models and a tokenizer decide; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
