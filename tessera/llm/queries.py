"""The queries of this package's operators: each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, embedding_dedup, minhash, oracles, packing, pii, quality_classifier, quality_rules, revisits, token_counts, url_filters
from tessera.llm.common import table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads and headers as digests."""
    done = revisits.resolve(revisits.records_of_pages(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return done.select("record_id", "canonical_url", "kind", "verdict", "response_id", F.md5(F.coalesce("payload", F.lit(""))).alias("payload_md5"), F.md5(said).alias("headers_md5"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages", "page_id", "url"), RULES)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents", "doc_id", "text"), width=4)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
    return judged.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


QUERIES = {f.__name__: f for f in (op1_packing, op2_pii, op3_embedding_dedup, op4_token_counts, op5_revisits, op6_url_filters, op7_quality_classifier, op8_minhash, op9_byte_bpe, op10_quality_rules)}
ORACLE_SQL = {
    "op3_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op5_revisits": oracles.REVISITS,
    "op6_url_filters": oracles.url_filters(RULES),
    "op8_minhash": oracles.MINHASH,
    "op10_quality_rules": oracles.quality_rules_sql(),
}
