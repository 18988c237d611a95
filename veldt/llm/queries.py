"""Queries of the driver contract: one for each operator, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, filter_audit, fingerprints, inner_product, licenses, mixing, near_duplicates, secret_scan, shards, toxicity, warc
from .common import shared_folder, table
from .token_counts import token_counts


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals, told apart by a hash of the id, appended and compacted; one row for each document stored."""
    documents = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for arrival in range(4):
        store.append(documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == arrival))
        store.compact()
        store.vacuum(keep=1)
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "shard", "shard_size", "since", "arrival")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(bpe.decode(bpe.encode(documents))).drop("text", "ids", "decoded")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(documents, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return secret_scan.digests(found).drop("text", "secrets")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_toxicity": op3_toxicity,
    "op4_nearest": op4_nearest,
    "op5_shard_compaction": op5_shard_compaction,
    "op6_fingerprints": op6_fingerprints,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_secret_scan": op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_warc_derivatives": warc.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
