"""The corpus pipeline: stages over documents, each written and read again.

Toxic documents go, one document of each group of near-duplicates stays, the
sources are mixed to their target weights, and the mix is encoded.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import byte_bpe, mixing, near_duplicates, toxicity
from veldt.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on the labels of sf_dir."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that five-word shingles link at 0.8."""
    docs = docs.select(*COLUMNS)
    return near_duplicates.one_of_each(docs, near_duplicates.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    mixed = mixing.mix(docs, keep=("text", "lang", "source", "n_chars"))
    copies = mixed.select("doc_id", "text", "lang", "source", "n_chars", F.explode("positions").alias("position"))
    return copies.orderBy("position", "doc_id").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each copy."""
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, kept_words=1 << 18)  # the driver, which has run three stages, makes their map
    docs = docs.select("doc_id", "text")
    return byte_bpe.digests(bpe.decode(bpe.encode(docs))).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_duplicates), ("mixing sources to target weights", mix_sources), ("byte-level BPE", encode)]

#: Compression lengths and MinHash have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what one returns is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage-{at}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
