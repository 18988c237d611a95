"""Every registered query over one folder of awkward tables, and over empty ones: nulls, repeats, empty and very long texts, extra columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldt.llm import near_duplicates, queries

R = random.Random(2)
LONG = " ".join("".join(R.choices("abcdefgh", k=R.randint(2, 9))) for _ in range(60_000))
PROSE = [" ".join("".join(R.choices("abcdefghij", k=R.randint(2, 8))) for _ in range(120)) for _ in range(40)]
DOCUMENTS = [(i, t, R.choice(["en", "de", None]), R.choice(["a", "b", None])) for i, t in enumerate(PROSE)]
DOCUMENTS += [(100, None, None, None), (101, "", "en", "a"), (102, LONG, "en", "a"), (103, LONG + " end", "en", "b"), (104, PROSE[0], "en", "a"), (105, " \n\t", "fr", ""), (106, "é" * 5000, "fr", "c"), (None, PROSE[1], "en", "a"), (None, None, None, None), (107, "\x00a\x00", "en", "a"), (108, "x" * 20_000, "en", "a"), (109, "again and again. " * 30, "en", "a")]
DOCUMENTS += [(7, PROSE[7], "en", "a"), (7, "another text under the same id", "en", "a")]
KEYS = {"op1_mix_sources": 1, "op3_toxicity": 1, "op5_shard_compaction": 1, "op6_fingerprints": None, "op7_byte_bpe": 1, "op8_license_scan": 1, "op9_ngram_jaccard": None, "op10_token_counts": 1, "op13_secret_scan": 1}


def put(spark, folder, documents):
    clash = "size long, score double, labels string, rank int, shard string, part string, ids string"
    empty = [None] * 7
    spark.createDataFrame([(*d, None, *empty) for d in documents], f"doc_id long, text string, lang string, source string, n_chars long, {clash}").write.parquet(f"{folder}/documents.parquet")
    marks = [(d, i % 2, int(i % 5 == 0)) for i, (d, *_) in enumerate(documents) if d is not None] + ([(None, 1, 1), (3, None, None), (9999, 1, 1)] if documents else [])
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, None, "<script>never " + "x" * 100_000), (3, "v", "<p>" + LONG + "</p>"), (4, "w", "")] if documents else []
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("block", F.lit("clash")).write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [R.gauss(0, 1) for _ in range(6)], 0) for i in range(80)] + [(None, [1.0] * 6, 0), (40, None, 0), (60, [], 0)] if documents else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return put(spark, str(tmp_path_factory.mktemp("awkward")), DOCUMENTS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return put(spark, str(tmp_path_factory.mktemp("nothing")), [])


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_awkward_tables(spark, awkward, key):
    rows = queries.QUERIES[key](spark, awkward).collect()
    assert rows
    if KEYS.get(key):
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((d is not None, d or 0) for d, *_ in DOCUMENTS)
    if key == "op2_warc_derivatives":
        text = {r["page_id"]: r["block"] for r in rows if r["record_type"] == "conversion"}
        assert len(rows) == 12 and text[2] == "" and text[3] == LONG and text[None] == ""
    if key == "op7_byte_bpe":
        whole = {d: t for d, t, *_ in DOCUMENTS if d not in (7, None)}
        assert all(r["decoded_sha256"] == hashlib.sha256((whole[r["doc_id"]] or "").encode()).hexdigest() for r in rows if r["doc_id"] in whole)


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, key):
    assert queries.QUERIES[key](spark, nothing).count() == 0


def test_the_pipeline_over_awkward_and_empty_tables(spark, awkward, nothing):
    """Rows of null ids and repeated ones go through; near copies do not; what is left is encoded as often as the mix takes it."""
    assert corpus_pipeline.run(spark, nothing).count() == 0
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = near_duplicates.one_of_each(docs, near_duplicates.near_duplicates(docs))
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {102, 103} <= set(ids) and not {0, 104} <= set(ids) and ids.count(7) == 2
    got = corpus_pipeline.run(spark, awkward).collect()
    assert got and all(r["n_tokens"] >= 0 and len(r["ids_sha256"]) == 64 for r in got)
