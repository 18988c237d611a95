"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import string

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from veldt.llm import byte_bpe
from veldt.llm.token_counts import MergeCounter, merges, token_counts

TEXTS = ["", None, "Hello  wörld's \n\n 12½ Ⅷ 中文字 😀!!", "a<|endoftext|>b <|startoftext|>", "ΑΣ İ ﬁ é \x85x\xa0y", "x\x1c\x1dy   ", "a" * 700, "don't I'LL 'S 's", " 　 q", "Hello Hello", "é ́", "<|end"]
SCHEMA = "doc_id int, text string, n_tokens string, ids string, decoded int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in enumerate(TEXTS)], SCHEMA)


def test_counts_equal_the_library(docs):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = token_counts(docs, path, limit=10).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 10), text


def test_cache_bound_does_not_change_counts():
    definition = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    free, tight = MergeCounter(definition), MergeCounter(definition, cached_words=2)
    for text in TEXTS + ["one two three four one two three four"]:
        assert free.text(text or "") == tight.text(text or "")


def test_merges_take_the_leftmost_of_equal_rank():
    # symbols 0 = a; the pair aa has rank 0 and makes 1: aaa -> 1 0
    assert merges([0, 0, 0], {0: 0}, [1], 2) == 1
    assert merges([0, 0, 0, 0], {0: 0}, [1], 2) == 2
    assert merges([], {}, [], 1) == merges([0], {0: 0}, [1], 2) == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert token_counts(empty, P.path("word_bpe_49k.json")).count() == 0
    bpe = byte_bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.ByteBpe(spark, path, P.PATTERN, kept_words=4)  # most words are folded where they stand
    rows = byte_bpe.digests(bpe.decode(bpe.encode(docs))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_decoding_unknown_ids(spark):
    bpe = byte_bpe.ByteBpe(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    df = spark.createDataFrame([(1, [0, 10**6]), (2, None), (3, []), (4, [-1])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()}
    assert got[1] is None and got[2] is None and got[4] is None and bytes(got[3]) == b""


@pytest.mark.parametrize("word", ["a" * 100_000, "=" * 100_000, "".join(random.Random(1).choices("acgt", k=20_000)), "".join(random.Random(2).choices(string.ascii_letters, k=100_000))], ids=["run", "ruler", "few letters", "letters"])
def test_very_long_pieces(spark, word):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    bpe = byte_bpe.ByteBpe(spark, path, P.PATTERN)
    docs = spark.createDataFrame([(word,)], "text string")
    assert list(bpe.encode(docs).first()["ids"]) == library.encode_ordinary(word)
