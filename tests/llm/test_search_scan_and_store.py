"""Inner product search, license scan, toxicity, shards and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veldt.llm import inner_product, licenses, queries, shards, toxicity


def test_search_recall_order_and_unusable_vectors(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(900, 17)) * r.uniform(0.5, 2, (900, 1))
    v[100:140] = v[100]  # many equal vectors
    rows = [(i, [float(x) for x in np.float32(v[i])], "clash") for i in range(900)]
    rows += [(2000, None, ""), (2020, [0.0] * 17, ""), (2040, [float("nan")] + [1.0] * 16, ""), (2060, [1.0, 2.0], ""), (None, rows[1][1], ""), rows[40], (2080, [float("inf")] * 17, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = inner_product.nearest(df, F.col("vec_id") % 20 == 0, inner_product.Search(sample=500, query_block=16, chunk=64)).collect()
    e = np.float32(v).astype(float)
    hits = 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        scores = e @ e[q]
        assert all(r["score"] == pytest.approx(scores[r["vec_id"]], abs=1e-9) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        scores[q] = -np.inf
        hits += len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(900), -scores))[:20].tolist()))
    assert {r["query_id"] for r in got} == set(range(0, 900, 20)) and hits / (45 * 20) >= 0.9


@pytest.mark.parametrize("kind", ["float", "double"])
def test_search_among_near_ties(spark, kind):
    """Tight groups, which codes can't tell apart: the bound on a code's error lets the whole group through."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(8, 64))
    v = centres[r.integers(0, 8, 6000)] + r.normal(size=(6000, 64)) * 0.01
    v = np.float32(v).astype(float) if kind == "float" else v
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    got: dict[int, set[int]] = {}
    for row in inner_product.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    recall = []
    for q in range(0, 6000, 20):
        scores = v @ v[q]
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist())) / 20)
    assert len(got) == 300 and np.mean(recall) >= 0.99 and min(recall) >= 0.9


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in inner_product.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 3, (0, 2): 20, (20, 1): 0, (20, 2): 3}
    assert inner_product.nearest(df.limit(0), F.lit(True)).count() == 0


def test_codes_weigh_parallel_error():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    book = inner_product.fit(x, inner_product.Search(threshold=0.6))
    unit = x / np.linalg.norm(x, axis=1)[:, None]

    def parallel(b):
        codes = b.encode(x)
        decoded = np.take_along_axis(b.words[None], codes[:, :, None, None], 2)[:, :, 0].reshape(len(x), -1)
        return ((unit * (x - decoded)).sum(1) ** 2).mean()

    plain = inner_product.Codebook(8, book.words, 1.0)
    assert parallel(book) < parallel(plain)


NOTES = ["Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "GENERAL public license, general-public-license", None, "", "mit licence", "licensed under the apache licence version 2.0", "the license of mit", "MIT LICENSE mit license Apache\nLicense " + "w " * 50]


def test_license_places_and_labels(spark):
    long = licenses.TEMPLATES[1][1].replace(" to ", "\nto ")  # a notice over several lines
    texts = NOTES + ["before " * 30 + long + " after" * 30, " ".join(long.split()[:20])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, labels string")
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    phrases = {tuple(k.split()): v for k, v in licenses.PHRASES.items()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        r = rows[i]
        starts = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert rows[len(NOTES)]["labels"] == "mit" and rows[len(NOTES) + 1]["labels"] == ""
    assert rows[6]["labels"] == "apache" and rows[6]["n_base"] == 0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_notices_broken_at_each_word():
    scanner = licenses.Scanner({}, licenses.TEMPLATES, licenses.PHRASES, 0.8)
    for label, notice in licenses.TEMPLATES:
        parts = notice.split()
        for before in (0, 3, 40):
            for k in range(1, len(parts)):
                text = "w " * before + " ".join(parts[:k]) + "\n# " + " ".join(parts[k:]) + " v" * 40
                assert scanner.matches(text, licenses.words(text)).get(label) == 1.0


#: Prose, and notices of other licenses, that share most words of a short notice.
FALSE_NOTICES = [
    "The album was released under the label license agreement",
    "Released under the BSD License.",
    "He released the license holder under the law",
    "Licensed under the Mozilla License, version 2.0.",
    "licensed under the zlib license version 2.0 today",
    "Students at MIT were released under the new license",
    "The version of Apache that is licensed under 2.0 rules",
    "This work is free for the public under a general license version of 3",
]
TRUE_NOTICES = {
    "Released under the MIT-License": "mit",
    "It is released under the terms of the MIT licence / license.": "mit",
    "Licensed under the Apache Software License, Version 2.0": "apache",
    "this work is licensed under the GNU public license version 3": "gpl",
    "This work is licensed under a Creative Commons Attribution 3.0 International License": "cc",
    "Licensed under CC BY-NC 4.0": "cc",
    "This Source Code Form is subject to the\nterms of the Mozilla Public License, v. 2.0.": "mpl",
}


def test_short_notices_need_their_name_and_order():
    scanner = licenses.Scanner({}, licenses.TEMPLATES, {}, 0.8)
    for text in FALSE_NOTICES:
        assert scanner.matches(text, licenses.words(text)) == {}
    for text, label in TRUE_NOTICES.items():
        assert set(scanner.matches(text, licenses.words(text))) == {label}
        inside = f"{'word ' * 40}{text} {'more ' * 40}"
        assert set(scanner.matches(inside, licenses.words(inside))) == {label}


def test_filters_lose_no_block():
    r = random.Random(1)
    tokens = [f"t{i}".encode() for i in range(30)]
    templates = [(f"l{k}", " ".join(x.decode() for x in r.sample(tokens, r.randint(3, 9)))) for k in range(12)]
    frequencies = {t: r.randint(0, 50) for t in tokens}
    scanner = licenses.Scanner(frequencies, templates, {}, 0.7)
    for _ in range(300):
        block = r.choices(tokens, k=r.randint(1, 14))
        text = b" ".join(block).decode()
        want = {label for label, notice in templates if len(set(licenses.words(notice)) & set(block)) >= 0.7 * len(set(licenses.words(notice))) - 1e-9}
        assert set(scanner.matches(text, licenses.words(text))) == want


def toxic_corpus(n, seed=0):
    r = random.Random(seed)
    common = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    rude = ["zorkface", "quimble", "vexnard"]
    out = []
    for i in range(n):
        w = r.choices(common, k=r.randint(60, 200))
        y = i % 4 == 0
        for _ in range(r.randint(2, 5) * y):
            w.insert(r.randrange(len(w)), r.choice(rude))
        out.append((i, " ".join(w), int(y)))
    return out


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_corpus(1200)
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows] + [(9000, None, 5), (9001, "", 5), (None, "zorkface", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (9001, 0), (9001, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).withColumn("held_out", toxicity.held_out()).collect()}
    assert len(got) == 1203 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert got[9000]["score"] == got[9001]["score"] < 0.5


def test_toxicity_is_fitted_in_tasks(spark, monkeypatch):
    """The model equals that of plain lists, and no text comes to the driver."""
    rows = [(i, t.capitalize(), y) for i, t, y in toxic_corpus(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    collected, plain_collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.columns) or plain_collect(df))
    model = toxicity.train(docs, labels)
    assert collected and not any("text" in columns for columns in collected)
    lists = [[t for i, t, y in rows if y == k and zlib.crc32(str(i).encode()) % 5] for k in (0, 1)]
    half = [(len(own) + 1) // 2 for own in lists]
    low = [[t.lower() for t in own[:n]] for own, n in zip(lists, half)]
    assert model.toxic == toxicity.toxic_content(low[1], low[0], toxicity.Bounds().dictionary) != b""
    assert model.ordinary == toxicity.ordinary_content([w for t in low[0] for w in toxicity._spread(t)])
    x = np.array([toxicity.features(t, model.compressors()) for k in (1, 0) for t in lists[k][half[k] :]])
    y = np.array([float(k) for k in (1, 0) for _ in lists[k][half[k] :]])
    share = len(lists[1]) / (len(lists[0]) + len(lists[1]))
    weights, bias = toxicity._logistic(x, y, np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y))
    assert model.weights == pytest.approx(weights) and model.bias == pytest.approx(bias)


def test_features_equal_a_plain_loop():
    """Every window compressed by itself with either dictionary."""
    r = random.Random(6)
    words = ["zorkface", "blarg", "gentle", "sun", "tree", "ÄÖ", "river"]
    model = toxicity.ToxicityModel(b"zorkface\0blarg\0", b"gentle sun tree river")
    pair = model.compressors()
    for n in (0, 1, 5, 30, 400):
        text = " ".join(r.choices(words, k=n))
        data = text.lower().encode()
        if data:
            data += toxicity.PADDING
        saved = [len(pair[1].compress(w)) - len(pair[0].compress(w)) for w in (data[at : at + toxicity.WINDOW] for at in range(0, max(len(data) - (toxicity.WINDOW - toxicity.STRIDE), 1), toxicity.STRIDE))] if data else []
        top = (sorted(saved, reverse=True) + [0] * 3)[:3]
        assert toxicity.features(text, pair) == pytest.approx([*top, np.log1p(sum(s >= 2 for s in saved)), np.log1p(len(saved))])


def test_marks_need_a_share_and_a_ratio():
    toxic = [f"text {i} of a zorkface here" for i in range(100)] + [f"other {i} plain" for i in range(100)]
    ordinary = [f"text {i} of a person here" for i in range(399)] + ["one zorkface by chance"]
    content = toxicity.toxic_content(toxic, ordinary, 1000)
    assert b"zorkface" in content and b"person" not in content and b"text" not in content
    assert b"zork" not in toxicity.toxic_content(toxic, ordinary + ["text of a zorkface here"] * 100, 1000)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, model).first()["predicted"] == 0


def test_long_texts_are_scored_whole():
    model = toxicity.ToxicityModel(b"zorkface\0", b"abc def ghi")
    pair = model.compressors()
    text = "abc def ghi " * 20_000
    far = toxicity.features(text + "zorkface", pair)
    assert far[0] > toxicity.features(text, pair)[0]


def test_shards_merge_without_losing_rows(spark, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "store").as_uri(), target=1 << 20, fanout=3)
    docs = spark.createDataFrame([(i, f"text {i}", None) for i in range(90)], "doc_id long, text string, extra string")
    for k in range(3):
        store.append(docs.filter(F.col("doc_id") % 3 == k).coalesce(1))
    assert store.latest() == 3 and len(store.shards()) == 3 and store.append(docs.limit(0)) == 4
    before = {s.path for s in store.shards()}
    assert store.compact() == 5 and len(store.shards()) == 1 and store.shards()[0].arrival == 1
    assert sorted(r["doc_id"] for r in store.read().collect()) == list(range(90))
    assert store.read(3).count() == 90  # an old version can still be read
    assert store.compact() == 5 and store.vacuum(keep=1) >= len(before)
    assert store.read().count() == 90 and set(docs.columns) < set(store.read().columns)


def test_commits_conflict(spark, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "s").as_uri())
    store.append(spark.range(3).coalesce(1))
    with pytest.raises(shards.Conflict):
        store._publish(1, [], None)
    gone = store.shards()
    store.commit([], gone)
    with pytest.raises(shards.Conflict):
        store.commit([], gone)
    assert store.shards(1) == gone and store.shards() == []


def test_merged_shards_keep_their_arrival_and_stray_files_are_spared(spark, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "s").as_uri(), small=1 << 20, target=1 << 20, fanout=2)
    big = [(i, "".join(chr(97 + (i * 7919 + k * k * 31) % 26) for k in range(2000))) for i in range(40)]
    schema = "doc_id long, text string"
    store.append(spark.createDataFrame(big[:20], schema).coalesce(1))
    store.append(spark.createDataFrame(big[20:], schema).coalesce(1))
    for k in (100, 101):
        store.append(spark.createDataFrame([(k, "x")], schema).coalesce(1))
    stray = "data/stray.parquet"
    store._fs.create(store._path(stray)).close()
    store.compact()
    assert sorted((s.arrival, s.rows) for s in store.shards()) == [(1, 40), (3, 2)]
    store.vacuum(keep=1)
    assert stray in [p for p, _ in store._files("data")] and store.read().count() == 42
    store.vacuum(keep=1, spare_seconds=-10)
    assert stray not in [p for p, _ in store._files("data")] and store.read().count() == 42


@pytest.mark.parametrize("name", ["shard", "SHARD_RUN", "since", "arrival", "shard_size", "shard_file"])
def test_columns_named_like_the_stores_own(spark, tmp_path, name):
    """They are stored and merged as they are; those that read() has itself come back under another name."""
    store = shards.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    df = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), "id").alias(name), F.lit("y").alias("stored_shard"))
    for k in range(3):
        store.append(df.filter(F.col("doc_id") % 3 == k).coalesce(1))
    store.compact()
    rows = store.read()
    back = f"stored_{name}" + "_" * (name == "shard") if name.lower() in shards.OWN else name
    assert {(r["doc_id"], r[back]) for r in rows.collect()} == {(i, f"x{i}") for i in range(12)}
    assert len({c.lower() for c in rows.columns}) == len(rows.columns) and rows.select("shard").distinct().count() < 3
    empty = shards.ShardStore(spark, str(tmp_path / "empty"))
    empty.append(df.limit(0))
    assert empty.read().columns == rows.columns and empty.read().count() == 0


def test_appended_shards_are_small(spark, tmp_path):
    store = shards.ShardStore(spark, (tmp_path / "s").as_uri(), small=10_000)
    store.append(spark.range(1000).select("id", F.lit("y" * 92).alias("text")).coalesce(1))
    assert [s.rows for s in store.shards()] == [100] * 10


@pytest.mark.parametrize("n", [0, 50])
def test_op5_returns_every_document(spark, tmp_path, n):
    rows = [(i % 45 if i else None, None if i % 9 == 0 else "é" * (i % 13)) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet((tmp_path / "documents.parquet").as_uri())
    got = queries.op5_shard_compaction(spark, tmp_path.as_uri()).collect()
    want = [(i, None if t is None else len(t.encode())) for i, t in rows]
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in got), key=str) == sorted(want, key=str)
    assert all(1 <= r["arrival"] <= r["since"] for r in got)


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in toxic_corpus(600, 1)]
    rows += [(1000 + i, rows[i][1], "en", "s1", 1) for i in range(1, 10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).withColumn("predicted", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(600, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append([r["doc_id"] for r in docs.collect()])
    toxic = {i for i, _, y in toxic_corpus(600, 1) if y}
    assert len(toxic & set(seen[0])) < 0.1 * len(toxic) and len(set(seen[0]) - toxic) > 0.95 * 459
    assert not any(i in seen[1] for i in range(1001, 1010) if i - 1000 in seen[0]) and len(set(seen[1])) == len(seen[1])
    assert max(map(seen[2].count, seen[2])) <= 3 and set(seen[2]) <= set(seen[1])
    assert sorted(seen[3]) == sorted(seen[2])
