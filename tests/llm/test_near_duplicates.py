"""Near-duplicates, components and fingerprints against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import fingerprints, near_duplicates
from veldt.llm.components import components

WORDS = [f"w{i}" for i in range(500)]


def make(seed=3):
    """Clusters of near copies, exact copies, shared passages, odd texts."""
    r = random.Random(seed)
    docs = []
    for c in range(12):
        base = r.choices(WORDS, k=r.randint(40, 120))
        docs += [" ".join(base)] * r.randint(1, 3)
        for _ in range(r.randint(0, 6)):
            w = list(base)
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            docs.append(" ".join(w))
    passage = " ".join(r.choices(WORDS, k=40))
    docs += [f"{passage} {' '.join(r.choices(WORDS, k=40))}" for _ in range(8)]
    docs += ["", None, "one", "One!", "two words", "a b c d", "A, b; C d", "x y z v w", "Straße ÉCOLE été"]
    return list(enumerate(docs))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def truth(docs):
    seqs = {i: tuple(words(t)) for i, t in docs}
    sh = {i: {s[k : k + 5] for k in range(max(1, len(s) - 4))} if s else set() for i, s in seqs.items()}
    ids = list(seqs)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {i: 0 for i in ids}
    for a in ids:
        for b in ids:
            if a < b and (seqs[a] == seqs[b] or sh[a] and sh[b] and len(sh[a] & sh[b]) / len(sh[a] | sh[b]) >= 0.8):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("blocks", [512, 3])
def test_join_equals_brute_force(spark, blocks):
    docs = make()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, class_id string, sig int")
    found = near_duplicates.near_duplicates(df, near_duplicates.Forest(block_rows=blocks, block_shingles=150 * blocks))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found.collect()}
    assert got == truth(docs)
    kept = near_duplicates.one_of_each(df, found)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in got.values()}) and kept.columns == df.columns


def test_odd_ids_and_empty_tables(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_duplicates.near_duplicates(df)
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in found.collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 2, 1)]
    assert near_duplicates.one_of_each(df, found).count() == 3
    empty = df.limit(0)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_one_id_with_different_texts(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[100:140])
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (1, b)], "doc_id long, text string")
    found = near_duplicates.near_duplicates(df)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in found.collect()) == [(1, 1, 1, 0), (1, 1, 1, 0), (1, 1, 1, 1), (2, 1, 1, 1)]
    assert sorted(r["text"] for r in near_duplicates.one_of_each(df, found).collect()) == sorted([a, b])


def test_prefixes_shorten_until_the_target_is_met(spark):
    r = random.Random(8)
    docs = []
    for c in range(150):  # pairs at about 0.82
        base = [r.choice(WORDS) for _ in range(100)]
        docs += [" ".join(base), " ".join(base[:-10] + r.choices(WORDS, k=10))]
    forest = near_duplicates.Forest()
    prints = near_duplicates.fingerprints(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), forest)
    edges = near_duplicates.candidates(prints.select(F.col("doc_id").alias("rep"), "sig"), forest).collect()
    met = {tuple(sorted(e)) for e in edges}
    assert sum((2 * c, 2 * c + 1) in met for c in range(150)) >= 149
    assert forest.meets(8, 0.8) < forest.target_recall < forest.meets(5, 0.8)


def test_shingle_hashes_follow_words():
    s = near_duplicates.Shingler(5)
    a, b = s.words("One two, THREE\nfour five six"), s.words("zero one two three four five six")
    assert list(a) == list(b[1:]) and len(set(s.shingles(a)) & set(s.shingles(b))) == 2
    assert s.identity(a) == s.identity(s.words("one two three four five SIX!")) != s.identity(b)


def test_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(7)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near_duplicates.shared(sets).tolist() == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(900, 900)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}


def generalised(a, b):
    def terms(t):
        w = [x for x in re.split(r"[\x09-\x0D\x20]+", t) if x]
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = terms(a), terms(b)
    low = sum((x & y).values())
    high = sum(x.values()) + sum(y.values()) - low
    return low / high if high else 1.0


def test_fingerprints(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices(WORDS, k=r.randint(5, 300)))) for i in range(150)]
    docs += [(200, "x y z " * 200), (201, docs[3][1]), (202, None), (203, ""), (204, "é"), (-5, "neg a b c d e"), (None, "null id a b c d"), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, range string")
    rows = fingerprints.edit_likeness(df).collect()
    assert len(rows) == len(docs)
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), generalised(t, edited), generalised(t, n)))
    key = lambda x: tuple((v is None, v) for v in x[:3])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["fingerprint"]) for r in rows), key=key)
    want.sort(key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    errors = np.array([g[3] - w[3] for g, w in zip(got, want)])
    assert abs(errors.mean()) < 0.02 and errors.std() < 0.12
    assert max(abs(g[4] - w[4]) for g, w in zip(got, want)) < 0.35
    prints = {}
    for i, t in docs:
        prints.setdefault(t or "", set()).update(g[5] for g in got if g[0] == i and g[1] == len(t or ""))
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_weigh_repeats(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=8))
    pairs = []
    for k in range(40):
        body = " ".join(word() for _ in range(64))
        passages = [" ".join(word() for _ in range(8)) for _ in range(2)]
        times = r.choice([(40, 40), (200, 200), (40, 4)])
        a, b = (" ".join([body] + [passages[i * (k % 2)]] * n) for i, n in enumerate(times))
        pairs.append((2 * k, a, b))
    texts = spark.createDataFrame([row for k, a, b in pairs for row in ((k, a), (k + 1, b))], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(texts, ["doc_id"]).collect()}
    assert all(len(p) == 6 * fingerprints.SLOTS and fingerprints.EMPTY not in p for p in prints.values())
    shown = spark.createDataFrame([(k, prints[k], prints[k + 1]) for k, _, _ in pairs], "k long, a string, b string")
    got = {r["k"]: r["x"] for r in shown.select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    errors = np.array([got[k] - generalised(a, b) for k, a, b in pairs])
    assert abs(errors.mean()) < 0.03 and abs(errors).max() < 0.25


def test_one_document_is_its_own_next(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprints.edit_likeness(df).first()["near_next"] == 1.0
    assert fingerprints.edit_likeness(df.limit(0)).count() == 0
