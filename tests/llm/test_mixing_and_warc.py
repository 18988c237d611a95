"""Mixing and WARC derivatives: brute force, SQL and edge cases."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veldt.llm import mixing, warc


def table(con, name, rows, columns):
    con.execute(f"CREATE OR REPLACE TABLE {name} ({columns})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)


DOCS = [(i, " ".join(["w"] * (1 + i * 7 % 23)), None if i % 9 == 0 else f"s{i % 4}") for i in range(60)] + [(None, "a b", "s1"), (5, None, "s2"), (5, "", "s2"), (7, "x y", "s3"), (7, "x y", "s3")]


def test_targets_shares_and_sql(spark):
    docs = spark.createDataFrame([(*d, "clash", 1.0) for d in DOCS], "doc_id long, text string, source string, target string, order double")
    rows = mixing.mix(docs, keep=("text",)).collect()
    assert len(rows) == len(DOCS)
    con = duckdb.connect()
    table(con, "documents", DOCS, "doc_id BIGINT, text VARCHAR, source VARCHAR")
    want = con.execute(mixing.ORACLE).fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    sizes = {}
    for d in DOCS:
        sizes[d[2]] = sizes.get(d[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    assert {r["source_size"] for r in rows} == set(sizes.values())
    targets = {(r["source_size"], round(r["target"], 9)) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(sum(sizes.values()))
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    positions = [r["position"] for r in rows if r["position"] is not None]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert rows[0]["text"] is not None
    again = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs).collect()]
    assert sorted(again, key=key) == sorted([(r["doc_id"], r["size"], r["taken"]) for r in rows], key=key)


def test_caps_are_reshared(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 90, "b"), (3, "c " * 100, "c")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    assert got[1] == 30.0 and got[2] == pytest.approx(170 * 2 / 3) and got[3] == pytest.approx(170 / 3)


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "share double, place int")
    for r in df.select("share", "place", mixing._time(F.col("share"), F.col("place"), mixing.CURRICULUM).alias("t")).collect():
        schedule, t = mixing.CURRICULUM[r["place"]], r["t"]
        step, total, done = 1 / (len(schedule) - 1), 0.0, 0.0
        for i, (a, b) in enumerate(zip(schedule, schedule[1:])):
            total += (a + b) / 2 * step
            inside = min(max(t - i * step, 0), step)
            done += a * inside + (b - a) / step * inside**2 / 2
        assert done / total == pytest.approx(r["share"], abs=1e-9)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2


PAGES = [
    (1, "http://a/?x=1", '<html lang="en"><head><title>A &amp; B</title><script>var t="</p>";</script><style>p{}</style></head><body><!-- c --><p>One<br>two &#233;&#x41; &lt;b&gt;</p><a href="/x">link</a>  tail</body></html>'),
    (2, None, None),
    (3, "http://b/", ""),
    (4, "http://c/", "&#0; &#55296; &#1114112; &#65;&#66 <p>x</P >\n\n\n y &amp;lt;"),
    (4, "http://c/", "&#0; &#55296; &#1114112; &#65;&#66 <p>x</P >\n\n\n y &amp;lt;"),
]


def test_derivatives_equal_sql(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, block string")
    df = warc.derive(warc.responses(pages))
    rows = [r.asDict() for r in df.collect()]
    con = duckdb.connect()
    table(con, "pages", PAGES, "page_id BIGINT, url VARCHAR, html VARCHAR")
    want = con.execute(warc.ORACLE)
    names = [c[0] for c in want.description]
    assert set(names) == set(df.columns)
    assert sorted(map(str, ([r[n] for n in names] for r in rows))) == sorted(map(str, map(list, want.fetchall())))
    text = next(r["block"] for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text == "A & B\nOne\ntwo é&#x41; <b>\nlink tail"
    by_source = {}
    for r in rows:
        by_source.setdefault(r["refers_to"], set()).add(r["record_type"])
        assert r["content_length"] == len(r["block"].encode())
    assert all(kinds == {"metadata", "conversion"} for kinds in by_source.values()) and len(by_source) == 4


def test_texts_of_broken_pages_equal_sql_and_are_made_in_projections(spark):
    random.seed(5)
    parts = ["<script>", "</script>", "<Script a='<b>'>", "<style>", "</style >", "<noscript>", "</noscript>", "<template x>", "</TEMPLATE>", "<!--", "-->", "<p>", "</p", "<", ">", " ", "  ", "\n", "\t", "\r", "\xa0", "\x0b", "&#65;", "&#", "&amp;", "&nbsp;", "&lt;", "bé", "<title>", "</title>"]
    pages = [(i, "u", "".join(random.choice(parts) for _ in range(random.randrange(40)))) for i in range(2000)]
    pages.append((2000, "u", "<script>" + "<i>" * 3000 + "</script>a<style>b</style>" + "<b>" * 3000))
    df = warc.derive(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))
    con = duckdb.connect()
    table(con, "pages", pages, "page_id BIGINT, url VARCHAR, html VARCHAR")
    want = con.execute(f"SELECT page_id, record_type, block FROM ({warc.ORACLE})").fetchall()
    assert sorted(map(tuple, df.select("page_id", "record_type", "block").collect())) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line]
    assert generated and not any("regexp_replace" in line for line in generated)


def test_records_are_well_formed(spark):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    for r in warc.serialised(warc.derive(warc.responses(pages))).collect():
        head, block = r["record"].split("\r\n\r\n", 1)
        assert head.startswith("WARC/1.1\r\nWARC-Type: ") and f"WARC-Refers-To: {r['refers_to']}" in head
        assert block[:-4] == r["block"]


def test_derived_records_replace_columns_of_their_names(spark):
    source = warc.responses(spark.createDataFrame([(1, "u", "<p>a<script>let x = 1")], "page_id long, url string, html string"))
    clash = source.withColumns({"block": F.lit("own"), "Refers_To": F.lit("own"), "note": F.lit("kept")})
    got = warc.derive(clash)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    rows = {r["record_type"]: r for r in got.collect()}
    assert rows["conversion"]["block"] == "a" and rows["conversion"]["note"] == "kept" and rows["metadata"]["refers_to"] != "own"
