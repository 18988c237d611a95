"""Filter interaction audit: what each filter removes, after which others, in every order.

Documents become mask cells: counts by part, failing filters and labels. The
cells are unpivoted against the steps of all orders; a running bit-or over the
earlier steps tells which documents are gone already, and conditional sums
give the metrics of each step.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> Mapping[str, Column]:
    """The filters that a text fails by itself, each a condition of failure."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n_words, capitals = F.size(words), F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n_words,
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bit(place: int, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << place)).otherwise(F.lit(0))


def mask_cells(documents: DataFrame, labels: DataFrame, repeats: str = "E") -> tuple[DataFrame, str]:
    """part, mask, good, toxic, n: documents by language, failing filters (a bit each, in the order of the names returned) and labels.

    The filter `repeats` fails a text that is identical to that of any smaller
    doc_id, in the whole table. Null texts are empty, a null language is the
    part of the empty string. A row of null doc_id fails `repeats` never and
    makes no other row fail it; rows of one doc_id don't fail each other. A
    document is good or toxic if any row of labels says so; documents without
    labels are neither. Other columns of either table are ignored; an empty
    table has no cells.

    Texts are read once and leave the scan as a digest and a mask. A text's
    copies are counted within each task before they meet, so a text with any
    number of copies is a few rows at its digest.
    """
    text = F.coalesce("text", F.lit(""))
    filters = text_filters(text)
    names = "".join(filters) + repeats
    mask = sum((_bit(i, fails) for i, fails in enumerate(filters.values())), F.lit(0))
    judged = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    is_one = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    no = F.lit(False)
    labelled = judged.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    cell = ["part", "mask", "good", "toxic"]
    by_id = labelled.groupBy("digest", *cell, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    # of a text's rows in a cell: how many have an id, and how many have the smallest one
    copies = by_id.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_id"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    fails = F.col("with_id") - F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    split = copies.withColumn("fails", fails).select(*cell, "n", "fails")
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("fails")).alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.col("fails").alias("n")))
    return split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").groupBy(*cell).agg(F.sum("n").alias("n")).filter("n > 0"), names


def interactions(cells: DataFrame, names: str) -> DataFrame:
    """The metrics of every step of every order of the filters, for each part.

    cells: part, mask, good, toxic and n, where bit i of the mask is set for
    documents that fail filter names[i]. Their number is bounded by the parts
    and masks, not by the documents. Of a step: kept documents after it,
    removed ones, redundant ones that fail its filter and are gone already,
    those that fail its filter only, good and toxic ones removed, and shapley,
    what its filter removes over all orders. No cells, no rows.
    """
    orders = F.array(*[F.struct(F.lit("".join(names[i] for i in p)).alias("filter_order"), F.array(*[F.lit(i) for i in p]).alias("places")) for p in permutations(range(len(names)))])
    step = F.posexplode("o.places").alias("at", "place")
    long = cells.select("*", F.explode(orders).alias("o")).select("part", "mask", "good", "toxic", "n", "o.filter_order", step)
    bit = F.call_function("shiftleft", F.lit(1), F.col("place"))
    long = long.withColumn("failed", F.col("mask").bitwiseAND(bit))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    removed = fails & ~gone
    steps = long.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "place").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("failed"))).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "place")).alias("shapley")
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents."""
    return interactions(*mask_cells(documents, labels))


#: The same in SQL, from the definition: every document against every step.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, [
    CASE WHEN len(words) < 100 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END] AS failing FROM w),
m AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT f.part, list_filter(failing, lambda v: v IS NOT NULL) AS failing, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN m ON f.doc_id = m.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT x.*, filter_order, step, filter_order[step] AS own, list_filter(failing, lambda v: instr(left(filter_order, step - 1), v) > 0) AS earlier
  FROM x, o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step) n),
r AS (SELECT part, filter_order, step, own,
    count(*) FILTER (len(earlier) = 0 AND NOT list_contains(failing, own)) AS kept,
    count(*) FILTER (len(earlier) = 0 AND list_contains(failing, own)) AS removed,
    count(*) FILTER (len(earlier) > 0 AND list_contains(failing, own)) AS redundant,
    count(*) FILTER (failing = [own]) AS unique_fails,
    count(*) FILTER (len(earlier) = 0 AND list_contains(failing, own) AND quality = 1) AS good_lost,
    count(*) FILTER (len(earlier) = 0 AND list_contains(failing, own) AND toxic = 1) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
