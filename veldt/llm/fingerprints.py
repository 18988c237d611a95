"""Document fingerprints by consistent weighted sampling, in DataFrame functions.

Terms are five-word shingles, weighted by how often a text repeats them. A
sample is a (term, level) pair with a level of 1 to the term's weight: each
slot of the fingerprint draws one number for every such pair of a text, and
the least draw is its sample. Two texts draw the same sample with a
probability equal to the generalised Jaccard similarity of their weights.

Weights are counts, so the levels can be listed: there are as many as the
text has shingles, and one hash is a draw. Ioffe's scheme, which jumps over
levels by gamma-distributed numbers, has the same collision rate but needs
five numbers and their logarithms for each draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 64
WORDS = 5
#: A slot of a text without words; never the code of a sample.
EMPTY = "------"


def shingles(text: Column, n: int = WORDS) -> Column:
    """Hashes of the runs of n words (parted by white space), repeats kept.

    A text of fewer words has one shingle, of all its words; a text without
    words has none.
    """

    def of(words: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
        return F.when(F.size(words) >= n, several).when(F.size(words) > 0, F.array(F.xxhash64(words)))

    words = F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")
    return F.coalesce(F.get(F.transform(F.array(words), of), F.lit(0)), F.array().cast("array<bigint>"))


def weighted(terms: Column) -> Column:
    """Distinct terms with their counts: array<struct<term, weight>>."""

    def counted(ordered: Column) -> Column:
        firsts = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.get(
            F.transform(
                F.array(firsts),
                lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("weight"))),
            ),
            F.lit(0),
        )

    once = F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(1).alias("weight")))
    repeats = F.size(F.array_distinct(terms)) < F.size(terms)
    return F.when(repeats, F.get(F.transform(F.array(F.array_sort(terms)), counted), F.lit(0))).otherwise(once)


def levels(terms: Column) -> Column:
    """A hash of each (term, level), level = 1 to the term's weight: as many as there are terms with repeats."""
    once = F.transform(terms, lambda x: F.xxhash64(x, F.lit(1)))
    several = F.flatten(F.transform(weighted(terms), lambda x: F.transform(F.sequence(F.lit(1), x["weight"]), lambda k: F.xxhash64(x["term"], k))))
    return F.when(F.size(F.array_distinct(terms)) < F.size(terms), several).otherwise(once)


def samples(texts: DataFrame, keys: list[str], column: str, slots: int = SLOTS) -> DataFrame:
    """keys and fingerprint: each slot's least draw over all levels of all terms of the text.

    A text without words has empty slots only. Each task keeps one row of
    draws a text before rows are exchanged by the keys; where texts is dealt
    by some of the keys already there is no exchange.
    """
    each = texts.select(*keys, F.explode_outer(F.get(F.transform(F.array(shingles(F.col(column))), levels), F.lit(0))).alias("level"))
    least = [F.min(F.xxhash64("level", F.lit(k))).alias(f"draw_{k}") for k in range(slots)]
    drawn = each.groupBy(*keys).agg(F.count("level").alias("n"), *least)
    codes = [F.lower(F.lpad(F.hex(F.col(f"draw_{k}").bitwiseAND(F.lit((1 << 24) - 1).cast("long"))), 6, "0")) for k in range(slots)]
    return drawn.select(*keys, F.when(F.col("n") > 0, F.concat(*codes)).otherwise(F.lit(EMPTY * slots)).alias("fingerprint"))


def fingerprints(texts: DataFrame, keys: list[str], column: str = "text", slots: int = SLOTS) -> DataFrame:
    """keys and fingerprint of each text; keys must tell the rows apart."""
    return samples(texts, keys, column, slots)


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of equal slots among those that either fingerprint fills; 1 if neither fills any."""
    places = F.sequence(F.lit(0), F.lit(slots - 1))
    part = lambda x, i: F.substring(x, i * 6 + 1, F.lit(6))
    used = F.size(F.filter(places, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY)))
    same = F.size(F.filter(places, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != EMPTY)))
    return F.when(used > 0, same.cast("double") / used).otherwise(1.0)


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """docs with `range`: doc_id's place among at most `ranges` quantiles; -1 for null ids."""
    quantiles = [k / ranges for k in range(1, ranges)] or [0.5]
    found = docs.agg(F.percentile_approx("doc_id", quantiles, max(10_000, 4 * ranges)).alias("at")).first()["at"]
    bounds = sorted(set(found or []))
    steps = len(bounds).bit_length()
    edges = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    # bisection: how many bounds lie at or below the id
    below = F.aggregate(
        F.array(*[F.lit(1 << k) for k in reversed(range(steps))]) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda low, step: F.when(F.get(edges, low + step - 1) <= F.col("doc_id"), low + step).otherwise(low),
    )
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(below))


#: Rows of a range, on average, and the most ranges: their bounds are a literal in the plan.
RANGE_ROWS, MOST_RANGES = 512, 4096


def edit_likeness(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of each text and of its edited text, one row for each row of df.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The edited text has its last floor(n_chars/2)
    code points replaced by as many of the start of the next text, or all of
    it if that is shorter; next is by descending doc_id, null ids last, equal
    ids by text; after the last comes the first. Null texts count as empty. A
    text without words has empty slots only; two such are alike (1).

    Rows are dealt into ranges of ids, so one task never holds the order of
    all; only the heads of the ranges cross over to another range.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ranged = in_ranges(docs, min(MOST_RANGES, max(1, docs.count() // RANGE_ROWS)))
    # at most MOST_RANGES + 1 rows
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))
    downwards = Window.orderBy(F.col("range").desc())
    around = downwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("range", F.coalesce(F.lead("range").over(downwards), F.first("range").over(around)).alias("follows"))
    head_texts = ranged.join(F.broadcast(heads.withColumnRenamed("range", "of")), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    head_texts = head_texts.groupBy("of").agg(F.min("text").alias("head_text"))
    head_texts = written(follows.join(head_texts, F.col("follows") == F.col("of")).select("range", "head_text"), "fingerprint-heads")
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = ranged.select("range", "doc_id", "text", F.row_number().over(inside).alias("place"), F.lead("text").over(inside).alias("next_text"))
    rows = rows.join(head_texts, "range", "left")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "head_text"), F.lit(1), half))
    rows = rows.select("range", "place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["range", "place", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.posexplode(F.array("text", "edited")).alias("version", "words"))
    each = samples(both, [*keys, "version"], "words", slots)
    of = lambda k: F.max(F.when(F.col("version") == k, F.col("fingerprint")))
    prints = each.groupBy(*keys).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    prints = written(prints, "fingerprints")
    head_prints = prints.filter("place = 1").select(F.col("range").alias("of"), F.col("fingerprint").alias("head_print"))
    head_prints = follows.join(head_prints, F.col("follows") == F.col("of")).select("range", "head_print")
    ahead = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))
    out = prints.withColumn("next_print", ahead).join(F.broadcast(head_prints), "range", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), slots).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("next_print", "head_print"), slots).alias("near_next"))
