"""Byte-level BPE by higher-order functions.

Each match of the pattern is a word, encoded by folding ranked merges over its
bytes. While it is folded a word is a string with one character for each part,
so that a pair of parts is two characters, a literal map has the ranks of
pairs, and joining a pair replaces two characters by one. Words of all
documents are counted; the distinct frequent ones are folded once and kept,
with the words that are pieces themselves, in a second literal map. A
document's other words are folded where they stand, so no text is shuffled.

Decoding turns ids into the bytes of their pieces and concatenates these.
"""

from __future__ import annotations

import base64
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal, text_or_empty, written

#: Small maps of the literal map of pairs; the map of words has one for every two words kept.
PAIR_SLOTS = 1 << 16
#: The characters of ids begin here, and leave out the surrogates.
FIRST, SURROGATES, BEHIND = 0x100, 0xD800, 0xE000
#: Words of more bytes are cut where no piece can reach across, and are not kept.
LONG = 64
#: Words of this many uses or more are counted together when the least uses of kept words are chosen.
MOST_USES = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """The pieces and ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _slots(pairs: DataFrame, key: str, value: str, n: int, uses: Column) -> DataFrame:
    """One row: an array of n small maps; a key's map is at its hash modulo n.

    Spark goes through a map to find a key; within a small map the keys of
    most uses come first, where they are found soonest.
    """
    spark = pairs.sparkSession
    entries = F.array_sort(F.collect_list(F.struct((-uses).alias("order"), key, value)))
    small = pairs.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("slot")).agg(F.transform(entries, lambda x: F.struct(x[key].alias(key), x[value].alias(value))).alias("small"))
    every = spark.range(n).select(F.col("id").cast("int").alias("slot")).join(small, "slot", "left")
    in_order = F.array_sort(F.collect_list(F.struct("slot", "small")), lambda a, b: a["slot"] - b["slot"])
    return every.agg(F.transform(in_order, lambda x: F.map_from_entries(x["small"])).alias("slots"))


def _find(slots: Column, key: Column, n: int) -> Column:
    return F.element_at(F.get(slots, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), key)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def _char(rank: int) -> str:
    return chr(rank + FIRST if rank + FIRST < SURROGATES else rank + FIRST + BEHIND - SURROGATES)


def _rank(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < SURROGATES, code - FIRST).otherwise(code - (FIRST + BEHIND - SURROGATES))


class ByteBpe:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, kept_words: int = 1 << 19):
        """kept_words: at most so many frequent words are kept folded, besides the pieces.

        It bounds the literal map and changes the time that encoding takes,
        never its result.
        """
        self.spark, self.kept_words, self.word_slots = spark, kept_words, max(1, kept_words >> 1)
        self.pattern = f"(?U){pattern}"
        ranks = read_ranks(path)
        single = [ranks.get(bytes([b])) for b in range(256)]
        if None in single:
            raise ValueError("a byte has no piece")
        self.bytes, self.letters = "".join(map(chr, range(256))), "".join(map(_char, single))
        pairs: dict[tuple[int, int], int] = {}
        beside = [False] * (1 << 16)
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                beside[piece[cut - 1] * 256 + piece[cut]] = True
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        # what a pair makes, the pair, and a mark if what it makes joins another of its left parts at a lower rank
        made = [_char(r) + _char(a) + _char(b) + "!" * (pairs.get((r, a), r) < r) for (a, b), r in pairs.items()]
        by_id: list[str | None] = [None] * (max(ranks.values()) + 1)
        words, ids = [], []
        for piece, rank in ranks.items():
            by_id[rank] = piece.decode("latin-1")
            try:
                words.append(piece.decode())
                ids.append(rank)
            except UnicodeDecodeError:  # part of a letter: never a word
                pass
        small = spark.createDataFrame([(made, beside, by_id)], "made array<string>, beside array<boolean>, pieces array<string>")
        self.beside, self.pieces = literal(small.select("beside")), literal(small.select("pieces"))
        joins = small.select(F.explode("made").alias("made")).select(F.substring("made", 2, 2).alias("pair"), "made")
        self.joins = literal(_slots(joins, "pair", "made", PAIR_SLOTS, F.lit(0)))
        whole = spark.createDataFrame([(words, ids)], "words array<string>, ids array<int>")
        self.whole = whole.select(F.explode(F.arrays_zip("words", "ids")).alias("x")).select(F.col("x.words").alias("word"), F.array("x.ids").alias("ids"))

    # folding

    def _best(self, parts: Column) -> Column:
        """What the pair of lowest rank makes; null if no pair of neighbours joins. Characters sort as ranks."""
        pairs = F.regexp_extract_all(parts, F.lit("(?s)(?=(..))"), F.lit(1))
        return F.array_min(F.transform(pairs, lambda pair: _find(self.joins, pair, PAIR_SLOTS)))

    def _state(self, parts: Column) -> Column:
        return _let(parts, lambda p: F.struct(p.alias("parts"), self._best(p).alias("best")))

    def _merge(self, state: Column, _: Column) -> Column:
        """Joins all pairs of the lowest rank, from left to right.

        If one of these joins makes a pair of lower rank, which has to come
        before the next of them, only the first is made.
        """
        parts, best = state["parts"], state["best"]
        new, pair = F.substring(best, 1, 1), F.substring(best, 2, 2)
        every = self._state(F.replace(parts, pair, new))
        first = self._state(F.overlay(parts, new, F.position(pair, parts), F.lit(2)))
        step = _let(every, lambda e: F.when((e["best"] < best) | (F.char_length(best) > 3), first).otherwise(e))
        return F.when(best.isNull(), state).otherwise(step)

    def _folded(self, latin: Column) -> Column:
        """The parts of one word or chunk, given as a character for each byte."""
        parts = F.translate(latin, self.bytes, self.letters)
        return F.aggregate(F.sequence(F.lit(1), F.char_length(latin)), self._state(parts), self._merge, lambda s: s["parts"])

    def _cut(self, latin: Column) -> Column:
        """The chunks of a word: it is cut where two bytes meet that no piece holds side by side."""

        def chunks(codes: Column) -> Column:
            apart = lambda i: ~F.get(self.beside, F.get(codes, i - 1) * 256 + F.get(codes, i))
            starts = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: (i == 0) | apart(i))
            return _let(starts, lambda s: F.transform(s, lambda a, k: F.substring(latin, a + 1, F.coalesce(F.get(s, k + 1), F.size(codes)) - a)))

        return _let(F.transform(F.split(latin, ""), F.ascii), chunks)

    def fold(self, word: Column) -> Column:
        """Ids of one word, a string that is no piece itself.

        A word of more than LONG bytes is cut into chunks first, as no merge
        reaches from one to the next.
        """

        def run(latin: Column) -> Column:
            parts = F.when(F.char_length(latin) <= LONG, self._folded(latin)).otherwise(F.array_join(F.transform(self._cut(latin), self._folded), ""))
            return F.transform(F.split(parts, ""), _rank)

        return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), run)

    # texts

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def kept(self, df: DataFrame, column: str = "text") -> Column:
        """The literal map from words to ids: all pieces, and the words that df holds most often, each folded once."""
        counted = df.select(F.explode(self.words(text_or_empty(column))).alias("word")).groupBy("word").count()
        counted = counted.filter((F.col("count") > 1) & (F.octet_length("word") <= LONG))
        counted = written(counted, "bpe-words")
        uses = {r["uses"]: r["words"] for r in counted.groupBy(F.least("count", F.lit(MOST_USES)).alias("uses")).agg(F.count("*").alias("words")).collect()}  # at most MOST_USES rows
        least, room = MOST_USES + 1, self.kept_words
        while least > 2 and uses.get(least - 1, 0) <= room:
            least -= 1
            room -= uses.get(least, 0)
        frequent = counted.filter(F.col("count") >= least)
        both = frequent.join(self.whole, "word", "full")
        ids = F.coalesce("ids", self.fold(F.col("word")))
        return literal(_slots(both.select("word", ids.alias("ids"), F.coalesce("count", F.lit(0)).alias("uses")), "word", "ids", self.word_slots, F.col("uses")))

    def encode(self, df: DataFrame, column: str = "text", out: str = "ids") -> DataFrame:
        """df with the ids of each whole text, an array<int>.

        Null and empty texts have no ids. A column of the name `out` is
        replaced; all rows stay. df is read twice: to count words, and to
        encode.
        """
        known = self.kept(df, column)
        ids = F.transform(self.words(text_or_empty(column)), lambda w: F.coalesce(_find(known, w, self.word_slots), self.fold(w)))
        return df.withColumn(out, F.flatten(ids))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """df with the bytes that the ids stand for; null for null ids and where an id lies beyond the last rank."""
        known = (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) < F.size(self.pieces)))
        pieces = F.transform(F.col(ids), lambda i: F.get(self.pieces, i))
        return df.withColumn(out, F.when(known, F.encode(F.array_join(pieces, ""), "ISO-8859-1")))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with n_tokens and the SHA-256 of the ids, in decimal joined by commas, and of the decoded bytes."""
    return df.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.btrim(F.to_json(ids), F.lit("[]")).cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col(decoded), 256),
        }
    )
