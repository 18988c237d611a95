"""Phrase collocation mining: sketch, automata, sums, thresholds.

A first pass makes one sketch of how often phrases occur: cells of saturating
counters, so a cell's bit tells whether the phrases in it can reach the least
count. No task holds all cells: each sends those that it uses, and each block
of cells is summed in one place. A second pass compiles the phrases of each
piece of the input that the sketch lets through into an automaton, and scans
that piece with it; in keys and text each word is two letters of two alphabets,
so only whole words match, and overlapping matches all count. The counts are
summed and the thresholds applied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes as the scan sees them: A-Z in lower case, what ends a piece as a full stop, a tab as a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 9 else b for b in range(256))
STOP = b"."

#: log2 of the sketch's blocks; the cells of a block are shuffled and summed together.
BLOCK_BITS = 10
#: Occurrences that a task gathers before it sends their cells.
GATHERED = 1 << 22
#: Odd factors that mix the words of a phrase, by place.
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Mining:
    """least: occurrences of a candidate; longest: its words at most; inside: percent of a phrase's occurrences from which a longer one replaces it; top: rows of a language.

    cell_bits: log2 of the sketch's cells. A task that sums a block of them holds
    a byte a cell (4 MB).
    sent_bits: log2 of the bits that are sent to executors (32 MB); neighbouring
    cells share one where there are more cells. Both decide how many phrases
    too rare are counted in vain, and never a result.
    piece_bytes: text that one automaton is made for.
    """

    least: int = 10
    longest: int = 3
    inside: int = 50
    top: int = 2000
    cell_bits: int = 32
    piece_bytes: int = 4 << 20
    sent_bits: int = 28

    def __post_init__(self) -> None:
        if not (1 <= self.least <= 255 and self.longest == 3 and 16 <= self.cell_bits <= 32 and 16 <= self.sent_bits <= 30):
            raise ValueError("a counter is one byte, phrases have up to three words, a sketch has 2^16 to 2^32 cells and sends 2^16 to 2^30 bits")

    @property
    def block_cells(self) -> int:
        """log2 of the cells of a block."""
        return self.cell_bits - BLOCK_BITS

    @property
    def shared(self) -> int:
        """log2 of the cells that share a bit."""
        return max(0, self.cell_bits - self.sent_bits)


def folded(raw: bytes) -> bytes:
    """A text with a blank on both sides of each full stop, which stands for any end of a piece."""
    return raw.translate(_FOLD).replace(STOP, b" . ")


def pieces(batch: pd.DataFrame, most: int) -> Iterator[tuple[str, bytes]]:
    """(lang, folded text) of a batch's texts, joined by language and cut at ends of pieces near `most` bytes."""
    for lang, texts in batch.groupby("lang", sort=False)["raw"]:
        kept, size = [], 0
        for raw in texts:
            text = folded(bytes(raw))
            at = 0
            while len(text) - at > most and (cut := text.find(STOP, at + most)) >= 0:  # a very long text is cut; no phrase crosses a stop
                yield lang, text[at:cut]
                at = cut
            kept.append(text[at:])
            size += len(kept[-1])
            if size >= most:
                yield lang, b" . ".join(kept)
                kept, size = [], 0
        if kept:
            yield lang, b" . ".join(kept)


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct number, by number, and what place among them each number has."""
    order = np.argsort(numbers)
    ordered = numbers[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(ordered), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def split(text: bytes) -> pa.Array:
    """The words of a folded text."""
    raw = np.frombuffer(text, np.uint8)
    inside = raw != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    offsets = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


class Phrases:
    """The phrases of one piece of text: words as numbers, and a hash at every place.

    starts[k] tells where a phrase of k + 1 words stands, hashes[k] its hash
    there. The language is part of a hash.
    """

    def __init__(self, lang: str, text: bytes, longest: int):
        encoded = split(text).dictionary_encode()
        self.words, self.ids = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        self.uses = np.bincount(self.ids, minlength=len(self.words))
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words)) * _FACTORS[0]
        self.stop = self.words.index(STOP).as_py()
        plain = self.ids != self.stop
        self.n_words = int(plain.sum())
        self.hashed = hashed  # of each word, in the order of their numbers
        self.starts, self.hashes = [plain], [hashed[self.ids]]
        for k in range(1, longest):
            n = max(0, len(self.ids) - k)
            self.starts.append(self.starts[-1][:n] & plain[k:])
            mixed = self.hashes[-1][:n]
            self.hashes.append((mixed ^ (mixed >> np.uint64(29))) * _FACTORS[k] + self.hashes[0][k:])

    def occurrences(self, mining: Mining) -> list[np.ndarray]:
        """Cells of all phrases, each as often as it stands; those of words up to mining.least times, which a counter doesn't tell from more."""
        times = np.minimum(self.uses, mining.least)
        if self.stop >= 0:
            times[self.stop] = 0
        words = np.repeat(cells(self.hashed, mining.cell_bits), times)
        return [words, *(cells(h[s], mining.cell_bits) for h, s in zip(self.hashes[1:], self.starts[1:]))]

    def candidates(self, passes) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the sketch lets through, as places where it stands: a number for each word (the most frequent first; -1 for others), and a place of each distinct phrase of 1, 2 ... words. All words and shorter phrases of a phrase pass as well."""
        plain = np.flatnonzero(passes(self.hashed))
        plain = plain[plain != self.stop]
        plain = plain[np.argsort(-self.uses[plain], kind="stable")]
        ranks = np.full(len(self.uses), -1)
        ranks[plain] = np.arange(len(plain))
        anywhere = np.empty(len(self.uses), np.int64)
        anywhere[self.ids] = np.arange(len(self.ids))
        ranked = ranks[self.ids]
        found, numbers, passing = [anywhere[plain]], ranked, ranked >= 0
        for k in range(1, len(self.starts)):
            at = np.flatnonzero(passing[:-1] & passing[1:])
            at = at[self.starts[k][at]]
            at = at[passes(self.hashes[k][at])]
            # a phrase is known by its first words' number and its last word
            first, back = distinct(numbers[at] * len(plain) + ranked[at + k])
            found.append(at[first])
            numbers, passing = np.full(max(0, len(passing) - 1), -1), np.zeros(max(0, len(passing) - 1), bool)
            numbers[at], passing[at] = back, True
            if k == 1:
                self.inside = np.zeros(len(self.ids), bool)  # words of some pair that passes
                self.inside[at] = self.inside[at + 1] = True
        return ranked, found

    def counted(self, ranked: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
        """How often each phrase of found stands in the piece: words by their numbers, longer ones by an automaton.

        A word is a letter of one alphabet and a letter of another, so a key
        begins and ends with words; what stands in no pair that passes is a
        stop, which no key holds. Children of a node are sought one after the
        other, so both alphabets are small and frequent words come first.
        """
        uses = [self.uses[self.ids[found[0]]]]
        if not len(found[1]):
            return [*uses, *(np.zeros(0, np.int64) for _ in found[1:])]
        side = isqrt(len(found[0])) + 1
        kept = self.inside.copy()
        kept[1:] |= self.inside[:-1]  # one stop after each run of words
        place = np.cumsum(kept) - 1
        here, inside = ranked[kept], self.inside[kept]
        letters = np.zeros((len(here), 2), np.uint32)
        letters[inside, 0] = 1 + here[inside] // side
        letters[inside, 1] = 1 + side + here[inside] % side
        text = letters.tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
        begins = np.concatenate([2 * place[at] for at in found[1:]])
        ends = begins + np.concatenate([np.full(len(at), 2 * (k + 2)) for k, at in enumerate(found[1:])])
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
            automaton.add_word(text[a:b], i)
        automaton.make_automaton()
        hits = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(begins))
        return [*uses, *np.split(hits, np.cumsum([len(at) for at in found[1:-1]]))]

    def spelled(self, found: list[np.ndarray]) -> pa.Array:
        """The phrases that stand at the places of found, after an empty one."""
        words = lambda at: self.words.take(pa.array(self.ids[at]))
        phrases = [words(found[0]), *(pc.binary_join_element_wise(*(words(at + i) for i in range(k + 2)), b" ") for k, at in enumerate(found[1:]))]
        return pa.concat_arrays([pa.array([b""]), *phrases])


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (((hashes ^ (hashes >> np.uint64(32))) * _FACTORS[1]) >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(gathered: list[np.ndarray], mining: Mining) -> pd.DataFrame:
    """The cells of some occurrences by block: gaps between them by bytes of a kind, and counters, compressed."""
    every = np.concatenate(gathered)
    gathered.clear()
    every.sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    used = every[new]
    at = np.flatnonzero(new).astype(np.uint32)
    counters = np.minimum(np.diff(at, append=np.uint32(len(every))), np.uint32(mining.least)).astype(np.uint8)
    del every, new, at
    blocks, begins = np.unique(used >> np.uint32(mining.block_cells), return_index=True)
    gaps = np.diff(used, prepend=np.uint32(0))
    gaps[begins] = used[begins] & np.uint32((1 << mining.block_cells) - 1)
    planes = np.vstack([gaps.view(np.uint8).reshape(-1, 4).T, counters])
    pack = zstandard.ZstdCompressor(level=1)
    packed = [pack.compress(planes[:, a:b].tobytes()) for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(used)])]
    return pd.DataFrame({"block": blocks.astype(np.int32), "counters": packed})


def _sketch_part(mining: Mining):
    """One task's cells, as compressed parts of blocks of saturating counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered, size = [], 0
        for batch in batches:
            for lang, text in pieces(batch, mining.piece_bytes):
                own = Phrases(lang, text, mining.longest).occurrences(mining)
                gathered += own
                size += sum(map(len, own))
                if size >= GATHERED:
                    yield _packed(gathered, mining)
                    size = 0
        if size:
            yield _packed(gathered, mining)

    return run


def _sketch_sum(mining: Mining):
    """The bits of each block: whether counters of the cells that share it add up to the least count. Rows come by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        counters = np.zeros(1 << mining.block_cells, np.uint8)
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch["block"], batch["counters"]):
                if block not in found:
                    found[block] = np.zeros(1 << (mining.block_cells - mining.shared), bool)
                    counters[:] = 0
                planes = np.frombuffer(unpack.decompress(bytes(part)), np.uint8).reshape(5, -1)
                at = np.ascontiguousarray(planes[:4].T).view(np.uint32).ravel().cumsum()
                sums = np.minimum(counters[at].astype(np.uint16) + planes[4], mining.least).astype(np.uint8)
                counters[at] = sums
                found[block][at[sums >= mining.least] >> mining.shared] = True
        yield pd.DataFrame({"block": list(found), "bits": [np.packbits(x, bitorder="little").tobytes() for x in found.values()]})

    return run


def sketch(texts: DataFrame, mining: Mining) -> np.ndarray:
    """Bits of the cells that reach mining.least; texts has lang and raw.

    As large as mining.sent_bits says, whatever the input.
    """
    parts = texts.mapInPandas(_sketch_part(mining), "block int, counters binary")
    n = min(1 << BLOCK_BITS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = parts.repartition(n, "block").sortWithinPartitions("block").mapInPandas(_sketch_sum(mining), "block int, bits binary")
    size = 1 << (mining.block_cells - mining.shared - 3)
    found = np.zeros(size << BLOCK_BITS, np.uint8)
    for r in written(summed, "phrase-sketch").collect():  # 2^sent_bits bits at most
        found[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return found


def _scan(mining: Mining, sent):
    """Counts of each piece: of its candidates by an automaton, of their words, and, under an empty phrase, of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)

        def passes(hashes: np.ndarray) -> np.ndarray:
            at = cells(hashes, mining.cell_bits) >> np.uint32(mining.shared)
            return ((bits[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)

        for batch in batches:
            for lang, text in pieces(batch.to_pandas(), mining.piece_bytes):
                phrases = Phrases(lang, text, mining.longest)
                ranked, found = phrases.candidates(passes)
                f = np.concatenate([[phrases.n_words], *phrases.counted(ranked, found)])
                sizes = np.repeat(np.arange(len(found) + 1, dtype=np.int32), [1, *map(len, found)])
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(f)), phrases.spelled(found), pa.array(sizes), pa.array(f)], ["lang", "phrase", "size", "f"])

    return run


def counts(texts: DataFrame, mining: Mining, bits: np.ndarray) -> DataFrame:
    """lang, phrase (bytes), size, f: exact counts of all phrases of mining.least occurrences or more; size 0 has the words of the language."""
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    parts = texts.mapInArrow(_scan(mining, sent), "lang string, phrase binary, size int, f long")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= mining.least) | (F.col("size") == 0))


#: Groups of a language that are ranked apart before their best meet.
RANK_GROUPS = 64


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each candidate at its lowest-scoring cut, ties to the cut after fewer words.

    Every cut asks for the counts of its two parts. A frequent word is asked
    for by many distinct phrases, but has one row itself, so a skewed join can
    split those that ask.
    """
    phrases = found.filter("size >= 2")
    words = F.split(F.col("phrase").cast("string"), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ").cast("binary")
    cut = lambda k: F.array(F.struct(F.lit(k).alias("k"), F.lit("l").alias("side"), part(F.lit(1), F.lit(k)).alias("part")), F.struct(F.lit(k).alias("k"), F.lit("r").alias("side"), part(F.lit(k + 1), F.col("size") - k).alias("part")))
    cuts = F.when(F.col("size") == 2, cut(1)).otherwise(F.concat(cut(1), cut(2)))
    asked = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "size", "a", "c.*")
    given = found.filter("size between 1 and 2").select("lang", F.col("phrase").alias("part"), F.col("f").alias("given"))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("given")))
    wide = asked.join(given, ["lang", "part"]).groupBy("lang", "phrase", "size", "a").agg(of(1, "l").alias("l1"), of(1, "r").alias("r1"), of(2, "l").alias("l2"), of(2, "r").alias("r2"))
    exact = lambda l, r: F.expr(f"cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))")
    each = wide.withColumns({"s1": exact("l1", "r1"), "s2": exact("l2", "r2")})
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    either = lambda x: F.when(second, F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    return each.select("lang", "phrase", "size", "a", either("l").alias("l"), either("r").alias("r"), either("s").cast("long").alias("score"))


def outside(candidates: DataFrame, found: DataFrame, inside: int) -> DataFrame:
    """The candidates whose words don't lie in a longer phrase of found that has `inside` percent of their occurrences or more."""
    words = F.split(F.col("phrase").cast("string"), " ")
    pair = lambda a: F.array_join(F.slice(words, a, 2), " ").cast("binary")
    longer = found.filter("size = 3").select("lang", F.explode(F.array(pair(1), pair(2))).alias("phrase"), "f")
    covering = longer.groupBy("lang", "phrase").agg(F.max("f").alias("covering"))
    return candidates.join(covering, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("covering") < inside * F.col("a"), F.lit(True))).drop("covering")


def best(candidates: DataFrame, top: int) -> DataFrame:
    """The first `top` candidates of each language with their rank, by score and a descending, then phrase in byte order."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    first = candidates.withColumn("place", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).filter(F.col("place") <= top).drop("place")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(df: DataFrame, mining: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language.

    Texts are taken whole, with A-Z in lower case, cut into pieces at
    .,;:!? and line ends, and into words at blanks and tabs. Null texts are
    empty, a null language is `und`. Repeated rows count as often as they
    stand; other columns are ignored; languages without candidates, and empty
    tables, have no rows. n counts the language's words; a, l and r the
    phrase and the parts of its lowest-scoring cut; score is
    floor(10^6 a a / (l r)), exact for counts below 10^15.

    df is read twice. A phrase of `least` occurrences passes the sketch in
    every piece, so its count is exact; what else passes is dropped after the
    sum.
    """
    texts = df.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    found = written(counts(texts, mining, sketch(texts, mining)), "phrase-counts")
    ranked = best(outside(scored(found), found, mining.inside), mining.top)
    totals = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


#: The same in SQL, from the definition.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(words) AS phrase, 1 AS size FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS s FROM f WHERE size > 1),
k AS (SELECT c.*, k, array_to_string(s[:k], ' ') AS lp, array_to_string(s[k + 1:], ' ') AS rp FROM c, (SELECT unnest([1, 2]) AS k) x WHERE k < size),
q AS (SELECT k.lang, k.phrase, size, a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score FROM k
  JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = k.lang AND x.phrase = lp JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = k.lang AND y.phrase = rp),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([array_to_string(s[:2], ' '), array_to_string(s[2:], ' ')]) AS phrase, a FROM c WHERE size = 3),
v AS (SELECT lang, phrase, max(a) AS covering FROM h GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.phrase = b.phrase WHERE NOT coalesce(100 * covering >= 50 * a, false)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
