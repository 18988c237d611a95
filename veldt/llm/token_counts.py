"""Token counts by byte-pair merging on a heap over a linked list.

Only the number of tokens is made, never an identifier: a word starts as one
symbol a byte, and each merge takes one symbol away.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the code points from
    256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts tokens as a BPE model file of the `tokenizers` library does.

    Takes models of this kind: NFC, white space to one blank and lower case;
    a pattern whose matches are the words; byte-level letters; a suffix at the
    end of a word. Other kinds raise ValueError, rather than count wrongly.
    """

    def __init__(self, definition: str, cached_words: int = 600_000):
        model = json.loads(definition)
        steps = [n["type"] for n in model["normalizer"]["normalizers"]]
        split, level = model["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"]:
            raise ValueError("this kind of tokenizer is not supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        suffix = model["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        ids: dict[str, int] = {}
        number = lambda symbol: ids.setdefault(symbol, len(ids))
        self.inner, self.last = [number(x) for x in letters], [number(x + suffix) for x in letters]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["model"]["merges"]]
        numbered = [(number(a), number(b), number(a + b)) for a, b in pairs]
        self.base = len(ids)
        self.ranks = {a * self.base + b: rank for rank, (a, b, _) in enumerate(numbered)}
        self.results = [c for _, _, c in numbered]
        self.words = regex.compile(split["pattern"]["Regex"])
        added = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.spaces, self.odd = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")  # str.split() also splits at these four
        self.cached_words = cached_words
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges."""
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return len(raw) - merges(symbols, self.ranks, self.results, self.base)

    def _chunk(self, chunk: str) -> int:
        """Tokens of a string without white space."""
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return sum(map(self.word, self.words.findall(plain.lower())))

    def _piece(self, text: str) -> int:
        """Tokens of a text without added tokens; no word crosses white space."""
        total, known, older = 0, self.known, self.older
        for w in self.spaces.split(text) if self.odd.search(text) else text.split():
            n = known.get(w)
            if n is None:
                n = older.get(w)
                if n is None:
                    n = self._chunk(w)
                if len(known) >= self.cached_words:  # memory stays bounded; recent words stay known
                    self.older = older = known
                    self.known = known = {}
                if len(w) <= 64:
                    known[w] = n
            total += n
        return total

    def text(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._piece(text)
        pieces = self.added.split(text)
        return len(pieces) - 1 + sum(map(self._piece, pieces))


def merges(symbols: list[int], ranks: dict[int, int], results: list[int], base: int) -> int:
    """How many merges the ranks allow in a list of symbols, which it uses up.

    ranks: of the pair a, b under a * base + b; results: the symbol that each
    rank makes. The heap holds rank and place of the left symbol in one
    integer; an entry is stale when the pair now at its place has another
    rank. Of equal ranks the leftmost goes first.
    """
    n = len(symbols)
    find = ranks.get
    heap = []
    for i in range(n - 1):
        if (r := find(symbols[i] * base + symbols[i + 1])) is not None:
            heap.append(r << 32 | i)
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        left, j = symbols[i], after[i]
        if left < 0 or j >= n or find(left * base + symbols[j]) != top >> 32:
            continue
        merged = symbols[i] = results[top >> 32]
        symbols[j] = -1
        k = after[i] = after[j]
        done += 1
        if k < n:
            before[k] = i
            if (r := find(merged * base + symbols[k])) is not None:
                push(heap, r << 32 | i)
        if (h := before[i]) >= 0 and (r := find(symbols[h] * base + merged)) is not None:
            push(heap, r << 32 | h)
    return done


def token_counts(df: DataFrame, model_path: str, column: str = "text", limit: int = 2048) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit for each whole text.

    Null and empty texts have 0 tokens. Columns of these three names are
    replaced; all rows stay, repeated ones too. No shuffle; each Python worker
    keeps the counts of up to twice `cached_words` words.
    """
    definition = df.sparkSession.sparkContext.broadcast(Path(model_path).read_text(encoding="utf-8"))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = MergeCounter(definition.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    text = text_or_empty(column)
    return df.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": count(text)}).withColumn("over_limit", F.col("n_tokens") > limit)
