"""Secret scans: three base patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary holds what stands often in text, so words take few
tokens and random strings take many. A long run of key letters whose
characters per token stay at or below a threshold is reported, unless it is a
digest or an identifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import read_ranks

#: The base kinds in the order that spans of one start take, with the added kind last.
KINDS = ("assign", "access", "hex", "random")

#: An assignment's key words, in either case of ASCII letters; what must stand behind it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # the runs of 16 and more: what is left of [0-9a-f]+
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEXADECIMAL = re.compile("[0-9a-fA-F]+")
_LABELLED_DIGEST = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-=_/].+", re.IGNORECASE)
_UUID = re.compile("[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A part of an identifier: a number, or humps of letters with a short number behind.
_PART = re.compile("[0-9]+|(?:[A-Z][a-z]{2,}|[a-z]+|[A-Z]+)(?:[A-Z][a-z]{2,})*[0-9]{0,4}")
_PARTS = re.compile("[-_+/=]+")

#: Key words as bytes in lower case: a text without any of them has no assignment.
_KEY_WORDS = (b"passw", b"secret", b"token", b"api")


@dataclass(frozen=True)
class Efficiency:
    """least: characters of a run that is judged; most: its characters per token at most.

    Of random strings of 20 letters and digits 99.9 % have at most 1.82.
    """

    least: int = 16
    most: float = 1.9


def is_digest(run: str) -> bool:
    """A hexadecimal string as long as a common digest, or one that its prefix names as a digest."""
    return bool(len(run) in DIGEST_LENGTHS and _HEXADECIMAL.fullmatch(run) or _LABELLED_DIGEST.fullmatch(run))


def is_identifier(run: str) -> bool:
    """A UUID, or parts of plain words and numbers joined by separators."""
    return bool(_UUID.fullmatch(run)) or all(_PART.fullmatch(p) for p in _PARTS.split(run) if p)


class SecretScanner:
    """Finds secrets in one text; positions are code points."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, efficiency: Efficiency = Efficiency()):
        self.tokens = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.efficiency = efficiency
        self.run = re.compile(f"[A-Za-z0-9+/_=-]{{{efficiency.least},}}")
        letters = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"}
        # bytes of runs become x, all others blanks, so one search tells whether a text has a run at all
        self.fold = bytes(0x78 if b in letters else 0x20 for b in range(256))
        self.long = b"x" * min(efficiency.least, 16)

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        return found + [("hex", *m.span()) for m in HEX.finditer(text)]

    def characters_per_token(self, run: str) -> float:
        return len(run) / len(self.tokens.encode_ordinary(run))

    def random(self, text: str, base: Sequence[tuple[str, int, int]]) -> Iterator[tuple[int, int, float]]:
        """The runs of low token efficiency that meet no base span."""
        spans = sorted((start, end) for _, start, end in base)
        at, reached = 0, -1
        for m in self.run.finditer(text):
            while at < len(spans) and spans[at][0] < m.end():
                reached = max(reached, spans[at][1])
                at += 1
            if reached > m.start() or is_identifier(m[0]) or is_digest(m[0]):
                continue
            ratio = self.characters_per_token(m[0])
            if ratio <= self.efficiency.most:
                yield m.start(), m.end(), ratio

    def scan(self, raw: bytes) -> list[dict]:
        """The spans of a text given in UTF-8, by start and then kind."""
        runs = self.long in raw.translate(self.fold)
        if not runs:
            lower = raw.lower()
            if not any(k in lower for k in _KEY_WORDS):
                return []  # nothing else can match: access keys and hexadecimal runs are runs
        text = raw.decode("utf-8", "replace")
        base = self.base(text)
        found = [(start, KINDS.index(kind), end, None) for kind, start, end in base]
        found += [(start, KINDS.index("random"), end, ratio) for start, end, ratio in self.random(text, base)]
        return [{"kind": KINDS[k], "start": start, "end": end, "chars_per_token": ratio} for start, k, end, ratio in sorted(found, key=lambda x: x[:3])]


SPAN = "array<struct<kind:string,start:long,end:long,chars_per_token:double>>"


def find_secrets(df: DataFrame, ranks_path: str, pattern: str, efficiency: Efficiency = Efficiency(), column: str = "text", out: str = "secrets") -> DataFrame:
    """df with the secrets of each whole text: kind, start, end (code points, end exclusive) and, of random strings, characters per token.

    Base kinds are the matches of ASSIGN with a value of 12 characters or
    more, of ACCESS with 18 or more, and HEX; a kind's matches don't overlap,
    those of different kinds may. A random string is a maximal run of key
    letters that meets no base span, is neither digest nor identifier, and has
    at most `efficiency.most` characters per token of the vocabulary.

    Null and empty texts have no spans. All rows stay, repeated ones too; a
    column of the name `out` is replaced. No shuffle: texts are scanned where
    they stand, and the vocabulary is all that is sent to executors.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf(SPAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = SecretScanner(ranks.value, pattern, efficiency)
        for texts in batches:
            yield pd.Series([scanner.scan(bytes(t)) for t in texts], dtype=object)

    return df.withColumn(out, scan(F.coalesce(F.col(column).cast("binary"), F.lit(b""))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(df: DataFrame, secrets: str = "secrets") -> DataFrame:
    """df with counts by base kind, the digest of the base spans, and all spans as text."""
    spans = F.col(secrets)
    of = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    base = F.filter(spans, lambda s: s["kind"] != "random")
    counts = {f"n_{kind}": F.size(of(kind)).cast("long") for kind in KINDS}
    return df.withColumns(counts | {"base_sha256": F.sha2(_listed(base).cast("binary"), 256), "spans": _listed(spans)})
