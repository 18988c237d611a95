"""License scans: an exact set-similarity join of text blocks with license notices.

Tokens stand in one global order, rarest first by the number of documents
that hold them. A block that meets a template's containment threshold must
hold one of the template's first tokens in that order (its prefix), so only
blocks with a prefix token become candidates; length and position bound the
overlap that a candidate can still reach; what remains is counted exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

PHRASES: Mapping[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by label; a label may have several.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)

#: Words of a notice that name the license: one of them has to stand where a short notice is seen.
NAMES: Mapping[str, frozenset[str]] = {"mit": frozenset({"mit"}), "apache": frozenset({"apache"}), "gpl": frozenset({"gnu", "gpl"}), "cc": frozenset({"commons", "cc"}), "mpl": frozenset({"mozilla", "mpl"})}
#: Notices of at most so many words are made of words that stand in any prose: where their label has names, the words have to come in order, and with a name.
SHORT = 24

#: Bytes of words: digits, a-z and everything beyond ASCII; A-Z become a-z, all else parts words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FOLD_KEEPING_LINES = bytes(0x0A if b == 0x0A else c for b, c in enumerate(_FOLD))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def _common(words: Sequence[bytes], block: Sequence[bytes]) -> int:
    """How many of the words stand in the block in their order: the longest common subsequence."""
    longest = [0] * (len(words) + 1)
    for token in block:
        before = 0
        for i, word in enumerate(words, 1):
            before, longest[i] = longest[i], before + 1 if token == word else max(longest[i], longest[i - 1])
    return longest[-1]


@dataclass(frozen=True)
class Template:
    label: str
    n_words: int
    tokens: tuple[bytes, ...]  # distinct, in global order
    needed: int  # tokens of an overlap that meets the threshold
    sequence: tuple[bytes, ...] = ()  # of a short notice that a name tells apart, its words in order
    names: frozenset[bytes] = frozenset()  # of which such a notice needs one

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.tokens[: len(self.tokens) - self.needed + 1]


class Scanner:
    """Finds, in one text, the places of phrases and the templates of its blocks."""

    def __init__(self, frequencies: Mapping[bytes, int], templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], threshold: float):
        order = lambda t: (frequencies.get(t, 0), t)
        self.templates = []
        for label, notice in templates:
            tokens = tuple(sorted(set(words(notice)), key=order))
            if tokens:
                own = words(notice)
                short = len(own) <= SHORT
                names = frozenset(n.encode() for n in NAMES.get(label, ())).intersection(tokens) if short else frozenset()
                self.templates.append(Template(label, len(own), tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9)), tuple(own) if names else (), names))
        self.threshold = threshold
        everything = sorted({t for x in self.templates for t in x.tokens}, key=order)
        self.place = {t: i for i, t in enumerate(everything)}
        self.index = dict.fromkeys(t for template in self.templates for t in template.prefix)
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            own = words(phrase)
            self.phrases.setdefault(own[-1], []).append((own, label))

    def base(self, tokens: list[bytes]) -> tuple[list[int], set[str]]:
        """The starts of all phrase places, and the labels of these."""
        starts, labels = [], set()
        for last, found in self.phrases.items():
            at = -1
            try:
                while True:
                    at = tokens.index(last, at + 1)
                    for own, label in found:
                        start = at - len(own) + 1
                        if start >= 0 and tokens[start : at + 1] == own:
                            starts.append(start)
                            labels.add(label)
            except ValueError:
                pass
        return starts, labels

    def _share(self, template: Template, block: set[bytes]) -> float:
        """The containment of a template in a block's tokens; 0 if it can't reach the threshold."""
        ordered = sorted(self.place[t] for t in block if t in self.place)
        if len(ordered) < template.needed:  # length
            return 0.0
        position = next((i for i, t in enumerate(template.prefix) if t in block), None)  # prefix
        if position is None:
            return 0.0
        behind = len(ordered) - bisect_left(ordered, self.place[template.tokens[position]])
        if min(len(template.tokens) - position, behind) < template.needed:  # position
            return 0.0
        share = sum(1 for t in template.tokens if t in block)
        return share / len(template.tokens) if share >= template.needed else 0.0

    def _in_order(self, template: Template, block: list[bytes]) -> bool:
        """Whether a block that shares a template's words may be the notice: of a short one the share has to come in order, the name at its place among them."""
        own = template.sequence
        if not own:
            return True
        needed = math.ceil(self.threshold * len(own) - 1e-9)
        places = [(i, j) for i, word in enumerate(own) if word in template.names for j, token in enumerate(block) if token == word]
        return any(_common(own[:i], block[:j]) + 1 + _common(own[i + 1 :], block[j + 1 :]) >= needed for i, j in places)

    def matches(self, text: str, tokens: list[bytes]) -> dict[str, float]:
        """The largest containment of each label that reaches the threshold in some block.

        Blocks are lines, and for each template the windows of twice its
        words that start at multiples of its words: whatever stretch of the
        text is as long as the template lies in one of them.
        """
        best: dict[str, float] = {}
        present = set(tokens)
        if self.index.keys().isdisjoint(present):
            return best
        wanted = [t for t in self.templates if self._share(t, present) > 0]
        if not wanted:
            return best
        lines = [x.split() for x in text.encode("utf-8", "replace").translate(_FOLD_KEEPING_LINES).split(b"\n")]
        lines = [x for x in lines if not self.index.keys().isdisjoint(x)]
        for template in wanted:
            prefix, n = frozenset(template.prefix), template.n_words
            at = {i // n for i, t in enumerate(tokens) if t in prefix}
            starts = {q * n for x in at for q in (x - 1, x) if q >= 0}
            for block in [x for x in lines if not prefix.isdisjoint(x)] + [tokens[s : s + 2 * n] for s in starts]:
                share = self._share(template, set(block))
                if share and share > best.get(template.label, 0.0) and self._in_order(template, block):
                    best[template.label] = max(best.get(template.label, 0.0), share)
        return best

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        tokens = words(text)
        starts, base = self.base(tokens)
        found = self.matches(text, tokens)
        score = 1.0 if starts else max(found.values(), default=0.0)
        return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score


def template_frequencies(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, column: str = "text") -> DataFrame:
    """token, documents: how many texts hold each token of the templates; over all texts."""
    wanted = {t for _, notice in templates for t in words(notice)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(wanted.intersection(words(text)))
        yield pd.DataFrame({"token": list(counts), "documents": list(counts.values())})

    partial = df.select(text_or_empty(column).alias("text")).mapInPandas(count, "token binary, documents long")
    return partial.groupBy("token").agg(F.sum("documents").alias("documents"))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8, column: str = "text") -> DataFrame:
    """df with the columns of SCHEMA for each whole text.

    first_word and last_word are the smallest and largest start of a phrase;
    labels are those of phrases and templates (of short notices only where
    their words come in order and with the license's name); score is 1 where a phrase
    stands, else the largest containment that reaches the threshold, else 0.
    Null and empty texts have no words and empty labels. All rows stay;
    columns of these names are replaced. The templates and the frequencies of
    their tokens are all that is sent to executors: as large as the templates,
    whatever the input. Each text is read twice: for the order, and to join.
    """
    counted = {bytes(r["token"]): r["documents"] for r in written(template_frequencies(df, templates, column), "license-order").collect()}

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(counted, templates, phrases, threshold)
        names = [x.split()[0] for x in SCHEMA.split(",")]
        for texts in batches:
            found = pd.DataFrame([scanner.scan(t) for t in texts], columns=names)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    names = [x.split()[0] for x in SCHEMA.split(",")]
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, scan(text_or_empty(column)).alias("license_scan")).select(*kept, "license_scan.*")
