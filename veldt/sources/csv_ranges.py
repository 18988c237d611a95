"""CSV files of unknown encoding, read in byte ranges.

One parallel pass tells of each range which encodings fit it and how many
quotes it holds. A file takes the first encoding that fits all its ranges; the
quotes before a range tell whether it begins inside a quoted field. A second
pass cuts the ranges at ends of records and parses each apart.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stores import files, opened, ship

#: Bytes of a range.
RANGE = 32 << 20
#: Records of a batch that goes to Spark, and bytes read at a time beyond a range.
BATCH, BEYOND = 8192, 1 << 16
CONTINUES = range(0x80, 0xC0)


def _fits(raw: bytes, before: bool, after: bytes, encoding: str) -> bool:
    """Whether a range decodes strictly. A letter of UTF-8 belongs to the range that it begins in."""
    if codecs.lookup(encoding).name == "utf-8":
        skip = 0
        while before and skip < min(3, len(raw)) and raw[skip] in CONTINUES:
            skip += 1
        more = 0
        while more < len(after) and after[more] in CONTINUES:
            more += 1
        raw = raw[skip:] + after[:more]
    try:
        raw.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def _judge(encodings: Sequence[str]):
    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for uri, size, start, end in batch.itertuples(index=False, name=None):
                with opened(uri) as f:
                    f.seek(start)
                    raw, after = f.read(end - start), f.read(3)
                rows.append((uri, size, start, end, [_fits(raw, start > 0, after, e) for e in encodings], raw.count(b'"')))
            yield pd.DataFrame(rows, columns=["uri", "size", "start", "end", "fits", "quotes"])

    return run


def _record_end(stream, data: bytearray, at: int, inside: bool) -> int:
    """The place behind the first line end from `at` on that is outside of quotes; reads on as needed; the data's end at the file's."""
    while True:
        line = data.find(b"\n", at)
        if line >= 0:
            inside ^= data.count(b'"', at, line) % 2 == 1
            at = line + 1
            if not inside:
                return at
            continue
        inside ^= data.count(b'"', at) % 2 == 1
        at = len(data)
        more = stream.read(BEYOND)
        if not more:
            return at
        data += more


def _header(stream, encoding: str) -> list[str]:
    stream.seek(0)
    data = bytearray(stream.read(BEYOND))
    text = bytes(data[: _record_end(stream, data, 0, False)]) if data else b""
    names = next(csv.reader(io.StringIO(text.decode(encoding).lstrip("﻿"), newline="")), [])
    return [n.strip() for n in names]


def records(stream, start: int, end: int, inside: bool, encoding: str) -> Iterator[list[str]]:
    """The records that begin in a range; inside: whether an odd number of quotes stands before it."""
    at = max(start - 1, 0)  # a record that begins with the range shows by the line end before it
    stream.seek(at)
    data = bytearray(stream.read(end - at))
    first = 0
    if start > 0:
        first = _record_end(stream, data, 0, inside ^ (data[:1] == b'"'))
    if at + first >= end and start > 0:
        return
    # up to the end of the record that the range's last byte is part of
    within = data.count(b'"', first, end - 1 - at) % 2 == 1
    last = _record_end(stream, data, max(end - 1 - at, first), within) if end - 1 - at >= first else first
    text = bytes(data[first:last]).decode(encoding)
    rows = csv.reader(io.StringIO(text, newline=""))
    if start == 0:
        next(rows, None)  # the header
    yield from (r for r in rows if r)


def _parse(names: Sequence[str], na: frozenset[str], encodings: Sequence[str]):
    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            for uri, start, end, fits, before in batch.itertuples(index=False, name=None):
                encoding = next((e for e, ok in zip(encodings, fits) if ok), None)
                if encoding is None:
                    raise ValueError(f"no encoding fits {uri}")
                with opened(uri) as f:
                    places = {n: i for i, n in enumerate(_header(f, encoding))}
                    order = [places.get(n) for n in names]
                    held: list[list] = []
                    for record in records(f, start, end, before % 2 == 1, encoding):
                        held.append([None if i is None or i >= len(record) or record[i] in na else record[i] for i in order])
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=list(names), dtype=object)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=list(names), dtype=object)

    return run


def csv_texts(spark: SparkSession, path: str, names: Sequence[str], na: Iterable[str], encodings: Iterable[str], range_bytes: int = RANGE) -> DataFrame:
    """The named columns of a CSV file, or of those below a folder, as text.

    Columns are matched by each file's header; those that it lacks, and fields
    that a short record lacks, are NULL, as is what stands in na. Empty lines
    are left out. Encodings are UTF-8 or have one byte a letter. Quotes stand
    around fields, and twice within them.
    """
    ship(spark)
    chosen = tuple(encodings)
    ranges = [(uri, size, at, min(at + range_bytes, size)) for uri, size in files(path, (".csv",)) for at in range(0, size, range_bytes)]
    n = max(1, len(ranges))
    listed = spark.createDataFrame(ranges, "uri string, size long, start long, end long")
    judged = listed.repartition(n).mapInPandas(_judge(chosen), "uri string, size long, start long, end long, fits array<boolean>, quotes long")
    whole = Window.partitionBy("uri")
    fits = F.array(*[F.min(F.get("fits", F.lit(i))).over(whole) for i in range(len(chosen))])
    before = F.coalesce(F.sum("quotes").over(whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = judged.select("uri", "start", "end", fits.alias("fits"), before.alias("before")).repartition(n)
    return known.mapInPandas(_parse(tuple(names), frozenset(na), chosen), ", ".join(f"`{c}` string" for c in names))


def plain_header(path: str) -> list[str]:
    """The column names of a CSV file, or of the first one below a folder, in any of its encodings: names are plain letters."""
    found = files(path, (".csv",))
    if not found:
        raise FileNotFoundError(f"no CSV in {path}")
    with opened(found[0][0]) as f:
        return _header(f, "latin-1" if not _fits(f.read(BEYOND), False, b"", "utf-8") else "utf-8")
