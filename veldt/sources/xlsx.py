"""Workbooks: sheets of .xlsx files as rows of text.

A workbook is a ZIP of XML parts. A sheet part is one compressed stream, so a
partition is one sheet of one file; it is parsed as it is read, and only the
workbook's table of shared strings is held.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import Element, iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files, opened, ship

#: Namespaces of the parts. Fixed values.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Rows of a batch that goes to Spark.
BATCH = 4096


def _elements(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[Element]:
    """The elements of a tag as they end; each is freed before the next, and its parent lets it go."""
    with book.open(part) as stream:
        above: list[Element] = []
        for event, element in iterparse(stream, events=("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                element.clear()
                if above:
                    above[-1].clear()


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and their parts, in the workbook's order."""
    links = {x.get("Id"): x.get("Target") for x in _elements(book, "xl/_rels/workbook.xml.rels", f"{PACKAGE}Relationship")}
    inside = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    return {x.get("name"): inside(links[x.get(f"{LINK}id")]) for x in _elements(book, "xl/workbook.xml", f"{MAIN}sheet")}


def _text(element: Element) -> str:
    """Runs of a string joined; readings beside it (rPh) are no part of it."""
    own = [t.text or "" for t in element.findall(f"{MAIN}t")]
    return "".join(own + [t.text or "" for run in element.findall(f"{MAIN}r") for t in run.findall(f"{MAIN}t")])


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    part = "xl/sharedStrings.xml"
    return [_text(x) for x in _elements(book, part, f"{MAIN}si")] if part in book.namelist() else []


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Za-z]+", reference)[0].upper():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _value(cell: Element, strings: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return None if inline is None else _text(inline)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(value)]
    return {"1": "TRUE", "0": "FALSE"}.get(value) if kind == "b" else value


def sheet_rows(book: zipfile.ZipFile, part: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers from 1, and the values by column; rows without values are left out."""
    number = 0
    for row in _elements(book, part, f"{MAIN}row"):
        number = int(row.get("r", number + 1))
        values, at = {}, -1
        for cell in row.iter(f"{MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else at + 1
            value = _value(cell, strings)
            if value is not None:
                values[at] = value
        if values:
            yield number, values


def header(book: zipfile.ZipFile, part: str, strings: list[str], row: int) -> dict[int, str]:
    """Columns and their names; of repeated names the later ones get a number, as .1."""
    for number, values in sheet_rows(book, part, strings):
        if number >= row:
            break
    else:
        raise ValueError(f"the sheet has no row {row}")
    if number != row:
        raise ValueError(f"row {row} of the sheet is empty")
    names: dict[int, str] = {}
    for at, name in sorted(values.items()):
        taken, n, free = set(names.values()), 1, name
        while free in taken:
            free, n = f"{name}.{n}", n + 1
        names[at] = free
    return names


@dataclass
class Sheet(InputPartition):
    uri: str


class XlsxReader(DataSourceReader):
    def __init__(self, columns: list[str], path: str, sheet: str | None, row: int):
        self.columns, self.path, self.sheet, self.row = columns, path, sheet, row

    def partitions(self) -> list[InputPartition]:
        return [Sheet(uri) for uri, _ in files(self.path, (".xlsx",))]

    def read(self, partition: Sheet) -> Iterator:
        import pyarrow as pa

        with opened(partition.uri) as raw, zipfile.ZipFile(raw) as book:
            part, strings = _part(book, self.sheet), shared_strings(book)
            names = header(book, part, strings, self.row)
            places = {name: at for at, name in names.items()}
            missing = [c for c in self.columns if c not in places]
            if missing:
                raise ValueError(f"{partition.uri} lacks the columns {missing}")
            order = [places[c] for c in self.columns]
            schema = pa.schema([(c, pa.string()) for c in self.columns])
            rows: list[list] = []

            def batch():
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(order))], schema=schema)

            for number, values in sheet_rows(book, part, strings):
                if number > self.row:
                    rows.append([values.get(at) for at in order])
                    if len(rows) == BATCH:
                        yield batch()
                        rows.clear()
            if rows:
                yield batch()


def _part(book: zipfile.ZipFile, sheet: str | None) -> str:
    parts = sheet_parts(book)
    if sheet is None:
        return next(iter(parts.values()))
    if sheet not in parts:
        raise ValueError(f"no sheet {sheet!r}; there are {list(parts)}")
    return parts[sheet]


class XlsxSource(DataSource):
    """Options: path (a file, or a folder of files of one layout), sheet (else the first), headerRow (from 1; else 1)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        uri = next(iter(files(self.options["path"], (".xlsx",))), (None,))[0]
        if uri is None:
            raise FileNotFoundError(f"no workbook in {self.options['path']}")
        with opened(uri) as raw, zipfile.ZipFile(raw) as book:
            names = header(book, _part(book, self.options.get("sheet")), shared_strings(book), int(self.options.get("headerRow", 1)))
        return ", ".join(f"`{n.replace('`', '``')}` string" for _, n in sorted(names.items()))

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(schema.fieldNames(), self.options["path"], self.options.get("sheet"), int(self.options.get("headerRow", 1)))


def sheet(spark: SparkSession, path: str, name: str | None = None, header_row: int = 1) -> DataFrame:
    """A sheet of the workbook at path, or of every workbook below it, as text.

    Columns are named by the header row, as they stand there. Numbers keep the
    digits of the file, dates are its serial numbers, truths are TRUE and
    FALSE, errors and empty cells are NULL; rows without values are left out.
    """
    ship(spark)
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("headerRow", header_row)
    return (reader.option("sheet", name) if name is not None else reader).load(path)
