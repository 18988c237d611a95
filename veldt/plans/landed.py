"""Files of foreign formats made from the driver's rows, for the queries that read such files."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.sources.stores import published, ship
from veldt.sources.xlsx import LINK, MAIN, PACKAGE


def _letters(column: int) -> str:
    return (_letters(column // 26 - 1) if column >= 26 else "") + chr(65 + column % 26)


def _cell(reference: str, value, shared: dict[str, int]) -> str:
    """Numbers as they are, every second text as a shared string, the others inline."""
    if value is None or value != value:
        return ""
    if not isinstance(value, str):
        return f'<c r="{reference}"><v>{value}</v></c>'
    if len(value) % 2:
        return f'<c r="{reference}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def workbook(out, sheet: str, header_row: int, names: Sequence[str], rows: Iterator[Sequence]) -> None:
    """A workbook of a note sheet and a sheet of rows under a title, written as a stream."""
    xml = lambda tag, body, space: f'<?xml version="1.0" encoding="UTF-8"?><{tag} xmlns="{space[1:-1]}">{body}</{tag}>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        shared: dict[str, int] = {}
        book.writestr("xl/worksheets/sheet1.xml", xml("worksheet", '<sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Notes</t></is></c></row></sheetData>', MAIN))
        with book.open("xl/worksheets/sheet2.xml", "w") as part:
            head = lambda at, values: f'<row r="{at}">' + "".join(_cell(f"{_letters(i)}{at}", v, shared) for i, v in enumerate(values)) + "</row>"
            part.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{head(1, ["A title"])}{head(header_row, names)}'.encode())
            for at, values in enumerate(rows, header_row + 1):
                part.write(head(at, values).encode())
            part.write(b"</sheetData></worksheet>")
        book.writestr("xl/sharedStrings.xml", xml("sst", "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared), MAIN))
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(("Notes", sheet), 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-1]}"><sheets>{sheets}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", xml("Relationships", "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)), PACKAGE))


def land_workbooks(df: DataFrame, by: str, folder: str, sheet: str, header_row: int, names: Sequence[str]) -> DataFrame:
    """One workbook for each value of `by`, each written by one task; the other columns get the names. Lazy."""
    ship(df.sparkSession)
    df = df.toDF(*[by if c == by else f"c{i}" for i, c in enumerate(df.columns)])
    columns = [c for c in df.columns if c != by]

    def write(batches):
        import pandas as pd

        def files():
            """(value, rows) of each workbook; a workbook is read to its end before the next."""
            stream = ((key, row) for batch in batches for key, row in zip(batch[by], batch[columns].itertuples(index=False, name=None)))
            first = next(stream, None)
            while first is not None:
                key, after = first[0], []

                def rows(start=first):
                    yield start[1]
                    for k, row in stream:
                        if k != key:
                            after.append((k, row))
                            return
                        yield row

                yield key, rows()
                first = after[0] if after else None

        for key, rows in files():
            path = f"{folder}/{key}.xlsx"
            with published(path) as out:
                workbook(out, sheet, header_row, names, rows)
            yield pd.DataFrame({"path": [path]})

    return df.repartition(by).sortWithinPartitions(F.col(by)).mapInPandas(write, "path string")
