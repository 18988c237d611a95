"""Workbooks, gridded cubes and rasters: files made by hand, and round trips."""

import datetime as dt
import math
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

from veldt.plans.landed import land_workbooks
from veldt.sources import geotiff, netcdf, tables, xlsx

MAIN, LINK, PACKAGE = xlsx.MAIN[1:-1], xlsx.LINK[1:-1], xlsx.PACKAGE[1:-1]
SHEET = f"""<?xml version="1.0"?><worksheet xmlns="{MAIN}"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="inlineStr"><is><t> Estimate </t></is></c><c r="C3" t="s"><v>1</v></c><c r="AA3" t="str"><v>Far</v></c></row>
<row r="4"><c r="A4"><v>101011001</v></c><c r="B4"><v>1.5E3</v></c><c r="C4" t="b"><v>1</v></c><c r="AA4" t="s"><v>2</v></c></row>
<row r="5"><c r="A5" t="e"><v>#N/A</v></c></row>
<row><c t="s"><v>2</v></c><c t="inlineStr"><is><r><t>a </t></r><r><t>&amp; b</t></r></is></c><c/></row>
<row r="9"><c r="B9" t="s"><v>3</v></c></row>
</sheetData></worksheet>"""
STRINGS = f'<sst xmlns="{MAIN}"><si><t>Title</t></si><si><t>Code</t></si><si><r><t>Gre</t></r><r><t>at Ö</t></r><rPh><t>no</t></rPh></si><si><t>..</t></si></sst>'


def book(path, absolute=False):
    target = "/xl/worksheets/data.xml" if absolute else "worksheets/data.xml"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name="Notes" r:id="a"/><sheet name="Table 1" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="b" Target="{target}"/><Relationship Id="a" Target="worksheets/notes.xml"/></Relationships>')
        z.writestr("xl/worksheets/notes.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/data.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", STRINGS)


def test_sheet_of_two_workbooks(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    book(tmp_path / "b.xlsx", absolute=True)
    (tmp_path / ".hidden.xlsx").write_bytes(b"no workbook")
    df = xlsx.sheet(spark, str(tmp_path), "Table 1", 3)
    assert df.columns == ["Code", " Estimate ", "Code.1", "Far"]
    rows = [("101011001", "1.5E3", "TRUE", "Great Ö"), ("Great Ö", "a & b", None, None), (None, "..", None, None)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows * 2, key=str)
    typed = tables.census(df, {"Code": "region_code", "Estimate": "estimate"}, ["estimate"])
    assert sorted((r["region_code"] or "", r["estimate"] or 0.0) for r in typed.collect()) == sorted([("101011001", 1500.0), ("Great Ö", 0.0), ("", 0.0)] * 2)
    assert xlsx.sheet(spark, str(tmp_path / "a.xlsx")).columns == ["7"]


def test_sheets_that_are_not_there(spark, tmp_path):
    book(tmp_path / "a.xlsx")
    for sheet, row in (("Table 2", 1), ("Table 1", 2), ("Table 1", 99)):
        with pytest.raises(Exception, match="sheet|row"):
            xlsx.sheet(spark, str(tmp_path / "a.xlsx"), sheet, row).count()
    with pytest.raises(Exception, match="absent"):
        xlsx.sheet(spark, str(tmp_path / "absent.xlsx")).count()


def test_long_sheet_round_trip(spark, tmp_path):
    df = spark.range(10_000).select((F.col("id") % 3).alias("file"), F.col("id").cast("string").alias("a"), (F.col("id") / 4).alias("b"))
    assert land_workbooks(df, "file", str(tmp_path), "S", 5, ["a<b", "n"]).count() == 3
    got = xlsx.sheet(spark, str(tmp_path), "S", 5)
    assert got.rdd.getNumPartitions() == 3
    assert got.agg(F.countDistinct("`a<b`"), F.sum(F.col("n").cast("double"))).first()[:] == (10_000, sum(range(10_000)) / 4)


def by_hand(version=1, streaming=False, var="other"):
    """Two steps of shorts with scale and a fill value beside a second record variable; latitudes run south."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, v: name(k) + struct.pack(">II", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    off = ">I" if version == 1 else ">Q"
    dims = struct.pack(">II", 10, 3) + name("time") + struct.pack(">I", 0) + name("lat") + struct.pack(">I", 3) + name("lon") + struct.pack(">I", 1)
    short = name("_FillValue") + struct.pack(">IIhh", 3, 1, -9, 0) + name("scale_factor") + struct.pack(">IId", 6, 1, 0.5) + name("add_offset") + struct.pack(">IIf", 5, 1, 10.0)

    def head(begins):
        specs = [("lat", [1], b"\0" * 8, 5, 12), ("lon", [2], b"\0" * 8, 5, 4), ("time", [0], struct.pack(">II", 12, 1) + text("units", "hours since 1995-12-31 00:00"), 4, 4), (var, [0, 1, 2], struct.pack(">II", 12, 3) + short, 3, 8)]
        out = b"CDF" + bytes([version]) + struct.pack(">I", 0xFFFFFFFF if streaming else 2) + dims + struct.pack(">II", 12, 1) + text("title", "t") + struct.pack(">II", 11, 4)
        for (n, own, held, kind, size), b in zip(specs, begins):
            out += name(n) + struct.pack(f">I{len(own)}I", len(own), *own) + held + struct.pack(">II", kind, size) + struct.pack(off, b)
        return out

    start = len(head([0] * 4))
    records = b"".join(struct.pack(">i3hxx", hours, *values) for hours, values in ((0, (1, -9, 3)), (30, (4, 5, -9))))
    return head([start, start + 12, start + 16, start + 20]) + struct.pack(">3ff", -10.0, -10.5, -11.0, 150.0) + records


@pytest.mark.parametrize("version,streaming,var", [(1, False, "rain"), (2, True, "rain"), (1, False, "other")])
def test_cube_by_hand(spark, tmp_path, version, streaming, var):
    """Also where the number of records isn't stored, and where the name's variable is missing: the first one is taken."""
    (tmp_path / "1996.rain.nc").write_bytes(by_hand(version, streaming, var))
    got = netcdf.cube(spark, str(tmp_path), records=1).orderBy("date", "lat").collect()
    day = [dt.date(1995, 12, 31), dt.date(1996, 1, 1)]
    assert [(r["variable"], r["year"], r["date"], r["lat"], r["lon"], r["value"]) for r in got] == [("rain", 1996, day[i], lat, 150.0, v) for i, row in enumerate(([11.5, None, 10.5], [None, 12.5, 12.0])) for lat, v in zip((-11.0, -10.5, -10.0), row)]
    assert netcdf.cube(spark, str(tmp_path), missing="drop").count() == 4


def test_cube_round_trip_and_pruning(spark, tmp_path):
    days = spark.range(800).select(F.date_add(F.lit("1995-06-01").cast("date"), F.col("id").cast("int")).alias("date"), F.explode(F.array(*map(F.lit, (-30.05, -30.0, -10.0)))).alias("lat"), "id")
    cells = days.select(F.explode(F.array(F.lit("rain"), F.lit("pan"))).alias("variable"), "date", "lat", F.explode(F.array(F.lit(140.0), F.lit(120.5))).alias("lon"), F.when(F.col("id") % 7 > 0, F.col("id") / 3 + F.col("lat")).alias("value"))
    cells = cells.unionByName(cells.filter("value is null").limit(3)).unionByName(spark.createDataFrame([(None, dt.date(1995, 1, 1), 1.0, 1.0, 1.0), ("rain", None, 1.0, 1.0, 1.0)], "variable string, date date, lat double, lon double, value double"))
    written = {r["path"].split("/")[-1]: r["records"] for r in netcdf.write_cube(cells, str(tmp_path)).collect()}
    assert written == {f"{y}.{v}.nc": n for v in ("rain", "pan") for y, n in ((1995, 214), (1996, 366), (1997, 220))}
    key = ["variable", "date", "lat", "lon"]
    want = cells.filter("variable is not null and date is not null").distinct()
    got = netcdf.cube(spark, str(tmp_path)).select(*want.columns)
    assert got.count() == want.count() == got.select(*key).distinct().count()
    assert got.exceptAll(want).count() == 0
    one = netcdf.cube(spark, str(tmp_path)).filter("variable = 'rain' AND year IN (1996)")
    assert one.rdd.getNumPartitions() == math.ceil(366 / 64) and one.count() == 366 * 6
    reader = netcdf.NetcdfReader(str(tmp_path), 1000, "null")
    rest = list(reader.pushFilters([EqualTo(("variable",), "pan"), GreaterThan(("year",), 1995), In(("year",), (1995, 1997)), IsNotNull(("year",))]))
    assert rest == [IsNotNull(("year",))] and [(p.variable, p.year, p.n) for p in reader.partitions()] == [("pan", 1997, 220)]
    assert netcdf.cube_year(spark, str(tmp_path), "pan", 1996, "drop").count() == want.filter("variable = 'pan' and year(date) = 1996 and value is not null").count()
    with pytest.raises(FileNotFoundError):
        netcdf.cube_year(spark, str(tmp_path), "pan", 2000)
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if "part-" in f]


def test_cube_rows_are_reduced_before_files(spark, tmp_path):
    """A thousand rows of each cell and date leave one, NaN counts as missing."""
    rows = spark.range(6000).select(F.lit("rain").alias("variable"), F.date_add(F.lit("1996-12-31").cast("date"), (F.col("id") % 2).cast("int")).alias("date"), (F.col("id") % 3).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.when(F.col("id") % 6 < 5, F.when(F.col("id") % 12 > 6, F.lit(float("nan"))).otherwise(F.col("id").cast("double"))).alias("value"))
    files = netcdf.write_cube(rows, str(tmp_path))
    assert spark.read.parquet(*files.inputFiles()).count() == 6
    assert sorted(r["records"] for r in files.collect()) == [1, 1]
    got = {(r["date"].year, r["lat"]): r["value"] for r in netcdf.cube(spark, str(tmp_path)).collect()}
    want = {(1996 + i % 2, float(i % 3)): None if i == 5 else max(n for n in range(i, 6000, 6) if n % 12 <= 6) for i in range(6)}
    assert got == want


def test_empty_cube(spark, tmp_path):
    none = spark.createDataFrame([], "variable string, date date, lat double, lon double, value double")
    assert netcdf.write_cube(none, str(tmp_path)).count() == 0
    assert netcdf.cube(spark, str(tmp_path)).count() == 0


def tiff(order, big, tags, body):
    """A file of one directory behind its body, which begins at byte 16."""
    codes = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    extra, entries = b"", []
    at = 16 + len(body)
    for tag, code, held in tags:
        raw = held if code == "s" else struct.pack(f"{order}{len(held)}{code}", *held)
        if len(raw) > (8 if big else 4):
            raw, extra = struct.pack(f"{order}{'Q' if big else 'I'}", at + len(extra)), extra + raw
        entries.append(struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, codes[code], len(held)) + raw.ljust(8 if big else 4, b"\0"))
    place = at + len(extra)
    mark = {"<": b"II", ">": b"MM"}[order]
    head = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, place) if big else struct.pack(f"{order}HI", 42, place)).ljust(14, b"\0")
    return head + body + extra + struct.pack(f"{order}{'Q' if big else 'H'}", len(entries)) + b"".join(entries) + b"\0" * 8


@pytest.mark.parametrize("order,big,predictor", [("<", False, 1), (">", True, 2)])
def test_strips_by_hand(spark, tmp_path, order, big, predictor):
    """Two bands of shorts in strips of two rows, one of them raw or differenced; nodata and either byte order."""
    image = np.array([[[1, 9], [2, 8], [-1, 7]], [[4, 6], [5, 5], [6, 4]], [[7, 3], [-1, 2], [9, 1]]])
    coded = image.copy()
    if predictor == 2:
        coded[:, 1:] = image[:, 1:] - image[:, :-1]
    strips = [zlib.compress(s.astype(f"{order}i2").tobytes()) for s in (coded[:2], coded[2:])]
    at = [16, 16 + len(strips[0])]
    tags = [(256, "I", (3,)), (257, "I", (3,)), (258, "H", (16, 16)), (259, "H", (8,)), (273, "Q" if big else "I", at), (277, "H", (2,)), (278, "I", (2,)), (279, "I", [len(s) for s in strips]), (317, "H", (predictor,)), (339, "H", (2, 2)), (33550, "d", (50.0, 25.0, 0.0)), (33922, "d", (1.0, 0.0, 0.0, 1000.0, 2000.0, 0.0)), (34735, "H", (1, 1, 0, 1, 3072, 0, 1, 3577)), (42113, "s", b"-1\0")]
    (tmp_path / "x.tif").write_bytes(tiff(order, big, tags, b"".join(strips)))
    got = {(r["row"], r["col"]): (r["value"], r["x"], r["y"], r["block"]) for r in geotiff.raster_pixels(spark, str(tmp_path / "x.tif"), blocks=1).collect()}
    assert got == {(i, j): (None if image[i, j, 0] == -1 else float(image[i, j, 0]), 950 + 50 * (j + 0.5), 2000 - 25 * (i + 0.5), i // 2) for i in range(3) for j in range(3)}
    assert {(r["row"], r["col"], r["value"]) for r in geotiff.raster_pixels(spark, str(tmp_path), band=2).collect()} == {(i, j, float(image[i, j, 1])) for i in range(3) for j in range(3)}
    (m,) = geotiff.raster_metadata(spark, str(tmp_path)).collect()
    assert (m["crs"], m["width"], m["height"], m["count"], m["dtype"], m["nodata"], m["west"], m["south"], m["east"], m["north"], m["res_x"], m["res_y"], m["blocks"]) == ("EPSG:3577", 3, 3, 2, "int16", -1.0, 950.0, 1925.0, 1100.0, 2000.0, 50.0, 25.0, 2)
    with pytest.raises(Exception, match="band"):
        geotiff.raster_pixels(spark, str(tmp_path), band=3).count()


def test_raster_round_trip_and_code_histogram(spark, tmp_path):
    """What stands in the files is the pixel table; code counts over blocks equal those of the table."""
    pixels = spark.range(40_000).select((F.col("id") / 250).cast("int").alias("row"), (F.col("id") % 250).cast("int").alias("col"), F.when(F.col("id") % 11 > 0, F.col("id") % 17 + 300).alias("value")).filter("row not between 64 and 100")
    grid = geotiff.Grid(110.0, -10.0, 0.25, 0.5, nodata=-9999.0, dtype="int32", tile=32, tile_rows=2, epsg=3577)
    files = geotiff.write_raster(pixels, str(tmp_path), grid).collect()
    assert sorted((os.path.basename(r["path"]), r["tiles"]) for r in files) == [("band-000000.tif", 16), ("band-000001.tif", 8), ("band-000002.tif", 8)]
    read = geotiff.raster_pixels(spark, str(tmp_path), blocks=3)
    top = read.groupBy("path").agg(F.max("y").alias("top"))
    placed = read.select(F.round((-10.0 - F.col("y")) / 0.5 - 0.5).cast("int").alias("row"), F.round((F.col("x") - 110.0) / 0.25 - 0.5).cast("int").alias("col"), F.col("value").cast("long").alias("value")).dropna(subset=["value"])
    assert top.count() == 3 and sorted(map(tuple, placed.collect())) == sorted(map(tuple, pixels.dropna(subset=["value"]).collect()))
    count = lambda df: {r["value"]: r["n"] for r in df.dropna(subset=["value"]).groupBy("value").agg(F.count("*").alias("n")).collect()}
    assert count(read) == count(pixels)
    assert [r["crs"] for r in geotiff.raster_metadata(spark, str(tmp_path)).collect()] == ["EPSG:3577"] * 3
    assert geotiff.write_raster(pixels.limit(0), str(tmp_path / "none"), grid).count() == 0


def test_files_of_other_kinds_are_refused(spark, tmp_path):
    (tmp_path / "1999.x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="NetCDF"):
        netcdf.cube(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="TIFF"):
        geotiff.raster_pixels(spark, str(tmp_path)).count()
