"""Gridded cubes: variables over time, latitude and longitude in classic NetCDF files.

The classic layouts (CDF-1, CDF-2 and CDF-5) store a record for each time
step, one behind the other, so a partition is a range of records of one file
and reads no other bytes. Files are named <year>.<variable>.nc; a filter on
variable or year leaves files unopened.
"""

from __future__ import annotations

import datetime as dt
import math
import posixpath
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .scratch import written
from .stores import files, opened, published, ship

#: Type codes of the format: numpy kinds, big-endian. Fixed values.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
STREAMING = 0xFFFFFFFF
#: Names of the axes, by the order of a variable's dimensions.
TIME, LATITUDE, LONGITUDE = ("time",), ("lat", "latitude", "y"), ("lon", "longitude", "x")
SCHEMA = "variable string, year int, date date, lat double, lon double, value double"
NAMED = re.compile(r"(\d{4})\.(\w+)\.nc$")


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    kind: int
    begin: int
    size: int = 0


@dataclass
class Header:
    """What stands before the data."""

    n_records: int = 0
    dims: list[tuple[str, int]] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> list[int]:
        """Lengths of the dimensions, without that of records."""
        return [self.dims[d][1] for d in v.dims if self.dims[d][1]]


def read_header(stream, file_size: int) -> Header:
    import numpy as np

    magic = stream.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    wide, offset = magic[3] == 5, ">I" if magic[3] == 1 else ">Q"

    def number(code: str) -> int:
        return struct.unpack(code, stream.read(struct.calcsize(code)))[0]

    count = lambda: number(">Q" if wide else ">I")

    def padded(n: int) -> bytes:
        return stream.read(n + -n % 4)[:n]

    def listed(tag: int) -> int:
        found, n = number(">I"), count()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError("a list of the header is broken")
        return n

    def name() -> str:
        return padded(count()).decode()

    def attributes() -> dict:
        found = {}
        for _ in range(listed(ATTRIBUTES)):
            key, kind, n = name(), number(">I"), count()
            raw = padded(n * np.dtype(TYPES[kind]).itemsize)
            values = raw.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
            found[key] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return found

    h = Header(count())
    streaming = h.n_records == (0xFFFFFFFFFFFFFFFF if wide else STREAMING)
    h.dims = [(name(), count()) for _ in range(listed(DIMENSIONS))]
    h.attributes = attributes()
    for _ in range(listed(VARIABLES)):
        own, dims = name(), [count() for _ in range(count())]
        held, kind = attributes(), number(">I")
        count()  # the size as stored, which large variables overflow
        h.variables[own] = Variable(own, dims, held, kind, number(offset))
    for v in h.variables.values():
        v.size = math.prod(h.shape(v)) * np.dtype(TYPES[v.kind]).itemsize
    records = [v for v in h.variables.values() if h.is_record(v)]
    # a lone record variable is not padded
    h.record_size = records[0].size if len(records) == 1 else sum(v.size + -v.size % 4 for v in records)
    if streaming:
        h.n_records = (file_size - min(v.begin for v in records)) // h.record_size if records else 0
    return h


def values(stream, h: Header, v: Variable, first: int = 0, n: int = 1):
    """The values of records first to first + n, or of a variable without records, as stored."""
    import numpy as np

    if not h.is_record(v):
        stream.seek(v.begin)
        return np.frombuffer(stream.read(v.size), TYPES[v.kind]).reshape(h.shape(v))
    out = np.empty((n, *h.shape(v)), TYPES[v.kind])
    for i in range(n):
        stream.seek(v.begin + (first + i) * h.record_size)
        out[i] = np.frombuffer(stream.read(v.size), TYPES[v.kind]).reshape(h.shape(v))
    return out


def decoded(raw, v: Variable):
    """Doubles, missing values as NaN, scale and offset applied."""
    import numpy as np

    out = raw.astype("float64")
    for mark in ("_FillValue", "missing_value"):
        if mark in v.attributes:
            out[raw == np.array(v.attributes[mark]).astype(raw.dtype)] = np.nan
    return out * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)


def data_variable(h: Header, wanted: str) -> Variable:
    """The variable of that name; else the first that is no axis."""
    if wanted in h.variables:
        return h.variables[wanted]
    axes = {name for name, _ in h.dims}
    found = [v for v in h.variables.values() if v.name not in axes and len(v.dims) == 3]
    if not found:
        raise ValueError(f"no variable {wanted!r} over time, latitude and longitude")
    return found[0]


def axis(stream, h: Header, v: Variable, place: int, names: tuple[str, ...]):
    dim = h.dims[v.dims[place]][0]
    if dim.lower() not in names or dim not in h.variables:
        raise ValueError(f"{v.name} lies over {dim!r} where one of {names} is due")
    return dim, h.variables[dim]


#: Units of time axes, in days. Fixed values.
UNITS = {"days": 1.0, "hours": 1 / 24, "minutes": 1 / 1440, "seconds": 1 / 86400}


def dates(offsets, units: str) -> list[dt.date]:
    """Dates of a time axis such as "days since 1970-01-01"."""
    unit, _, origin = units.partition(" since ")
    if unit.strip().lower() not in UNITS:
        raise ValueError(f"unknown unit of time {units!r}")
    day = dt.date.fromisoformat(origin.strip()[:10])
    return [day + dt.timedelta(days=math.floor(o * UNITS[unit.strip().lower()] + 1e-9)) for o in offsets]


@dataclass
class Records(InputPartition):
    uri: str
    size: int
    variable: str
    year: int
    first: int
    n: int


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, records: int, missing: str):
        self.path, self.records, self.missing = path, records, missing
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on variable and year decide by a file's name; Spark keeps all the others."""
        compare = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in compare and f.attribute in (("variable",), ("year",)):
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for uri, size in files(self.path, (".nc",)):
            named = NAMED.search(posixpath.basename(uri))
            if named is None:
                continue
            of = {"year": int(named[1]), "variable": named[2]}
            if all(test(of[key], value) for key, test, value in self.tests):
                with opened(uri) as stream:
                    n = read_header(stream, size).n_records
                found += [Records(uri, size, of["variable"], of["year"], at, min(self.records, n - at)) for at in range(0, n, self.records)]
        return found or [Records("", 0, "", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not partition.n:
            return
        with opened(partition.uri) as stream:
            h = read_header(stream, partition.size)
            v = data_variable(h, partition.variable)
            (_, time), (_, lat), (_, lon) = (axis(stream, h, v, i, names) for i, names in enumerate((TIME, LATITUDE, LONGITUDE)))
            lats, lons = (values(stream, h, a).astype("float64") for a in (lat, lon))
            offsets = values(stream, h, time, partition.first, partition.n) if h.is_record(time) else values(stream, h, time)[partition.first : partition.first + partition.n]
            grid_lat, grid_lon = (x.ravel() for x in np.meshgrid(lats, lons, indexing="ij"))
            for i, day in enumerate(dates(offsets.astype("float64").tolist(), time.attributes["units"])):
                raw = values(stream, h, v, partition.first + i)[0] if h.is_record(v) else values(stream, h, v)[partition.first + i]
                own = decoded(raw, v).ravel()
                there = ~np.isnan(own)
                keep = there if self.missing == "drop" else np.ones(len(own), bool)
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, "int32")), pa.array([partition.variable])).cast(pa.string()),
                        pa.array(np.full(n, partition.year, "int32")),
                        pa.array(np.full(n, (day - dt.date(1970, 1, 1)).days, "int32")).cast(pa.date32()),
                        pa.array(grid_lat[keep]),
                        pa.array(grid_lon[keep]),
                        pa.array(own[keep], mask=~there[keep]),
                    ],
                    names=["variable", "year", "date", "lat", "lon", "value"],
                )


class NetcdfSource(DataSource):
    """Options: path (a file or a folder), records (of a partition; else 64), missing (`null` or `drop`; else `null`)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetcdfReader:
        missing = self.options.get("missing", "null")
        if missing not in ("null", "drop"):
            raise ValueError("missing is null or drop")
        return NetcdfReader(self.options["path"], int(self.options.get("records", 64)), missing)


def cube(spark: SparkSession, path: str, missing: str = "null", records: int = 64) -> DataFrame:
    """variable, year, date, lat, lon, value of the grids below path.

    A file without the variable that its name says gives its first one.
    Cells without a value are NULL, or left out with missing="drop". Filters
    on variable and year keep other files closed.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf").option("missing", missing).option("records", records).load(path)


def cube_year(spark: SparkSession, path: str, variable: str, year: int, missing: str = "null") -> DataFrame:
    """date, lat, lon, value of one variable's year; fails if its file isn't there."""
    own = f"{path.rstrip('/')}/{variable}/{year}.{variable}.nc"
    files(own, (".nc",))
    return cube(spark, own, missing).select("date", "lat", "lon", "value")


def _string(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def header_bytes(variable: str, n_records: int, lats, lons, units: str, fill: float) -> bytes:
    """The header and axes of a CDF-2 file of one variable over (time, lat, lon) in doubles."""
    import numpy as np

    attribute = lambda name, kind, n, raw: _string(name) + struct.pack(">II", kind, n) + raw + b"\0" * (-len(raw) % 4)
    text = lambda name, value: attribute(name, 2, len(value.encode()), value.encode())
    double, grid = 6, len(lats) * len(lons) * 8
    specs = [("lat", [1], [text("units", "degrees_north")], len(lats) * 8), ("lon", [2], [text("units", "degrees_east")], len(lons) * 8), ("time", [0], [text("units", units)], 8), (variable, [0, 1, 2], [attribute("_FillValue", double, 1, struct.pack(">d", fill))], grid)]

    def build(begins: list[int]) -> bytes:
        dims = struct.pack(">II", DIMENSIONS, 3) + b"".join(_string(n) + struct.pack(">I", size) for n, size in (("time", 0), ("lat", len(lats)), ("lon", len(lons))))
        out = b"CDF\x02" + struct.pack(">I", n_records) + dims + struct.pack(">II", 0, 0) + struct.pack(">II", VARIABLES, len(specs))
        for (name, own, held, size), begin in zip(specs, begins):
            out += _string(name) + struct.pack(f">I{len(own)}I", len(own), *own) + struct.pack(">II", ATTRIBUTES, len(held)) + b"".join(held) + struct.pack(">IIQ", double, min(size, STREAMING), begin)
        return out

    start = len(build([0] * 4))
    lon_at = start + len(lats) * 8
    time_at = lon_at + len(lons) * 8
    return build([start, lon_at, time_at, time_at + 8]) + np.asarray(lats, ">f8").tobytes() + np.asarray(lons, ">f8").tobytes()


def write_cube(cells: DataFrame, folder: str) -> DataFrame:
    """Writes variable, date, lat, lon, value as <folder>/<variable>/<year>.<variable>.nc; path and records of each file.

    Files are written when the result is read. Of rows of one cell and date
    the largest value stays: that reduction runs first, in all tasks, and is
    kept as a table below the scratch folder, so what is sent to the files is
    bounded by grid and dates. A file's axes are the latitudes and longitudes
    that its rows hold, its records their dates; cells without a row or a
    value are missing; rows with a NULL key are left out. A file is written
    by one task, record by record in the order of dates, so a task holds one
    record's grid and not the file; it gets its name when it is whole.
    """
    ship(cells.sparkSession)
    folder = folder.rstrip("/")
    of, value = ["variable", "year"], F.col("value").cast("double")
    keyed = cells.select("variable", F.year("date").alias("year"), F.unix_date("date").alias("day"), "lat", "lon", F.when(~F.isnan(value), value).alias("value")).dropna(subset=["variable", "day", "lat", "lon"])
    reduced = written(keyed.groupBy(*of, "day", "lat", "lon").agg(F.max("value").alias("value")), "cube-rows")
    # a file's shape comes as the first of its rows
    shape = reduced.groupBy(*of).agg(F.countDistinct("day").cast("int").alias("n"), F.array_sort(F.collect_set("lat")).alias("lats"), F.array_sort(F.collect_set("lon")).alias("lons"))
    rows = shape.unionByName(reduced, allowMissingColumns=True).repartition(*of).sortWithinPartitions(*of, F.asc_nulls_first("day"))
    return rows.select(*of, "day", "lat", "lon", "value", "n", "lats", "lons").mapInPandas(lambda batches: _written(batches, folder), "path string, records int")


class _File:
    """One file being written."""

    def __init__(self, path: str, variable: str, n: int, lats, lons):
        self.path, self.lats, self.lons = path, lats, lons
        self.day, self.record, self.records = None, None, 0
        self.context = published(path)
        self.out = self.context.__enter__()
        self.out.write(header_bytes(variable, n, lats, lons, "days since 1970-01-01", math.nan))

    def put(self, day: int, rows) -> None:
        import numpy as np

        if day != self.day:
            self.flush()
            self.day, self.record = day, np.full((len(self.lats), len(self.lons)), np.nan)
        places = np.searchsorted(self.lats, rows["lat"]), np.searchsorted(self.lons, rows["lon"])
        np.fmax.at(self.record, places, rows["value"].to_numpy("float64", na_value=np.nan))

    def flush(self) -> None:
        if self.record is not None:
            self.out.write(struct.pack(">d", float(self.day)) + self.record.astype(">f8").tobytes())
            self.records += 1

    def close(self):
        import pandas as pd

        self.flush()
        self.context.__exit__(None, None, None)
        return pd.DataFrame({"path": [self.path], "records": [self.records]})


def _written(batches, folder: str) -> Iterator:
    """Sorted rows to files; a row for each file."""
    now, file = None, None
    try:
        for batch in batches:
            batch["day"] = batch["day"].astype("Int64").fillna(-(1 << 40))
            for (variable, year, day), rows in batch.groupby(["variable", "year", "day"], sort=False):
                if (variable, year) != now:
                    if file is not None:
                        yield file.close()
                    now, own = (variable, year), rows.iloc[0]
                    file = _File(f"{folder}/{variable}/{year}.{variable}.nc", variable, int(own["n"]), own["lats"], own["lons"])
                else:
                    file.put(int(day), rows)
        if file is not None:
            done, file = file, None
            yield done.close()
    except BaseException as e:
        if file is not None:
            file.context.__exit__(type(e), e, e.__traceback__)
        raise
