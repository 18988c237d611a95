"""Rasters: tiled or striped TIFF files as rows of pixels, and their metadata.

A file is a header, a directory of tags and blocks (tiles or strips) that are
compressed apart. A partition is a run of blocks of one file and reads no
others.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import files, opened, published, ship

#: Tags, field types and compressions of the format. Fixed values.
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
RAW, DEFLATE = (1,), (8, 32946)
GEOGRAPHIC, PROJECTED = 2048, 3072
KINDS = {1: "u", 2: "i", 3: "f"}

SCHEMA = "path string, block int, row int, col int, x double, y double, value double"
METADATA = "path string, crs string, width int, height int, count int, dtype string, nodata double, west double, south double, east double, north double, res_x double, res_y double, blocks int"


@dataclass
class Raster:
    """The layout of one file."""

    width: int
    height: int
    count: int
    dtype: str
    block: tuple[int, int]  # rows and columns
    offsets: list[int]
    sizes: list[int]
    compression: int
    predictor: int
    nodata: float | None
    scale: tuple[float, float]
    corner: tuple[float, float]
    crs: str | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])


def read_directory(stream) -> Raster:
    head = stream.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    counter, place, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    stream.seek(at)
    n = struct.unpack(f"{order}{counter}", stream.read(struct.calcsize(f"={counter}")))[0]
    entries = stream.read(n * entry)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", entries, i * entry)
        count = struct.unpack_from(f"{order}{place}", entries, i * entry + 4)[0]
        if kind not in FIELDS:
            continue
        size, inline = struct.calcsize(f"={FIELDS[kind]}") * count, struct.calcsize(f"={place}")
        if size <= inline:
            raw = entries[i * entry + 4 + inline :][:size]
        else:
            stream.seek(struct.unpack_from(f"{order}{place}", entries, i * entry + 4 + inline)[0])
            raw = stream.read(size)
        tags[tag] = (raw,) if FIELDS[kind] == "s" else struct.unpack(f"{order}{count}{FIELDS[kind]}", raw)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    if one(PLANAR, 1) != 1 and one(SAMPLES, 1) > 1:
        raise ValueError("bands in planes of their own are not supported")
    width, height = one(WIDTH), one(LENGTH)
    tiled = TILE_OFFSETS in tags
    block = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    bits, kind = one(BITS, 1), KINDS.get(one(SAMPLE_FORMAT, 1))
    if bits not in (8, 16, 32, 64) or kind is None:
        raise ValueError("samples of this kind are not supported")
    dtype = f"{order}{kind}{bits // 8}"
    nodata = tags[NODATA][0].rstrip(b"\0 ").decode() if NODATA in tags else ""
    scale, tie = tags.get(PIXEL_SCALE, (1.0, 1.0)), tags.get(TIE_POINT, (0.0,) * 6)
    corner = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1])
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED, codes.get(GEOGRAPHIC))
    offsets, sizes = (TILE_OFFSETS, TILE_SIZES) if tiled else (STRIP_OFFSETS, STRIP_SIZES)
    return Raster(width, height, one(SAMPLES, 1), dtype, block, list(tags[offsets]), list(tags[sizes]), one(COMPRESSION, 1), one(PREDICTOR, 1), float(nodata) if nodata else None, (scale[0], scale[1]), corner, None if code is None else f"EPSG:{code}")


def read_block(stream, raster: Raster, number: int, band: int):
    """Row and column of the first pixel and the samples of a block, cut at the edges; None where a block is not stored."""
    import numpy as np

    row, col = number // raster.across * raster.block[0], number % raster.across * raster.block[1]
    if raster.sizes[number] == 0:
        return row, col, None
    stream.seek(raster.offsets[number])
    raw = stream.read(raster.sizes[number])
    if raster.compression in DEFLATE:
        raw = zlib.decompress(raw)
    elif raster.compression not in RAW:
        raise ValueError(f"compression {raster.compression} is not supported")
    samples = np.frombuffer(raw, raster.dtype)
    samples = samples[: len(samples) // (raster.block[1] * raster.count) * raster.block[1] * raster.count].reshape(-1, raster.block[1], raster.count)
    if raster.predictor == 2:
        samples = np.cumsum(samples, axis=1, dtype=raster.dtype)
    elif raster.predictor != 1:
        raise ValueError(f"predictor {raster.predictor} is not supported")
    return row, col, samples[: raster.height - row, : raster.width - col, band - 1]


@dataclass
class Blocks(InputPartition):
    uri: str
    first: int
    n: int


class GeotiffReader(DataSourceReader):
    def __init__(self, path: str, band: int, blocks: int, metadata: bool):
        self.path, self.band, self.blocks, self.metadata = path, band, blocks, metadata

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for uri, _ in files(self.path, (".tif", ".tiff")):
            if self.metadata:
                found.append(Blocks(uri, 0, 1))
                continue
            with opened(uri) as stream:
                n = len(read_directory(stream).offsets)
            found += [Blocks(uri, at, min(self.blocks, n - at)) for at in range(0, n, self.blocks)]
        return found or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not partition.n:
            return
        with opened(partition.uri) as stream:
            r = read_directory(stream)
            if self.metadata:
                left, top = r.corner
                yield (partition.uri, r.crs, r.width, r.height, r.count, np.dtype(r.dtype).name, r.nodata, left, top - r.height * r.scale[1], left + r.width * r.scale[0], top, r.scale[0], r.scale[1], len(r.offsets))
                return
            if not 1 <= self.band <= r.count:
                raise ValueError(f"{partition.uri} has no band {self.band}")
            for number in range(partition.first, partition.first + partition.n):
                row, col, samples = read_block(stream, r, number, self.band)
                if samples is None:
                    continue
                rows, cols = (x.ravel().astype("int32") for x in np.indices(samples.shape))
                rows, cols, own = rows + np.int32(row), cols + np.int32(col), samples.ravel().astype("float64")
                empty = np.isnan(own) if r.nodata is None else np.isnan(own) | (own == r.nodata)
                same = pa.array(np.zeros(len(own), "int32"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.DictionaryArray.from_arrays(same, pa.array([partition.uri])).cast(pa.string()),
                        pa.array(np.full(len(own), number, "int32")),
                        pa.array(rows),
                        pa.array(cols),
                        pa.array(r.corner[0] + (cols + 0.5) * r.scale[0]),
                        pa.array(r.corner[1] - (rows + 0.5) * r.scale[1]),
                        pa.array(own, mask=empty),
                    ],
                    names=["path", "block", "row", "col", "x", "y", "value"],
                )


class GeotiffSource(DataSource):
    """Options: path (a file or a folder), band (from 1; else 1), blocks (of a partition; else 64), metadata (one row a file in place of pixels)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _metadata(self) -> bool:
        return self.options.get("metadata", "false").lower() == "true"

    def schema(self) -> str:
        return METADATA if self._metadata() else SCHEMA

    def reader(self, schema) -> GeotiffReader:
        return GeotiffReader(self.options["path"], int(self.options.get("band", 1)), int(self.options.get("blocks", 64)), self._metadata())


def _source(spark: SparkSession):
    ship(spark)
    spark.dataSource.register(GeotiffSource)
    return spark.read.format("geotiff")


def raster_pixels(spark: SparkSession, path: str, band: int = 1, blocks: int = 64) -> DataFrame:
    """The pixels of the rasters at path: file, block, row and column, the centre's coordinates, and the value, NULL where it is nodata.

    Blocks that a file doesn't store have no rows.
    """
    return _source(spark).option("band", band).option("blocks", blocks).load(path)


def raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: reference system, size, kind of samples, nodata, bounds and resolution; no block is read."""
    return _source(spark).option("metadata", True).load(path)


@dataclass(frozen=True)
class Grid:
    """Where pixels lie: the upper left corner, the size of a pixel, and the code of the reference system."""

    left: float
    top: float
    step_x: float
    step_y: float
    epsg: int = 4326
    nodata: float = 0.0
    dtype: str = "uint8"
    tile: int = 256
    tile_rows: int = 4  # of one file


def write_raster(pixels: DataFrame, folder: str, grid: Grid) -> DataFrame:
    """Writes row, col, value as tiled, deflated TIFF files, one for each band of tile rows; path and tiles of each file.

    Lazy: files are written when the result is read. Files are as wide as the
    last column that the band holds. Pixels without a row or a value are
    nodata; of several values of a pixel the largest stays. A file's tiles
    are held, compressed, until it is whole; a band bounds their number.
    """
    ship(pixels.sparkSession)
    folder = folder.rstrip("/")
    place = lambda c: F.floor(F.col(c) / grid.tile).cast("int")
    keyed = pixels.select("row", "col", F.col("value").cast("double").alias("value")).dropna(subset=["row", "col"])
    keyed = keyed.withColumns({"tile_row": place("row"), "tile_col": place("col")}).withColumn("band", F.floor(F.col("tile_row") / grid.tile_rows).cast("int"))
    rows = keyed.repartition("band").sortWithinPartitions("band", "tile_row", "tile_col")
    return rows.mapInPandas(lambda batches: _written(batches, folder, grid), "path string, tiles int")


def _written(batches, folder: str, grid: Grid) -> Iterator:
    import numpy as np
    import pandas as pd

    band, tiles, place, tile, height, width = None, {}, None, None, 0, 0

    def flush() -> None:
        if place is not None:
            whole = np.where(np.isnan(tile), grid.nodata, tile).astype(grid.dtype)
            tiles[place] = zlib.compress(whole.tobytes(), 6)

    def close():
        path = f"{folder}/band-{band:06d}.tif"
        first = band * grid.tile_rows * grid.tile
        with published(path) as out:
            out.write(_file(tiles, height - first, width, band * grid.tile_rows, grid))
        return pd.DataFrame({"path": [path], "tiles": [len(tiles)]})

    for batch in batches:
        for (own_band, tile_row, tile_col), rows in batch.groupby(["band", "tile_row", "tile_col"], sort=False):
            if (own_band, tile_row, tile_col) != (band, *(place or (None, None))):
                flush()
                if own_band != band:
                    if band is not None:
                        yield close()
                    band, tiles, height, width = own_band, {}, 0, 0
                place, tile = (tile_row, tile_col), np.full((grid.tile, grid.tile), np.nan)
            height, width = max(height, int(rows["row"].max()) + 1), max(width, int(rows["col"].max()) + 1)
            np.fmax.at(tile, (rows["row"].to_numpy() % grid.tile, rows["col"].to_numpy() % grid.tile), rows["value"].to_numpy("float64", na_value=np.nan))
    if band is not None:
        flush()
        yield close()


def _file(tiles: dict[tuple[int, int], bytes], height: int, width: int, first_tile_row: int, grid: Grid) -> bytes:
    """A file of one directory: header, tiles, tag values, directory. Tiles without pixels are not stored."""
    import numpy as np

    across, down = -(-width // grid.tile), -(-height // grid.tile)
    body, offsets, sizes = bytearray(b"II*\0\0\0\0\0"), [0] * (across * down), [0] * (across * down)
    for (tile_row, tile_col), data in sorted(tiles.items()):
        at = (tile_row - first_tile_row) * across + tile_col
        offsets[at], sizes[at] = len(body), len(data)
        body += data
    kind = np.dtype(grid.dtype)
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    nodata = (repr(grid.nodata) if kind.kind == "f" else str(int(grid.nodata))).encode() + b"\0"
    top = grid.top - first_tile_row * grid.tile * grid.step_y
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if grid.epsg == 4326 else 1, GEOGRAPHIC if grid.epsg == 4326 else PROJECTED, 0, 1, grid.epsg)
    tags = [(WIDTH, "I", (width,)), (LENGTH, "I", (height,)), (BITS, "H", (kind.itemsize * 8,)), (COMPRESSION, "H", (8,)), (262, "H", (1,)), (SAMPLES, "H", (1,)), (TILE_WIDTH, "I", (grid.tile,)), (TILE_LENGTH, "I", (grid.tile,)), (TILE_OFFSETS, "I", offsets), (TILE_SIZES, "I", sizes), (SAMPLE_FORMAT, "H", (sample,)), (PIXEL_SCALE, "d", (grid.step_x, grid.step_y, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, grid.left, top, 0.0)), (GEO_KEYS, "H", keys), (NODATA, "s", nodata)]
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    entries = b""
    for tag, code, held in tags:
        raw = bytes(held) if code == "s" else struct.pack(f"<{len(held)}{code}", *held)
        if len(raw) <= 4:
            where = raw.ljust(4, b"\0")
        else:
            body += b"\0" * (len(body) % 2)
            where = struct.pack("<I", len(body))
            body += raw
        entries += struct.pack("<HHI", tag, codes[code], len(held)) + where
    body += b"\0" * (len(body) % 2)
    at = len(body)
    if at + len(entries) + 6 > math.pow(2, 32) - 1:
        raise ValueError("a file of more than 4 GB: take fewer tile_rows")
    body += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    body[4:8] = struct.pack("<I", at)
    return bytes(body)
