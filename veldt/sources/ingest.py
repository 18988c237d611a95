"""Ingest of gridded files with a status for each unit and a log of all runs.

A unit is a variable's year. Its landed file is masked and written where
readers look for it; what became of each unit is merged into the log. A unit
that failed is tried again by the next run, one that is done is not.
"""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .netcdf import LATITUDE, LONGITUDE, TIME, axis, data_variable, dates, decoded, header_bytes, read_header, values
from .scratch import written
from .stores import opened, published, ship, store
from .versions import VersionedTable

DONE, ALREADY, SKIPPED, FAILED = "done", "already", "skipped", "error"
STATUS = "variable string, year int, status string, records int, cells int, present long, message string"


@dataclass(frozen=True)
class Ingest:
    """landed and masked: folders of <variable>/<year>.<variable>.nc; log: a versioned table; first_years: of variables that begin late.

    within and degrees: how far the number of cells kept (a share) and their
    mean latitude may be from the mask's. places: decimals by which
    coordinates of files and mask agree.
    """

    landed: str
    masked: str
    log: str
    first_years: Mapping[str, int]
    within: float = 0.01
    degrees: float = 1.0
    places: int = 4


def _size(uri: str) -> int | None:
    from pyarrow import fs

    system, path = store(uri)
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def _kept(lats, lons, mask: set[tuple[float, float]], plan: Ingest):
    """The file's cells that the mask keeps; fails where the two grids don't agree."""
    import numpy as np

    keep = np.array([[(round(a, plan.places), round(o, plan.places)) in mask for o in lons] for a in lats], bool)
    n = int(keep.sum())
    if abs(n - len(mask)) > plan.within * len(mask):
        raise ValueError(f"the mask has {len(mask)} cells, of which the file holds {n}")
    middle, own = sum(a for a, _ in mask) / len(mask), float((np.asarray(lats)[:, None] * keep).sum() / n)
    if abs(middle - own) > plan.degrees:
        raise ValueError(f"the mean latitude moved from {middle:.1f} to {own:.1f}")
    return keep


def mask_file(source: str, size: int, target: str, variable: str, mask: set[tuple[float, float]], plan: Ingest) -> tuple[int, int, int]:
    """Writes a landed file's cells of the mask, a record at a time; records, cells kept, and values that are there."""
    import numpy as np

    present = 0
    with opened(source) as stream:
        h = read_header(stream, size)
        v = data_variable(h, variable)
        (_, time), (_, lat), (_, lon) = (axis(stream, h, v, i, names) for i, names in enumerate((TIME, LATITUDE, LONGITUDE)))
        lats, lons = (values(stream, h, a).astype("float64").tolist() for a in (lat, lon))
        keep = _kept(lats, lons, mask, plan)
        n = h.n_records if h.is_record(v) else h.shape(v)[0]
        offsets = values(stream, h, time, 0, n) if h.is_record(time) else values(stream, h, time)
        days = dates(offsets.astype("float64").tolist(), time.attributes["units"])
        with published(target) as out:
            out.write(header_bytes(variable, n, lats, lons, "days since 1970-01-01", np.nan))
            for i, day in enumerate(days):
                raw = values(stream, h, v, i)[0] if h.is_record(v) else values(stream, h, v)[i]
                record = np.where(keep, decoded(raw, v), np.nan)
                present += int((~np.isnan(record)).sum())
                out.write(struct.pack(">d", float((day - dt.date(1970, 1, 1)).days)) + record.astype(">f8").tobytes())
    return n, int(keep.sum()), present


def _units(plan: Ingest, mask_sent) -> object:
    def run(batches) -> Iterator:
        import pandas as pd

        mask = mask_sent.value
        for batch in batches:
            for variable, year in zip(batch["variable"], batch["year"]):
                name = f"{variable}/{year}.{variable}.nc"
                source, target = f"{plan.landed}/{name}", f"{plan.masked}/{name}"
                counts, message = (None, None, None), None
                if year < plan.first_years.get(variable, 0):
                    status = SKIPPED
                elif _size(target) is not None:
                    status = ALREADY
                else:
                    try:
                        if (size := _size(source)) is None:
                            raise FileNotFoundError(f"{name} has not landed")
                        counts, status = mask_file(source, size, target, variable, mask, plan), DONE
                    except Exception as e:  # one unit's failure is its status, and no other's
                        status, message = FAILED, f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(variable, year, status, *counts, message)], columns=["variable", "year", "status", "records", "cells", "present", "message"]).astype({"records": "Int32", "cells": "Int32", "present": "Int64"})

    return run


def ingest(units: DataFrame, mask: DataFrame, plan: Ingest) -> DataFrame:
    """variable, year, status, records, cells, present, message of each unit in this run, which is merged into the log.

    Units (variable, year) are taken once each; those of NULL have no part.
    done: masked and written; already: the masked file is there; skipped: the
    year is before the variable's first; error: see message, the next run
    tries again. A unit is one task's work and holds one record at a time; a
    task that is run again finds the file there or writes it anew, under its
    name only when whole. The mask (lat, lon) goes to every task: it is
    bounded by the grid. An empty mask is an error.
    """
    spark = units.sparkSession
    ship(spark)
    cells = mask.select(F.round("lat", plan.places).alias("lat"), F.round("lon", plan.places).alias("lon")).dropna().distinct()
    kept = {(r["lat"], r["lon"]) for r in cells.collect()}
    if not kept:
        raise ValueError("the mask has no cells")
    wanted = units.select("variable", F.col("year").cast("int").alias("year")).dropna().distinct()
    n = max(1, min(wanted.count(), 10_000))
    rows = written(wanted.repartition(n).mapInPandas(_units(plan, spark.sparkContext.broadcast(kept)), STATUS), "ingest")
    table = VersionedTable(spark, plan.log, ["variable", "year"], buckets=8)
    last = {"run": F.lit(table.version + 1), "finished": F.when(F.col("status").isin(DONE, ALREADY), True).otherwise(False)}
    table.merge(rows.withColumns(last), ["run"])
    return rows


def unfinished(units: DataFrame, log: str) -> DataFrame:
    """The units that no run has finished yet: those that the next run will try."""
    table = VersionedTable(units.sparkSession, log, ["variable", "year"])
    if not table.version:
        return units.select("variable", "year").distinct()
    return units.select("variable", "year").distinct().join(table.read().filter("finished"), ["variable", "year"], "left_anti")
