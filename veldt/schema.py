"""Schemas of the domain tables, and guards on incoming frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS_DAILY = "cell_id long, date date, daily_rain double, evap_pan double, max_temp double, min_temp double"
CELL_MASK = "cell_id long, lat double, lon double, cropping_fraction double, t005 boolean, t010 boolean, t020 boolean"
CELL_REGION = "cell_id long, row int, col int, lat double, lon double, weight double, aagis_code string, region_name string"
REGION = "aagis_code string, region_name string, zone string, state string"
REGION_RING = "aagis_code string, ring_id int, verts array<struct<x: double, y: double>>"
SURVEY_LONG = "variable string, year int, region string, value double, rse double"
COMMODITY = "region string, year int, area_ha double, production_t double, yield_t_ha double, area_rse double, production_rse double"
STATION = "station_id string, name string, latitude double, longitude double, elevation_m double, start_year int, available boolean"
ANNUAL = "aagis_code string, region_name string, value double, n_cells int, year int, variable string"
DAY_SUMMARY = (
    "date string, lat double, lon double, tz string, cloud_cover struct<afternoon: double>, humidity struct<afternoon: double>, "
    "precipitation struct<total: double>, temperature struct<min: double, max: double, afternoon: double, night: double, evening: double, morning: double>, "
    "pressure struct<afternoon: double>, wind struct<max: struct<speed: double, direction: double>>"
)


class SchemaError(ValueError):
    pass


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """df, or SchemaError with what is missing and what is there."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns {missing}; found {df.columns}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all float columns: done once, at the scan; no operator handles NaN."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def resolve_synonyms(df: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """Renames the first of its synonyms found for each name; case and outer blanks don't count. SchemaError names all that is missing."""
    found = {c.strip().lower(): c for c in df.columns}
    names, missing = {}, []
    for name, options in synonyms.items():
        hit = next((found[o.lower()] for o in options if o.lower() in found), None)
        if hit is None:
            missing.append(name)
        else:
            names[hit] = name
    if missing:
        raise SchemaError(f"no column for {missing} among {df.columns}")
    return df.withColumnsRenamed(names)
