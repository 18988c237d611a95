"""Scans: explicit schemas, explicit missing values, no inference."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt import schema as S

from .csv_ranges import RANGE, csv_texts, plain_header
from .sinks import write_parquet

#: Encodings in the order they are tried. Fixed values.
ENCODINGS = ("utf-8", "cp1252", "latin-1")
#: What stands for a missing value in the census, and what sheet readers take for one besides. Fixed values.
CENSUS_MARKS = ("..", "np", "-", "nil")
READER_MARKS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv_safe(spark: SparkSession, path: str, schema: str, na: Iterable[str] = ("",), encodings: Iterable[str] = ENCODINGS, range_bytes: int = RANGE) -> DataFrame:
    """A CSV file, or those below a folder, decoded strictly by the first encoding that fits each file.

    Files are read in byte ranges, each by its own task; columns are matched
    by the header. Only `na` is missing, so a literal NA stays. Numbers that
    don't parse are NULL.
    """
    wanted = T._parse_datatype_string(schema)
    return typed(csv_texts(spark, path, wanted.fieldNames(), na, encodings, range_bytes), wanted)


def typed(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """Strings to the wanted types, trimmed; what doesn't parse is NULL."""
    return df.select(*[(F.col(f.name) if isinstance(f.dataType, T.StringType) else F.trim(f.name).try_cast(f.dataType)).alias(f.name) for f in wanted.fields])


def plain_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A UTF-8 CSV with a header, codes as text; splittable."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", False).csv(path)


#: Columns of the survey files by level. Fixed values.
SURVEY_LEVELS = {"regional": ("Variable", "Year", "ABARES region", "Value", "RSE"), "national": ("Variable", "Year", "Industry", "Value", "RSE"), "state": ("Variable", "Year", "State", "Industry", "Value", "RSE")}
SURVEY_NAMES = {"Variable": "variable", "Year": "year", "ABARES region": "region", "Value": "value", "RSE": "rse", "Industry": "industry", "State": "state"}


def survey(spark: SparkSession, path: str, level: str) -> DataFrame:
    """The long survey table of a level: checked, renamed, trimmed, numbers typed."""
    columns = SURVEY_LEVELS[level]
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    raw = S.require_columns(raw, columns).select(*columns).withColumnsRenamed(SURVEY_NAMES)
    number = {"year": "int", "value": "double", "rse": "double"}
    return raw.select(*[(F.trim(c).try_cast(number[c]) if c in number else F.trim(c)).alias(c) for c in raw.columns])


def census(raw: DataFrame, names: dict[str, str], numbers: Iterable[str]) -> DataFrame:
    """A census sheet read as text: headers trimmed and renamed, missing-value marks to NULL, numbers typed."""
    trimmed = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})
    known = S.require_columns(trimmed, names).withColumnsRenamed(names)
    clean = lambda c: F.when(~F.trim(c).isin(*CENSUS_MARKS, *READER_MARKS), F.trim(c))
    return known.select(*[(clean(c).try_cast("double") if c in set(numbers) else clean(c)).alias(c) for c in names.values()])


#: Other names of a station list's columns. Fixed values.
STATION_SYNONYMS = {
    "station_id": ("stn_num", "stnnum", "station_id", "number", "id"),
    "name": ("stn_name", "stnname", "station_name", "name"),
    "latitude": ("lat", "latitude"),
    "longitude": ("lon", "lng", "longitude"),
    "elevation_m": ("elevation", "elevation_m", "elev"),
    "start_year": ("start", "start_year", "first_year"),
}


def stations(raw: DataFrame, unavailable: Iterable[str] = ()) -> DataFrame:
    """Schema STATION from a list whose columns may have other names; ids are six digits."""
    from veldt.functions.scalars import zero_padded

    found = S.resolve_synonyms(raw, STATION_SYNONYMS)
    ids = zero_padded(F.col("station_id"))
    bad = list(unavailable)
    number = lambda c, kind: F.col(c).cast("string").try_cast(kind).alias(c)
    available = (~ids.isin(*bad) if bad else F.lit(True)).alias("available")
    return found.select(ids.alias("station_id"), F.trim("name").alias("name"), number("latitude", "double"), number("longitude", "double"), number("elevation_m", "double"), number("start_year", "int"), available)


def cached_stations(spark: SparkSession, landed: str, cache: str, unavailable: Iterable[str] = (), fresh: bool = False) -> DataFrame:
    """The station list from its cached table, or from the landed CSV, which is then cached; fresh takes the landed one anyway.

    The landed file is read with the fallback of encodings, its columns by
    their synonyms. Availability is not cached: it is that of this call.
    """
    if fresh or not exists(spark, cache):
        named = plain_header(landed)
        text = csv_texts(spark, landed, named, ("",), ENCODINGS)
        write_parquet(stations(text).drop("available"), cache, sort_by=("station_id",))
    bad = list(unavailable)
    return spark.read.parquet(cache).withColumn("available", ~F.col("station_id").isin(*bad) if bad else F.lit(True))


def grid(spark: SparkSession, folder: str, variables: Iterable[str] | None = None, years: Iterable[int] | None = None) -> DataFrame:
    """Daily cells from Parquet partitioned by variable and year; both filters prune folders."""
    df = spark.read.parquet(folder)
    if variables is not None:
        df = df.filter(F.col("variable").isin(*variables))
    if years is not None:
        df = df.filter(F.col("year").isin(*years))
    return S.nan_to_null(df)


def mask(spark: SparkSession, path: str, name: str = "t005") -> DataFrame:
    """cell_id, lat, lon of the cells that the mask keeps."""
    return spark.read.parquet(path).filter(F.col(name).cast("boolean")).select("cell_id", "lat", "lon")


def rings(spark: SparkSession, geojson: str) -> DataFrame:
    """Schema REGION_RING from a GeoJSON file of (multi)polygons, in JVM expressions."""
    shape = "struct<type: string, features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    doc = spark.read.text(geojson, wholetext=True).select(F.from_json("value", shape).alias("d"))
    feature = doc.select(F.explode("d.features").alias("f"))
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    each = feature.select(F.coalesce(F.try_element_at("f.properties", F.lit("aagis_code")), F.try_element_at("f.properties", F.lit("aagis"))).alias("aagis_code"), F.posexplode(F.flatten(polygons)).alias("ring_id", "line"))
    return each.select("aagis_code", "ring_id", F.transform("line", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("verts"))


#: Attributes of the boundary file: code, name, zone, and the code once more. Fixed values.
REGION_FIELDS = {"aagis_code": "class", "region_name": "name", "zone": "zone"}
SECOND_CODE = "aagis"


def region_mapping(spark: SparkSession, geojson: str, fields: dict[str, str] | None = None, second: str = SECOND_CODE) -> DataFrame:
    """aagis_code, region_name, zone, state and alt_code of each feature of a GeoJSON file: trimmed attributes, the state by the code's first digit.

    Missing attributes are NULL; a file in which no feature has one of them is
    refused when the query runs.
    """
    from veldt.functions.scalars import state_of

    wanted = fields or REGION_FIELDS
    doc = spark.read.text(geojson, wholetext=True).select(F.from_json("value", "struct<features: array<struct<properties: map<string, string>>>>").alias("d"))
    held = lambda field: F.exists("d.features", lambda f: F.map_contains_key(f["properties"], field))
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(held(f), F.lit(False)), F.lit(f)) for f in wanted.values()]))
    checked = doc.select(F.when(F.size(lacking) == 0, F.col("d.features")).otherwise(F.raise_error(F.concat(F.lit(f"{geojson} lacks "), F.array_join(lacking, ", "))).cast("array<struct<properties: map<string, string>>>")).alias("features"))
    own = lambda field: F.trim(F.try_element_at("f.properties", F.lit(field)))
    found = checked.select(F.explode("features").alias("f")).select(*[own(field).alias(name) for name, field in wanted.items()], own(second).alias("alt_code"))
    return found.withColumn("state", state_of(F.col("aagis_code")))


def per_farm(spark: SparkSession, path: str) -> DataFrame:
    """region, year, area_ha, production_t, yield_t_ha, area_rse, production_rse from a commodity's file: regions trimmed, numbers typed; columns that the file lacks are NULL."""
    columns = {"year": "int", "area_ha": "double", "production_t": "double", "yield_t_ha": "double", "area_rse": "double", "production_rse": "double"}
    schema = "region string, " + ", ".join(f"{c} {kind}" for c, kind in columns.items())
    return csv_safe(spark, path, schema).withColumn("region", F.trim("region"))


def named_rings(found: DataFrame, regions: DataFrame) -> DataFrame:
    """Rings with region_name; the name is NULL where no region has the code."""
    return found.join(regions.select("aagis_code", "region_name"), "aagis_code", "left")


def day_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON day summaries, flattened; absent fields are NULL."""
    raw = spark.read.schema(S.DAY_SUMMARY).option("multiLine", True).json(path)
    picks = {"cloud_afternoon": "cloud_cover.afternoon", "humidity_afternoon": "humidity.afternoon", "rain_total": "precipitation.total", "temp_min": "temperature.min", "temp_max": "temperature.max", "temp_afternoon": "temperature.afternoon", "temp_night": "temperature.night", "temp_evening": "temperature.evening", "temp_morning": "temperature.morning", "pressure_afternoon": "pressure.afternoon", "wind_speed": "wind.max.speed", "wind_direction": "wind.max.direction"}
    return raw.select(F.col("date").try_cast("date").alias("date"), "lat", "lon", "tz", *[F.col(path).alias(name) for name, path in picks.items()])


def not_landed(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed ingest still has to fetch."""
    return wanted.join(landed.select(*keys).distinct(), keys, "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def land_path(folder: str, variable: str, year: int) -> str:
    return f"{folder.rstrip('/')}/variable={variable}/year={year}"


def land_paths(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted (variable, year) with the path of each, as land_path builds it."""
    return wanted.withColumn("path", F.format_string(f"{folder.rstrip('/')}/variable=%s/year=%d", "variable", "year"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def products(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The Parquet products that exist, by name; the others are left out."""
    return {name: spark.read.parquet(path) for name, path in paths.items() if exists(spark, path)}


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fails before any work if an input is missing, and names all that are."""
    missing = [f"{name}: {path}" for name, path in paths.items() if not exists(spark, path)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {'; '.join(missing)}")


#: Variables and industry of the survey files. Fixed values.
POPULATION_VARIABLE, NATIONAL_INDUSTRY = "Population", "All Broadacre"


def population(regional: DataFrame) -> DataFrame:
    """region, year and population from the regional survey table."""
    return regional.filter(F.col("variable") == POPULATION_VARIABLE).select("region", "year", F.col("value").alias("population"))


def national_production(national: DataFrame, variable: str) -> DataFrame:
    """year, national_total_t and national_rse: production of a farm times farms, by one aggregate.

    A year that lacks either has no total and is left out; rse is that of production.
    """
    pick = lambda name, c: F.max(F.when(F.col("variable") == name, F.col(c)))
    total = pick(variable, "value") * pick(POPULATION_VARIABLE, "value")
    farms = national.filter((F.col("industry") == NATIONAL_INDUSTRY) & F.col("variable").isin(variable, POPULATION_VARIABLE))
    return farms.groupBy("year").agg(total.alias("national_total_t"), pick(variable, "rse").alias("national_rse")).filter("national_total_t is not null")
