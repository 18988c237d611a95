"""Queries by operator, each with the SQL that DuckDB answers alike.

SQL is written from the definition and not from the DataFrame plan. Doubles
are rounded on both sides, because sums come in different orders. Many values
have few decimals and would lie between two rounded ones; a small shift before
rounding keeps them off that edge, on both sides alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adapt import Tables

#: Shift and places below LARGE, and from there on.
LARGE, FINE, COARSE = "1e6", ("1.7e-8", 6), ("1.23e-2", 1)


def rounding(c: str) -> str:
    """A column rounded, as SQL text that Spark and DuckDB share."""
    (a, n), (b, m) = FINE, COARSE
    return f"CASE WHEN abs({c}) >= {LARGE} THEN round({c} + {b}, {m}) ELSE round({c} + {a}, {n}) END"


#: Common table expressions; a statement gets those that it names, and what these name.
CTES = {
    "obs": "SELECT l_suppkey AS cell_id, l_shipdate::DATE AS date, sum(l_quantity) AS daily_rain, 1e2 * sum(l_discount) AS evap_pan, avg(l_extendedprice) / 3e3 AS max_temp, avg(l_extendedprice) / 3e3 - 1e2 * avg(l_tax) AS min_temp FROM lineitem GROUP BY ALL",
    "cells": "SELECT s_suppkey AS cell_id, -1e1 - s_suppkey % 34 AS lat, 1.12e2 + s_suppkey % 42 AS lon, s_nationkey AS region, cos(radians(-1e1 - s_suppkey % 34)) AS weight FROM supplier",
    "regions": "SELECT n_nationkey AS region, n_name AS region_name, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey",
    "days": "SELECT unnest(generate_series((SELECT min(l_shipdate::DATE) FROM lineitem), (SELECT max(l_shipdate::DATE) FROM lineitem), INTERVAL 1 DAY))::DATE AS date",
    "dense": """SELECT c.cell_id, d.date, CASE WHEN (c.cell_id * 31 + (d.date - DATE '1970-01-01')) % 97 <> 0 THEN coalesce(o.daily_rain, 0e0) END AS daily_rain,
      CASE WHEN (c.cell_id * 31 + (d.date - DATE '1970-01-01')) % 97 <> 0 THEN coalesce(o.evap_pan, 1.5e0) END AS evap_pan,
      coalesce(o.max_temp, 1.5e1 + (c.cell_id * 7 + (d.date - DATE '1970-01-01')) % 23) AS max_temp,
      coalesce(o.min_temp, 1.5e1 + (c.cell_id * 7 + (d.date - DATE '1970-01-01')) % 23 - 9e0) AS min_temp
      FROM cells c CROSS JOIN days d LEFT JOIN obs o ON o.cell_id = c.cell_id AND o.date = d.date""",
    "whole": "SELECT cell_id, date, coalesce(daily_rain, 2.5e-1) AS daily_rain, coalesce(evap_pan, 1.5e0) AS evap_pan, max_temp, min_temp FROM dense",
    "stacked": "UNPIVOT obs ON daily_rain, evap_pan, max_temp, min_temp INTO NAME variable VALUE value",
    "annual_cell": "SELECT cell_id, variable, year(date)::INT AS year, CASE WHEN variable = 'daily_rain' THEN sum(value) ELSE avg(value) END AS value FROM stacked GROUP BY 1, 2, 3",
    "month_cell": "SELECT cell_id, variable, year(date)::INT AS year, month(date)::INT AS month, CASE WHEN variable = 'daily_rain' THEN sum(value) ELSE avg(value) END AS value FROM stacked GROUP BY 1, 2, 3, 4",
    "annual": "SELECT region, variable, year, sum(value * weight) / sum(weight) AS value, count(*)::INT AS n_cells FROM annual_cell JOIN cells USING (cell_id) GROUP BY ALL",
    "per_farm": "SELECT s_nationkey AS region, year(l_shipdate)::INT AS year, sum(l_quantity) AS area_ha, sum(l_extendedprice) AS production_t, 1e2 * stddev_samp(l_extendedprice) / avg(l_extendedprice) AS production_rse, sum(l_extendedprice) / sum(l_quantity) AS yield_t_ha FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "population": "SELECT c_nationkey AS region, year(o_orderdate)::INT AS year, count(DISTINCT o_custkey)::DOUBLE AS population FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "totals": "SELECT f.region, f.year, population, area_ha * population AS area_total_ha, production_t * population AS production_total_t, yield_t_ha FROM per_farm f LEFT JOIN population p ON f.region = p.region AND f.year = p.year",
    "national": "SELECT year, sum(production_total_t) * (1e0 + (year % 3 - 1) / 1e1) AS national_total_t, 1e1 + year % 4 * 5 AS national_rse FROM totals GROUP BY year",
    "judged": "SELECT s.year, region_sum_t, n_regions, national_total_t, national_rse, abs(region_sum_t - national_total_t) / national_total_t AS rel_error, n_regions = 25 AS full_coverage, coalesce(national_rse <= 20, false) AS reliable FROM (SELECT year, sum(production_total_t) AS region_sum_t, count(DISTINCT region)::INT AS n_regions FROM totals WHERE production_total_t IS NOT NULL GROUP BY year) s JOIN national n ON s.year = n.year",
    "climate": "SELECT region, year, max(value) FILTER (variable = 'daily_rain') AS rain, max(value) FILTER (variable = 'max_temp') AS tmax FROM annual GROUP BY ALL",
    "joined": "SELECT f.region, f.year, yield_t_ha, production_rse, rain, tmax FROM per_farm f JOIN climate c ON f.region = c.region AND f.year = c.year",
    "lines": "SELECT region, count(*) AS n, regr_slope(yield_t_ha, year) AS sy, regr_intercept(yield_t_ha, year) AS iy, regr_slope(rain, year) AS sr, regr_intercept(rain, year) AS ir, regr_slope(tmax, year) AS st, regr_intercept(tmax, year) AS it FROM joined GROUP BY region",
    "panel": "SELECT j.*, CASE WHEN n >= 3 THEN yield_t_ha - iy - sy * year END AS resid_yield, CASE WHEN n >= 3 THEN rain - ir - sr * year END AS resid_rain, CASE WHEN n >= 3 THEN tmax - it - st * year END AS resid_tmax FROM joined j JOIN lines USING (region)",
    "left_view": "SELECT l_orderkey AS id, sum(l_extendedprice) / 1e4 AS price, avg(l_tax) AS rate FROM lineitem GROUP BY 1",
    "right_view": "SELECT o_orderkey AS id, o_totalprice / 1e4 AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1e6 END AS rate FROM orders",
    "pairs": "SELECT id % 7 AS code, 'price' AS variable, l.price AS a, r.price AS b FROM left_view l JOIN right_view r USING (id) WHERE l.price IS NOT NULL AND r.price IS NOT NULL UNION ALL SELECT id % 7, 'rate', l.rate, r.rate FROM left_view l JOIN right_view r USING (id) WHERE l.rate IS NOT NULL AND r.rate IS NOT NULL",
    "month_days": "SELECT cell_id, year(date)::INT AS year, month(date)::INT AS month, date_trunc('month', date) AS first_day, count(daily_rain) AS n_rain, count(evap_pan) AS n_evap, sum(daily_rain) AS rain, sum(evap_pan) AS evap FROM dense GROUP BY ALL",
    "rain_months": "SELECT cell_id, year, month, year * 12 + month AS month_index, CASE WHEN n_rain = day(last_day(first_day)) THEN rain END AS rain FROM month_days",
    "full_months": "SELECT cell_id, year(date)::INT AS year, month(date)::INT AS month, (year(date) * 12 + month(date))::INT AS month_index, CASE WHEN count(*) = day(last_day(max(date))) THEN sum(daily_rain) END AS rain, CASE WHEN count(*) = day(last_day(max(date))) THEN sum(daily_rain) - sum(evap_pan) END AS balance FROM whole GROUP BY ALL",
    "southern": "SELECT *, year(date)::INT AS season_year FROM dense WHERE month(date) BETWEEN 4 AND 10",
    "summer": "SELECT *, (CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END)::INT AS season_year FROM dense WHERE month(date) IN (9, 10, 11, 12, 1, 2) AND (CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END) < (SELECT max(year(date)) FROM dense)",
    "t90": "SELECT cell_id, quantile_cont((max_temp + min_temp) / 2, 0.9) AS t90 FROM dense WHERE year(date) BETWEEN 1995 AND 1997 GROUP BY cell_id",
    "heat": """SELECT d.cell_id, d.date, avg((max_temp + min_temp) / 2) OVER (PARTITION BY d.cell_id ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS t3,
      avg((max_temp + min_temp) / 2) OVER (PARTITION BY d.cell_id ORDER BY date RANGE BETWEEN INTERVAL 32 DAY PRECEDING AND INTERVAL 3 DAY PRECEDING) AS t30, t90 FROM dense d JOIN t90 USING (cell_id)""",
    "ehf": "SELECT cell_id, date, t3, t30, CASE WHEN t3 > t90 AND t30 IS NULL THEN NULL WHEN t3 > t90 AND t3 - t30 > 1 THEN (t3 - t30) * (t3 - t90) WHEN t3 > t90 THEN t3 - t90 ELSE 0e0 END AS ehf FROM heat",
}


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Registers a function of Tables under an operator's key. doubles: the SQL's columns to round."""

    def put(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = Query(build, sql, tuple(doubles.split()))
        return build

    return put


def statement(sql: str, doubles: tuple[str, ...]) -> str:
    """The whole SQL: needed common tables first, doubles rounded."""
    needed: set[str] = set()
    rest = [sql]
    while rest:
        text = rest.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|UNPIVOT)\s+{name}\b", text):
                needed.add(name)
                rest.append(body)
    parts = []
    done: set[str] = set()
    while len(done) < len(needed):
        for name in CTES:
            if name in needed - done and not any(re.search(rf"\b(FROM|JOIN|UNPIVOT)\s+{other}\b", CTES[name]) for other in needed - done - {name}):
                parts.append(f"{name} AS ({CTES[name]})")
                done.add(name)
    head = f"WITH {', '.join(parts)} " if parts else ""
    if not doubles:
        return head + sql
    rounded = ", ".join(f"{rounding(c)} AS {c}" for c in doubles)
    return f"{head}SELECT * REPLACE ({rounded}) FROM ({sql}) result"


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.expr(rounding(f"`{c}`")) for c in doubles}) if doubles else df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_climate, queries_survey, queries_other, queries_files  # noqa: F401  they register

    def run(build):
        return lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))

    return {key: run(q.build) for key, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import queries_climate, queries_survey, queries_other, queries_files  # noqa: F401

    return {key: statement(q.sql, q.doubles) for key, q in REGISTRY.items() if q.sql}
