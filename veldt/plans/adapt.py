"""Domain tables made from the driver's tables.

The formulas are arbitrary; what matters is that the SQL renderings in
catalogue.py use the same ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions.scalars import area_weight
from veldt.operators import climatology, survey
from veldt.operators.timeseries import dealt, densified
from veldt.sources.scratch import written

VARIABLES = ["daily_rain", "evap_pan", "max_temp", "min_temp"]


def made_once(months: DataFrame, name: str) -> DataFrame:
    """Months of cells as a table, for queries that use them twice; read in a fixed number of partitions by cell."""
    return dealt(written(months, name), "cell_id")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def obs(self) -> DataFrame:
        """A cell's day: totals and means of its lines.

        Few lines share a cell and day, so a split's lines would all be held by
        the task that reads it; dealt first, they are shared by the partitions,
        whose number is fixed.
        """
        price = F.avg("l_extendedprice") / 3000.0
        lines = self.raw("lineitem").withColumns({"cell_id": F.col("l_suppkey"), "date": F.col("l_shipdate").cast("date")})
        return dealt(lines, "cell_id", "date").groupBy("cell_id", "date").agg(F.sum("l_quantity").alias("daily_rain"), (F.lit(100.0) * F.sum("l_discount")).alias("evap_pan"), price.alias("max_temp"), (price - F.lit(100.0) * F.avg("l_tax")).alias("min_temp"))

    @cached_property
    def cells(self) -> DataFrame:
        key = F.col("s_suppkey")
        placed = self.raw("supplier").select(key.alias("cell_id"), (F.lit(-10.0) - key % 34).alias("lat"), (F.lit(112.0) + key % 42).alias("lon"), F.col("s_nationkey").alias("region"))
        return placed.withColumn("weight", area_weight(F.col("lat")))

    @cached_property
    def regions(self) -> DataFrame:
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("region_name"), F.col("r_name").alias("zone"))

    @cached_property
    def dense(self) -> DataFrame:
        """Every cell's every day; days without lines get a made temperature and no rain, and some days stay missing."""
        span = self.raw("lineitem").agg(F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last")).first()
        days = densified(self.obs, self.cells.select("cell_id"), "date", F.lit(span["first"]), F.lit(span["last"]))
        n = F.unix_date("date")
        hole = (F.col("cell_id") * 31 + n) % 97 == 0
        made = F.lit(15.0) + (F.col("cell_id") * 7 + n) % 23
        return days.select(
            "cell_id",
            "date",
            F.when(~hole, F.coalesce("daily_rain", F.lit(0.0))).alias("daily_rain"),
            F.when(~hole, F.coalesce("evap_pan", F.lit(1.5))).alias("evap_pan"),
            F.coalesce("max_temp", made).alias("max_temp"),
            F.coalesce("min_temp", made - F.lit(9.0)).alias("min_temp"),
        )

    @cached_property
    def whole(self) -> DataFrame:
        """dense without missing days."""
        return self.dense.withColumns({"daily_rain": F.coalesce("daily_rain", F.lit(0.25)), "evap_pan": F.coalesce("evap_pan", F.lit(1.5))})

    @cached_property
    def parts(self) -> DataFrame:
        return climatology.monthly_parts(self.obs, VARIABLES)

    def in_regions(self, cells: DataFrame) -> DataFrame:
        return cells.join(self.cells.select("cell_id", "region", "weight", "lat"), "cell_id")

    @cached_property
    def annual(self) -> DataFrame:
        """Region series: region, variable, year, value, n_cells."""
        return climatology.region_means(self.in_regions(climatology.annual(self.parts)), ["region", "variable", "year"])

    @cached_property
    def per_farm(self) -> DataFrame:
        lines = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        rse = F.lit(100.0) * F.stddev_samp("l_extendedprice") / F.avg("l_extendedprice")
        found = lines.groupBy(F.col("s_nationkey").alias("region"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("area_ha"), F.sum("l_extendedprice").alias("production_t"), rse.alias("production_rse"))
        return found.withColumn("yield_t_ha", F.when(F.col("area_ha") > 0, F.col("production_t") / F.col("area_ha")))

    @cached_property
    def population(self) -> DataFrame:
        placed = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return placed.groupBy(F.col("c_nationkey").alias("region"), F.year("o_orderdate").alias("year")).agg(F.countDistinct("o_custkey").cast("double").alias("population"))

    @cached_property
    def national(self) -> DataFrame:
        """National averages: total production over the whole population, offset by up to a tenth."""
        totals = survey.region_totals(self.per_farm, self.population).groupBy("year").agg((F.sum("production_total_t") * (F.lit(1.0) + (F.col("year") % 3 - 1) / 10.0)).alias("national_total_t"))
        return totals.withColumn("national_rse", F.lit(10.0) + F.col("year") % 4 * 5)

    @cached_property
    def climate(self) -> DataFrame:
        v = lambda name: F.avg(F.when(F.col("variable") == name, F.col("value")))
        return self.annual.filter(F.col("variable").isin("daily_rain", "max_temp")).groupBy("region", "year").agg(v("daily_rain").alias("rain"), v("max_temp").alias("tmax"))

    @cached_property
    def panel(self) -> DataFrame:
        return survey.build_panel(self.per_farm.select("region", "year", "yield_t_ha", "production_rse"), self.climate)

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def providers(self) -> tuple[DataFrame, DataFrame]:
        """The two views of an order: its lines added up, and its own total."""
        lines = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.sum("l_extendedprice") / 1e4).alias("price"), F.avg("l_tax").alias("rate"))
        orders = self.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 1e6).alias("rate"))
        return lines, orders
