"""Expressions and statistics against closed forms and hand-made tables."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from veldt.functions import scalars as S
from veldt.functions import stats


def one(df):
    return df.first()


def test_area_weight_and_distance(spark):
    r = one(spark.range(1).select(*[S.area_weight(F.lit(x)).alias(f"w{i}") for i, x in enumerate((0.0, 60.0, -60.0))], S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km")))
    assert r["w0"] == pytest.approx(1) and r["w1"] == pytest.approx(0.5) and r["w2"] == pytest.approx(0.5)
    assert r["km"] == pytest.approx(111.2, abs=0.1)


def test_vapour_pressure(spark):
    r = one(spark.range(1).select(S.saturation_vapour_pressure_hpa(F.lit(0.0)).alias("a"), S.saturation_vapour_pressure_hpa(F.lit(20.0)).alias("b")))
    assert r["a"] == pytest.approx(6.108) and r["b"] == pytest.approx(23.4, abs=0.1)


def test_normal_quantile(spark):
    ps = [1e-6, 1e-4, 0.01, 0.07, 0.075, 0.3, 0.5, 0.8, 0.925, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(S.normal_quantile_sql("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-12)


def test_gamma_cdf_closed_forms(spark):
    rows = [(x, a) for a in (1.0, 2.0) for x in (0.1, 1.0, 5.0, 30.0)]
    df = spark.createDataFrame(rows, "x double, a double").select("x", "a", S.gamma_cdf(F.col("x"), F.col("a"), F.lit(2.0)).alias("p"))
    for r in df.collect():
        z = r["x"] / 2
        assert r["p"] == pytest.approx(1 - math.exp(-z) * (1 if r["a"] == 1 else 1 + z), abs=1e-12)


def test_gamma_cdf_of_large_shapes(spark):
    rows = [(a * m, a) for a in (0.1, 0.7, 5.0, 99.0, 150.0, 1000.0, 20000.0) for m in (0.5, 0.9, 0.99, 1.0, 1.01, 1.1, 1.5, 3.0, 20.0)]
    for r in spark.createDataFrame(rows, "x double, a double").select("x", "a", S.gamma_cdf(F.col("x"), F.col("a"), F.lit(1.0)).alias("p")).collect():
        top = int(r["x"] + 20 * math.sqrt(r["x"]) + 200)
        want = math.fsum(math.exp((r["a"] + n) * math.log(r["x"]) - r["x"] - math.lgamma(r["a"] + n + 1)) for n in range(top))
        assert r["p"] == pytest.approx(want, abs=1e-8)


def test_gdd_keeps_missing(spark):
    df = spark.createDataFrame([(20.0, 10.0), (None, 10.0), (5.0, -9.0), (40.0, 20.0)], "a double, b double")
    got = [r[0] for r in df.select(S.daily_gdd(F.col("a"), F.col("b"), 10.0, 30.0)).collect()]
    assert got == [5.0, None, 0.0, 15.0]


def test_excess_heat(spark):
    df = spark.createDataFrame([(30.0, 20.0, 25.0), (30.0, None, 25.0), (20.0, None, 25.0), (30.0, 29.9, 25.0)], "t3 double, t30 double, t90 double")
    got = [r[0] for r in df.select(S.excess_heat(F.col("t3"), F.col("t30"), F.col("t90"))).collect()]
    assert got == [50.0, None, 0.0, 5.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("12",), (" 1234567 ",), (None,)], "s string")
    assert [r[0] for r in df.select(S.zero_padded(F.col("s"))).collect()] == ["000012", "1234567", None]
    codes = [("0", "national"), ("1", "state"), ("102.0", "sa4"), ("10203", "sa3"), ("102031234", "sa2"), ("12", "unknown"), ("x1", "unknown")]
    df = spark.createDataFrame(codes, "c string, want string")
    assert all(r[0] == r[1] for r in df.select("want", S.region_level(F.col("c"))).collect())


def test_weighted_mean_guards(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0), ("b", 10.0, 1.0), ("b", None, 3.0), ("c", 1.0, 0.0)], "k string, v double, w double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(stats.weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    assert got == {"a": 17.5, "b": 10.0, "c": None}


def test_correlation_guards(spark):
    rows = [("line", x, 2.0 * x) for x in (1.0, 2.0, 3.0, 4.0)] + [("flat", x, 1.0) for x in (1.0, 2.0, 3.0, 4.0)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(stats.guarded_corr(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["line"] == pytest.approx(1) and got["flat"] is None and got["few"] is None


def test_trend_and_detrending(spark):
    rows = [("a", y, 1 + 0.05 * (y - 2000)) for y in range(2000, 2020)] + [("b", 2000, 1.0), ("b", 2001, 2.0)]
    df = spark.createDataFrame(rows, "k string, year int, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg((10 * stats.slope(F.col("year"), F.col("v"))).alias("s")).collect()}
    assert got["a"] == pytest.approx(0.5) and got["b"] is None
    res = stats.detrended(df, ["k"], "year", "v", "r")
    assert res.filter("k = 'a' and abs(r) > 1e-9").count() == 0 and res.filter("k = 'b' and r is not null").count() == 0
    cv = {r["k"]: r["cv"] for r in res.groupBy("k").agg(stats.detrended_cv(F.col("r"), F.col("v")).alias("cv")).collect()}
    assert cv["a"] == pytest.approx(0, abs=1e-9) and cv["b"] is None


def test_gamma_fit_needs_four_wet_values(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 1.0, 2.0, 3.0, 5.0)] + [("b", x) for x in (1.0, 2.0, 0.0)] + [("c", 2.0)] * 5, "k string, v double")
    got = {r["k"]: (r["s"], r["q"]) for r in df.groupBy("k").agg(stats.thom_shape(F.col("v")).alias("s"), stats.zero_probability(F.col("v")).alias("q")).collect()}
    a = math.log(11 / 4) - sum(map(math.log, (1, 2, 3, 5))) / 4
    assert got["a"] == (pytest.approx((1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)), 0.2)
    assert got["b"][0] is None and got["c"][0] is None
