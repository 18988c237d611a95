"""Column functions: geography, agronomy, text and calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def saturation_vapour_pressure_hpa(t: Column) -> Column:
    """Tetens."""
    return F.lit(6.108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def relative_humidity(vp: Column, max_temp: Column) -> Column:
    return F.lit(100.0) * vp / saturation_vapour_pressure_hpa(max_temp)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; NULL stays NULL, which least and greatest alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def daily_gdd(max_temp: Column, min_temp: Column, base: float = 0.0, cap: float | None = None) -> Column:
    if cap is not None:
        max_temp, min_temp = (F.when(t.isNotNull(), F.least(t, F.lit(cap))) for t in (max_temp, min_temp))
    mean = (max_temp + min_temp) / 2 - F.lit(base)
    return F.when(mean.isNotNull(), F.greatest(mean, F.lit(0.0)))


def excess_heat(t3: Column, t30: Column, t90: Column) -> Column:
    """Significance t3 - t90 times the acclimatisation excess, where it is positive; else 0.

    Without t30 a significant day is NULL.
    """
    factor = F.when(t30.isNotNull(), F.greatest(F.lit(1.0), t3 - t30))
    return F.when(t3 > t90, factor * (t3 - t90)).when(t3.isNotNull() & t90.isNotNull(), F.lit(0.0))


def cell_area_km2(lat: Column, dlat: float, dlon: float) -> Column:
    return F.lit(EARTH_RADIUS_KM**2 * math.radians(dlat) * math.radians(dlon)) * F.cos(F.radians(lat))


def grid_key(x: Column, step: float) -> Column:
    """The whole number of steps nearest to a coordinate: an equi-join key for labels within half a step."""
    return F.round(x / F.lit(step)).cast("long")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def season_year(date: Column, months: tuple[int, ...], next_year_months: tuple[int, ...] = ()) -> Column:
    """The year a day's season is labelled with, its start year; NULL outside the season."""
    year, month = F.year(date), F.month(date)
    return F.when(month.isin(*months), year).when(month.isin(*next_year_months) if next_year_months else F.lit(False), year - 1)


def zero_padded(x: Column, width: int = 6) -> Column:
    """lpad cuts longer strings; these stay whole here."""
    text = F.trim(x.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


#: States by the first digit of a region code. Fixed values.
STATES = {"1": "NSW", "2": "VIC", "3": "QLD", "4": "SA", "5": "WA", "6": "TAS", "7": "NT"}


def state_of(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair]), F.substring(code, 1, 1))


#: Levels of the census hierarchy by the digits of a code. Fixed values.
LEVELS = {1: "state", 3: "sa4", 5: "sa3", 9: "sa2"}


def region_level(code: Column, national: str = "0") -> Column:
    """Level of a code by its number of digits; a trailing ".0" does not count."""
    text = F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")
    level = F.when(text == national, F.lit("national"))
    for digits, name in LEVELS.items():
        level = level.when(F.length(text) == digits, F.lit(name))
    return F.when(text.rlike(r"^[0-9]+$"), level.otherwise(F.lit("unknown"))).otherwise(F.lit("unknown"))


def threshold_name(t: Column) -> Column:
    return F.format_string("cropping_mask_t%03d", F.round(t * 100).cast("int"))


def poly(coefficients: tuple[str, ...], r: str) -> str:
    """Horner's form as SQL text, highest power first."""
    text = coefficients[0]
    for c in coefficients[1:]:
        text = f"({text} * {r} + {c})"
    return text


#: Coefficients of algorithm AS 241, highest power first: centre, middle and tail. Fixed values.
AS241 = (
    (
        ("2.5090809287301226727e3", "3.3430575583588128105e4", "6.7265770927008700853e4", "4.5921953931549871457e4", "1.3731693765509461125e4", "1.9715909503065514427e3", "1.3314166789178437745e2", "3.3871328727963666080e0"),
        ("5.2264952788528545610e3", "2.8729085735721942674e4", "3.9307895800092710610e4", "2.1213794301586595867e4", "5.3941960214247511077e3", "6.8718700749205790830e2", "4.2313330701600911252e1", "1e0"),
    ),
    (
        ("7.74545014278341407640e-4", "2.27238449892691845833e-2", "2.41780725177450611770e-1", "1.27045825245236838258e0", "3.64784832476320460504e0", "5.76949722146069140550e0", "4.63033784615654529590e0", "1.42343711074968357734e0"),
        ("1.05075007164441684324e-9", "5.47593808499534494600e-4", "1.51986665636164571966e-2", "1.48103976427480074590e-1", "6.89767334985100004550e-1", "1.67638483018380384940e0", "2.05319162663775882187e0", "1e0"),
    ),
    (
        ("2.01033439929228813265e-7", "2.71155556874348757815e-5", "1.24266094738807843860e-3", "2.65321895265761230930e-2", "2.96560571828504891230e-1", "1.78482653991729133580e0", "5.46378491116411436990e0", "6.65790464350110377720e0"),
        ("2.04426310338993978564e-15", "1.42151175831644588870e-7", "1.84631831751005468180e-5", "7.86869131145613259100e-4", "1.48753612908506148525e-2", "1.36929880922735805310e-1", "5.99832206555887937690e-1", "1e0"),
    ),
)


def normal_quantile_sql(p: str) -> str:
    """The standard normal quantile of p as SQL text that Spark and DuckDB share."""
    q = f"({p} - 5e-1)"
    rc = f"(1.80625e-1 - {q} * {q})"
    tail = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE 1e0 - {p} END))"
    centre = f"{poly(AS241[0][0], rc)} * {q} / {poly(AS241[0][1], rc)}"
    r1, r2 = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    side = f"(CASE WHEN {tail} <= 5e0 THEN {poly(AS241[1][0], r1)} / {poly(AS241[1][1], r1)} ELSE {poly(AS241[2][0], r2)} / {poly(AS241[2][1], r2)} END)"
    return f"(CASE WHEN abs({q}) <= 4.25e-1 THEN {centre} ELSE CASE WHEN {q} < 0 THEN -{side} ELSE {side} END END)"


def fisk_cdf(x: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Log-logistic CDF; NULL at or below its support."""
    return F.when(x > gamma, F.lit(1.0) / (F.lit(1.0) + F.pow((x - gamma) / alpha, -beta)))


#: Lanczos coefficients for g = 7. Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """For x > 0.5, by Lanczos' approximation."""
    z = x - F.lit(1.0)
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + F.lit(float(i)))
    t = z + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.log(t) - t + F.log(total)


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    """Regularised lower incomplete gamma function; 0 at or below 0.

    By its power series up to z = x / scale = shape + 1 and by the continued
    fraction of the upper function beyond. Either needs some roots of the
    shape as terms.
    """
    z, roots = x / scale, F.lit(10.0) * F.sqrt(F.greatest(shape, F.lit(0.0)) + F.lit(1.0))
    last = lambda least: F.ceil(roots + F.lit(least)).cast("int")
    backwards = lambda least: F.sequence(last(least), F.lit(1), F.lit(-1))
    # term n over term n - 1 is z / (shape + n): the sum is nested as Horner's form
    series = F.aggregate(backwards(30.0), F.lit(1.0), lambda f, n: F.lit(1.0) + f * z / (shape + n))
    fraction = F.aggregate(backwards(60.0), z + F.lit(2.0) * last(60.0) + F.lit(1.0) - shape, lambda f, n: z + F.lit(2.0) * n - F.lit(1.0) - shape - n * (n - shape) / f)
    front = F.exp(shape * F.log(z) - z - log_gamma(shape + F.lit(1.0)))
    upper = F.lit(1.0) - front * shape / fraction
    return F.when(x <= 0, F.lit(0.0)).when(z > shape + F.lit(1.0), F.greatest(upper, F.lit(0.0))).when(x.isNotNull(), F.least(front * series, F.lit(1.0)))
