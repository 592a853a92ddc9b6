"""Column functions for wind, air, angles, places and prices. All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zephyrgrid import constants as K


def as_col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _floor_at(value: Column, low: float) -> Column:
    # greatest() ignores nulls, a missing speed has to stay missing
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def known(condition: Column) -> Column:
    """A flag that is false, not null, when an input is missing."""
    return F.coalesce(condition, F.lit(False))


# --- wind -------------------------------------------------------------------
def wind_speed(u, v) -> Column:
    u, v = as_col(u), as_col(v)
    return F.sqrt(u * u + v * v)


def wind_direction(u, v) -> Column:
    """Where the wind comes from: north 0, east 90. Dead calm is 180 by convention."""
    u, v = as_col(u), as_col(v)
    bearing = F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))
    return F.when((u == 0) & (v == 0), F.lit(180.0)).otherwise(bearing)


def wind_u(speed, direction) -> Column:
    return -as_col(speed) * F.sin(F.radians(as_col(direction)))


def wind_v(speed, direction) -> Column:
    return -as_col(speed) * F.cos(F.radians(as_col(direction)))


def angle_difference(a, b) -> Column:
    return F.pmod(as_col(a) - as_col(b) + 180.0, F.lit(360.0)) - 180.0


def normalise_direction(direction) -> Column:
    return F.pmod(as_col(direction), F.lit(360.0))


def wind_shear(low, high, height_low: float, height_high: float) -> Column:
    ratio = _floor_at(as_col(high), K.CALM_FLOOR) / _floor_at(as_col(low), K.CALM_FLOOR)
    return F.ln(ratio) / math.log(height_high / height_low)


def hub_wind(speed, alpha, height: float = K.HUB_HEIGHT, reference: float = 100.0) -> Column:
    return as_col(speed) * F.pow(F.lit(height / reference), as_col(alpha))


def wind_power_density(density, speed) -> Column:
    speed = as_col(speed)
    return as_col(density) * 0.5 * speed * speed * speed


def theory_power(swept_area, speed) -> Column:
    speed = as_col(speed)
    return as_col(swept_area) * (0.5 * K.RHO_STANDARD) * speed * speed * speed / 1000.0


def ten_minute_kw(energy) -> Column:
    return as_col(energy) * float(K.SAMPLES_PER_HOUR)


def gust_factor(gust, speed) -> Column:
    return as_col(gust) / _floor_at(as_col(speed), K.CALM_FLOOR)


# --- air --------------------------------------------------------------------
def vapour_pressure(humidity, pressure) -> Column:
    q, p = as_col(humidity), as_col(pressure)
    return F.try_divide(q * p, q * K.ONE_MINUS_EPSILON + K.EPSILON)


def air_density(temperature, humidity, pressure) -> Column:
    t, p = as_col(temperature), as_col(pressure)
    dry = p - vapour_pressure(humidity, pressure) * K.VAPOUR_SHARE
    return F.try_divide(dry, t * K.R_DRY)


# --- time -------------------------------------------------------------------
def hour_end(ts) -> Column:
    """Ceiling to the hour, a full hour stays as it is."""
    late = as_col(ts) + F.expr("INTERVAL '3599.999999' SECOND")
    return F.date_trunc("hour", late).cast("timestamp_ntz")


def ten_minute_floor(ts) -> Column:
    ts = as_col(ts)
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    minutes = F.minute(ts)
    return hour + F.make_dt_interval(F.lit(0), F.lit(0), minutes - minutes % 10, F.lit(0))


def seconds_since_epoch(ts) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), as_col(ts))


def lead_hours(available, target) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(available), as_col(target)) / F.lit(3.6e9)


def day_of(ts) -> Column:
    return F.date_trunc("day", as_col(ts)).cast("timestamp_ntz")


def cyclic_time(ts) -> dict[str, Column]:
    ts = as_col(ts)
    hour = F.hour(ts) * (2 * math.pi / 24)
    day = F.dayofyear(ts) * (2 * math.pi / 365.25)
    return {
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
        "doy_sin": F.sin(day), "doy_cos": F.cos(day),
        "month": F.month(ts), "season": season(ts),
    }


def season(ts) -> Column:
    month = F.month(as_col(ts))
    return (
        F.when(month.isin(12, 1, 2), K.SEASONS[0]).when(month.isin(3, 4, 5), K.SEASONS[1])
        .when(month.isin(6, 7, 8), K.SEASONS[2]).when(month.isNotNull(), K.SEASONS[3])
    )


def hour_bucket(hour) -> Column:
    """Right-closed thirds of a day; hour 0 belongs to the first."""
    h = as_col(hour)
    return (
        F.when((h >= 0) & (h <= 8), K.HOUR_BUCKETS[0])
        .when((h > 8) & (h <= 16), K.HOUR_BUCKETS[1])
        .when((h > 16) & (h <= 24), K.HOUR_BUCKETS[2])
    )


def lead_bucket(lead) -> Column:
    lead = as_col(lead)
    return (
        F.when((lead >= 12) & (lead < 20), "12-19").when((lead >= 20) & (lead < 28), "20-27")
        .when((lead >= 28) & (lead < 36), "28-35")
    )


# --- places -----------------------------------------------------------------
def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = dlat * dlat + F.cos(lat1) * F.cos(lat2) * dlon * dlon
    bounded = F.when(a.isNotNull(), F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))
    return F.asin(F.sqrt(bounded)) * (2 * K.EARTH_KM)


def dms_parts(text) -> tuple[Column, Column]:
    """Latitude and longitude of ``37°16'55.61"N 128°57'02.10"E``; other shapes raise."""
    parts = F.regexp_extract_all(as_col(text), F.lit(r"([0-9.]+|[NSEW])"), 1)
    number = lambda i: parts[i].cast("double")
    sign = lambda i, negative: F.when(parts[i] == negative, -1.0).otherwise(1.0)
    right = F.when(F.size(parts) == 8, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not a coordinate: "), as_col(text))).cast("boolean"))
    lat = F.when(right, sign(3, "S") * (number(0) + number(1) / 60 + number(2) / 3600))
    lon = F.when(right, sign(7, "W") * (number(4) + number(5) / 60 + number(6) / 3600))
    return lat, lon


# --- settlement -------------------------------------------------------------
def error_ratio(pred, actual, capacity) -> Column:
    return F.abs(as_col(pred) - as_col(actual)) / as_col(capacity)


def unit_price(ratio) -> Column:
    ratio = as_col(ratio)
    (edge_a, price_a), (edge_b, price_b) = K.PRICE_STEPS
    return F.when(ratio <= edge_a, price_a).when(ratio <= edge_b, price_b).otherwise(0.0)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def soft_price(ratio, steepness: float = K.SOFT_STEEPNESS) -> Column:
    ratio = as_col(ratio)
    first = _sigmoid((ratio - 0.06) * steepness)
    second = _sigmoid((ratio - 0.08) * steepness)
    return F.lit(4.0) - first - second * 3.0


def settlement_gradient(error, steepness: float = K.SOFT_STEEPNESS,
                        weight: float = 0.7) -> tuple[Column, Column]:
    """First and second derivative of the smoothed settlement loss at a utilisation error."""
    error = as_col(error)
    size = F.abs(error)
    bells, curves = F.lit(0.0), F.lit(0.0)
    for edge, share in ((0.06, 1.0), (0.08, 3.0)):  # the edges of the price steps, and what crossing one costs
        g = _sigmoid((size - edge) * steepness)
        bell = g * (F.lit(1.0) - g)
        bells = bells + bell * (share * steepness)
        curves = curves + bell * (F.lit(1.0) - g * 2.0) * (share * steepness * steepness)
    rest = 1.0 - weight
    gradient = F.signum(error) * (F.lit(weight) + bells * (rest / 4.0))
    floor = max(1e-2 * rest, 1e-6)
    return gradient, F.greatest(F.abs(curves) * (rest / 4.0), F.lit(floor))


def r6(value) -> Column:
    """Round to six places (three from 10 on) by plain arithmetic, the same in every engine.

    The small shift keeps values that end in an exact half away from the rounding edge.
    """
    value = as_col(value)
    near = lambda scale: F.floor(value * scale + 0.501) / F.lit(scale)
    return F.when(F.abs(value) < 10, near(1e6)).otherwise(near(1e3))
