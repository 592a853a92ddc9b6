"""The given tables in the shape of the inputs, as DataFrames and as SQL for the oracle.

Averages are taken over whole cents (exact integers), so both engines start from equal bits.
Literals are written as doubles (``e0``), and the arithmetic of a column is the same text in
both; every operator on top is written twice, independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators.contracts import rename_known

TARGETS = list(K.GROUPS)
PREDICTION_CAPACITY = 500_000.0

# q, d, t, p: mean quantity, discount, tax and price of the rows behind one grid point
LDAPS_RAW = {
    "heightAboveGround_10_10u": "q - 25.5e0", "heightAboveGround_10_10v": "d * 200e0 - 10e0",
    "heightAboveGround_50_50MUmax": "q - 22.5e0", "heightAboveGround_50_50MUmin": "q - 25.5e0 - d * 20e0",
    "heightAboveGround_50_50MVmax": "d * 200e0 - 8e0", "heightAboveGround_50_50MVmin": "d * 200e0 - 10e0 - t * 25e0",
    "heightAboveGround_5_XBLWS": "q * 0.6e0 - 15e0", "heightAboveGround_5_YBLWS": "d * 120e0 - 6e0",
    "heightAboveGround_2_t": "273.15e0 + t * 250e0", "heightAboveGround_2_dpt": "263.15e0 + t * 250e0 + d * 150e0",
    "heightAboveGround_2_q": "d / 10e0", "heightAboveGround_2_r": "40e0 + d * 700e0",
    "surface_0_sp": "90000e0 + p / 10e0", "meanSea_0_prmsl": "101000e0 + q * 10e0",
    "etc_0_blh": "200e0 + q * 30e0", "surface_0_NDNSW": "q * 10e0", "surface_0_NDNLW": "0e0 - q",
    "heightAboveGround_2_SWDIR": "q * 6e0", "heightAboveGround_2_SWDIF": "q * 4e0",
    "etc_0_hcc": "d * 5e0 + t * 6e0", "etc_0_mcc": "t * 12.5e0", "etc_0_lcc": "d * 10e0",
    "etc_0_VLCDC": "(d + t) / 2e0", "surface_0_avg_lsprate": "t * 2e0", "surface_0_lssrate": "t * 0.5e0",
    "surface_0_ncpcp": "t * 3e0", "surface_0_snol": "d * 0.3e0", "surface_0_SNOM": "d * 0.2e0",
    "surface_0_lsm": "1e0 + d * 0e0", "surface_0_h": "900e0 + q",
}
GFS_RAW = {
    "heightAboveGround_10_10u": "q - 25.5e0", "heightAboveGround_10_10v": "d * 200e0 - 10e0",
    "heightAboveGround_80_u": "q * 1.2e0 - 30e0", "heightAboveGround_80_v": "d * 230e0 - 11e0",
    "heightAboveGround_100_100u": "q * 1.25e0 - 31e0", "heightAboveGround_100_100v": "d * 240e0 - 12e0",
    "heightAboveGround_2_2t": "273.15e0 + t * 250e0", "heightAboveGround_2_2d": "264.15e0 + t * 250e0 + d * 140e0",
    "heightAboveGround_2_2r": "45e0 + d * 650e0", "heightAboveGround_2_2sh": "d / 12e0",
    "planetaryBoundaryLayer_0_u": "q * 1.3e0 - 32e0", "planetaryBoundaryLayer_0_v": "d * 250e0 - 12e0",
    "planetaryBoundaryLayer_0_VRATE": "q * 100e0", "surface_0_dswrf": "q * 12e0", "surface_0_dlwrf": "q * 5e0",
    "surface_0_prate": "t * 0.01e0", "surface_0_tp": "t * 4e0", "surface_0_sp": "90500e0 + p / 10e0",
    "meanSea_0_prmsl": "101200e0 + q * 9e0", "surface_0_gust": "q * 0.8e0 + 6e0",
    "lowCloudLayer_0_lcc": "d * 900e0", "middleCloudLayer_0_mcc": "t * 1200e0", "highCloudLayer_0_hcc": "d * 500e0",
    "atmosphere_0_tcc": "d * 600e0 + t * 400e0", "isobaricInhPa_850_t": "268e0 + t * 200e0",
    "isobaricInhPa_850_u": "q * 1.5e0 - 37e0", "isobaricInhPa_850_v": "d * 300e0 - 14e0",
    "isobaricInhPa_850_r": "50e0 + d * 400e0", "isobaricInhPa_700_t": "258e0 + t * 180e0",
    "isobaricInhPa_700_u": "q * 1.7e0 - 42e0", "isobaricInhPa_700_v": "d * 330e0 - 15e0",
    "isobaricInhPa_500_gh": "5500e0 + q * 3e0", "isobaricInhPa_500_t": "248e0 + t * 150e0",
    "isobaricInhPa_500_u": "q * 2e0 - 50e0", "isobaricInhPa_500_v": "d * 360e0 - 17e0",
}
SCORED_MODELS = {"alpha": (7919, 400, 200), "beta": (104729, 300, 130), "gamma": (1299709, 500, 250)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _half_up(text: str, scale: str = "1e6") -> str:
    return f"floor(({text}) * {scale} + 0.5e0) / {scale}"


# --- forecast grids ---------------------------------------------------------
_CENTS = {"sq": "l_quantity", "sd": "l_discount", "st": "l_tax", "sp": "l_extendedprice"}
_MEANS = {"q": "sq", "d": "sd", "t": "st", "p": "sp"}
_LAT = "37e0 + 0.03e0 * floor(CAST(grid_id AS DOUBLE) / 3e0)"
_LON = "128.9e0 + 0.03e0 * CAST(grid_id % 3 AS DOUBLE)"


def grid_means(spark, d) -> DataFrame:
    """Sums and means of the rows behind each grid point and stamp."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    sums = table(spark, d, "lineitem").groupBy(
        F.col("l_shipdate").alias("forecast_kst_dtm"), (F.col("l_suppkey") % 9).alias("grid_id")).agg(
        F.count(F.lit(1)).alias("n"), *[cents(c).alias(a) for a, c in _CENTS.items()])
    means = {a: F.expr(f"CAST({s} AS DOUBLE) / (CAST(n AS DOUBLE) * 100e0)") for a, s in _MEANS.items()}
    lead = F.lit(12) + F.dayofyear("forecast_kst_dtm") % 24
    return sums.withColumns(means).withColumns({
        "latitude": F.expr(_LAT), "longitude": F.expr(_LON),
        "data_available_kst_dtm": F.col("forecast_kst_dtm") - F.make_dt_interval(F.lit(0), lead)})


def _raw(spark, d, columns: dict[str, str], means: DataFrame | None = None) -> DataFrame:
    means = grid_means(spark, d) if means is None else means
    return means.select(
        "forecast_kst_dtm", "data_available_kst_dtm", "grid_id", "latitude", "longitude",
        *[F.expr(_half_up(e)).alias(n) for n, e in columns.items()])


def ldaps_raw(spark, d, means: DataFrame | None = None) -> DataFrame:
    return _raw(spark, d, LDAPS_RAW, means)


def gfs_raw(spark, d, means: DataFrame | None = None) -> DataFrame:
    return _raw(spark, d, GFS_RAW, means)


def ldaps(spark, d, means: DataFrame | None = None) -> DataFrame:
    return rename_known(ldaps_raw(spark, d, means), K.LDAPS_NAMES)


def gfs(spark, d) -> DataFrame:
    return rename_known(gfs_raw(spark, d), K.GFS_NAMES)


def _raw_sql(columns: dict[str, str], names: dict[str, str] | None) -> str:
    made = ", ".join(f'{_half_up(e)} AS "{names[n] if names else n}"' for n, e in columns.items())
    return ("SELECT forecast_kst_dtm, data_available_kst_dtm, grid_id, latitude, longitude, "
            f"{made} FROM grid_means")


# --- row-level weather, one row per order line -------------------------------
OBS = {
    "u": "l_quantity - 25.5e0", "v": "l_discount * 200e0 - 10e0", "t2m": "273.15e0 + l_tax * 250e0",
    "dpt2m": "263.15e0 + l_tax * 250e0 + l_discount * 150e0", "q2m": "l_discount / 10e0",
    "rh2m": "40e0 + l_discount * 700e0", "sp": "90000e0 + l_extendedprice / 10e0",
    "ws_low": "l_quantity / 5e0 - 1e0", "ws_high": "l_quantity / 4e0", "gust": "l_quantity * 0.4e0",
    "wd": "CAST(l_partkey % 720 AS DOUBLE) / 2e0", "wd2": "CAST(l_suppkey * 7 % 360 AS DOUBLE)",
}


def obs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.expr(_half_up(e)).alias(n) for n, e in OBS.items()])


# --- turbines ---------------------------------------------------------------
def turbine_info(spark, d) -> DataFrame:
    """Suppliers as turbines, with the coordinate as text and the group as a number."""
    k = F.col("s_suppkey")
    minute, second = (k * 7) % 60, (k * 13) % 60
    dms = F.concat(F.lit("37°"), minute.cast("string"), F.lit("'"), second.cast("string"), F.lit('.25"N 128°'),
                   second.cast("string"), F.lit("'"), minute.cast("string"), F.lit('.5"E'))
    group = F.col("s_nationkey") % 3 + 1
    return table(spark, d, "supplier").select(
        F.concat(F.lit("wtg"), k.cast("string")).alias("turbine"), group.cast("string").alias("group_no"),
        dms.alias("coordinate"), F.when(group == 3, 4.2).otherwise(3.6).alias("capacity_mw"),
        F.when(group == 3, "U136").otherwise("V126").alias("model"),
        F.expr("37e0 + 0.006e0 * CAST(s_suppkey % 10 AS DOUBLE)").alias("lat"),
        F.expr("128.9e0 + 0.006e0 * CAST((s_suppkey div 10) % 10 AS DOUBLE)").alias("lon"))


def turbines(spark, d) -> DataFrame:
    from zephyrgrid.operators.contracts import group_key
    info = turbine_info(spark, d)
    return info.select("turbine", group_key("group_no").alias("group"), "lat", "lon",
                       F.when(F.col("model") == "U136", 4200.0).otherwise(3600.0).alias("cap_kw"), "model")


# --- ten-minute sensors -----------------------------------------------------
def sensor_long(spark, d) -> DataFrame:
    events = table(spark, d, "events").select(
        F.concat(F.lit("wtg"), (F.col("user_id") % 3).cast("string")).alias("turbine"),
        S.ten_minute_floor("ts").alias("kst_dtm"), "event_id",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    agg = events.groupBy("turbine", "kst_dtm").agg(
        F.count("cents").alias("n"), F.sum("cents").alias("s"), F.min("event_id").alias("e"))
    power = "CAST(s AS DOUBLE) * 8e0 / (CAST(n AS DOUBLE) * 100e0) - 40e0"
    return agg.select(
        "turbine", "kst_dtm", F.expr(_half_up(power, "1e3")).alias("power_raw"),
        F.expr("CAST((e * 13) % 250 AS DOUBLE) / 10e0").alias("ws_raw"),
        F.expr("CAST((e * 37) % 360 - 180 AS DOUBLE)").alias("wd_raw"))


def sensor_turbines(spark, d) -> DataFrame:
    number = F.col("user_id") % 3
    return table(spark, d, "events").select(number.alias("k")).distinct().select(
        F.concat(F.lit("wtg"), F.col("k").cast("string")).alias("turbine"),
        F.when(F.col("k") < 2, K.GROUPS[0]).otherwise(K.GROUPS[1]).alias("group"),
        F.lit("V126").alias("model"), F.lit(600.0).alias("cap_kwh10m"),
        F.lit(22.5).alias("cut_out_ms"), F.lit(12469.0).alias("swept_area_m2"))


def sensor_frozen(spark, d) -> DataFrame:
    stuck = F.dayofmonth("kst_dtm") % 5 == 0
    return sensor_long(spark, d).withColumn("power_raw", F.when(stuck, 250.0).otherwise(F.col("power_raw")))


def sensor_wide(spark, d) -> DataFrame:
    made = []
    for t in ("wtg0", "wtg1", "wtg2"):
        for out, c in (("power_kw10m", "power_raw"), ("ws", "ws_raw"), ("wd", "wd_raw")):
            made.append(F.max(F.when(F.col("turbine") == t, F.col(c))).alias(f"{t}_{out}"))
    return sensor_long(spark, d).groupBy("kst_dtm").agg(*made)


# --- labels and predictions -------------------------------------------------
def labels_wide(spark, d) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    pick = lambda i: F.sum(F.when(F.col("o_custkey") % 3 == i, cents)).cast("double") / 100.0
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("kst_dtm")).agg(
        *[pick(i).alias(g) for i, g in enumerate(TARGETS)])


def _order_base(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.concat(F.lit("kpx_group_"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("group"),
        F.col("o_orderpriority").alias("model_name"), F.col("o_orderdate").alias("ts"), "o_orderkey",
        (F.col("o_orderkey") % 24).alias("hour"), F.col("o_totalprice").alias("actual"),
        F.lit(PREDICTION_CAPACITY).alias("capacity"))


def _noise(spec: tuple[int, int, int]) -> str:
    a, m, b = spec
    return f"actual * (1e0 + CAST((o_orderkey * {a}) % {m} - {b} AS DOUBLE) / 1000e0)"


def predictions(spark, d) -> DataFrame:
    return _order_base(spark, d).withColumn("pred", F.expr(_noise(SCORED_MODELS["alpha"])))


def store(spark, d) -> DataFrame:
    """Every order predicted by three models, in long form."""
    cells = F.array(*[F.struct(F.lit(n).alias("model_name"), F.expr(_noise(s)).alias("pred"))
                      for n, s in SCORED_MODELS.items()])
    return _order_base(spark, d).drop("model_name").select("*", F.inline(cells))


VIEWS: dict[str, str] = {
    "grid_sums": """SELECT l_shipdate AS forecast_kst_dtm, l_suppkey % 9 AS grid_id, count(*) AS n, """
    + ", ".join(f"sum(CAST(round({c} * 100) AS BIGINT)) AS {a}" for a, c in _CENTS.items())
    + " FROM lineitem GROUP BY 1, 2",
    "grid_means": "SELECT *, " + ", ".join(
        f"CAST({s} AS DOUBLE) / (CAST(n AS DOUBLE) * 100e0) AS {a}" for a, s in _MEANS.items())
    + f", {_LAT} AS latitude, {_LON} AS longitude, forecast_kst_dtm - to_hours(12 + dayofyear(forecast_kst_dtm) % 24) "
    "AS data_available_kst_dtm FROM grid_sums",
    "ldaps_raw": _raw_sql(LDAPS_RAW, None), "gfs_raw": _raw_sql(GFS_RAW, None),
    "ldaps": _raw_sql(LDAPS_RAW, K.LDAPS_NAMES), "gfs": _raw_sql(GFS_RAW, K.GFS_NAMES),
    "obs": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_half_up(e)} AS {n}" for n, e in OBS.items())
    + " FROM lineitem",
    "turbine_info": """SELECT 'wtg' || s_suppkey AS turbine, CAST(s_nationkey % 3 + 1 AS VARCHAR) AS group_no,
        '37°' || (s_suppkey * 7) % 60 || '''' || (s_suppkey * 13) % 60 || '.25"N 128°' || (s_suppkey * 13) % 60
        || '''' || (s_suppkey * 7) % 60 || '.5"E' AS coordinate,
        CASE WHEN s_nationkey % 3 = 2 THEN 4.2e0 ELSE 3.6e0 END AS capacity_mw,
        CASE WHEN s_nationkey % 3 = 2 THEN 'U136' ELSE 'V126' END AS model,
        37e0 + 0.006e0 * CAST(s_suppkey % 10 AS DOUBLE) AS lat,
        128.9e0 + 0.006e0 * CAST((s_suppkey // 10) % 10 AS DOUBLE) AS lon FROM supplier""",
    "turbines": """SELECT turbine, 'kpx_group_' || group_no AS "group", lat, lon,
        CASE WHEN model = 'U136' THEN 4200e0 ELSE 3600e0 END AS cap_kw, model FROM turbine_info""",
    "sensor_sums": """SELECT 'wtg' || (user_id % 3) AS turbine, time_bucket(INTERVAL 10 MINUTE, ts) AS kst_dtm,
        count(value) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS s, min(event_id) AS e FROM events GROUP BY 1, 2""",
    "sensor_long": "SELECT turbine, kst_dtm, "
    + _half_up("CAST(s AS DOUBLE) * 8e0 / (CAST(n AS DOUBLE) * 100e0) - 40e0", "1e3") + """ AS power_raw,
        CAST((e * 13) % 250 AS DOUBLE) / 10e0 AS ws_raw, CAST((e * 37) % 360 - 180 AS DOUBLE) AS wd_raw FROM sensor_sums""",
    "sensor_turbines": """SELECT DISTINCT 'wtg' || (user_id % 3) AS turbine,
        CASE WHEN user_id % 3 < 2 THEN 'kpx_group_1' ELSE 'kpx_group_2' END AS "group", 'V126' AS model,
        600e0 AS cap_kwh10m, 22.5e0 AS cut_out_ms, 12469e0 AS swept_area_m2 FROM events""",
    "sensor_frozen": """SELECT turbine, kst_dtm, CASE WHEN dayofmonth(kst_dtm) % 5 = 0 THEN 250e0 ELSE power_raw END AS power_raw,
        ws_raw, wd_raw FROM sensor_long""",
    "labels_wide": "SELECT o_orderdate AS kst_dtm, " + ", ".join(
        f"CAST(sum(CASE WHEN o_custkey % 3 = {i} THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / 100e0 AS {g}"
        for i, g in enumerate(TARGETS)) + " FROM orders GROUP BY 1",
    "labels_long": " UNION ALL ".join(
        f"SELECT '{g}' AS \"group\", kst_dtm AS forecast_kst_dtm, {g} AS target FROM labels_wide WHERE {g} IS NOT NULL"
        for g in TARGETS),
    "order_base": """SELECT 'kpx_group_' || (o_custkey % 3 + 1) AS "group", o_orderpriority AS model_name, o_orderdate AS ts,
        o_orderkey, o_orderkey % 24 AS hour, o_totalprice AS actual, 500000e0 AS capacity FROM orders""",
    "predictions": f"SELECT *, {_noise(SCORED_MODELS['alpha'])} AS pred FROM order_base",
    "store": " UNION ALL ".join(
        f"SELECT * EXCLUDE (model_name), '{n}' AS model_name, {_noise(s)} AS pred FROM order_base"
        for n, s in SCORED_MODELS.items()),
}


def rnd(text: str) -> str:
    """The SQL side of :func:`scalars.r6`."""
    return (f"(CASE WHEN abs({text}) < 10 THEN floor(({text}) * 1e6 + 0.501e0) / 1e6 "
            f"ELSE floor(({text}) * 1000 + 0.501e0) / 1000e0 END)")


def rnds(*names: str) -> str:
    return ", ".join(f"{rnd(n)} AS {n}" for n in names)


def sql(body: str) -> str:
    """Prefix a query with the views it names, in order of need."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)
    visit(body)
    if not needed:
        return body
    parts = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    if body.lstrip()[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts}, {body.lstrip()[15:]}"
    if body.lstrip()[:5].upper() == "WITH ":
        return f"WITH {parts}, {body.lstrip()[5:]}"
    return f"WITH {parts} {body}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places and whole numbers to bigint, as the oracle writes them."""
    from pyspark.sql import types as T
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = S.r6(c)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        made.append(c.alias(f.name))
    out = df.select(*made)
    return out.select(*columns) if columns else out
