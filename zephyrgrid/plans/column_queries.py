"""Projections, contracts, scalar functions and quality flags over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import flags as Fl
from zephyrgrid.operators import sensor as Se
from zephyrgrid.operators import series as Sr
from zephyrgrid.operators import splits as Sp
from zephyrgrid.operators.ordering import tick
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans.bindings import rnd, rnds, rounded
from zephyrgrid.plans.physics import gfs_physics, gfs_wind, issue_times, ldaps_physics
from zephyrgrid.plans.registry import query

ROW = ["l_orderkey", "l_linenumber"]
_ROW = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"
_KEYS = "forecast_kst_dtm, grid_id"


def _obs(spark, d, **columns):
    return rounded(B.obs(spark, d).select(*ROW, *[c.alias(n) for n, c in columns.items()]))


def _obs_sql(**columns) -> str:
    return f"SELECT {_ROW}, " + ", ".join(f"{rnd(c)} AS {n}" for n, c in columns.items()) + " FROM obs"


# --- B: projections, filters, contracts --------------------------------------
_L = list(K.LDAPS_NAMES.values())
_G = list(K.GFS_NAMES.values())


@query("rename_ldaps", f"SELECT {_KEYS}, {rnds(*_L)} FROM ldaps")
def rename_ldaps(spark, d):
    return rounded(C.rename_known(B.ldaps_raw(spark, d), K.LDAPS_NAMES), "forecast_kst_dtm", "grid_id", *_L)


@query("rename_gfs", f"SELECT {_KEYS}, {rnds(*_G)} FROM gfs")
def rename_gfs(spark, d):
    return rounded(C.rename_known(B.gfs_raw(spark, d), K.GFS_NAMES), "forecast_kst_dtm", "grid_id", *_G)


@query("rename_scada", f"SELECT turbine, kst_dtm, {rnds('power_raw', 'ws_raw', 'wd_raw')} FROM sensor_long")
def rename_scada(spark, d):
    short = {"kst_dtm": "datetime", "power_raw": "power", "ws_raw": "ws", "wd_raw": "wd"}
    return rounded(C.rename_sensor(B.sensor_long(spark, d).withColumnsRenamed(short)))


@query("validate_contract", f"SELECT {_KEYS}, {rnds('latitude', 'longitude')} FROM ldaps")
def validate_contract(spark, d):
    checked = C.validate(B.ldaps_raw(spark, d), K.GRID_REQUIRED)
    return rounded(checked.select("forecast_kst_dtm", "grid_id", "latitude", "longitude"))


@query("inf_to_null", f"SELECT {_ROW}, " + rnd("CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END")
       + " AS ratio FROM lineitem")
def inf_to_null(spark, d):
    rows = B.table(spark, d, "lineitem")
    zero = F.when(F.col("l_quantity") > 25, float("inf")).otherwise(float("-inf"))
    zero = F.when(F.col("l_quantity") == 10, float("nan")).otherwise(zero)
    ratio = F.when(F.col("l_discount") == 0, zero).otherwise(F.try_divide("l_quantity", "l_discount"))
    return rounded(C.infinite_to_null(rows.select(*ROW, ratio.alias("ratio"))))


@query("select_group", f"""SELECT "group", forecast_kst_dtm, {rnd('target')} AS target FROM labels_long WHERE "group" = 'kpx_group_2'""")
def select_group(spark, d):
    return rounded(C.select_group(C.labels_long(B.labels_wide(spark, d)), "kpx_group_2"))


def _joined_labels(spark, d):
    grid = B.ldaps(spark, d).select("forecast_kst_dtm", "grid_id", "u10", "v10", "t2m")
    return grid.join(B.labels_wide(spark, d), grid["forecast_kst_dtm"] == F.col("kst_dtm"), "left")


@query("feature_columns", f"SELECT {rnds('u10', 'v10', 't2m')}, grid_id FROM ldaps")
def feature_columns(spark, d):
    df = _joined_labels(spark, d)
    return rounded(df.select(*C.feature_columns(df)))


@query("model_input", f"""SELECT {_KEYS}, {rnd('u10')} AS u10, CAST(t2m < dpt2m AS BIGINT) AS is_temp_below_dew,
    CAST(rh2m > 100 AS BIGINT) AS is_rh_over_100, """ + ", ".join(
    f"CAST((month(forecast_kst_dtm) % 12) // 3 = {i} AS BIGINT) AS season_{s}" for i, s in enumerate(K.SEASONS)) + " FROM ldaps")
def model_input(spark, d):
    df = B.ldaps(spark, d).withColumn("season", S.season("forecast_kst_dtm"))
    df = Fl.air_limits(df).select("forecast_kst_dtm", "grid_id", "u10", "sp", "is_temp_below_dew", "is_rh_over_100", "season")
    return rounded(C.model_input(df, drop=["sp"]))


@query("one_hot_fixed", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(
    f"CAST(l_returnflag = '{v}' AS BIGINT) AS l_returnflag_{v}" for v in "ANRX") + " FROM lineitem")
def one_hot_fixed(spark, d):
    return rounded(C.one_hot(B.table(spark, d, "lineitem").select(*ROW, "l_returnflag"), "l_returnflag", list("ANRX")))


@query("clip_power", f"SELECT {_ROW}, {rnd('least(greatest(u * 1000, 0), 21600)')} AS power FROM obs")
def clip_power(spark, d):
    return _obs(spark, d, power=C.clip_between(F.col("u") * 1000, 0.0, F.lit(21600.0)))


@query("utilisation_to_kwh", _obs_sql(energy="least(greatest(u / 20, 0), 1) * 21600", share="least(greatest(u * 1000 / 21600, 0), 1)"))
def utilisation_to_kwh(spark, d):
    return _obs(spark, d, energy=C.to_energy(F.col("u") / 20, F.lit(21600.0)),
                share=C.to_utilisation(F.col("u") * 1000, F.lit(21600.0)))


@query("turbine_spec", f"""SELECT turbine, {rnd('cap_kw / 6')} AS cap_kwh10m, CASE model WHEN 'V126' THEN 22.5e0 ELSE 22e0 END AS cut_out_ms,
    CASE model WHEN 'V126' THEN 12469e0 ELSE 14470e0 END AS swept_area_m2 FROM turbines""")
def turbine_spec(spark, d):
    return rounded(C.turbine_spec(B.turbines(spark, d)), "turbine", "cap_kwh10m", "cut_out_ms", "swept_area_m2")


_PART = "CAST(regexp_extract(coordinate, {pattern}, 1) AS DOUBLE)"
_DMS_LAT = ("37 + " + _PART + " / 60 + " + _PART + " / 3600").replace("{pattern}", "'37°([0-9]+)'", 1).replace("{pattern}", "'([0-9.]+)\"N'", 1)
_DMS_LON = ("128 + " + _PART + " / 60 + " + _PART + " / 3600").replace("{pattern}", "'128°([0-9]+)'", 1).replace("{pattern}", "'([0-9.]+)\"E'", 1)


@query("turbine_meta", f"""SELECT turbine, 'kpx_group_' || group_no AS "group", {rnd(_DMS_LAT)} AS lat, {rnd(_DMS_LON)} AS lon,
    {rnd('capacity_mw * 1000')} AS cap_kw FROM turbine_info""")
def turbine_meta(spark, d):
    info = B.turbine_info(spark, d).drop("lat", "lon")
    return rounded(C.turbine_meta(info, "coordinate", "group_no", "capacity_mw"), "turbine", "group", "lat", "lon", "cap_kw")


@query("normalise_group_key", """SELECT o_orderkey, 'kpx_group_' || (o_custkey % 3 + 1) AS "group" FROM orders""")
def normalise_group_key(spark, d):
    number = F.col("o_custkey") % 3 + 1
    spelled = F.when(F.col("o_orderkey") % 3 == 0, number.cast("string")).when(
        F.col("o_orderkey") % 3 == 1, number.cast("double").cast("string")).otherwise(
        F.concat(F.lit("kpx_group_"), number.cast("string")))
    return B.table(spark, d, "orders").select("o_orderkey", C.group_key(spelled).alias("group"))


@query("powercurve_filter", f"""SELECT turbine, kst_dtm, {rnds('power_raw', 'ws_raw')} FROM sensor_long WHERE ws_raw > 0.5e0 AND power_raw >= 0""")
def powercurve_filter(spark, d):
    return rounded(C.power_curve_points(B.sensor_long(spark, d), "ws_raw", "power_raw"), "turbine", "kst_dtm", "power_raw", "ws_raw")


_SPLIT = """SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY ts, o_orderkey) <= {cut}
    THEN '{a}' ELSE '{b}' END AS {name} FROM predictions"""
_N = "count(*) OVER (PARTITION BY {k})"


@query("time_split", _SPLIT.format(k='"group"', cut="floor(" + _N.format(k='"group"') + " * (1e0 - 0.2e0))", a="train", b="valid", name="split"))
def time_split(spark, d):
    return Sp.time_split(B.predictions(spark, d).select("group", "ts", "o_orderkey"), ["group"], ["ts", "o_orderkey"]).select("o_orderkey", "split")


@query("tune_audit_split", _SPLIT.format(k='"group", model_name', cut="floor(" + _N.format(k='"group", model_name') + " * 0.5e0)",
                                         a="tune", b="audit", name="half"))
def tune_audit_split(spark, d):
    rows = B.predictions(spark, d).select("group", "model_name", "ts", "o_orderkey")
    return Sp.tune_audit(rows, ["group", "model_name"], ["ts", "o_orderkey"], min_audit=20).select("o_orderkey", "half")


@query("warmup_trim", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY "group" ORDER BY ts, o_orderkey) AS rn
    FROM predictions) WHERE rn > 24""")
def warmup_trim(spark, d):
    return Sp.warmup_trim(B.predictions(spark, d).select("group", "ts", "o_orderkey"), ["group"], ["ts", "o_orderkey"]).select("o_orderkey")


B.VIEWS["fold_labels"] = f"""SELECT "group", forecast_kst_dtm, target / 1e6 AS target,
    CAST(floor(((year(forecast_kst_dtm) - 1996) * 12 + month(forecast_kst_dtm) - 1) / 3.0) AS BIGINT) AS own FROM labels_long"""
B.VIEWS["folds"] = """SELECT w."group", w.forecast_kst_dtm, w.target, f.fold, CASE WHEN w.own = f.fold THEN 'valid' ELSE 'train' END AS side
    FROM fold_labels w JOIN (SELECT DISTINCT own AS fold FROM fold_labels WHERE own >= 0) f ON w.own <= f.fold"""
ORIGIN = "1996-01-01 00:00:00"


def fold_labels(spark, d):
    labels = C.labels_long(B.labels_wide(spark, d)).withColumn("target", F.col("target") / F.lit(1e6))
    return Sp.fold_rows(labels, "forecast_kst_dtm", ORIGIN)


@query("rolling_origin_folds", f"""SELECT "group", forecast_kst_dtm, fold, side, {rnd('target')} AS target FROM folds""")
def rolling_origin_folds(spark, d):
    return rounded(fold_labels(spark, d), "group", "forecast_kst_dtm", "fold", "side", "target")


@query("fold_windows", f"""SELECT "group", fold, n_valid, {rnds('valid_mean')}, n_train, {rnds('train_mean')} FROM (SELECT "group", fold,
    count(CASE WHEN side = 'valid' THEN 1 END) AS n_valid, avg(CASE WHEN side = 'valid' THEN target END) AS valid_mean,
    count(CASE WHEN side = 'train' THEN 1 END) AS n_train, avg(CASE WHEN side = 'train' THEN target END) AS train_mean FROM folds GROUP BY 1, 2)
    WHERE n_valid > 0 AND n_train > 0""")
def fold_windows(spark, d):
    labels = C.labels_long(B.labels_wide(spark, d)).withColumn("target", F.col("target") / F.lit(1e6))
    return rounded(Sp.rolling_folds(labels, "forecast_kst_dtm", "target", ORIGIN, 3, ["group"]).filter("fold >= 0"))


@query("fold_report", f"""SELECT "group", count(*) AS folds, {rnd('avg(e)')} AS fold_mean, {rnd('stddev_samp(e)')} AS fold_std FROM (SELECT v."group", v.fold, avg(abs(v.target - t.m)) AS e
    FROM folds v JOIN (SELECT "group", fold, avg(target) AS m FROM folds WHERE side = 'train' GROUP BY 1, 2) t ON v."group" = t."group" AND v.fold = t.fold
    WHERE v.side = 'valid' GROUP BY 1, 2) GROUP BY 1""")
def fold_report(spark, d):
    """Mean and spread over the folds of the error of the train mean."""
    rows = fold_labels(spark, d)
    means = rows.filter("side = 'train'").groupBy("group", "fold").agg(F.avg("target").alias("m"))
    errors = rows.filter("side = 'valid'").join(F.broadcast(means), ["group", "fold"]).groupBy("group", "fold").agg(
        F.avg(F.abs(F.col("target") - F.col("m"))).alias("e"))
    return rounded(Sp.fold_report(errors, "e", ["group"]))


# --- C: scalar functions -----------------------------------------------------
_DIR = "(CASE WHEN {u} = 0 AND {v} = 0 THEN 180 ELSE (degrees(atan2(-{u}, -{v})) + 360) % 360 END)"
_WRAP = "((({a} - {b} + 180) % 360 + 360) % 360 - 180)"


@query("wind_speed", _obs_sql(ws="sqrt(u * u + v * v)"))
def wind_speed(spark, d):
    return _obs(spark, d, ws=S.wind_speed("u", "v"))


@query("wind_direction", _obs_sql(wd=_DIR.format(u="u", v="v")))
def wind_direction(spark, d):
    return _obs(spark, d, wd=S.wind_direction("u", "v"))


@query("uv_component", _obs_sql(u_part="-ws_high * sin(radians(wd))", v_part="-ws_high * cos(radians(wd))"))
def uv_component(spark, d):
    return _obs(spark, d, u_part=S.wind_u("ws_high", "wd"), v_part=S.wind_v("ws_high", "wd"))


@query("angle_difference", _obs_sql(turn=_WRAP.format(a="wd", b="wd2")))
def angle_difference(spark, d):
    return _obs(spark, d, turn=S.angle_difference("wd", "wd2"))


_SHEAR = "ln(greatest(ws_high, 1e-3) / greatest(ws_low, 1e-3)) / ln(10e0)"


@query("wind_shear", _obs_sql(alpha=_SHEAR))
def wind_shear(spark, d):
    return _obs(spark, d, alpha=S.wind_shear("ws_low", "ws_high", 10.0, 100.0))


@query("hub_wind", _obs_sql(hub=f"ws_high * pow(1.17e0, {_SHEAR})"))
def hub_wind(spark, d):
    return _obs(spark, d, hub=S.hub_wind("ws_high", S.wind_shear("ws_low", "ws_high", 10.0, 100.0)))


_E = "(q2m * sp / (0.62197e0 + 0.37803e0 * q2m))"
_RHO = f"((sp - 0.378e0 * {_E}) / (287.05e0 * t2m))"


@query("air_density", _obs_sql(e_pa=_E, air_density=_RHO))
def air_density(spark, d):
    return _obs(spark, d, e_pa=S.vapour_pressure("q2m", "sp"), air_density=S.air_density("t2m", "q2m", "sp"))


@query("wind_power_density", _obs_sql(wpd=f"0.5e0 * {_RHO} * pow(ws_high, 3)"))
def wind_power_density(spark, d):
    return _obs(spark, d, wpd=S.wind_power_density(S.air_density("t2m", "q2m", "sp"), "ws_high"))


@query("theory_power", _obs_sql(theory_kw="0.5e0 * 1.225e0 * 12469 * pow(ws_high, 3) / 1000", actual_kw="gust * 6"))
def theory_power(spark, d):
    return _obs(spark, d, theory_kw=S.theory_power(F.lit(12469.0), "ws_high"), actual_kw=S.ten_minute_kw("gust"))


@query("direction_sincos", _obs_sql(wd="wd", wd_sin="sin(radians(wd))", wd_cos="cos(radians(wd))"))
def direction_sincos(spark, d):
    return rounded(Se.direction_cycle(B.obs(spark, d).select(*ROW, "wd"), ["wd", "absent"]))


_CYCLE = ", ".join(rnd(f"{f}(2 * pi() * {x}(ts) / {n})") + f" AS {a}_{f}" for a, x, n in (
    ("hour", "hour", "24e0"), ("doy", "dayofyear", "365.25e0")) for f in ("sin", "cos"))
_SEASON = "CASE (month(ts) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END"


@query("cyclic_time", f"SELECT event_id, {_CYCLE}, month(ts) AS month, {_SEASON} AS season FROM events")
def cyclic_time(spark, d):
    return rounded(B.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in S.cyclic_time("ts").items()]))


@query("forecast_time_meta", f"""SELECT {_KEYS}, date_trunc('day', data_available_kst_dtm)::TIMESTAMP AS forecast_issue_date,
    {rnd("epoch_us(forecast_kst_dtm - data_available_kst_dtm) / 3.6e9")} AS lead_hour, hour(forecast_kst_dtm) AS target_hour FROM ldaps""")
def forecast_time_meta(spark, d):
    return rounded(issue_times(B.ldaps(spark, d)), "forecast_kst_dtm", "grid_id", "forecast_issue_date", "lead_hour", "target_hour")


_HOUR_END = "(CASE WHEN {t} = date_trunc('hour', {t}) THEN {t} ELSE date_trunc('hour', {t}) + INTERVAL 1 HOUR END)"


@query("hour_end", f"SELECT event_id, {_HOUR_END.format(t='ts')} AS hour_end FROM events")
def hour_end(spark, d):
    return B.table(spark, d, "events").select("event_id", S.hour_end("ts").alias("hour_end"))


@query("normalise_direction", _obs_sql(wd="((wd - 180) % 360 + 360) % 360"))
def normalise_direction(spark, d):
    return _obs(spark, d, wd=S.normalise_direction(F.col("wd") - 180))


_LEVELS = {f"gfs_ws_{n}": f"sqrt({u} * {u} + {v} * {v})" for n, (u, v) in K.GFS_LEVELS.items()} | {
    f"gfs_wd_{n}": _DIR.format(u=u, v=v) for n, (u, v) in K.GFS_LEVELS.items()}


@query("multi_level_wind", f"SELECT {_KEYS}, " + ", ".join(f"{rnd(e)} AS {n}" for n, e in _LEVELS.items()) + " FROM gfs")
def multi_level_wind(spark, d):
    return rounded(gfs_wind(B.gfs(spark, d)), "forecast_kst_dtm", "grid_id", *_LEVELS)


_WS = "sqrt(u10 * u10 + v10 * v10)"
B.VIEWS["gfs_levels"] = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _LEVELS.items()) + " FROM gfs"
_GSHEAR = "ln(greatest(gfs_ws_100, 1e-3) / greatest(gfs_ws_10, 1e-3)) / ln(10e0)"
B.VIEWS["gfs_hub"] = f"SELECT *, {_GSHEAR} AS gfs_shear_alpha, gfs_ws_100 * pow(1.17e0, {_GSHEAR}) AS gfs_ws_hub FROM gfs_levels"
_GRHO = "((gfs_sp - 0.378e0 * (gfs_q2m * gfs_sp / (0.62197e0 + 0.37803e0 * gfs_q2m))) / (287.05e0 * gfs_t2m))"
B.VIEWS["gfs_grid"] = f"""SELECT *, {_GRHO} AS gfs_air_density, 0.5e0 * {_GRHO} * pow(gfs_ws_hub, 3) AS gfs_wind_power_density,
    gfs_gust / greatest(gfs_ws_10, 1e-3) AS gfs_gust_factor, gfs_t2m - gfs_dpt2m AS gfs_t_dew_diff, gfs_t2m - gfs_t850 AS gfs_lapse_850,
    sqrt(pow(gfs_u850 - gfs_u10, 2) + pow(gfs_v850 - gfs_v10, 2)) AS gfs_bulk_shear_850 FROM gfs_hub"""
_GFS_MADE = ["gfs_shear_alpha", "gfs_ws_hub", "gfs_air_density", "gfs_wind_power_density", "gfs_gust_factor", "gfs_t_dew_diff",
             "gfs_lapse_850", "gfs_bulk_shear_850"]
_LRHO = "((sp - 0.378e0 * (q2m * sp / (0.62197e0 + 0.37803e0 * q2m))) / (287.05e0 * t2m))"
B.VIEWS["ldaps_grid"] = f"""SELECT *, {_WS} AS ws10, {_DIR.format(u='u10', v='v10')} AS wd10, {_LRHO} AS air_density,
    0.5e0 * {_LRHO} * pow({_WS}, 3) AS wind_power_density, u50_max - u50_min AS u50_range, v50_max - v50_min AS v50_range,
    sqrt(blws_x * blws_x + blws_y * blws_y) AS blws, t2m - dpt2m AS t_dew_diff FROM ldaps"""
B.VIEWS["ldaps_jumped"] = """SELECT *, ws10 - lag(ws10) OVER (PARTITION BY grid_id ORDER BY forecast_kst_dtm) AS ws10_diff_1h,
    max(ws10) OVER (PARTITION BY forecast_kst_dtm) - min(ws10) OVER (PARTITION BY forecast_kst_dtm) AS ws10_spatial_range FROM ldaps_grid"""
_LDAPS_MADE = ["ws10", "wd10", "air_density", "wind_power_density", "u50_range", "v50_range", "blws", "t_dew_diff"]


@query("atmos_indices", f"""SELECT {_KEYS}, {rnds(*_GFS_MADE)}, gfs_gust_factor > 5 AS is_gfs_gust_extreme FROM gfs_grid""")
def atmos_indices(spark, d):
    return rounded(gfs_physics(B.gfs(spark, d)), "forecast_kst_dtm", "grid_id", *_GFS_MADE, "is_gfs_gust_extreme")


@query("grid_physics", f"""SELECT {_KEYS}, {rnds(*_LDAPS_MADE)}, {rnd('ws10 * ws10')} AS ws10_2, {rnd('ws10 * ws10 * ws10')} AS ws10_3 FROM ldaps_grid""")
def grid_physics(spark, d):
    df = ldaps_physics(B.ldaps(spark, d)).withColumns({"ws10_2": F.col("ws10") ** 2, "ws10_3": F.col("ws10") * F.col("ws10") * F.col("ws10")})
    return rounded(df, "forecast_kst_dtm", "grid_id", *_LDAPS_MADE, "ws10_2", "ws10_3")


_KM = ("2 * 6371 * asin(sqrt(pow(sin(radians(37.03e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.03e0)) "
       "* pow(sin(radians(128.93e0 - lon) / 2), 2)))")


@query("haversine_km", f"SELECT turbine, {rnd(_KM)} AS km FROM turbines")
def haversine(spark, d):
    return rounded(B.turbines(spark, d).select("turbine", S.haversine_km("lat", "lon", F.lit(37.03), F.lit(128.93)).alias("km")))


_LEGACY = {"10m": ("u10", "v10"), "50m_max": ("u50_max", "v50_max"), "50m_min": ("u50_min", "v50_min"), "5m": ("blws_x", "blws_y")}


@query("legacy_raw_wind", f"SELECT {_KEYS}, " + ", ".join(
    f"{rnd(f'sqrt({u} * {u} + {v} * {v})')} AS ws_{n}, {rnd(_DIR.format(u=u, v=v))} AS wd_{n}, "
    f"{rnd(f'sin(radians({_DIR.format(u=u, v=v)}))')} AS wd_{n}_sin, {rnd(f'cos(radians({_DIR.format(u=u, v=v)}))')} AS wd_{n}_cos"
    for n, (u, v) in _LEGACY.items()) + " FROM ldaps")
def legacy_raw_wind(spark, d):
    made = {}
    for n, (u, v) in _LEGACY.items():
        made[f"ws_{n}"], made[f"wd_{n}"] = S.wind_speed(u, v), S.wind_direction(u, v)
    df = Se.direction_cycle(B.ldaps(spark, d).withColumns(made), [f"wd_{n}" for n in _LEGACY])
    return rounded(df, "forecast_kst_dtm", "grid_id", *[f"{p}_{n}{s}" for n in _LEGACY for p, s in (
        ("ws", ""), ("wd", ""), ("wd", "_sin"), ("wd", "_cos"))])


_BUCKET = "CASE WHEN {h} <= 8 THEN 'short' WHEN {h} <= 16 THEN 'middle' ELSE 'long' END"


@query("bucketize_hour", f"SELECT event_id, {_BUCKET.format(h='hour(ts)')} AS bucket FROM events")
def bucketize_hour(spark, d):
    return B.table(spark, d, "events").select("event_id", S.hour_bucket(F.hour("ts")).alias("bucket"))


@query("lead_bucket", """SELECT forecast_kst_dtm, grid_id, CASE WHEN dayofyear(forecast_kst_dtm) % 24 < 8 THEN '12-19'
    WHEN dayofyear(forecast_kst_dtm) % 24 < 16 THEN '20-27' ELSE '28-35' END AS bucket FROM ldaps""")
def lead_bucket(spark, d):
    return issue_times(B.ldaps(spark, d)).select("forecast_kst_dtm", "grid_id", S.lead_bucket("lead_hour").alias("bucket"))


_RATIO = "(abs(pred - actual) / capacity)"
_PRICE = f"(CASE WHEN {_RATIO} <= 0.06e0 THEN 4 WHEN {_RATIO} <= 0.08e0 THEN 3 ELSE 0 END)"


@query("unit_price", f"SELECT o_orderkey, {rnd(_PRICE)} AS price FROM predictions")
def unit_price(spark, d):
    ratio = S.error_ratio("pred", "actual", "capacity")
    return rounded(B.predictions(spark, d).select("o_orderkey", S.unit_price(ratio).alias("price")))


_SIG = "(1 / (1 + exp(-40 * ({r} - {e}))))"


@query("soft_price", f"SELECT o_orderkey, {rnd('4 - ' + _SIG.format(r=_RATIO, e='0.06e0') + ' - 3 * ' + _SIG.format(r=_RATIO, e='0.08e0'))} AS price FROM predictions")
def soft_price(spark, d):
    ratio = S.error_ratio("pred", "actual", "capacity")
    return rounded(B.predictions(spark, d).select("o_orderkey", S.soft_price(ratio).alias("price")))


@query("ficr_grad_hess", f"""WITH e AS (SELECT o_orderkey, (pred - actual) / capacity AS e FROM predictions),
    g AS (SELECT *, {_SIG.format(r='abs(e)', e='0.06e0')} AS g1, {_SIG.format(r='abs(e)', e='0.08e0')} AS g2 FROM e)
    SELECT o_orderkey, {rnd('0.7e0 * sign(e) + 0.3e0 * sign(e) * (40 * g1 * (1 - g1) + 120 * g2 * (1 - g2)) / 4')} AS grad,
    {rnd('greatest(0.3e0 * abs((1600 * g1 * (1 - g1) * (1 - 2 * g1) + 4800 * g2 * (1 - g2) * (1 - 2 * g2)) / 4), 0.003e0)')} AS hess FROM g""")
def ficr_grad_hess(spark, d):
    error = (F.col("pred") - F.col("actual")) / F.col("capacity")
    grad, hess = S.settlement_gradient(error)
    return rounded(B.predictions(spark, d).select("o_orderkey", grad.alias("grad"), hess.alias("hess")))


# --- D: quality flags --------------------------------------------------------
@query("ldaps_limits", f"SELECT {_KEYS}, t2m < dpt2m AS is_temp_below_dew, rh2m > 100 AS is_rh_over_100, sp <= 0 AS is_pressure_invalid FROM ldaps")
def ldaps_limits(spark, d):
    return Fl.air_limits(B.ldaps(spark, d)).select("forecast_kst_dtm", "grid_id", "is_temp_below_dew", "is_rh_over_100", "is_pressure_invalid")


@query("gfs_limits", f"""SELECT {_KEYS}, gfs_t2m < gfs_dpt2m AS is_gfs_temp_below_dew, gfs_rh2m > 100 AS is_gfs_rh_over_100,
    gfs_sp <= 0 AS is_gfs_pressure_invalid, gfs_gust_factor > 5 AS is_gfs_gust_extreme FROM gfs_grid""")
def gfs_limits(spark, d):
    df = gfs_physics(Fl.air_limits(B.gfs(spark, d), "gfs_"))
    return df.select("forecast_kst_dtm", "grid_id", "is_gfs_temp_below_dew", "is_gfs_rh_over_100", "is_gfs_pressure_invalid", "is_gfs_gust_extreme")


B.VIEWS["sensor_axis"] = """SELECT t.turbine, a.kst_dtm, s.power_raw, s.ws_raw, s.wd_raw FROM (SELECT DISTINCT turbine FROM sensor_long) t
    CROSS JOIN (SELECT unnest(generate_series(min(kst_dtm), max(kst_dtm), INTERVAL 10 MINUTE)) AS kst_dtm FROM sensor_long) a
    LEFT JOIN sensor_long s ON s.turbine = t.turbine AND s.kst_dtm = a.kst_dtm"""
_LIMITS = """coalesce(abs(power_raw) > cap_kwh10m * 1.05e0, FALSE) AS is_power_outlier,
    coalesce(power_raw < cap_kwh10m * -0.05e0, FALSE) AS is_power_neg_large,
    coalesce(power_raw < 0 AND power_raw >= cap_kwh10m * -0.05e0, FALSE) AS is_power_neg_small,
    coalesce(ws_raw < 0 OR ws_raw > 75, FALSE) AS is_ws_out_of_range, coalesce(ws_raw >= cut_out_ms, FALSE) AS is_cut_out,
    coalesce(ws_raw < 3 AND power_raw <= 0, FALSE) AS is_low_wind_zero_power,
    coalesce(ws_raw >= 5 AND ws_raw < cut_out_ms AND power_raw <= 0, FALSE) AS is_high_wind_zero_power"""


def _flag_views(tag: str, rows: str) -> None:
    """Flags of one source of readings, spelled out with ordinary windows."""
    B.VIEWS[f"limits_{tag}"] = (f'SELECT r.*, t."group", t.cap_kwh10m, t.cut_out_ms, t.swept_area_m2, '
                                f"{_HOUR_END.format(t='r.kst_dtm')} AS hour_end, {_LIMITS} FROM {rows} r LEFT JOIN sensor_turbines t ON r.turbine = t.turbine")
    B.VIEWS[f"runs_{tag}"] = f"""SELECT *, sum(brk) OVER (PARTITION BY turbine ORDER BY kst_dtm) AS run_id FROM (SELECT *,
        CASE WHEN power_raw = lag(power_raw) OVER (PARTITION BY turbine ORDER BY kst_dtm) THEN 0 ELSE 1 END AS brk FROM limits_{tag})"""
    B.VIEWS[f"frozen_{tag}"] = f"""SELECT *, coalesce(count(*) OVER (PARTITION BY turbine, run_id) >= 18 AND power_raw <> 0, FALSE) AS is_frozen_sensor FROM runs_{tag}"""
    B.VIEWS[f"flags_{tag}"] = f"""SELECT * EXCLUDE (brk, run_id), coalesce(abs(CASE WHEN NOT is_power_outlier THEN power_raw END
        - median(CASE WHEN NOT is_power_outlier THEN power_raw END) OVER (PARTITION BY kst_dtm, "group")) > cap_kwh10m * 0.5e0, FALSE)
        AS is_turbine_disagreement FROM frozen_{tag}"""
    bits = " + ".join(f"CAST({f} AS INTEGER) * {1 << i}" for i, f in enumerate(K.QC_FLAGS))
    B.VIEWS[f"coded_{tag}"] = f"SELECT *, CAST({bits} AS BIGINT) AS power_qc_flag FROM flags_{tag}"


_flag_views("axis", "sensor_axis")
_flag_views("stuck", "sensor_frozen")
_LIMIT_FLAGS = ["is_power_outlier", "is_power_neg_large", "is_power_neg_small", "is_ws_out_of_range", "is_cut_out",
                "is_low_wind_zero_power", "is_high_wind_zero_power"]


def readings(spark, d):
    """Long readings on the full axis with turbine columns."""
    return Se.time_axis(Sr.complete_axis(B.sensor_long(spark, d)), B.sensor_turbines(spark, d))


@query("scada_limits", f"SELECT turbine, kst_dtm, {', '.join(_LIMIT_FLAGS)} FROM limits_axis")
def scada_limits(spark, d):
    return Fl.sensor_limits(readings(spark, d)).select("turbine", "kst_dtm", *_LIMIT_FLAGS)


@query("frozen_sensor", "SELECT turbine, kst_dtm, is_frozen_sensor FROM frozen_stuck")
def frozen_sensor(spark, d):
    return Sr.frozen_sensor(B.sensor_frozen(spark, d)).select("turbine", "kst_dtm", "is_frozen_sensor")


@query("turbine_disagreement", "SELECT turbine, kst_dtm, is_turbine_disagreement FROM flags_axis")
def turbine_disagreement(spark, d):
    return Fl.turbine_disagreement(Fl.sensor_limits(readings(spark, d))).select("turbine", "kst_dtm", "is_turbine_disagreement")


@query("qc_bitcode", "SELECT turbine, kst_dtm, power_qc_flag FROM coded_stuck")
def qc_bitcode(spark, d):
    rows = Se.time_axis(B.sensor_frozen(spark, d), B.sensor_turbines(spark, d))
    return rounded(Fl.sensor_flags(rows), "turbine", "kst_dtm", "power_qc_flag")


@query("qc_decode", "SELECT turbine, kst_dtm, is_cut_out AS cut_out, is_power_neg_large AS negative FROM coded_axis")
def qc_decode(spark, d):
    coded = Fl.sensor_flags(readings(spark, d), position=tick("kst_dtm", 600)).select("turbine", "kst_dtm", "power_qc_flag")
    return coded.select("turbine", "kst_dtm", Fl.qc_has("power_qc_flag", "is_cut_out").alias("cut_out"),
                        Fl.qc_has("power_qc_flag", "is_power_neg_large").alias("negative"))


@query("ldaps_jumps", f"""SELECT {_KEYS}, {rnds('ws10_diff_1h', 'ws10_spatial_range')}, coalesce(abs(ws10_diff_1h) > 15, FALSE) AS is_ws_time_jump,
    coalesce(ws10_spatial_range > 10, FALSE) AS is_ws_space_jump FROM ldaps_jumped""")
def ldaps_jumps(spark, d):
    return rounded(Fl.grid_jumps(ldaps_physics(B.ldaps(spark, d))), "forecast_kst_dtm", "grid_id", "ws10_diff_1h",
                   "ws10_spatial_range", "is_ws_time_jump", "is_ws_space_jump")


B.VIEWS["cleaned"] = """SELECT *, CASE WHEN NOT (is_power_outlier OR is_power_neg_large OR is_frozen_sensor) THEN power_raw END AS power_clean,
    CASE WHEN NOT is_ws_out_of_range THEN ws_raw END AS ws_clean, (wd_raw % 360 + 360) % 360 AS wd_clean FROM flags_axis"""


@query("clean_columns", f"SELECT turbine, kst_dtm, {rnds('power_clean', 'ws_clean', 'wd_clean')} FROM cleaned")
def clean_columns(spark, d):
    return rounded(Fl.clean_columns(Fl.sensor_flags(readings(spark, d), position=tick("kst_dtm", 600))), "turbine", "kst_dtm", "power_clean", "ws_clean", "wd_clean")


@query("hour_coverage", """SELECT turbine, kst_dtm, n AS n_valid_in_hour, n BETWEEN 1 AND 5 AS is_partial_missing, n = 0 AS is_full_missing_hour
    FROM (SELECT turbine, kst_dtm, count(power_clean) OVER (PARTITION BY turbine, hour_end) AS n FROM cleaned)""")
def hour_coverage(spark, d):
    clean = Fl.clean_columns(Fl.sensor_flags(readings(spark, d), position=tick("kst_dtm", 600)))
    return rounded(Fl.hour_coverage(clean), "turbine", "kst_dtm", "n_valid_in_hour", "is_partial_missing", "is_full_missing_hour")


@query("signal_guard", f"""SELECT 'ws10' AS "column", {rnd('max(abs(ws10))')} AS peak, max(abs(ws10)) > 0 AS has_signal FROM ldaps_grid
    UNION ALL SELECT 'flat', {rnd('max(abs(lsm * 0))')}, FALSE FROM ldaps_grid""")
def signal_guard(spark, d):
    df = ldaps_physics(B.ldaps(spark, d)).withColumn("flat", F.col("lsm") * 0)
    return rounded(C.signal_guard(C.require_signal(df, ["ws10"]), ["ws10", "flat"]))


@query("submission_checks", """SELECT count(*) AS n_rows, CAST(sum((kpx_group_1 IS NULL)::INT + (kpx_group_2 IS NULL)::INT + (kpx_group_3 IS NULL)::INT) AS BIGINT) AS n_null,
    CAST(sum((coalesce(kpx_group_1, 0) < 0)::INT + (coalesce(kpx_group_2, 0) < 0)::INT + (coalesce(kpx_group_3, 0) < 0)::INT) AS BIGINT) AS n_negative, CAST(sum((coalesce(kpx_group_1, 0) > 1000000)::INT + (coalesce(kpx_group_2, 0) > 1000000)::INT + (coalesce(kpx_group_3, 0) > 1000000)::INT) AS BIGINT) AS n_above_capacity,
    count(DISTINCT kpx_group_1) > 1 AS varies_kpx_group_1, count(DISTINCT kpx_group_2) > 1 AS varies_kpx_group_2, count(DISTINCT kpx_group_3) > 1 AS varies_kpx_group_3, (SELECT count(DISTINCT l_shipdate) FROM lineitem) AS n_expected,
    TRUE AS columns_equal FROM labels_wide""")
def submission_checks(spark, d):
    labels = B.labels_wide(spark, d)
    sample = B.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("kst_dtm")).distinct().withColumns(
        {g: F.lit(0.0) for g in K.GROUPS})
    return rounded(C.submission_violations(labels, sample, {g: 1_000_000.0 for g in K.GROUPS}))
