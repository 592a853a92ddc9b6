"""Joins, aggregations and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators import sensor as Se
from zephyrgrid.operators import series as Sr
from zephyrgrid.operators import spatial as Sa
from zephyrgrid.operators import stats as Q
from zephyrgrid.operators.ordering import tick
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans import features as Ft
from zephyrgrid.plans.bindings import rnd, rnds, rounded
from zephyrgrid.plans.column_queries import _DIR, _WRAP
from zephyrgrid.plans.physics import issue_times
from zephyrgrid.plans.registry import query
from zephyrgrid.plans.source_queries import result_rows
from zephyrgrid.session import attach, stable
from zephyrgrid.sources.catalog import file_versions

TS = "forecast_kst_dtm"
_GT = f'"group", {TS}'

# --- spatial views -----------------------------------------------------------
B.VIEWS["grid_places"] = "SELECT DISTINCT grid_id, latitude, longitude FROM ldaps"
B.VIEWS["near_pairs"] = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turbine ORDER BY round(distance_km, 9), grid_id) AS rank FROM
    (SELECT t.turbine, t."group", t.cap_kw, g.grid_id, 2 * 6371 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) AS distance_km
    FROM turbines t CROSS JOIN grid_places g)) WHERE rank <= 4"""
B.VIEWS["turbine_shares"] = """SELECT *, (1 / pow(greatest(distance_km, 1e-6), 2)) / sum(1 / pow(greatest(distance_km, 1e-6), 2))
    OVER (PARTITION BY turbine) AS share FROM near_pairs"""
B.VIEWS["group_shares"] = """SELECT a."group", a.grid_id, coalesce(s.total, 0) / (c.cap + 1e-8) AS w
    FROM (SELECT DISTINCT t."group", g.grid_id FROM turbines t, grid_places g) a
    JOIN (SELECT "group", sum(cap_kw) AS cap FROM turbines GROUP BY 1) c ON a."group" = c."group"
    LEFT JOIN (SELECT "group", grid_id, sum(cap_kw * share) AS total FROM turbine_shares GROUP BY 1, 2) s
    ON a."group" = s."group" AND a.grid_id = s.grid_id"""


def _area_sql(rows: str, features: list[str]) -> str:
    cells = ", ".join(f"CASE WHEN count({f}) = (SELECT count(*) FROM grid_places) THEN sum(w * {f}) END AS {f}" for f in features)
    return f'SELECT g.{TS}, s."group", {cells} FROM {rows} g JOIN group_shares s ON g.grid_id = s.grid_id GROUP BY 1, 2'


_CYC = ", ".join(f"{f}(2 * pi() * {x}({TS}) / {n}) AS {a}_{f}" for a, x, n in (
    ("hour", "hour", "24e0"), ("doy", "dayofyear", "365.25e0")) for f in ("sin", "cos"))
_META = f"""date_trunc('day', data_available_kst_dtm)::TIMESTAMP AS forecast_issue_date, hour({TS}) AS target_hour,
    epoch_us({TS} - data_available_kst_dtm) / 3.6e9 AS"""
_SEAS = f"CASE (month({TS}) % 12) // 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season"
B.VIEWS["ldaps_means"] = _area_sql("ldaps_jumped", K.LDAPS_AREA_FEATURES)
B.VIEWS["ldaps_dirs"] = f"SELECT *, sqrt(u10 * u10 + v10 * v10) AS ws10_vector, {_DIR.format(u='u10', v='v10')} AS wd10, ws10 * ws10 AS ws10_2, pow(ws10, 3) AS ws10_3 FROM ldaps_means"
B.VIEWS["ldaps_areas"] = f"""SELECT a.*, sin(radians(wd10)) AS wd10_sin, cos(radians(wd10)) AS wd10_cos, {_CYC}, month({TS}) AS month, {_SEAS},
    m.lead_hour, m.target_hour, m.forecast_issue_date FROM ldaps_dirs a JOIN (SELECT DISTINCT {TS} AS mts, {_META} lead_hour FROM ldaps) m ON a.{TS} = m.mts"""
B.VIEWS["gfs_means"] = _area_sql("gfs_grid", K.GFS_AREA_FEATURES)
_AREA_LEVELS = [n for n, (u, v) in K.GFS_LEVELS.items() if {u, v} <= set(K.GFS_AREA_FEATURES)]
B.VIEWS["gfs_dirs"] = "SELECT *, " + ", ".join(
    f"{_DIR.format(u=K.GFS_LEVELS[n][0], v=K.GFS_LEVELS[n][1])} AS gfs_wd_{n}" for n in _AREA_LEVELS) + \
    ", gfs_ws_hub * gfs_ws_hub AS gfs_ws_hub_2, pow(gfs_ws_hub, 3) AS gfs_ws_hub_3 FROM gfs_means"
B.VIEWS["gfs_areas"] = "SELECT a.*, " + ", ".join(
    f"sin(radians(gfs_wd_{n})) AS gfs_wd_{n}_sin, cos(radians(gfs_wd_{n})) AS gfs_wd_{n}_cos" for n in _AREA_LEVELS) + \
    f""", {_CYC}, month({TS}) AS month, {_SEAS}, m.gfs_lead_hour, m.target_hour, m.forecast_issue_date
    FROM gfs_dirs a JOIN (SELECT DISTINCT {TS} AS mts, {_META} gfs_lead_hour FROM gfs) m ON a.{TS} = m.mts"""


def _ramp_view(rows: str, ws: str, u: str, v: str, wd: str, p: str) -> str:
    w = f'(PARTITION BY "group" ORDER BY {TS})'
    nxt = f'(PARTITION BY "group" ORDER BY {TS} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)'
    return f"""SELECT *, {ws} - lag({ws}) OVER {w} AS {p}_ws_diff_1h, {ws} - lag({ws}, 3) OVER {w} AS {p}_ws_diff_3h,
        {u} - lag({u}) OVER {w} AS {p}_u_diff_1h, {v} - lag({v}) OVER {w} AS {p}_v_diff_1h, abs({ws} - lag({ws}) OVER {w}) AS {p}_ws_ramp_rate,
        max({ws}) OVER {nxt} AS {p}_ws_next3h_max, min({ws}) OVER {nxt} AS {p}_ws_next3h_min,
        abs({_WRAP.format(a=wd, b=f'lag({wd}) OVER {w}')}) AS {p}_wd_rotation FROM {rows}"""


B.VIEWS["ldaps_ramps"] = _ramp_view("ldaps_areas", "ws10", "u10", "v10", "wd10", "ldaps")
B.VIEWS["gfs_ramps"] = _ramp_view("gfs_areas", "gfs_ws_hub", "gfs_u100", "gfs_v100", "gfs_wd_100", "gfs")
RAMPS = ["ws_diff_1h", "ws_diff_3h", "u_diff_1h", "v_diff_1h", "ws_ramp_rate", "ws_next3h_max", "ws_next3h_min", "wd_rotation"]


def grid_places(spark, d, means=None):
    return Sa.grid_coordinates(B.ldaps(spark, d, means))


_weights: dict[tuple, object] = {}


def weights(spark, d, means=None):
    """Group weights, written once per session and set of files: they depend on places only."""
    key = (spark.sparkContext.applicationId, d, file_versions(spark, [f"{d}/{t}.parquet" for t in ("lineitem", "supplier")]))
    if key not in _weights:
        _weights[key] = Sa.group_weights(B.turbines(spark, d), grid_places(spark, d, means))
    return _weights[key]


def area(spark, d, source):
    return Ft.area_table(source, {"ldaps": B.ldaps_raw, "gfs": B.gfs_raw}[source](spark, d), weights(spark, d))


def ramped(spark, d, source):
    return Sr.forecast_ramps(stable(area(spark, d, source)), source)


# --- E: joins ----------------------------------------------------------------
_JOINED = ["u10", "ws10", "gfs_ws_hub", "gfs_t2m", "hour_sin_ldaps", "hour_sin_gfs", "doy_cos_ldaps", "doy_cos_gfs"]


@query("join_ldaps_gfs", f"""SELECT l."group", l.{TS}, {rnd('l.u10')} AS u10, {rnd('l.ws10')} AS ws10, {rnd('g.gfs_ws_hub')} AS gfs_ws_hub,
    {rnd('g.gfs_t2m')} AS gfs_t2m, {rnd('l.hour_sin')} AS hour_sin_ldaps, {rnd('g.hour_sin')} AS hour_sin_gfs, {rnd('l.doy_cos')} AS doy_cos_ldaps,
    {rnd('g.doy_cos')} AS doy_cos_gfs FROM ldaps_areas l JOIN gfs_areas g ON l."group" = g."group" AND l.{TS} = g.{TS}""")
def join_ldaps_gfs(spark, d):
    w = weights(spark, d)
    both = C.join_by_key(Ft.area_table("ldaps", B.ldaps_raw(spark, d), w), Ft.area_table("gfs", B.gfs_raw(spark, d), w),
                         ["group", TS], "inner")
    return rounded(both, "group", TS, *_JOINED)


@query("join_labels", f"""SELECT a."group", a.{TS}, {rnd('a.ws10')} AS ws10, {rnd('l.target')} AS target FROM ldaps_means a
    JOIN labels_long l ON a."group" = l."group" AND a.{TS} = l.{TS}""")
def join_labels(spark, d):
    labels = C.labels_long(B.labels_wide(spark, d))
    return rounded(area(spark, d, "ldaps").join(labels, ["group", TS]), "group", TS, "ws10", "target")


@query("join_turbine_meta", f"""SELECT s.turbine, s.kst_dtm, {rnd('power_raw')} AS power_raw, t."group", t.model, t.cap_kwh10m, t.cut_out_ms, t.swept_area_m2
    FROM sensor_long s LEFT JOIN sensor_turbines t ON s.turbine = t.turbine""")
def join_turbine_meta(spark, d):
    df = C.join_turbines(B.sensor_long(spark, d), B.sensor_turbines(spark, d), Se.TURBINE_COLUMNS)
    return rounded(df, "turbine", "kst_dtm", "power_raw", "group", "model", "cap_kwh10m", "cut_out_ms", "swept_area_m2")


@query("join_time_meta", f"""SELECT {_GT}, {rnd('lead_hour')} AS lead_hour, target_hour, forecast_issue_date, month, season,
    {rnds('doy_sin', 'doy_cos')} FROM ldaps_areas""")
def join_time_meta(spark, d):
    grid = issue_times(B.ldaps(spark, d))
    means = Sa.area_means(grid, ["u10"], weights(spark, d))
    df = Sa.time_meta(means, grid, ["lead_hour", "target_hour", "forecast_issue_date", "absent"])
    return rounded(df, "group", TS, "lead_hour", "target_hour", "forecast_issue_date", "month", "season", "doy_sin", "doy_cos")


@query("cross_turbine_grid", f"SELECT turbine, grid_id, {rnd('distance_km')} AS distance_km, rank FROM near_pairs")
def cross_turbine_grid(spark, d):
    return rounded(Sa.nearest_grid(B.turbines(spark, d), grid_places(spark, d)))


@query("knn_grid", f"SELECT turbine, grid_id, {rnd('share')} AS w FROM turbine_shares")
def knn_grid(spark, d):
    near = Sa.nearest_grid(B.turbines(spark, d), grid_places(spark, d))
    return rounded(Sa.turbine_weights(near), "turbine", "grid_id", "w")


@query("lookup_map", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, t."group", t.cap_kw FROM lineitem
    LEFT JOIN turbines t ON t.turbine = 'wtg' || l_suppkey""")
def lookup_map(spark, d):
    rows = B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("wtg"), F.col("l_suppkey").cast("string")).alias("turbine"))
    return rounded(attach(rows, B.turbines(spark, d), ["turbine"]), "l_orderkey", "l_linenumber", "group", "cap_kw")


@query("align_reindex", f"""SELECT c_custkey, {rnd('total / 1e6')} AS total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total
    FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def align_reindex(spark, d):
    totals = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    order = B.table(spark, d, "customer").select("c_custkey")
    return rounded(order.join(totals, "c_custkey", "left").withColumn("total", F.col("total") / F.lit(1e6)))


@query("time_axis_complete", f"SELECT turbine, kst_dtm, {rnds('power_raw', 'ws_raw', 'wd_raw')} FROM sensor_axis")
def time_axis_complete(spark, d):
    return rounded(Sr.complete_axis(B.sensor_long(spark, d)))


# --- sensor chain views ------------------------------------------------------
def _fill_view(rows: str, column: str, out: str, mask: str) -> str:
    """Runs are measured as a whole and filled between the nearest values on both sides."""
    w = "(PARTITION BY turbine ORDER BY kst_dtm ROWS BETWEEN {} )"
    before, after = w.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), w.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    return f"""SELECT * EXCLUDE (rn_, il_, xl_, yl_, xr_, yr_), coalesce({column} IS NULL AND il_ <= 2 AND xl_ IS NOT NULL AND xr_ IS NOT NULL, FALSE) AS {mask},
        CASE WHEN {column} IS NULL AND il_ <= 2 THEN yl_ + (yr_ - yl_) * (rn_ - xl_) / (xr_ - xl_) ELSE {column} END AS {out}
        FROM (SELECT * EXCLUDE (ig_), count(*) OVER (PARTITION BY turbine, {column} IS NULL, ig_) AS il_,
        max(CASE WHEN {column} IS NOT NULL THEN rn_ END) OVER {before} AS xl_, min(CASE WHEN {column} IS NOT NULL THEN rn_ END) OVER {after} AS xr_,
        last_value({column} IGNORE NULLS) OVER {before} AS yl_, first_value({column} IGNORE NULLS) OVER {after} AS yr_
        FROM (SELECT *, rn_ - row_number() OVER (PARTITION BY turbine, {column} IS NULL ORDER BY kst_dtm) AS ig_
        FROM (SELECT *, row_number() OVER (PARTITION BY turbine ORDER BY kst_dtm) AS rn_ FROM {rows})))"""


B.VIEWS["filled_power"] = _fill_view("cleaned", "power_clean", "power_filled", "is_power_interpolated")
B.VIEWS["filled_wind"] = _fill_view("filled_power", "ws_clean", "ws_filled", "is_ws_interpolated")
B.VIEWS["wind_parts"] = "SELECT *, -ws_filled * sin(radians(wd_clean)) AS u_part, -ws_filled * cos(radians(wd_clean)) AS v_part FROM filled_wind"
B.VIEWS["filled_u"] = _fill_view("wind_parts", "u_part", "u_scada", "is_u_interpolated")
B.VIEWS["sensor_ready"] = _fill_view("filled_u", "v_part", "v_scada", "is_v_interpolated")
B.VIEWS["hourly_turbine"] = """SELECT turbine, hour_end, count(power_filled) AS n_valid, coalesce(sum(power_filled), 0) AS power_sum_all,
    avg(ws_filled) AS ws_mean, stddev_samp(ws_filled) AS ws_std, max(ws_filled) AS ws_max, avg(u_scada) AS u_mean, avg(v_scada) AS v_mean,
    bool_or(is_high_wind_zero_power) AS is_high_wind_zero, bool_or(is_cut_out) AS is_cut_out_hour, bool_or(is_power_outlier) AS is_outlier_hour,
    bool_or(is_power_interpolated) AS is_interp_hour, quantile_cont(ws_filled, 0.25) AS ws_q25, quantile_cont(ws_filled, 0.75) AS ws_q75,
    any_value("group") AS "group", any_value(cap_kwh10m) AS cap_kwh10m, CASE WHEN count(power_filled) >= 6 THEN sum(power_filled) END AS power_sum_strict,
    CASE WHEN count(power_filled) >= 5 THEN sum(power_filled) * 6 / count(power_filled) END AS power_sum_relaxed FROM sensor_ready GROUP BY 1, 2"""
B.VIEWS["hourly_group_base"] = """SELECT h.hour_end, m."group", m.n_members, m.cap_sum,
    CASE WHEN count(t.power_sum_strict) = m.n_members THEN sum(t.power_sum_strict) END AS scada_power_kwh,
    CASE WHEN count(t.power_sum_relaxed) = m.n_members THEN sum(t.power_sum_relaxed) END AS scada_power_kwh_relaxed,
    coalesce(sum(t.n_valid), 0) / (6 * m.n_members) AS coverage_ratio,
    coalesce(sum(CASE WHEN t.n_valid >= 6 THEN t.cap_kwh10m END), 0) / (m.cap_sum + 1e-8) AS avail_cap_ratio,
    avg(t.ws_mean) AS scada_ws_scalar, stddev_samp(t.ws_mean) AS scada_ws_std, avg(t.u_mean) AS scada_u, avg(t.v_mean) AS scada_v
    FROM (SELECT DISTINCT hour_end FROM hourly_turbine) h
    CROSS JOIN (SELECT "group", count(*) AS n_members, sum(cap_kwh10m) AS cap_sum FROM (SELECT DISTINCT "group", turbine, cap_kwh10m FROM hourly_turbine) GROUP BY 1) m
    LEFT JOIN hourly_turbine t ON t.hour_end = h.hour_end AND t."group" = m."group" GROUP BY h.hour_end, m."group", m.n_members, m.cap_sum"""
B.VIEWS["hourly_group_wind"] = "SELECT *, sqrt(scada_u * scada_u + scada_v * scada_v) AS scada_ws_vector FROM hourly_group_base"
B.VIEWS["hourly_group"] = f"""SELECT *, {_DIR.format(u='scada_u', v='scada_v')} AS scada_wd,
    least(scada_ws_vector / (scada_ws_scalar + 1e-8), CASE WHEN scada_ws_scalar IS NOT NULL THEN 1 END) AS scada_dir_resultant,
    scada_power_kwh / (cap_sum * 6) AS capacity_factor FROM hourly_group_wind"""


def sensor_ready(spark, d):
    return Ft.prepare("scada", B.sensor_long(spark, d), B.sensor_turbines(spark, d))


def hourly(spark, d):
    return Se.turbine_hourly(sensor_ready(spark, d))


@query("dir_valid", "SELECT turbine, kst_dtm, coalesce(ws_filled >= 1, FALSE) AS dir_valid FROM sensor_ready")
def dir_valid(spark, d):
    return sensor_ready(spark, d).select("turbine", "kst_dtm", "dir_valid")


_HOURLY = ["power_sum_all", "ws_mean", "ws_std", "ws_max", "u_mean", "v_mean", "ws_q25", "ws_q75", "power_sum_strict", "power_sum_relaxed"]
_ANY = ["is_high_wind_zero", "is_cut_out_hour", "is_outlier_hour", "is_interp_hour"]


@query("join_quantiles", f"SELECT turbine, hour_end, {rnds('ws_q25', 'ws_q75')} FROM hourly_turbine")
def join_quantiles(spark, d):
    return rounded(hourly(spark, d), "turbine", "hour_end", "ws_q25", "ws_q75")


# --- F: aggregations and reshaping -------------------------------------------
@query("idw_weights", f'SELECT "group", grid_id, {rnd("w")} AS w FROM group_shares')
def idw_weights(spark, d):
    return rounded(Sa.group_weights(B.turbines(spark, d), grid_places(spark, d)))


_FEW = ["u10", "v10", "t2m", "q2m"]


@query("idw_group_feature", f"SELECT {_GT}, {rnds(*_FEW)} FROM ldaps_means")
def idw_group_feature(spark, d):
    return rounded(Sa.area_means(B.ldaps(spark, d), _FEW, weights(spark, d)), "group", TS, *_FEW)


_L_AREA = [*K.LDAPS_AREA_FEATURES, "ws10_vector", "wd10", "wd10_sin", "wd10_cos", "ws10_2", "ws10_3", "lead_hour", "hour_cos", "doy_sin"]
_G_AREA = [*K.GFS_AREA_FEATURES, *[f"gfs_wd_{n}{s}" for n in _AREA_LEVELS for s in ("", "_sin", "_cos")], "gfs_ws_hub_2", "gfs_lead_hour", "doy_sin"]


@query("ldaps_group_idw", f"SELECT {_GT}, {rnds(*_L_AREA)}, target_hour, month, season, forecast_issue_date FROM ldaps_areas")
def ldaps_group_idw(spark, d):
    return rounded(area(spark, d, "ldaps"), "group", TS, *_L_AREA, "target_hour", "month", "season", "forecast_issue_date")


@query("gfs_group_idw", f"SELECT {_GT}, {rnds(*_G_AREA)}, {rnd('gfs_ws_hub_3 / 1000')} AS hub_cubed, target_hour, season FROM gfs_areas")
def gfs_group_idw(spark, d):
    df = area(spark, d, "gfs").withColumn("hub_cubed", F.col("gfs_ws_hub_3") / 1000)
    return rounded(df, "group", TS, *_G_AREA, "hub_cubed", "target_hour", "season")


_STATS = ", ".join(f"{rnd(f'{fn}({c})')} AS ldaps_{c}_{n}" for c in K.LDAPS_STAT_FEATURES
                   for fn, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))
_QUARTS = ", ".join(f"{rnd(f'quantile_cont(ws10, {s})')} AS ldaps_ws10_{n}" for s, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))


@query("grid_stats", f"""SELECT {TS}, {_STATS}, {_QUARTS}, {rnd('avg(ws10 * ws10)')} AS ldaps_mean_ws2, {rnd('avg(pow(ws10, 3))')} AS ldaps_mean_ws3,
    {rnd('avg(air_density * pow(ws10, 3))')} AS ldaps_mean_rho_ws3, {rnd('max(ws10) - min(ws10)')} AS ldaps_ws10_range,
    {rnd(_DIR.format(u='avg(u10)', v='avg(v10)'))} AS ldaps_wd10 FROM ldaps_grid GROUP BY 1""")
def grid_stats(spark, d):
    from zephyrgrid.plans.physics import ldaps_physics
    return rounded(Sa.grid_statistics(ldaps_physics(B.ldaps(spark, d))))


@query("turbine_hourly", f'SELECT turbine, hour_end, n_valid, "group", {rnds(*_HOURLY)}, {", ".join(_ANY)} FROM hourly_turbine')
def turbine_hourly(spark, d):
    return rounded(hourly(spark, d), "turbine", "hour_end", "n_valid", "group", *_HOURLY, *_ANY)


_GROUPED = ["scada_power_kwh", "scada_power_kwh_relaxed", "coverage_ratio", "avail_cap_ratio", "scada_ws_scalar", "scada_ws_vector",
            "scada_ws_std", "scada_u", "scada_v", "scada_wd", "scada_dir_resultant", "capacity_factor"]


@query("group_hourly", f"""SELECT "group", hour_end, {rnds(*_GROUPED)},
    {rnd("CASE WHEN scada_dir_resultant < 0.999999 THEN degrees(sqrt(-2 * ln(greatest(scada_dir_resultant, 1e-6)))) WHEN scada_dir_resultant IS NOT NULL THEN 0 END")}
    AS scada_dir_spread FROM hourly_group""")
def group_hourly(spark, d):
    df = Se.group_hourly(hourly(spark, d))
    # a square root at its zero magnifies the last bit, so full agreement is written as 0
    calm = F.when(F.col("scada_dir_resultant") < 0.999999, F.col("scada_dir_spread"))
    df = df.withColumn("scada_dir_spread", F.coalesce(calm, F.when(F.col("scada_dir_resultant").isNotNull(), 0.0)))
    return rounded(df, "group", "hour_end", *_GROUPED, "scada_dir_spread")


@query("wide_to_long", " UNION ALL ".join(
    f"""SELECT s.kst_dtm, '{t}' AS turbine, {rnd('r.power_raw')} AS power_raw, {rnd('r.ws_raw')} AS ws_raw, {rnd('r.wd_raw')} AS wd_raw
    FROM (SELECT DISTINCT kst_dtm FROM sensor_long) s LEFT JOIN sensor_long r ON r.kst_dtm = s.kst_dtm AND r.turbine = '{t}'"""
    for t in ("wtg0", "wtg1", "wtg2")))
def wide_to_long(spark, d):
    return rounded(Se.wide_to_long(B.sensor_wide(spark, d), ["wtg0", "wtg1", "wtg2"]))


@query("long_to_wide", f"""SELECT hour_end, {", ".join(f"{rnd(f'max(CASE WHEN turbine = {chr(39)}{t}{chr(39)} THEN ws_mean END)')} AS {t}"
    for t in ("wtg0", "wtg1", "wtg2"))} FROM hourly_turbine GROUP BY 1""")
def long_to_wide(spark, d):
    return rounded(Se.long_to_wide(hourly(spark, d), "hour_end", "turbine", "ws_mean", ["wtg0", "wtg1", "wtg2"]))


_SCALED = ["u", "v", "t2m", "sp"]


@query("scale_params", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std FROM obs WHERE l_linenumber <= 4" for c in _SCALED)
    + " UNION ALL SELECT 'flat', 1, 1 FROM obs WHERE l_linenumber <= 4 LIMIT 5")
def scale_params(spark, d):
    train = B.obs(spark, d).filter("l_linenumber <= 4").withColumn("flat", F.lit(1.0))
    return rounded(Q.scale_params(train, [*_SCALED, "flat"]))


_P = "(SELECT {}({}) FROM obs WHERE l_linenumber <= 4)"


@query("standardise", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(
    f"{rnd('(' + c + ' - ' + _P.format('avg', c) + ') / ' + _P.format('stddev_samp', c))} AS {c}" for c in _SCALED) + " FROM obs")
def standardise(spark, d):
    rows = B.obs(spark, d)
    params = Q.as_dict(Q.scale_params(rows.filter("l_linenumber <= 4"), _SCALED))
    return rounded(Q.standardise(rows, params), "l_orderkey", "l_linenumber", *_SCALED)


@query("inverse_scale", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rnds('u', 't2m')} FROM obs")
def inverse_scale(spark, d):
    rows = B.obs(spark, d)
    params = Q.as_dict(Q.scale_params(rows, ["u", "t2m"]))
    scaled = Q.standardise(rows, params)
    back = {c: Q.unstandardise(F.col(c), params[c]) for c in ("u", "t2m")}
    return rounded(scaled.withColumns(back), "l_orderkey", "l_linenumber", "u", "t2m")


@query("minmax_scale", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, " + ", ".join(
    f"{rnd('(' + c + ' - ' + _P.format('min', c) + ') / (' + _P.format('max', c) + ' - ' + _P.format('min', c) + ')')} AS {c}" for c in _SCALED)
    + " FROM obs")
def minmax_scale(spark, d):
    rows = B.obs(spark, d)
    params = Q.as_dict(Q.minmax_params(rows.filter("l_linenumber <= 4"), _SCALED))
    return rounded(Q.minmax_scale(rows, params), "l_orderkey", "l_linenumber", *_SCALED)


_HOLED = "(SELECT l_orderkey, l_linenumber, CASE WHEN wd <= 300 THEN u END AS u, CASE WHEN wd2 >= 50 THEN t2m END AS t2m FROM obs)"


@query("median_impute", f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {", ".join(
    rnd(f"coalesce({c}, (SELECT median({c}) FROM {_HOLED} WHERE l_linenumber <= 4))") + f" AS {c}" for c in ("u", "t2m"))} FROM {_HOLED}""")
def median_impute(spark, d):
    rows = B.obs(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("wd") <= 300, F.col("u")).alias("u"),
                                  F.when(F.col("wd2") >= 50, F.col("t2m")).alias("t2m"))
    found = Q.as_dict(Q.medians(rows.filter("l_linenumber <= 4"), ["u", "t2m"]))
    return rounded(Q.impute(rows, {c: found[c][0] for c in ("u", "t2m")}))


@query("describe", " UNION ALL ".join(
    f"""SELECT turbine, '{c}' AS "column", count({c}) AS "count", {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std, {rnd(f'min({c})')} AS min,
    {rnd(f'max({c})')} AS max, {rnd(f'quantile_cont({c}, 0.25)')} AS q25, {rnd(f'quantile_cont({c}, 0.5)')} AS q50, {rnd(f'quantile_cont({c}, 0.75)')} AS q75
    FROM sensor_long GROUP BY 1""" for c in ("power_raw", "ws_raw")))
def describe(spark, d):
    return rounded(Q.describe(B.sensor_long(spark, d), ["power_raw", "ws_raw"], ["turbine"]))


@query("value_counts", f"""SELECT event_type, count(*) AS "count", {rnd('count(*) / sum(count(*)) OVER ()')} AS share FROM events GROUP BY 1""")
def value_counts(spark, d):
    return rounded(Q.value_counts(B.table(spark, d, "events"), "event_type", share=True))


@query("count_distinct", """SELECT model_name, count(DISTINCT "group") AS n_groups, count(DISTINCT round(pred * 100)) AS n_predictions FROM predictions GROUP BY 1""")
def count_distinct(spark, d):
    return rounded(B.predictions(spark, d).groupBy("model_name").agg(
        F.count_distinct("group").alias("n_groups"), F.count_distinct(F.round(F.col("pred") * 100)).alias("n_predictions")))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("score_pivot", 'SELECT "group", ' + ", ".join(
    f"""{rnd(f"max(CASE WHEN model_name = '{p}' THEN score END)")} AS "{p}" """ for p in _PRIORITIES) + " FROM result_rows GROUP BY 1")
def score_pivot(spark, d):
    return rounded(Q.score_pivot(result_rows(spark, d), _PRIORITIES))


@query("empirical_power_curve", f"""WITH c AS (SELECT t.model, floor(ws_raw / 0.5e0) * 0.5e0 AS ws_bin, median(power_raw) AS m, count(*) AS n FROM sensor_long s
    JOIN sensor_turbines t ON s.turbine = t.turbine GROUP BY 1, 2)
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {rnd('CASE WHEN ws_high >= 3 AND ws_high < 22.5 THEN m ELSE 0 END * 12')} AS curve_power
    FROM obs LEFT JOIN c ON c.ws_bin = floor(ws_high / 0.5e0) * 0.5e0""")
def empirical_power_curve(spark, d):
    points = Se.time_axis(B.sensor_long(spark, d), B.sensor_turbines(spark, d))
    curve = Q.power_curve(points, "ws_raw", "power_raw", "model")
    rows = B.obs(spark, d).withColumn("model", F.lit("V126"))
    return rounded(Q.curve_power(rows, curve, "ws_high", "model", K.CUT_IN, 22.5, 12.0), "l_orderkey", "l_linenumber", "curve_power")


# --- H: windows --------------------------------------------------------------
def _ramp_names(*parts):
    return [f"ldaps_{p}" for p in parts]


@query("ramp_diff", f"SELECT {_GT}, {rnds(*_ramp_names(*RAMPS[:5]))} FROM ldaps_ramps")
def ramp_diff(spark, d):
    return rounded(ramped(spark, d, "ldaps"), "group", TS, *_ramp_names(*RAMPS[:5]))


@query("next3h_extrema", f"SELECT {_GT}, {rnds(*_ramp_names(*RAMPS[5:7]))} FROM ldaps_ramps")
def next3h_extrema(spark, d):
    return rounded(ramped(spark, d, "ldaps"), "group", TS, *_ramp_names(*RAMPS[5:7]))


@query("direction_rotation", f"SELECT {_GT}, {rnds('ldaps_wd_rotation')} FROM ldaps_ramps")
def direction_rotation(spark, d):
    return rounded(ramped(spark, d, "ldaps"), "group", TS, "ldaps_wd_rotation")


@query("forecast_feature", f"SELECT {_GT}, {rnds(*[f'gfs_{r}' for r in RAMPS])} FROM gfs_ramps")
def forecast_feature(spark, d):
    return rounded(ramped(spark, d, "gfs"), "group", TS, *[f"gfs_{r}" for r in RAMPS])


@query("gap_runs", """SELECT turbine, min(kst_dtm) AS gap_start, max(kst_dtm) AS gap_end, count(*) AS run_len FROM (SELECT *,
    row_number() OVER (PARTITION BY turbine ORDER BY kst_dtm) - row_number() OVER (PARTITION BY turbine, power_raw IS NULL ORDER BY kst_dtm) AS g
    FROM sensor_axis) WHERE power_raw IS NULL GROUP BY turbine, g""")
def gap_runs(spark, d):
    return rounded(Sr.gap_runs(Sr.complete_axis(B.sensor_long(spark, d)), "power_raw"))


B.VIEWS["axis_filled"] = _fill_view("sensor_axis", "power_raw", "filled", "is_filled")


@query("interpolate_short_gap", f"SELECT turbine, kst_dtm, {rnd('filled')} AS filled, is_filled FROM axis_filled")
def interpolate_short_gap(spark, d):
    axis = Sr.complete_axis(B.sensor_long(spark, d))
    filled = Sr.fill_short_gaps(axis, [("power_raw", "filled", "is_filled")], position=tick("kst_dtm", 600))
    return rounded(filled, "turbine", "kst_dtm", "filled", "is_filled")


@query("scada_interpolation", f"""SELECT turbine, kst_dtm, {rnds('power_filled', 'ws_filled', 'u_scada', 'v_scada')}, is_power_interpolated, is_ws_interpolated,
    is_u_interpolated FROM sensor_ready""")
def scada_interpolation(spark, d):
    return rounded(sensor_ready(spark, d), "turbine", "kst_dtm", "power_filled", "ws_filled", "u_scada", "v_scada",
                   "is_power_interpolated", "is_ws_interpolated", "is_u_interpolated")


DAY = 86_400
B.VIEWS["dataset"] = f"""SELECT a.*, l.target FROM ldaps_ramps a LEFT JOIN labels_long l ON a."group" = l."group" AND a.{TS} = l.{TS}"""
B.VIEWS["dataset_axis"] = f"""SELECT x."group", x.{TS}, d.* EXCLUDE ("group", {TS}) FROM (SELECT "group", unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS {TS}
    FROM (SELECT DISTINCT "group" FROM dataset), (SELECT min({TS}) AS lo, max({TS}) AS hi FROM dataset)) x
    LEFT JOIN dataset d ON x."group" = d."group" AND x.{TS} = d.{TS}"""
SEQ = ["u10", "v10", "ws10"]
# known at every stamp; missing where a grid point is; and the measured power, missing where nothing was reported
SEQ_INPUTS = {"calendar": ["doy_sin", "doy_cos", "month"], "wind": SEQ, "measured": ["target", "doy_sin", "doy_cos"]}


def dataset(spark, d):
    """Area features and ramps of every stamp, with the label where there is one."""
    labels = C.labels_long(B.labels_wide(spark, d))
    return ramped(spark, d, "ldaps").join(labels, ["group", TS], "left")


def _sequence_sql(first: str, last: str) -> str:
    w = f'(PARTITION BY "group" ORDER BY {TS} ROWS BETWEEN {first} AND {last})'
    parts = []
    for name, (a, b, c) in SEQ_INPUTS.items():
        known = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL THEN 1 END"
        wide = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
        parts.append(f"""SELECT {_GT}, '{name}' AS inputs, CAST(24 AS BIGINT) AS seq_rows, {rnd('s_first')} AS first_a, {rnd('s_last')} AS last_c,
            {rnd('s_sum')} AS sum_b, {rnd('target / 1e6')} AS target FROM (SELECT *, count({known}) OVER {w} AS n, first_value({wide(a)}) OVER {w} AS s_first,
            last_value({wide(c)}) OVER {w} AS s_last, sum({wide(b)}) OVER {w} AS s_sum FROM dataset_axis) WHERE n = 24 AND target IS NOT NULL""")
    return " UNION ALL ".join(parts)


def _sequences(spark, d, **options):
    rows, seq = stable(dataset(spark, d)), F.col("sequence")
    total = F.aggregate(seq, F.lit(0.0), lambda acc, x: acc + x[1].cast("double"))
    made = None
    for name, inputs in SEQ_INPUTS.items():
        part = Sr.sequences(rows, inputs, "target", step_seconds=DAY, **options).select(
            "group", TS, F.lit(name).alias("inputs"), F.size(seq).alias("seq_rows"), seq[0][0].cast("double").alias("first_a"),
            F.element_at(seq, -1)[2].cast("double").alias("last_c"), total.alias("sum_b"), (F.col("target") / F.lit(1e6)).alias("target"))
        made = part if made is None else made.unionByName(part)
    return rounded(made)


@query("sequence_window", _sequence_sql("23 PRECEDING", "CURRENT ROW"))
def sequence_window(spark, d):
    return _sequences(spark, d)


@query("sequence_next_step", _sequence_sql("24 PRECEDING", "1 PRECEDING"))
def sequence_next_step(spark, d):
    return _sequences(spark, d, next_step=True)


@query("context_prefix", f"""SELECT {_GT}, {rnd('target / 1e6')} AS target, {TS} >= TIMESTAMP '2001-01-01' AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY "group",
    {TS} < TIMESTAMP '2001-01-01' ORDER BY {TS} DESC) AS r FROM labels_long) WHERE {TS} >= TIMESTAMP '2001-01-01' OR r <= 24""")
def context_prefix(spark, d):
    labels = C.labels_long(B.labels_wide(spark, d)).withColumn("target", F.col("target") / F.lit(1e6))
    cut = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return rounded(Sr.with_context(labels.filter(F.col(TS) < cut), labels.filter(F.col(TS) >= cut)))


@query("persistence_lag1", f"""SELECT o_orderkey, {rnd('p')} AS persistence FROM (SELECT o_orderkey, lag(actual) OVER (PARTITION BY "group", model_name
    ORDER BY ts, o_orderkey) AS p FROM predictions) WHERE p IS NOT NULL""")
def persistence_lag1(spark, d):
    rows = B.predictions(spark, d).select("group", "model_name", "ts", "o_orderkey", "actual")
    return rounded(Sr.persistence(rows, "actual", ["group", "model_name"], ["ts", "o_orderkey"]), "o_orderkey", "persistence")


@query("best_by_group", f"""SELECT "group", model_name, {rnd('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, model_name) AS r
    FROM result_rows WHERE model_name <> '5-LOW') WHERE r = 1""")
def best_by_group(spark, d):
    rows = result_rows(spark, d).filter("model_name <> '5-LOW'")
    return rounded(Q.best_by(rows, ["group"], "score", "model_name"), "group", "model_name", "score")


B.VIEWS["board"] = """SELECT model_name, avg(nmae) AS mean_nmae, avg(ficr) AS mean_ficr, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse,
    avg(n_features) AS mean_features, count(DISTINCT "group") AS groups, 0.5e0 * (1 - avg(nmae)) + 0.5e0 * avg(ficr) AS official_score FROM result_rows GROUP BY 1"""
BOARD = ["mean_nmae", "mean_ficr", "mean_mae", "mean_rmse", "mean_features", "official_score"]


@query("leaderboard_rank", f"SELECT model_name, groups, {rnds(*BOARD)}, row_number() OVER (ORDER BY official_score DESC, model_name) AS rank FROM board")
def leaderboard_rank(spark, d):
    return rounded(M.ranked_leaderboard(M.leaderboard(result_rows(spark, d))), "model_name", "groups", *BOARD, "rank")


@query("dedupe_keep_last", f"""SELECT "group", model_name, o_orderkey, {rnd('pred')} AS pred FROM (SELECT *, row_number() OVER (PARTITION BY "group", model_name
    ORDER BY ts DESC, o_orderkey DESC) AS r FROM predictions) WHERE r = 1""")
def dedupe_keep_last(spark, d):
    rows = B.predictions(spark, d).select("group", "model_name", "ts", "o_orderkey", "pred")
    return rounded(Q.latest(rows, ["group", "model_name"], F.struct("ts", "o_orderkey")), "group", "model_name", "o_orderkey", "pred")


_BRAND = "(SELECT p_brand, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS total FROM part GROUP BY 1)"


@query("cumulative_share", f"""SELECT p_brand, {rnd('c')} AS cumulative, coalesce(lag(c) OVER (ORDER BY total DESC, p_brand) < 0.6e0, TRUE) AS keep FROM (SELECT *,
    CAST(sum(total) OVER (ORDER BY total DESC, p_brand ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) AS c FROM {_BRAND})""")
def cumulative_share(spark, d):
    totals = B.table(spark, d, "part").groupBy("p_brand").agg(F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("total"))
    return rounded(Q.cumulative_share(totals, "total", "p_brand", 0.6), "p_brand", "cumulative", "keep")


_SCALES = {n: f'avg(target) OVER (PARTITION BY "group" ORDER BY {TS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (168, 24, 6)}


@query("causal_multiscale", f"""SELECT {_GT}, {rnd('a')} AS target_scale_168, {rnd('b - a')} AS target_scale_24, {rnd('c - b')} AS target_scale_6,
    {rnd('target - c')} AS target_scale_1 FROM (SELECT *, {_SCALES[168]} AS a, {_SCALES[24]} AS b, {_SCALES[6]} AS c FROM (SELECT "group", {TS}, u10 AS target FROM ldaps_means))""")
def causal_multiscale(spark, d):
    means = Sa.area_means(B.ldaps(spark, d), ["u10"], weights(spark, d)).withColumnRenamed("u10", "target")
    return rounded(Sr.causal_scales(means, "target"), "group", TS, *[f"target_scale_{n}" for n in (168, 24, 6, 1)])
