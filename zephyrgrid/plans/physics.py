"""Grid-point physics per forecast source. A column is derived only where its inputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S


def issue_times(df: DataFrame, lead: str = "lead_hour") -> DataFrame:
    """Issue date, hours ahead and target hour; left out where a stamp is missing."""
    if not {"data_available_kst_dtm", "forecast_kst_dtm"} <= set(df.columns):
        return df
    return df.withColumns({
        "forecast_issue_date": S.day_of("data_available_kst_dtm"),
        lead: S.lead_hours("data_available_kst_dtm", "forecast_kst_dtm"), "target_hour": F.hour("forecast_kst_dtm")})


def gfs_wind(df: DataFrame) -> DataFrame:
    """Speed and direction at every level whose components are present."""
    made = {}
    for level, (u, v) in K.GFS_LEVELS.items():
        if {u, v} <= set(df.columns):
            made[f"gfs_ws_{level}"] = S.wind_speed(u, v)
            made[f"gfs_wd_{level}"] = S.wind_direction(u, v)
    return df.withColumns(made)


def gfs_physics(df: DataFrame) -> DataFrame:
    """Shear, hub wind, density and stability of the grid points, before any averaging."""
    df = gfs_wind(df)
    have = lambda *c: set(c) <= set(df.columns)
    if have("gfs_ws_10", "gfs_ws_100"):
        df = df.withColumn("gfs_shear_alpha", S.wind_shear("gfs_ws_10", "gfs_ws_100", 10.0, 100.0))
        df = df.withColumn("gfs_ws_hub", S.hub_wind("gfs_ws_100", "gfs_shear_alpha"))
    if have("gfs_t2m", "gfs_q2m", "gfs_sp"):
        df = df.withColumns({"gfs_e_pa": S.vapour_pressure("gfs_q2m", "gfs_sp"),
                             "gfs_air_density": S.air_density("gfs_t2m", "gfs_q2m", "gfs_sp")})
        speed = next((c for c in ("gfs_ws_hub", "gfs_ws_100") if c in df.columns), None)
        if speed:
            df = df.withColumn("gfs_wind_power_density", S.wind_power_density("gfs_air_density", speed))
    made = {}
    if have("gfs_gust", "gfs_ws_10"):
        made["gfs_gust_factor"] = S.gust_factor("gfs_gust", "gfs_ws_10")
        made["is_gfs_gust_extreme"] = S.known(made["gfs_gust_factor"] > K.GUST_RATIO_MAX)
    if have("gfs_t2m", "gfs_dpt2m"):
        made["gfs_t_dew_diff"] = F.col("gfs_t2m") - F.col("gfs_dpt2m")
    if have("gfs_t2m", "gfs_t850"):
        made["gfs_lapse_850"] = F.col("gfs_t2m") - F.col("gfs_t850")
    if have("gfs_u850", "gfs_u10", "gfs_v850", "gfs_v10"):
        made["gfs_bulk_shear_850"] = S.wind_speed(F.col("gfs_u850") - F.col("gfs_u10"), F.col("gfs_v850") - F.col("gfs_v10"))
    return df.withColumns(made) if made else df


def ldaps_physics(df: DataFrame) -> DataFrame:
    """Wind, density and ranges of the grid points, before any averaging."""
    made = {}
    have = lambda *c: set(c) <= set(df.columns) | set(made)
    if have("u10", "v10"):
        made["ws10"], made["wd10"] = S.wind_speed("u10", "v10"), S.wind_direction("u10", "v10")
    if have("t2m", "q2m", "sp"):
        made["e_pa"], made["air_density"] = S.vapour_pressure("q2m", "sp"), S.air_density("t2m", "q2m", "sp")
        if have("ws10"):
            made["wind_power_density"] = S.wind_power_density(made["air_density"], made["ws10"])
    for name, high, low in (("u50_range", "u50_max", "u50_min"), ("v50_range", "v50_max", "v50_min"), ("t_dew_diff", "t2m", "dpt2m")):
        if have(high, low):
            made[name] = F.col(high) - F.col(low)
    if have("blws_x", "blws_y"):
        made["blws"] = S.wind_speed("blws_x", "blws_y")
    return df.withColumns(made) if made else df
