"""Ten-minute sensor series: wide to long, repair, hourly turbine and group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import flags, series
from zephyrgrid.operators.contracts import join_turbines
from zephyrgrid.operators.ordering import BLOCK_ROWS, framed, time_slice
from zephyrgrid.session import attach, stable

TURBINE_COLUMNS = ["turbine", "group", "model", "cap_kwh10m", "cut_out_ms", "swept_area_m2"]


def wide_to_long(df: DataFrame, turbines: list[str], ts: str = "kst_dtm", power: str = "power_kw10m") -> DataFrame:
    cells = F.array(*[F.struct(
        F.lit(t).alias("turbine"), F.col(f"{t}_{power}").cast("double").alias("power_raw"),
        F.col(f"{t}_ws").cast("double").alias("ws_raw"), F.col(f"{t}_wd").cast("double").alias("wd_raw"))
        for t in turbines])
    return df.select(F.col(ts).alias("kst_dtm"), F.inline(cells))


def long_to_wide(df: DataFrame, index: str, column: str, value: str, members: list) -> DataFrame:
    """One column per declared member, so no extra pass looks for the members."""
    return df.groupBy(index).pivot(column, members).agg(F.first(value, ignorenulls=True))


def time_axis(df: DataFrame, turbines: DataFrame) -> DataFrame:
    return join_turbines(df.withColumn("hour_end", S.hour_end("kst_dtm")), turbines, TURBINE_COLUMNS)


def repaired(df: DataFrame, block: int = BLOCK_ROWS, steps: int = K.MAX_GAP,
             position: Column | None = None) -> DataFrame:
    """Frozen flag, cleaned and gap-filled power, wind and wind vector in one sorted pass.

    The wind is filled as a speed and as components, never as an angle. The neighbours cover
    the run test and the three fills that build on each other.
    """
    def fill(*pairs):
        def stage(w):
            made = {}
            for column, filled, mask in pairs:
                made.update(series.short_gap_columns(w, column, filled, mask, steps))
            return made
        return stage
    reach = K.FROZEN_STEPS + 3 * steps
    return framed(
        df, ["turbine"], ["kst_dtm"], *series.frozen_stages("power_raw"), lambda w: flags.clean_values(),
        fill(("power_clean", "power_filled", "is_power_interpolated"), ("ws_clean", "ws_filled", "is_ws_interpolated")),
        lambda w: {"_u": S.wind_u("ws_filled", "wd_clean"), "_v": S.wind_v("ws_filled", "wd_clean")},
        fill(("_u", "u_scada", "is_u_interpolated"), ("_v", "v_scada", None)),
        before=reach, after=reach, slice_by=time_slice("kst_dtm"), position=position, block=block,
    ).drop("_break", "_u", "_v")


def physics(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "dir_valid": S.known(F.col("ws_filled") >= K.LOW_WIND),
        "p_theory_std_kw": S.theory_power("swept_area_m2", "ws_filled"),
        "power_kw": S.ten_minute_kw("power_filled")})


def direction_cycle(df: DataFrame, columns: list[str]) -> DataFrame:
    made = {}
    for c in columns:
        if c in df.columns:
            angle = F.radians(F.col(c))
            made[f"{c}_sin"], made[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(made) if made else df


def turbine_hourly(df: DataFrame) -> DataFrame:
    """One row per turbine and hour. A group holds at most the six readings of the hour."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    agg = df.groupBy("turbine", "hour_end").agg(
        F.count("power_filled").alias("n_valid"),
        F.coalesce(F.sum("power_filled"), F.lit(0.0)).alias("power_sum_all"),
        F.avg("ws_filled").alias("ws_mean"), F.stddev_samp("ws_filled").alias("ws_std"),
        F.max("ws_filled").alias("ws_max"),
        F.avg("u_scada").alias("u_mean"), F.avg("v_scada").alias("v_mean"),
        any_of("is_high_wind_zero_power").alias("is_high_wind_zero"),
        any_of("is_cut_out").alias("is_cut_out_hour"),
        any_of("is_power_outlier").alias("is_outlier_hour"),
        any_of("is_power_interpolated").alias("is_interp_hour"),
        F.percentile("ws_filled", F.lit(0.25)).alias("ws_q25"),
        F.percentile("ws_filled", F.lit(0.75)).alias("ws_q75"),
        F.first("group", ignorenulls=True).alias("group"),
        F.first("cap_kwh10m", ignorenulls=True).alias("cap_kwh10m"))
    n, total = F.col("n_valid"), F.col("power_sum_all")
    return agg.withColumns({
        "power_sum_strict": F.when(n >= K.SAMPLES_PER_HOUR, total),
        "power_sum_relaxed": F.when(n >= K.RELAXED_SAMPLES, total * float(K.SAMPLES_PER_HOUR) / n)})


def group_members(hourly: DataFrame) -> DataFrame:
    """Members and capacity of each group, from the turbines seen in the data."""
    seen = hourly.groupBy("group", "turbine").agg(F.first("cap_kwh10m", ignorenulls=True).alias("_cap"))
    return seen.filter(F.col("group").isNotNull()).groupBy("group").agg(
        F.count(F.lit(1)).alias("n_members"), F.sum("_cap").alias("cap_sum"))


def group_hourly(hourly: DataFrame, groups: list[str] = K.GROUPS) -> DataFrame:
    """One row per group and hour for every hour seen; a missing member makes the sum null.

    ``hourly`` is written first: it is read for the sums, the hours and the members.
    """
    hourly = stable(hourly)
    full = F.col("n_valid") >= K.SAMPLES_PER_HOUR
    sums = hourly.groupBy("group", "hour_end").agg(
        F.count("power_sum_strict").alias("_n_strict"), F.sum("power_sum_strict").alias("_strict"),
        F.count("power_sum_relaxed").alias("_n_relaxed"), F.sum("power_sum_relaxed").alias("_relaxed"),
        F.sum("n_valid").alias("_valid"), F.sum(F.when(full, F.col("cap_kwh10m"))).alias("_avail"),
        F.avg("ws_mean").alias("scada_ws_scalar"), F.stddev_samp("ws_mean").alias("scada_ws_std"),
        F.avg("u_mean").alias("scada_u"), F.avg("v_mean").alias("scada_v"))
    hours = hourly.filter(F.col("hour_end").isNotNull()).select("hour_end").distinct()
    wanted = F.explode(F.array(*[F.lit(g) for g in groups])).alias("group")
    axis = attach(hours.select("hour_end", wanted), group_members(hourly), ["group"], "inner", counted=len(groups))
    rows = axis.join(sums, ["group", "hour_end"], "left")
    samples = float(K.SAMPLES_PER_HOUR)
    strict = F.when(F.col("_n_strict") == F.col("n_members"), F.col("_strict"))
    relaxed = F.when(F.col("_n_relaxed") == F.col("n_members"), F.col("_relaxed"))
    rows = rows.withColumn("scada_ws_vector", S.wind_speed("scada_u", "scada_v"))
    steady = F.col("scada_ws_vector") / (F.col("scada_ws_scalar") + K.TINY)
    rows = rows.withColumn("scada_dir_resultant", F.when(steady.isNotNull(), F.least(steady, F.lit(1.0))))
    kept = F.col("scada_dir_resultant")
    spread = F.degrees(F.sqrt(F.ln(F.greatest(kept, F.lit(1e-6))) * -2.0))
    return rows.select(
        "hour_end", "group", strict.alias("scada_power_kwh"), relaxed.alias("scada_power_kwh_relaxed"),
        (F.coalesce(F.col("_valid"), F.lit(0)) / (F.col("n_members") * samples)).alias("coverage_ratio"),
        (F.coalesce(F.col("_avail"), F.lit(0.0)) / (F.col("cap_sum") + K.TINY)).alias("avail_cap_ratio"),
        "scada_ws_scalar", "scada_ws_vector", "scada_ws_std", "scada_u", "scada_v",
        S.wind_direction("scada_u", "scada_v").alias("scada_wd"), "scada_dir_resultant",
        F.when(kept.isNotNull(), spread).alias("scada_dir_spread"),
        (strict / (F.col("cap_sum") * samples)).alias("capacity_factor"))
