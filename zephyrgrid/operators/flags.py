"""Quality flags. A flag is never null: a comparison with a missing value is false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import series
from zephyrgrid.operators.ordering import BLOCK_ROWS, framed, time_slice


def air_limits(df: DataFrame, prefix: str = "") -> DataFrame:
    """Model output that breaks physical limits is marked, its values stay."""
    flag = f"is_{prefix}"
    t, dew, rh, sp = (f"{prefix}{c}" for c in ("t2m", "dpt2m", "rh2m", "sp"))
    made = {}
    if {t, dew} <= set(df.columns):
        made[f"{flag}temp_below_dew"] = S.known(F.col(t) < F.col(dew))
    if rh in df.columns:
        made[f"{flag}rh_over_100"] = S.known(F.col(rh) > K.RH_MAX)
    if sp in df.columns:
        made[f"{flag}pressure_invalid"] = S.known(F.col(sp) <= 0)
    return df.withColumns(made) if made else df


def sensor_limits(df: DataFrame) -> DataFrame:
    p, ws, cap = F.col("power_raw"), F.col("ws_raw"), F.col("cap_kwh10m")
    large = S.known(p < cap * -K.NEGATIVE_RATIO)
    return df.withColumns({
        "is_power_outlier": S.known(F.abs(p) > cap * K.POWER_CAP_RATIO),
        "is_power_neg_large": large,
        "is_power_neg_small": S.known(p < 0) & ~large,
        "is_ws_out_of_range": S.known((ws < 0) | (ws > K.WIND_MAX)),
        "is_cut_out": S.known(ws >= F.col("cut_out_ms")),
        "is_low_wind_zero_power": S.known((ws < K.CUT_IN) & (p <= 0)),
        "is_high_wind_zero_power": S.known((ws >= K.HIGH_WIND) & (ws < F.col("cut_out_ms")) & (p <= 0)),
    })


def turbine_disagreement(df: DataFrame, ts: str = "kst_dtm", group: str = "group") -> DataFrame:
    """Far from the median of the same stamp and group; a partition is the turbines of one group."""
    usable = F.when(~F.col("is_power_outlier"), F.col("power_raw"))
    middle = F.median(usable).over(Window.partitionBy(ts, group))
    return df.withColumn("is_turbine_disagreement", S.known(
        F.abs(usable - middle) > F.col("cap_kwh10m") * K.DISAGREE_RATIO))


def qc_code(flags: list[str] = K.QC_FLAGS) -> Column:
    code = F.lit(0)
    for bit, name in enumerate(flags):
        code = code + F.col(name).cast("int") * (1 << bit)
    return code.cast("int")


def qc_has(code, flag: str, flags: list[str] = K.QC_FLAGS) -> Column:
    return S.as_col(code).bitwiseAND(1 << flags.index(flag)) > 0


def sensor_flags(df: DataFrame, block: int = BLOCK_ROWS, position: Column | None = None) -> DataFrame:
    """All nine flags and the code, on a table with turbine columns."""
    marked = series.frozen_sensor(sensor_limits(df), block=block, position=position)
    return turbine_disagreement(marked).withColumn("power_qc_flag", qc_code())


def grid_jumps(df: DataFrame, ws: str = "ws10", grid: str = "grid_id", ts: str = "forecast_kst_dtm",
               block: int = BLOCK_ROWS) -> DataFrame:
    """Change per grid point in time, range over the points of one stamp, and both flags."""
    timed = framed(df, [grid], [ts], lambda w: {f"{ws}_diff_1h": F.col(ws) - F.lag(ws).over(w)},
                   before=1, slice_by=time_slice(ts), block=block)
    stamp = Window.partitionBy(ts)
    spread = F.max(ws).over(stamp) - F.min(ws).over(stamp)
    return (timed.withColumn(f"{ws}_spatial_range", spread)
            .withColumns({
                "is_ws_time_jump": S.known(F.abs(F.col(f"{ws}_diff_1h")) > K.TIME_JUMP),
                "is_ws_space_jump": S.known(F.col(f"{ws}_spatial_range") > K.SPACE_JUMP)}))


def clean_values() -> dict[str, Column]:
    doubt = F.lit(False)
    for name in K.DISTRUST_FLAGS:
        doubt = doubt | F.col(name)
    return {"power_clean": F.when(~doubt, F.col("power_raw")),
            "ws_clean": F.when(~F.col("is_ws_out_of_range"), F.col("ws_raw")),
            "wd_clean": S.normalise_direction("wd_raw")}


def clean_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(clean_values())


def hour_coverage(df: DataFrame, column: str = "power_clean") -> DataFrame:
    """Valid values per turbine and hour; a partition is the six readings of one hour."""
    n = F.count(column).over(Window.partitionBy("turbine", "hour_end"))
    return df.withColumn("n_valid_in_hour", n).withColumns({
        "is_partial_missing": (F.col("n_valid_in_hour") > 0) & (F.col("n_valid_in_hour") < K.SAMPLES_PER_HOUR),
        "is_full_missing_hour": F.col("n_valid_in_hour") == 0})
