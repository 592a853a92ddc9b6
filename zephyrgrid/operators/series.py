"""Ramps, gaps, sequences and other bounded-frame work on forecast and sensor series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import ordering
from zephyrgrid.operators.ordering import BLOCK_ROWS, framed, tick, time_slice


def ramp_columns(ws: str, u: str, v: str, wd: str, prefix: str = ""):
    """Changes over one and three rows, extremes of the next three, turning of direction."""
    p = f"{prefix}_" if prefix else ""

    def build(w) -> dict[str, Column]:
        step = F.col(ws) - F.lag(ws, 1).over(w)
        ahead = w.rowsBetween(1, 3)
        return {
            f"{p}ws_diff_1h": step, f"{p}ws_diff_3h": F.col(ws) - F.lag(ws, 3).over(w),
            f"{p}u_diff_1h": F.col(u) - F.lag(u, 1).over(w),
            f"{p}v_diff_1h": F.col(v) - F.lag(v, 1).over(w),
            f"{p}ws_ramp_rate": F.abs(step),
            f"{p}ws_next3h_max": F.max(ws).over(ahead), f"{p}ws_next3h_min": F.min(ws).over(ahead),
            f"{p}wd_rotation": F.abs(S.angle_difference(F.col(wd), F.lag(wd, 1).over(w))),
        }
    return build


def ramps(df: DataFrame, ws: str, u: str, v: str, wd: str, prefix: str = "",
          keys=("group",), ts: str = "forecast_kst_dtm", block: int = BLOCK_ROWS) -> DataFrame:
    return framed(df, list(keys), [ts], ramp_columns(ws, u, v, wd, prefix), before=3, after=3,
                  slice_by=time_slice(ts), block=block)


def forecast_ramps(df: DataFrame, source: str, **options) -> DataFrame:
    """Ramps on the best wind a source has: hub height, else 100 m, else 10 m."""
    if source == "ldaps":
        return ramps(df, "ws10", "u10", "v10", "wd10", "ldaps", **options)
    first = lambda *names: next((n for n in names if n in df.columns), names[-1])
    return ramps(df, first("gfs_ws_hub", "gfs_ws_100", "gfs_ws_10"), first("gfs_u100", "gfs_u10"),
                 first("gfs_v100", "gfs_v10"), first("gfs_wd_100", "gfs_wd_10"), "gfs", **options)


def short_gap_columns(w, column: str, filled: str, mask: str | None, steps: int) -> dict[str, Column]:
    """Linear fill by row position of null runs up to ``steps`` rows with values on both sides."""
    spot = F.col("_pos")
    point = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("y"), spot.alias("x")))
    left = F.last(point, ignorenulls=True).over(w.rowsBetween(-steps, -1))
    right = F.first(point, ignorenulls=True).over(w.rowsBetween(1, steps))
    run = right["x"] - left["x"] - 1
    fits = F.col(column).isNull() & S.known(run <= steps)
    line = left["y"] + (right["y"] - left["y"]) * (spot - left["x"]) / (right["x"] - left["x"])
    made = {filled: F.when(fits, line).otherwise(F.col(column))}
    if mask:
        made[mask] = fits
    return made


def fill_short_gaps(df: DataFrame, pairs: list[tuple[str, str, str | None]], keys=("turbine",),
                    ts: str = "kst_dtm", steps: int = K.MAX_GAP, block: int = BLOCK_ROWS,
                    position: Column | None = None) -> DataFrame:
    """Fill (column, filled, mask) pairs in one pass; long runs and edges stay missing.

    A run that may be filled has a value within ``steps`` rows on either side, so a frame of
    that width decides it and the length of longer runs never has to be known.
    """
    def stage(w) -> dict[str, Column]:
        made: dict[str, Column] = {}
        for column, filled, mask in pairs:
            made.update(short_gap_columns(w, column, filled, mask, steps))
        return made
    return framed(df, list(keys), [ts], stage, before=steps, after=steps,
                  slice_by=time_slice(ts), position=position, block=block)


def gap_runs(df: DataFrame, column: str, keys=("turbine",), ts: str = "kst_dtm") -> DataFrame:
    """(keys, start, end, run_len) of each null run.

    The number of values seen so far is constant inside a run, so it names the run; a run of
    any length is then one hash aggregate, never one window partition.
    """
    value = F.col(column).isNotNull().cast("bigint")
    seen = ordering.numbered(df, list(keys), [ts], time_slice(ts), running={"_seen": value})
    return (seen.filter(F.col(column).isNull()).groupBy(*keys, "_seen")
            .agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count(F.lit(1)).alias("run_len"))
            .drop("_seen"))


def frozen_stages(column: str, flag: str = "is_frozen_sensor", steps: int = K.FROZEN_STEPS):
    """True in runs of at least ``steps`` equal values; zero and null runs are exempt.

    A frame of ``steps - 1`` rows either way shows whether the run around a row is that long.
    """
    def breaks(w) -> dict[str, Column]:
        same = S.known(F.col(column) == F.lag(column).over(w))
        return {"_break": F.when(~same, F.col("_pos"))}

    def runs(w) -> dict[str, Column]:
        start = F.coalesce(F.max("_break").over(w.rowsBetween(-(steps - 1), 0)),
                           F.col("_pos") - (steps - 1))
        stop = F.coalesce(F.min("_break").over(w.rowsBetween(1, steps - 1)),
                          F.max("_pos").over(w.rowsBetween(0, steps - 1)) + 1)
        return {flag: S.known((stop - start >= steps) & (F.col(column) != 0))}
    return breaks, runs


def frozen_sensor(df: DataFrame, column: str = "power_raw", keys=("turbine",), ts: str = "kst_dtm",
                  steps: int = K.FROZEN_STEPS, flag: str = "is_frozen_sensor",
                  block: int = BLOCK_ROWS, position: Column | None = None) -> DataFrame:
    return framed(df, list(keys), [ts], *frozen_stages(column, flag, steps), before=steps,
                  after=steps - 1, slice_by=time_slice(ts), position=position, block=block).drop("_break")


def sequences(df: DataFrame, features: list[str], target: str, next_step: bool = False,
              keys=("group",), ts: str = "forecast_kst_dtm", length: int = K.SEQUENCE_LENGTH,
              block: int = BLOCK_ROWS, step_seconds: int | None = None) -> DataFrame:
    """Windows of ``length`` rows as an array of feature arrays.

    The target is that of the window's last row, or with ``next_step`` of the row after it. Windows that are
    short or hold a null are dropped. With ``step_seconds`` a window is a stretch of the regular time axis:
    stamps without a row count as missing cells, so no window bridges a gap. Without it rows are neighbours
    whatever lies between them.
    """
    last = -1 if next_step else 0
    first = last - length + 1
    missing = sum_of_nulls(features)
    position = None
    if step_seconds is not None:
        df = complete_axis(df.select(*keys, ts, *dict.fromkeys([*features, target])), step_seconds, keys, ts)
        position = tick(ts, step_seconds)

    def build(w) -> dict[str, Column]:
        frame = w.rowsBetween(first, last)
        cell = F.array(*[F.col(c).cast("float") for c in features])
        return {"_missing": F.sum(missing).over(frame), "_rows": F.count(F.lit(1)).over(frame),
                "sequence": F.collect_list(cell).over(frame)}
    made = framed(df, list(keys), [ts], build, before=length, slice_by=time_slice(ts), position=position, block=block)
    return (made.filter((F.col("_rows") == length) & (F.col("_missing") == 0) & F.col(target).isNotNull())
            .select(*keys, ts, "sequence", F.col(target).alias("target")))


def sum_of_nulls(columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")
    return total


def with_context(train: DataFrame, test: DataFrame, keys=("group",), ts: str = "forecast_kst_dtm",
                 length: int = K.SEQUENCE_LENGTH) -> DataFrame:
    """The last ``length`` train rows of each key, then the test rows; ``is_test`` tells them apart."""
    from_end = ordering.numbered(train, list(keys), [F.col(ts).desc()], -time_slice(ts))
    tail = from_end.filter(F.col("pos") <= length).drop("pos")
    return tail.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


def persistence(df: DataFrame, actual: str, keys: list[str], order: list[str],
                slice_by: Column | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """The previous actual as prediction; the first row of a key has none and is dropped."""
    return framed(df, keys, order, lambda w: {"persistence": F.lag(actual, 1).over(w)},
                  before=1, slice_by=slice_by, block=block, keep=F.col("persistence").isNotNull())


def causal_scales(df: DataFrame, value: str, keys=("group",), ts: str = "forecast_kst_dtm",
                  spans=(168, 24, 6), block: int = BLOCK_ROWS) -> DataFrame:
    """Split a series into slow to fast parts with trailing means only; the parts add up to it."""
    def build(w) -> dict[str, Column]:
        means = [F.avg(value).over(w.rowsBetween(-(n - 1), 0)) for n in spans]
        levels = [*means, F.col(value)]
        made = {f"{value}_scale_{spans[0]}": means[0]}
        for n, slow, fast in zip([*spans[1:], 1], levels, levels[1:]):
            made[f"{value}_scale_{n}"] = fast - slow
        return made
    return framed(df, list(keys), [ts], build, before=max(spans), slice_by=time_slice(ts), block=block)


def complete_axis(df: DataFrame, step_seconds: int = 600, keys=("turbine",), ts: str = "kst_dtm") -> DataFrame:
    """Every key on the full regular axis from the first to the last stamp; gaps become null rows.

    One row per key is expanded to days, the days are spread over the cluster, and each is
    expanded to its steps there.
    """
    every = Window.partitionBy()  # over one row per key
    members = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b")).select(
        *keys, F.min("_a").over(every).alias("_lo"), F.max("_b").over(every).alias("_hi"))
    span = F.floor(F.timestamp_diff("SECOND", F.col("_lo"), F.col("_hi")) / 86_400).cast("int")
    days = members.withColumn("_day", F.explode(F.sequence(F.lit(0), span))).repartition(*keys, "_day")
    stamp = F.col("_lo") + F.make_dt_interval(
        F.col("_day"), F.lit(0), F.lit(0), F.col("_step") * F.lit(step_seconds))
    axis = (days.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(86_400 // step_seconds - 1))))
            .select(*keys, "_hi", stamp.alias(ts)).filter(F.col(ts) <= F.col("_hi")).drop("_hi"))
    return axis.join(df, [*keys, ts], "left")
