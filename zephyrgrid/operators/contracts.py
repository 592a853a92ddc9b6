"""Projections, filters and input checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.session import attach


class ContractError(ValueError):
    """The input does not have the promised columns or values."""


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that are present; absent ones are no error."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def rename_sensor(df: DataFrame) -> DataFrame:
    renamed = rename_known(df, K.SENSOR_NAMES)
    missing = [c for c in K.SENSOR_REQUIRED if c not in renamed.columns]
    if missing:
        raise ContractError(f"sensor table lacks {missing}; melt a wide table first")
    return renamed


def validate(df: DataFrame, required: list[str], allow_empty: bool = False) -> DataFrame:
    """Names are checked on the plan; emptiness reads at most one row."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        raise ContractError(f"columns occur twice: {twice}")
    if not allow_empty and df.isEmpty():
        raise ContractError("the table is empty")
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def infinite_to_null(df: DataFrame) -> DataFrame:
    """±inf and NaN become null in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.withColumns({c: finite(c) for c in floating}) if floating else df


def select_group(df: DataFrame, group: str | None, column: str = "group") -> DataFrame:
    if group is None or column not in df.columns:
        return df
    return df.filter(F.col(column) == group)


def feature_columns(df: DataFrame, time_cols=("forecast_kst_dtm", "kst_dtm"), key: str = "group",
                    targets=tuple(K.GROUPS)) -> list[str]:
    """Numeric columns that are neither stamp, key nor the target of any group."""
    excluded = {*time_cols, key, *targets}
    return [c for c in numeric_columns(df) if c not in excluded]


def one_hot(df: DataFrame, column: str, categories: list | None = None, drop: bool = True,
            most: int = 1000) -> DataFrame:
    """One byte column per declared category, so that all splits get the same width.

    Without a declaration the values found are used; more than ``most`` of them is an error.
    """
    if column not in df.columns:
        return df
    if categories is None:
        found = df.select(column).distinct().filter(F.col(column).isNotNull()).limit(most + 1).collect()
        if len(found) > most:
            raise ContractError(f"{column} has more than {most} values, declare its categories")
        categories = sorted(r[0] for r in found)
    flags = {f"{column}_{c}": S.known(F.col(column) == F.lit(c)).cast("tinyint") for c in categories}
    wide = df.withColumns(flags)
    return wide.drop(column) if drop else wide


def model_input(df: DataFrame, drop: list[str] = ()) -> DataFrame:
    """Booleans to bytes, season to four columns, listed columns dropped."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    if flags:
        df = df.withColumns({c: F.col(c).cast("tinyint") for c in flags})
    return one_hot(df, "season", K.SEASONS).drop(*drop)


def clip_between(value, low, high) -> Column:
    value = S.as_col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, S.as_col(high))))


def to_energy(utilisation, capacity) -> Column:
    return clip_between(utilisation, 0.0, F.lit(1.0)) * S.as_col(capacity)


def to_utilisation(energy, capacity) -> Column:
    return clip_between(F.try_divide(S.as_col(energy), S.as_col(capacity)), 0.0, F.lit(1.0))


def _by_model(values: dict[str, float], model: str) -> Column:
    picks = [F.when(F.col(model) == name, F.lit(v)) for name, v in values.items()]
    return F.coalesce(*picks)


def turbine_spec(meta: DataFrame) -> DataFrame:
    """Ten-minute energy at full power, cut-out speed and swept area, where not yet given."""
    made = {}
    if "cap_kwh10m" not in meta.columns:
        if "cap_kw" not in meta.columns:
            raise ContractError("turbine table needs cap_kw or cap_kwh10m")
        made["cap_kwh10m"] = F.col("cap_kw") / float(K.SAMPLES_PER_HOUR)
    if "cut_out_ms" not in meta.columns:
        made["cut_out_ms"] = _by_model(K.CUT_OUT, "model")
    if "swept_area_m2" not in meta.columns:
        made["swept_area_m2"] = _by_model(K.SWEPT_AREA, "model")
    return meta.withColumns(made) if made else meta


def turbine_meta(info: DataFrame, coordinate: str, group: str, capacity_mw: str) -> DataFrame:
    lat, lon = S.dms_parts(coordinate)
    return info.withColumns({
        "lat": lat, "lon": lon, "cap_kw": F.col(capacity_mw) * 1000.0,
        "group": group_key(group)})


def group_key(group, domain=tuple(K.GROUPS)) -> Column:
    """1, 1.0 and "1" become ``kpx_group_1``; a value outside the domain raises."""
    text = S.as_col(group).cast("string")
    number = text.try_cast("double")
    whole = F.when((number % 1) == 0, F.concat(F.lit("kpx_group_"), number.cast("bigint").cast("string")))
    name = F.coalesce(whole, text)
    return F.when(name.isin(*domain), name).otherwise(
        F.raise_error(F.concat(F.lit("unknown group: "), F.coalesce(text, F.lit("null")))))


def weight_inputs(turbines: DataFrame, domain=tuple(K.GROUPS)) -> DataFrame:
    """Turbines with a named group and ``cap_kw``, the latter from ``capacity_mw`` if need be."""
    if "cap_kw" not in turbines.columns and "capacity_mw" in turbines.columns:
        turbines = turbines.withColumn("cap_kw", F.col("capacity_mw") * 1000.0)
    missing = [c for c in ("group", "lat", "lon", "cap_kw") if c not in turbines.columns]
    if missing:
        raise ContractError(f"turbine table lacks {missing}")
    return turbines.withColumn("group", group_key("group", domain))


def power_curve_points(df: DataFrame, speed: str, power: str, sample: int | None = None,
                       key: str | None = None, seed: int = 42) -> DataFrame:
    valid = df.dropna(subset=[speed, power]).filter((F.col(speed) > 0.5) & (F.col(power) >= 0))
    return valid if sample is None else sample_rows(valid, key, sample, seed)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample: the n smallest digests. A top-n, no shuffle of all rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(digest, F.col(key)).limit(n)


def signal_guard(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: largest magnitude and whether any signal is there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"no signal columns {missing}")
    peaks = df.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("peak")) for c in columns])
    return peaks.select(F.inline(cells)).withColumn("has_signal", S.known(F.col("peak") > 0))


def require_signal(df: DataFrame, columns: list[str]) -> DataFrame:
    dead = [r["column"] for r in signal_guard(df, columns).filter(~F.col("has_signal")).collect()]
    if dead:
        raise ContractError(f"all-zero or missing signal in {dead}")
    return df


def submission_violations(df: DataFrame, sample: DataFrame, capacities: dict[str, float]) -> DataFrame:
    """One row of violation counts for a finished submission table."""
    groups = list(capacities)
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    any_of = lambda conds: reduce(lambda a, b: a + b, [S.known(c).cast("bigint") for c in conds])
    expected = sample.agg(F.count(F.lit(1)).alias("n_expected"))
    found = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        total(any_of([F.col(g).isNull() for g in groups])).alias("n_null"),
        total(any_of([F.col(g) < 0 for g in groups])).alias("n_negative"),
        total(any_of([F.col(g) > c for g, c in capacities.items()])).alias("n_above_capacity"),
        *[(F.min(g) < F.max(g)).alias(f"varies_{g}") for g in groups])
    # two one-row tables, put side by side on a constant key
    both = found.withColumn("_k", F.lit(1)).join(expected.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("columns_equal", F.lit(df.columns == sample.columns))


def join_by_key(left: DataFrame, right: DataFrame, on: list[str], how: str,
                suffixes=("_ldaps", "_gfs")) -> DataFrame:
    """Join two wide tables; clashing names get a suffix on both sides before the join."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, on, how)


def labels_long(labels: DataFrame, time_col: str = "kst_dtm", groups=tuple(K.GROUPS)) -> DataFrame:
    """(group, forecast_kst_dtm, target) of the non-null label cells."""
    cells = F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).cast("double").alias("target")) for g in groups])
    return (labels.select(F.col(time_col).alias("forecast_kst_dtm"), F.inline(cells))
            .filter(F.col("target").isNotNull()))


def join_turbines(readings: DataFrame, turbines: DataFrame, wanted: list[str]) -> DataFrame:
    """Readings with turbine columns; a column that is already there is not attached again."""
    take = ["turbine"] + [c for c in wanted if c not in readings.columns and c != "turbine"]
    return attach(readings, turbines.select(*take), ["turbine"], "left")
