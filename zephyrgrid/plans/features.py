"""Feature tables: fixed step orders per source and the joined training table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import flags as Fl
from zephyrgrid.operators import sensor as Se
from zephyrgrid.operators import series as Sr
from zephyrgrid.operators import spatial as Sa
from zephyrgrid.operators.ordering import tick
from zephyrgrid.plans.physics import gfs_physics, issue_times, ldaps_physics

Step = Callable[[DataFrame], DataFrame]


# what a grid point needs on its own, row by row
_LDAPS_POINT: list[Step] = [
    lambda df: C.rename_known(C.validate(df, K.GRID_REQUIRED, allow_empty=True), K.LDAPS_NAMES),
    lambda df: issue_times(df, "lead_hour"), C.infinite_to_null, Fl.air_limits, ldaps_physics]
_GFS_POINT: list[Step] = [
    lambda df: C.rename_known(C.validate(df, K.GRID_REQUIRED, allow_empty=True), K.GFS_NAMES),
    lambda df: issue_times(df, "gfs_lead_hour"), C.infinite_to_null, lambda df: Fl.air_limits(df, "gfs_"), gfs_physics]


def _ldaps_steps(turbines: DataFrame | None) -> list[Step]:
    return [
        *_LDAPS_POINT, Fl.grid_jumps,
        lambda df: Se.direction_cycle(df, ["wd10"]).withColumns(S.cyclic_time("forecast_kst_dtm")),
    ]


def _gfs_steps(turbines: DataFrame | None) -> list[Step]:
    return [
        *_GFS_POINT,
        lambda df: Se.direction_cycle(df, [c for c in df.columns if c.startswith("gfs_wd_")]).withColumns(
            S.cyclic_time("forecast_kst_dtm")),
    ]


def _sensor_steps(turbines: DataFrame | None) -> list[Step]:
    if turbines is None:
        raise C.ContractError("sensor readings need a turbine table: limits differ by turbine")
    return [
        C.rename_sensor, lambda df: Se.time_axis(Sr.complete_axis(df), turbines), C.infinite_to_null, Fl.sensor_limits,
        lambda df: Se.repaired(df, position=tick("kst_dtm", 600)), Fl.turbine_disagreement,
        lambda df: Fl.hour_coverage(df.withColumn("power_qc_flag", Fl.qc_code())), Se.physics,
        lambda df: Se.direction_cycle(df, ["wd_clean"]),
    ]


SOURCES: dict[str, Callable[[DataFrame | None], list[Step]]] = {
    "ldaps": _ldaps_steps, "gfs": _gfs_steps, "scada": _sensor_steps}
ALIASES = {"sensor": "scada"}


def register_source(name: str, steps: Callable[[DataFrame | None], list[Step]], *aliases: str) -> None:
    SOURCES[name.lower()] = steps
    ALIASES.update({a.lower(): name.lower() for a in aliases})


def source_names() -> list[str]:
    return sorted(SOURCES)


def prepare(source: str, df: DataFrame, turbines: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Run the steps of a source in their fixed order, then keep one group if asked."""
    name = source.strip().lower()
    name = ALIASES.get(name, name)
    if name not in SOURCES:
        raise C.ContractError(f"unknown source {source}; known: {source_names()}")
    for step in SOURCES[name](turbines):
        df = df.transform(step)
    return C.select_group(df, group)


def area_table(source: str, raw: DataFrame, weights: DataFrame) -> DataFrame:
    """Group means with restored directions, straight from the raw grid.

    Area means read nothing from the flags, so only the row-by-row steps are run and the raw
    rows meet a single shuffle, that of the partial sums.
    """
    for step in {"ldaps": _LDAPS_POINT, "gfs": _GFS_POINT}[source]:
        raw = raw.transform(step)
    return {"ldaps": Sa.ldaps_area, "gfs": Sa.gfs_area}[source](raw, weights)


def build_dataset(ldaps_groups: DataFrame, gfs_groups: DataFrame, labels: DataFrame) -> DataFrame:
    """All groups at once: both sources on (group, stamp), labelled rows, numeric columns."""
    both = C.join_by_key(ldaps_groups, gfs_groups, ["group", "forecast_kst_dtm"], "inner")
    rows = both.join(C.labels_long(labels), ["group", "forecast_kst_dtm"], "inner")
    keep = [c for c in C.numeric_columns(rows) if c != "target"]
    return rows.select("group", "forecast_kst_dtm", *keep, "target")


def dataset_features(df: DataFrame) -> list[str]:
    return C.feature_columns(df, targets=(*K.GROUPS, "target"))
