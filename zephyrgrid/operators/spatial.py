"""Grid to plant group: neighbours, inverse-distance weights and area means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators.contracts import ContractError, weight_inputs
from zephyrgrid.operators.sensor import direction_cycle
from zephyrgrid.session import attach, stable


QUARTERED = 24  # cells are cut so many times at most


def grid_coordinates(df: DataFrame) -> DataFrame:
    """One row per grid point: the first known place, by the earliest stamp."""
    place = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
                   F.struct("latitude", "longitude"))
    first = F.min_by(place, F.when(place.isNotNull(), F.col("forecast_kst_dtm")))
    return df.groupBy("grid_id").agg(first.alias("_p")).select("grid_id", "_p.latitude", "_p.longitude")


def nearest_grid(turbines: DataFrame, grid: DataFrame, k: int = K.IDW_NEIGHBOURS, leaf: int = 64, key: str = "turbine",
                 settle_grid: bool = True) -> DataFrame:
    """(key, grid_id, distance_km, rank) of the k nearest points, ties by grid_id.

    The points' box is cut into quarters again and again, until no cell that matters has more than ``leaf`` points. A cell knows how many points
    it has and how far the farthest lies from its middle, so the distance of a place to its middle bounds those to its points
    from both sides. Each turbine descends from the whole box: of the quarters of its cells it keeps those
    that can hold one of its k nearest, which are few wherever it stands, and meets only the points of its last
    cells. A round is an equi-join on cells; nothing is ordered but the cells and last points of one turbine.
    """
    if settle_grid:
        grid = stable(grid.select("grid_id", "latitude", "longitude"))
    box = grid.agg(F.min("latitude"), F.max("latitude"), F.min("longitude"), F.max("longitude"),
                   F.count(F.lit(1))).first()
    if box[4] == 0:
        raise ContractError("no grid points")
    if any(v is None or v != v for v in box[:4]):
        raise ContractError("a grid point has no place")
    k = max(1, min(k, box[4]))
    near = turbines.select(key, "lat", "lon").filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    if near.isEmpty():
        raise ContractError("no turbine has coordinates")
    side = 2 ** QUARTERED
    height, width = (box[1] - box[0]) / side or 1.0, (box[3] - box[2]) / side or 1.0
    at = lambda c, low, size: F.least(F.floor((F.col(c) - low) / size), F.lit(side - 1)).cast("int")
    points = grid.select("grid_id", "latitude", "longitude", at("latitude", box[0], height).alias("_y"),
                         at("longitude", box[2], width).alias("_x"))
    points = stable(points)
    near = near.withColumns({"_y": F.lit(0), "_x": F.lit(0)})
    up, most = QUARTERED, box[4]
    while up and most > leaf:
        up -= 1
        cell = {c: F.shiftright(c, up) for c in ("_y", "_x")}
        middle = {"_la": F.lit(box[0]) + (cell["_y"] + 0.5) * (height * 2 ** up), "_lo": F.lit(box[2]) + (cell["_x"] + 0.5) * (width * 2 ** up)}
        cells = stable(points.withColumns(middle).withColumns(cell).groupBy("_y", "_x").agg(
            F.count(F.lit(1)).alias("_points"), F.max(S.haversine_km("latitude", "longitude", "_la", "_lo")).alias("_reach"),
            F.first("_la").alias("_la"), F.first("_lo").alias("_lo"),
            # points in one place cannot be told apart by smaller cells
            ((F.max("latitude") > F.min("latitude")) | (F.max("longitude") > F.min("longitude"))).alias("_wide")))
        quarters = cells.withColumns({"_cy": F.col("_y"), "_cx": F.col("_x"), "_y": F.shiftright("_y", 1), "_x": F.shiftright("_x", 1)})
        met = attach(near, quarters, ["_y", "_x"], "inner").withColumn("_mid", S.haversine_km("lat", "lon", "_la", "_lo"))
        by_reach = Window.partitionBy(key).orderBy(F.col("_mid") + F.col("_reach"), "_cy", "_cx")
        met = met.withColumn("_upto", F.sum("_points").over(by_reach.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        # so many points lie within this distance for sure; a cell that begins beyond it has none of the nearest
        enough = F.min(F.when(F.col("_upto") >= k, F.col("_mid") + F.col("_reach"))).over(Window.partitionBy(key))
        near = stable(met.withColumn("_enough", enough).filter(F.col("_mid") - F.col("_reach") <= F.col("_enough") + 1e-6).select(
            key, "lat", "lon", F.col("_cy").alias("_y"), F.col("_cx").alias("_x"), "_points", "_wide"))
        most = near.filter("_wide").agg(F.max("_points")).first()[0] or 0
        near = near.drop("_points", "_wide")
    held = points.withColumns({c: F.shiftright(c, up) for c in ("_y", "_x")})
    last = attach(near, held, ["_y", "_x"], "inner", counted=box[4]).withColumn(
        "distance_km", S.haversine_km("lat", "lon", "latitude", "longitude"))
    # places at equal distance differ in the last bits; equal to a micrometre is a tie
    order = Window.partitionBy(key).orderBy(F.round("distance_km", 9), "grid_id")
    return stable(last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "grid_id", "distance_km", "rank"))


def turbine_weights(neighbours: DataFrame, power: float = K.IDW_POWER, key: str = "turbine") -> DataFrame:
    inverse = F.lit(1.0) / F.pow(F.greatest(F.col("distance_km"), F.lit(K.MIN_KM)), F.lit(power))
    share = F.col("_inv") / F.sum("_inv").over(Window.partitionBy(key))
    return neighbours.withColumn("_inv", inverse).withColumn("w", share).drop("_inv")


def group_weights(turbines: DataFrame, grid: DataFrame, k: int = K.IDW_NEIGHBOURS,
                  power: float = K.IDW_POWER, key: str = "turbine", groups: list[str] = K.GROUPS,
                  check: bool = True) -> DataFrame:
    """(group, grid_id, w) for every grid point and group with turbines; unused points weigh 0."""
    turbines, grid = stable(weight_inputs(turbines, tuple(groups))), stable(grid)
    near = turbine_weights(nearest_grid(turbines, grid, k, key=key, settle_grid=False), power, key)
    placed = near.join(turbines.select(key, "group", "cap_kw"), key)
    shares = placed.groupBy("group", "grid_id").agg(F.sum(F.col("cap_kw") * F.col("w")).alias("_share"))
    totals = turbines.groupBy("group").agg(F.sum("cap_kw").alias("_total"))
    all_groups = F.explode(F.array(*[F.lit(g) for g in groups])).alias("group")
    # group names were checked against ``groups``, so there is at most one total for each
    every = grid.select("grid_id", all_groups).join(F.broadcast(totals), "group")
    weights = every.join(shares, ["group", "grid_id"], "left").select(
        "group", "grid_id", (F.coalesce(F.col("_share"), F.lit(0.0)) / (F.col("_total") + K.TINY)).alias("w"))
    return check_weights(weights) if check else weights


def check_weights(weights: DataFrame) -> DataFrame:
    """Each group's weights must be finite and add up to one."""
    weights = stable(weights)
    sums = weights.groupBy("group").agg(F.sum("w").alias("total")).collect()  # one row per group
    if not sums or any(r["total"] is None or not abs(r["total"] - 1.0) <= 1e-5 for r in sums):
        raise ContractError(f"weights of a group do not add up to 1, check group keys and capacities: {sums}")
    return weights


def area_means(df: DataFrame, features: list[str], weights: DataFrame, ts: str = "forecast_kst_dtm",
               ranges: dict[str, str] | None = None, first: list[str] = ()) -> DataFrame:
    """Weighted mean per (stamp, group) of all features: one scan, one shuffle of the rows as they are.

    A point that is absent or null makes the mean null, also where its weight is zero.
    ``ranges`` adds the spread over the points of a stamp as a feature, and ``first`` the first
    known value of columns that are the same for all points, in the same aggregation.
    """
    points = weights.groupBy("group").agg(F.count(F.lit(1)).alias("_points"))
    # one row per group and grid point; the number of points rides along
    side = weights.join(points, "group")
    spread = ranges or {}
    needed = list(dict.fromkeys([*features, *spread.values(), *first]))
    # dealt by stamp once, the rows meet the groups where their sums are taken
    rows = attach(df.select(ts, "grid_id", *needed).repartition(ts), side, ["grid_id"], "inner", counted=weights)
    # a null turns its sum into NaN, so one row count serves all features
    total = lambda c: F.sum(F.coalesce(F.col("w") * F.col(c), F.lit(float("nan")))).alias(c)
    known_first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("grid_id"))).alias(c)
    sums = rows.groupBy(ts, "group").agg(
        F.first("_points").alias("_points"), F.count(F.lit(1)).alias("_n"), F.sum("w").alias("_w"),
        *[total(c) for c in features],
        *[(F.max(c) - F.min(c)).alias(n) for n, c in spread.items()],
        *[known_first(c) for c in first])
    seen = F.col("_n") == F.col("_points")
    whole = lambda c: F.when(seen & ~F.isnan(c), F.col(c)).alias(c)
    level = lambda c: F.when(seen, F.col(c) * F.col("_w")).alias(c)
    return sums.select(ts, "group", *[whole(c) for c in features], *[level(n) for n in spread], *first)


def time_meta(group_df: DataFrame, grid_df: DataFrame, columns: list[str], ts: str = "forecast_kst_dtm",
              order: str = "grid_id") -> DataFrame:
    """Bring back the first known time columns of each stamp and add the cyclic ones."""
    present = [c for c in columns if c in grid_df.columns]
    if present:
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
        meta = grid_df.groupBy(ts).agg(*[first(c) for c in present])
        group_df = group_df.join(meta, ts, "left")
    return group_df.withColumns(S.cyclic_time(ts))


def _area(grid_df: DataFrame, weights: DataFrame, wanted: list[str], times: list[str],
          ranges: dict[str, str]) -> tuple[DataFrame, set[str]]:
    have = set(grid_df.columns)
    features = [c for c in wanted if c in have]
    spread = {n: c for n, c in ranges.items() if n not in have and c in have}
    if not features:
        raise ContractError("no feature to average")
    df = area_means(grid_df, features, weights, ranges=spread, first=[c for c in times if c in have])
    return df.withColumns(S.cyclic_time("forecast_kst_dtm")), set(features)


def ldaps_area(grid_df: DataFrame, weights: DataFrame) -> DataFrame:
    df, features = _area(grid_df, weights, K.LDAPS_AREA_FEATURES,
                         ["lead_hour", "target_hour", "forecast_issue_date"], {"ws10_spatial_range": "ws10"})
    if {"u10", "v10"} <= features:
        df = df.withColumns({"ws10_vector": S.wind_speed("u10", "v10"), "wd10": S.wind_direction("u10", "v10")})
        df = direction_cycle(df, ["wd10"])
    if "ws10" in features:
        ws = F.col("ws10")
        df = df.withColumns({"ws10_2": ws * ws, "ws10_3": ws * ws * ws})
    return df


def gfs_area(grid_df: DataFrame, weights: DataFrame) -> DataFrame:
    df, features = _area(grid_df, weights, K.GFS_AREA_FEATURES,
                         ["gfs_lead_hour", "target_hour", "forecast_issue_date"], {})
    levels = [n for n, (u, v) in K.GFS_LEVELS.items() if {u, v} <= features]
    df = df.withColumns({f"gfs_wd_{n}": S.wind_direction(*K.GFS_LEVELS[n]) for n in levels})
    df = direction_cycle(df, [f"gfs_wd_{n}" for n in levels])
    if "gfs_ws_hub" in features:
        hub = F.col("gfs_ws_hub")
        df = df.withColumns({"gfs_ws_hub_2": hub * hub, "gfs_ws_hub_3": hub * hub * hub})
    return df


def grid_statistics(df: DataFrame, ts: str = "forecast_kst_dtm", prefix: str = "ldaps") -> DataFrame:
    """Spread over the points of each stamp. Powers are taken per point, before the mean.

    A group is the points of one stamp, a fixed small number, so exact percentiles are cheap.
    """
    ws = F.col("ws10")
    features = [c for c in K.LDAPS_STAT_FEATURES if c in df.columns]
    stats = []
    for c in features:
        stats += [F.avg(c).alias(f"{prefix}_{c}_mean"), F.stddev_samp(c).alias(f"{prefix}_{c}_std"),
                  F.min(c).alias(f"{prefix}_{c}_min"), F.max(c).alias(f"{prefix}_{c}_max")]
    for name, share in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        stats.append(F.percentile("ws10", F.lit(share)).alias(f"{prefix}_ws10_{name}"))
    stats += [F.avg(ws * ws).alias(f"{prefix}_mean_ws2"), F.avg(ws * ws * ws).alias(f"{prefix}_mean_ws3")]
    if "air_density" in df.columns:
        stats.append(F.avg(F.col("air_density") * ws * ws * ws).alias(f"{prefix}_mean_rho_ws3"))
    p = lambda c: f"{prefix}_{c}"
    return df.groupBy(ts).agg(*stats).withColumns({
        p("ws10_range"): F.col(p("ws10_max")) - F.col(p("ws10_min")),
        p("wd10"): S.wind_direction(p("u10_mean"), p("v10_mean"))})
