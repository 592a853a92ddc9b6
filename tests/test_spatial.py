"""Neighbours, weights and area means against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.operators import spatial as Sa
from zephyrgrid.operators.contracts import ContractError


def km(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(a))


def places(spark, seed, n, spread):
    rng = np.random.default_rng(seed)
    grid = [(i, 37 + float(rng.uniform(0, spread)), 128 + float(rng.uniform(0, spread))) for i in range(n)]
    turbines = [(f"t{i}", 37 + float(rng.uniform(-spread, 2 * spread)), 128 + float(rng.uniform(-spread, 2 * spread))) for i in range(25)]
    turbines.append(("far", 10.0, 20.0))
    return (spark.createDataFrame(grid, "grid_id int, latitude double, longitude double"), grid,
            spark.createDataFrame(turbines, "turbine string, lat double, lon double"), turbines)


@pytest.mark.parametrize("n,spread,k", [(40, 0.2, 4), (3, 0.1, 4), (60, 3.0, 2)])
def test_nearest(spark, n, spread, k):
    gdf, grid, tdf, turbines = places(spark, n, n, spread)
    got = {(r["turbine"], r["rank"]): (r["grid_id"], r["distance_km"]) for r in Sa.nearest_grid(tdf, gdf, k).collect()}
    assert len(got) == len(turbines) * min(n, k)
    for name, lat, lon in turbines:
        by_hand = sorted((float(km(lat, lon, a, b)), i) for i, a, b in grid)[:k]
        for rank, (d, i) in enumerate(by_hand, 1):
            assert got[name, rank][0] == i and got[name, rank][1] == pytest.approx(d, rel=1e-9)


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_nearest_descends_to_few_points(spark, leaf, monkeypatch):
    """Many points, clumped and repeated, and turbines far from all of them."""
    rng = np.random.default_rng(leaf)
    spots = np.r_[rng.normal([37, 128], 0.01, (1500, 2)), rng.uniform([30, 100], [60, 140], (1500, 2)), np.tile([[45.0, 120.0]], (30, 1))]
    grid = [(i, float(a), float(b)) for i, (a, b) in enumerate(spots)]
    turbines = [("pole", 89.0, 0.0), ("other side", -37.0, -52.0), ("far", 10.0, 20.0), ("in clump", 37.0, 128.0), ("same", 45.0, 120.0),
                ("date line", 50.0, -179.0), *[(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform([20, 80], [70, 170], (20, 2)))]]
    gdf = spark.createDataFrame(grid, "grid_id int, latitude double, longitude double")
    tdf = spark.createDataFrame(turbines, "turbine string, lat double, lon double")
    seen, attach = [], Sa.attach
    monkeypatch.setattr(Sa, "attach", lambda *a, **b: (seen.append(out := attach(*a, **b)), out)[1])
    got = {(r["turbine"], r["rank"]): r["grid_id"] for r in Sa.nearest_grid(tdf, gdf, 4, leaf=leaf).collect()}
    for name, lat, lon in turbines:
        d = np.round(km(lat, lon, spots[:, 0], spots[:, 1]), 9)
        assert [got[name, r] for r in range(1, 5)] == np.lexsort((np.arange(len(d)), d))[:4].tolist()
    # the last join holds the points that were ordered: few of the 3,030 even for the far turbines
    per = {r["turbine"]: r["count"] for r in seen[-1].groupBy("turbine").count().collect()}
    assert max(per.values()) < 40 + 12 * leaf


def test_weights(spark):
    gdf, grid, tdf, turbines = places(spark, 5, 12, 0.1)
    tdf = tdf.withColumns({"group": F.when(F.col("turbine") == "far", 2).otherwise(1), "cap_kw": F.lit(3600.0)})
    w = Sa.group_weights(tdf, gdf).collect()
    assert {r["group"] for r in w} == set(K.GROUPS[:2]) and len(w) == 24
    for g in K.GROUPS[:2]:
        assert sum(r["w"] for r in w if r["group"] == g) == pytest.approx(1.0)
    want = np.zeros(12)
    near = [t for t in turbines if t[0] != "far"]
    for _, lat, lon in near:
        d = np.array([km(lat, lon, a, b) for _, a, b in grid])
        pick = np.argsort(d)[:4]
        want[pick] += 3600 * (1 / d[pick] ** 2) / (1 / d[pick] ** 2).sum()
    want /= 3600 * len(near)
    mine = np.array([r["w"] for r in sorted(w, key=lambda r: r["grid_id"]) if r["group"] == K.GROUPS[0]])
    np.testing.assert_allclose(mine, want, rtol=1e-9, atol=1e-12)


def test_bad_weights_raise(spark):
    gdf, _, tdf, _ = places(spark, 5, 4, 0.1)
    with pytest.raises(ContractError, match="add up"):
        Sa.group_weights(tdf.withColumns({"group": F.lit(1), "cap_kw": F.lit(0.0)}), gdf)
    with pytest.raises(ContractError, match="no grid"):
        Sa.nearest_grid(tdf, gdf.filter("grid_id < 0"))


def test_missing_point_makes_null(spark):
    """A point with zero weight still has to be there."""
    t = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [(t[0], 1, 2.0, 1.0), (t[0], 2, 4.0, 1.0), (t[0], 3, 9.0, 1.0), (t[1], 1, 2.0, 1.0), (t[1], 2, 4.0, 1.0),
            (t[2], 1, 2.0, 1.0), (t[2], 2, 4.0, None), (t[2], 3, None, 1.0)]
    df = spark.createDataFrame(rows, "forecast_kst_dtm timestamp_ntz, grid_id int, x double, y double")
    w = spark.createDataFrame([("g", 1, 0.5), ("g", 2, 0.5), ("g", 3, 0.0)], "group string, grid_id int, w double")
    out = {r["forecast_kst_dtm"].hour: r for r in Sa.area_means(df, ["x", "y"], w, ranges={"x_range": "x"}).collect()}
    assert (out[0]["x"], out[0]["y"], out[0]["x_range"]) == (3.0, 1.0, 7.0)
    assert (out[1]["x"], out[1]["y"], out[1]["x_range"]) == (None, None, None)
    assert (out[2]["x"], out[2]["y"], out[2]["x_range"]) == (None, None, 2.0)
