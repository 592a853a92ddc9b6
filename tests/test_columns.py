"""Scalars, contracts and flags on hand-made rows with edges and nulls."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import flags as Fl
from zephyrgrid.operators import sensor as Se


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_directions(spark):
    d = lambda u, v: S.wind_direction(F.lit(u), F.lit(v))
    assert one(spark, d(-1.0, 0.0), d(0.0, 1.0), d(1.0, 0.0), d(0.0, -1.0), d(0.0, 0.0)) == (90, 180, 270, 0, 180)
    turn = lambda a, b: S.angle_difference(F.lit(a), F.lit(b))
    assert one(spark, turn(350.0, 10.0), turn(10.0, 350.0), turn(180.0, 0.0), turn(0.0, 270.0)) == (-20, 20, -180, 90)
    assert one(spark, S.normalise_direction(F.lit(-90.0)), S.normalise_direction(F.lit(360.0))) == (270, 0)


def test_vector_round_trip(spark):
    u, v = S.wind_u(F.lit(7.0), F.lit(213.0)), S.wind_v(F.lit(7.0), F.lit(213.0))
    speed, direction = one(spark, S.wind_speed(u, v), S.wind_direction(u, v))
    assert speed == pytest.approx(7.0) and direction == pytest.approx(213.0)


def test_missing_stays_missing(spark):
    gone = F.lit(None).cast("double")
    assert one(spark, S.wind_shear(gone, F.lit(3.0), 10, 100), S.gust_factor(F.lit(3.0), gone), C.clip_between(gone, 0.0, F.lit(1.0)),
               S.air_density(F.lit(0.0), F.lit(0.01), F.lit(1e5)), S.season(F.lit(None).cast("timestamp_ntz"))) == (None,) * 5
    assert one(spark, S.wind_shear(F.lit(0.0), F.lit(0.0), 10, 100)) == (0.0,)


def test_time(spark):
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    ends = one(spark, S.hour_end(stamp("2024-01-01 00:10:00")), S.hour_end(stamp("2024-01-01 01:00:00")),
               S.hour_end(stamp("2024-01-01 01:00:00.000001")), S.ten_minute_floor(stamp("2024-01-01 01:29:59.9")))
    assert [e.strftime("%H:%M") for e in ends] == ["01:00", "01:00", "02:00", "01:20"]
    assert one(spark, S.lead_hours(stamp("2024-01-01 13:00:00"), stamp("2024-01-02 01:30:00"))) == (12.5,)
    assert one(spark, *[S.hour_bucket(F.lit(h)) for h in (0, 8, 9, 16, 23)]) == ("short", "short", "middle", "middle", "long")
    assert one(spark, S.season(stamp("2024-12-01 00:00:00")), S.season(stamp("2024-11-30 00:00:00"))) == ("winter", "autumn")


def test_prices(spark):
    price = lambda e: S.unit_price(F.lit(e))
    assert one(spark, price(0.06), price(0.0601), price(0.08), price(0.0801)) == (4, 3, 3, 0)
    soft = one(spark, S.soft_price(F.lit(0.0)), S.soft_price(F.lit(1.0)))
    assert soft[0] > 3.7 and soft[1] == pytest.approx(0.0, abs=1e-9)


def test_gradient_is_the_derivative(spark):
    def loss(e, k=40.0, w=0.7):
        g = lambda edge: 1 / (1 + math.exp(-k * (abs(e) - edge)))
        return w * abs(e) + (1 - w) * (g(0.06) + 3 * g(0.08)) / 4
    for e in (-0.3, -0.07, 0.03, 0.065, 0.09):
        grad, hess = one(spark, *S.settlement_gradient(F.lit(e)))
        assert grad == pytest.approx((loss(e + 1e-6) - loss(e - 1e-6)) / 2e-6, rel=1e-5)
        assert hess >= 0.003


def test_dms(spark):
    df = spark.createDataFrame([("37°16'55.61\"N 128°57'02.10\"E",), ("10°0'0\"S 20°30'0\"W",)], "c string")
    got = df.select(*[c.alias(n) for c, n in zip(S.dms_parts("c"), ("lat", "lon"))]).collect()
    assert got[0]["lat"] == pytest.approx(37.282114, abs=1e-6) and got[0]["lon"] == pytest.approx(128.950583, abs=1e-6)
    assert (got[1]["lat"], got[1]["lon"]) == (-10.0, -20.5)
    with pytest.raises(Exception, match="not a coordinate"):
        spark.createDataFrame([("37.2, 128.9",)], "c string").select(*S.dms_parts("c")).collect()


def test_group_key(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("kpx_group_3",)], "g string")
    assert [r[0] for r in df.select(C.group_key("g")).collect()] == ["kpx_group_1", "kpx_group_1", "kpx_group_3"]
    assert one(spark, C.group_key(F.lit(2)), C.group_key(F.lit(3.0))) == ("kpx_group_2", "kpx_group_3")
    for bad in ("1.5", "4", "plant", None):
        with pytest.raises(Exception, match="unknown group"):
            spark.createDataFrame([(bad,)], "g string").select(C.group_key("g")).collect()


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, s string")
    assert C.validate(df, ["a"]) is df
    with pytest.raises(C.ContractError, match="missing"):
        C.validate(df, ["z"])
    with pytest.raises(C.ContractError, match="twice"):
        C.validate(df.select("a", "a"), ["a"])
    with pytest.raises(C.ContractError, match="empty"):
        C.validate(df.filter("a > 1"), ["a"])
    with pytest.raises(C.ContractError, match="melt"):
        C.rename_sensor(df)
    assert C.rename_known(df, {"a": "c", "absent": "d"}).columns == ["c", "b", "s"]
    assert C.feature_columns(df.withColumn("kpx_group_2", F.lit(1.0))) == ["a", "b"]
    with pytest.raises(C.ContractError, match="declare"):
        C.one_hot(spark.range(5), "id", most=3)
    assert C.one_hot(df, "s").columns == ["a", "b", "s_x"]
    with pytest.raises(C.ContractError, match="signal"):
        C.require_signal(df.withColumn("z", F.lit(0.0)), ["b", "z"])
    infinite = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "v double")
    assert [r["v"] for r in C.infinite_to_null(infinite).collect()] == [None, None, None, 1.0]


def test_turbine_tables(spark):
    info = spark.createDataFrame([("37°0'0\"N 128°30'0\"E", 2, 3.6, "V126")], "at string, g int, mw double, model string")
    meta = C.turbine_spec(C.turbine_meta(info, "at", "g", "mw")).first()
    assert (meta["group"], meta["cap_kw"], meta["cap_kwh10m"], meta["cut_out_ms"], meta["lon"]) == ("kpx_group_2", 3600, 600, 22.5, 128.5)
    given = C.weight_inputs(spark.createDataFrame([(1, 1.0, 2.0, 4.2)], "group int, lat double, lon double, capacity_mw double")).first()
    assert given["cap_kw"] == 4200 and given["group"] == "kpx_group_1"


def test_submission_checks(spark):
    sample = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "forecast_id int, p double")
    done = spark.createDataFrame([(1, -1.0), (2, None), (3, 99.0)], "forecast_id int, p double")
    row = C.submission_violations(done, sample, {"p": 50.0}).first()
    assert (row["n_rows"], row["n_expected"], row["n_null"], row["n_negative"], row["n_above_capacity"], row["varies_p"]) == (3, 3, 1, 1, 1, True)


READING = "turbine string, kst_dtm timestamp_ntz, power_raw double, ws_raw double, wd_raw double, cap_kwh10m double, cut_out_ms double, group string"


def test_sensor_limits(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("t", at + dt.timedelta(minutes=10 * i), p, w, 0.0, 600.0, 22.5, "g") for i, (p, w) in enumerate(
        [(631.0, 8.0), (-31.0, 8.0), (-29.0, 1.0), (0.0, 2.0), (0.0, 5.0), (0.0, 22.5), (10.0, 76.0), (None, None)])]
    out = Fl.sensor_limits(spark.createDataFrame(rows, READING)).orderBy("kst_dtm").collect()
    flag = lambda name: [r[name] for r in out]
    on = lambda *i: [k in i for k in range(8)]
    assert flag("is_power_outlier") == on(0)
    assert flag("is_power_neg_large") == on(1)
    assert flag("is_power_neg_small") == on(2)
    assert flag("is_low_wind_zero_power") == on(2, 3)
    assert flag("is_high_wind_zero_power") == on(1, 4)
    assert flag("is_cut_out") == on(5, 6)
    assert flag("is_ws_out_of_range") == on(6)


def test_qc_code(spark):
    flags = {name: F.lit(name in ("is_power_neg_large", "is_turbine_disagreement")) for name in K.QC_FLAGS}
    row = spark.range(1).withColumns(flags).withColumn("q", Fl.qc_code()).select(
        "q", *[Fl.qc_has("q", n).alias(n) for n in K.QC_FLAGS]).first()
    assert row["q"] == 2 + 256
    assert [n for n in K.QC_FLAGS if row[n]] == ["is_power_neg_large", "is_turbine_disagreement"]


def test_disagreement_ignores_outliers(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(t, at, p, 8.0, 0.0, 600.0, 22.5, "g") for t, p in (("a", 100.0), ("b", 120.0), ("c", 500.0), ("d", 5000.0), ("e", None))]
    out = Fl.turbine_disagreement(Fl.sensor_limits(spark.createDataFrame(rows, READING)))
    assert {r["turbine"]: r["is_turbine_disagreement"] for r in out.collect()} == {"a": False, "b": False, "c": True, "d": False, "e": False}


def test_group_hours(spark):
    """A silent member makes the sum null but still counts for coverage; an absent group-hour is a row."""
    h1, h2 = dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 2)
    schema = "turbine string, hour_end timestamp_ntz, group string, cap_kwh10m double, n_valid bigint, power_sum_strict double, " \
             "power_sum_relaxed double, ws_mean double, u_mean double, v_mean double"
    g1, g2 = K.GROUPS[:2]
    rows = [("a", h1, g1, 600.0, 6, 60.0, 60.0, 5.0, 3.0, 4.0), ("b", h1, g1, 600.0, 5, None, 48.0, 5.0, 3.0, 4.0),
            ("a", h2, g1, 600.0, 6, 60.0, 60.0, 5.0, -3.0, -4.0), ("b", h2, g1, 600.0, 6, 30.0, 30.0, 5.0, 3.0, 4.0),
            ("c", h1, g2, 700.0, 6, 10.0, 10.0, 2.0, 0.0, 2.0)]
    out = {(r["group"], r["hour_end"].hour): r for r in Se.group_hourly(spark.createDataFrame(rows, schema)).collect()}
    assert len(out) == 4
    assert out[g1, 1]["scada_power_kwh"] is None and out[g1, 1]["scada_power_kwh_relaxed"] == 108.0
    assert out[g1, 1]["coverage_ratio"] == pytest.approx(11 / 12) and out[g1, 1]["avail_cap_ratio"] == pytest.approx(0.5)
    assert out[g1, 2]["scada_power_kwh"] == 90.0 and out[g1, 2]["capacity_factor"] == pytest.approx(90 / 7200)
    assert out[g1, 1]["scada_dir_resultant"] == pytest.approx(1.0) and out[g1, 2]["scada_ws_vector"] == 0.0
    assert out[g2, 2]["coverage_ratio"] == 0.0 and out[g2, 2]["scada_power_kwh"] is None


def test_wide_to_long(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 2.0, 3.0)],
                               "kst_dtm timestamp_ntz, x_wtg01_power_kw10m double, x_wtg01_ws double, x_wtg01_wd double")
    assert tuple(Se.wide_to_long(df, ["x_wtg01"]).first())[1:] == ("x_wtg01", 1.0, 2.0, 3.0)
