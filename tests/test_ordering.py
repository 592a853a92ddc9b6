"""Long-series primitives against plain windows and NumPy, with tiny blocks and hot keys."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from zephyrgrid.operators import ordering as O
from zephyrgrid.operators import series as Sr

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Keep small range partitions apart, so that offsets between slices are put to use."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series(spark, n=400, seed=1, gaps=True):
    """Two keys, one of them long, irregular stamps and null values."""
    rng = np.random.default_rng(seed)
    rows = []
    for key, length in (("a", n), ("b", 7)):
        step = 0
        for _ in range(length):
            step += int(rng.integers(1, 200)) if gaps else 1
            value = None if rng.random() < 0.3 else float(rng.integers(0, 5))
            rows.append((key, START + dt.timedelta(hours=step), value))
    pdf = pd.DataFrame(rows, columns=["group", "ts", "x"])
    frame = spark.createDataFrame(rows, "group string, ts timestamp_ntz, x double")
    return frame, pdf


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("sliced", [True, False])
def test_numbered_equals_row_number(spark, sliced):
    df, _ = series(spark)
    got = O.numbered(df, ["group"], ["ts"], O.time_slice("ts") if sliced else None,
                     running={"seen": F.col("x").isNotNull().cast("bigint")}, total="n")
    w = Window.partitionBy("group").orderBy("ts")
    want = df.withColumns({"pos": F.row_number().over(w).cast("bigint"),
                           "seen": F.sum(F.col("x").isNotNull().cast("bigint")).over(w),
                           "n": F.count(F.lit(1)).over(Window.partitionBy("group"))})
    assert rows_of(got, "group", "ts", "pos", "seen", "n") == rows_of(want, "group", "ts", "pos", "seen", "n")


def test_numbered_splits_a_hot_stamp(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.lit(1).alias("ts"), F.col("id"))
    got = O.numbered(df, ["k"], ["ts", "id"])
    ranged = df.repartitionByRange("k", "ts", "id").select(F.spark_partition_id().alias("p"))
    assert ranged.distinct().count() > 1
    assert got.filter(F.col("pos") != F.col("id") + 1).count() == 0 and got.count() == 5000


@pytest.mark.parametrize("block", [1, 5, 24, 1000])
def test_framed_equals_whole_window(spark, block):
    df, _ = series(spark)
    build = lambda w: {"back": F.sum("x").over(w.rowsBetween(-3, 0)), "next": F.max("x").over(w.rowsBetween(1, 3)),
                       "lag": F.lag("x", 3).over(w)}
    got = O.framed(df, ["group"], ["ts"], build, before=3, after=3, slice_by=O.time_slice("ts"), block=block)
    want = df.withColumns(build(Window.partitionBy("group").orderBy("ts")))
    cols = ("group", "ts", "back", "next", "lag")
    assert rows_of(got, *cols) == rows_of(want, *cols)


@pytest.mark.parametrize("hot", [False, True])
def test_exact_quantiles(spark, hot):
    rng = np.random.default_rng(3)
    values = rng.normal(size=3000)
    if hot:
        values[:2000] = 0.25
    rows = [("big", float(v)) for v in values] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["share"]): r["quantile"] for r in O.exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert got["big", share] == pytest.approx(np.quantile(values, share), abs=1e-12)
        assert got["two", share] == pytest.approx(1 + share)
        assert got["one", share] == 5.0


def frozen_by_hand(pdf, steps):
    out = []
    for _, part in pdf.groupby("group"):
        same = part["x"].eq(part["x"].shift())
        size = part.groupby((~same).cumsum())["x"].transform("size")
        out += list(zip(part["group"], part["ts"], (size >= steps) & part["x"].notna() & (part["x"] != 0)))
    return {(g, t): bool(f) for g, t, f in out}


@pytest.mark.parametrize("block", [4, 30, 1000])
def test_frozen_runs(spark, block):
    rng = np.random.default_rng(5)
    rows, step = [], 0
    for _ in range(60):
        value = [None, 0.0, 1.0, 2.0][int(rng.integers(0, 4))]
        for _ in range(int(rng.integers(1, 9))):
            step += 1
            rows.append(("a", START + dt.timedelta(hours=step), value))
    pdf = pd.DataFrame(rows, columns=["group", "ts", "x"])
    df = spark.createDataFrame(rows, "group string, ts timestamp_ntz, x double")
    got = Sr.frozen_sensor(df, "x", ["group"], "ts", steps=4, flag="f", block=block)
    assert {(r["group"], r["ts"]): r["f"] for r in got.collect()} == frozen_by_hand(pdf, 4)


def interpolate_by_hand(x, limit=2):
    s = pd.Series(x, dtype=float)
    missing = s.isna()
    size = s.groupby((missing != missing.shift()).cumsum()).transform("size")
    return s.where(~(missing & (size <= limit)), s.interpolate(limit_area="inside"))


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_short_gaps(spark, block):
    df, pdf = series(spark, 300, seed=9, gaps=False)
    got = Sr.fill_short_gaps(df, [("x", "y", "m")], ["group"], "ts", block=block).orderBy("group", "ts").toPandas()
    for key, part in pdf.groupby("group"):
        want = interpolate_by_hand(part["x"].tolist())
        mine = got[got["group"] == key].reset_index(drop=True)
        np.testing.assert_allclose(mine["y"].astype(float), want, equal_nan=True)
        assert (mine["m"] == (part["x"].reset_index(drop=True).isna() & want.notna())).all()


def test_short_gap_example(spark):
    x = [1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = spark.createDataFrame([("t", START + dt.timedelta(minutes=10 * i), v) for i, v in enumerate(x)],
                               "turbine string, kst_dtm timestamp_ntz, x double")
    out = Sr.fill_short_gaps(df, [("x", "y", "m")]).orderBy("kst_dtm").collect()
    assert [r["y"] for r in out] == [1, 2, 3, 4, None, None, None, 8, None]
    assert [r["m"] for r in out] == [False, True, True] + [False] * 6


def test_gap_runs(spark):
    df, pdf = series(spark, 300, seed=11)
    got = {(r["group"], r["gap_start"]): r["run_len"] for r in Sr.gap_runs(df, "x", ["group"], "ts").collect()}
    want = {}
    for key, part in pdf.groupby("group"):
        missing = part["x"].isna()
        for _, run in part[missing].groupby((missing != missing.shift()).cumsum()[missing]):
            want[key, run["ts"].iloc[0].to_pydatetime()] = len(run)
    assert got == want


def test_next_three_hours(spark):
    x = [1.0, 2.0, 5.0, 3.0, 4.0]
    df = spark.createDataFrame([("g", START + dt.timedelta(hours=i), v) for i, v in enumerate(x)],
                               "group string, forecast_kst_dtm timestamp_ntz, ws double")
    out = Sr.ramps(df, "ws", "ws", "ws", "ws").orderBy("forecast_kst_dtm").collect()
    assert [r["ws_next3h_max"] for r in out] == [5, 5, 4, 4, None]
    assert [r["ws_next3h_min"] for r in out] == [2, 3, 3, 4, None]
    assert [r["ws_diff_3h"] for r in out] == [None, None, None, 2, 2]


@pytest.mark.parametrize("next_step", [False, True])
@pytest.mark.parametrize("block", [4, 1000])
def test_sequences(spark, next_step, block):
    df, pdf = series(spark, 80, seed=2, gaps=False)
    df = df.withColumn("y", F.hour("ts").cast("double"))
    got = Sr.sequences(df, ["x", "y"], "y", next_step, ["group"], "ts", length=4, block=block)
    mine = {(r["group"], r["ts"]): (tuple(tuple(c) for c in r["sequence"]), r["target"]) for r in got.collect()}
    want = {}
    for key, part in pdf.groupby("group"):
        xs, ts = part["x"].tolist(), [t.to_pydatetime() for t in part["ts"]]
        for i in range(len(xs)):
            last = i - 1 if next_step else i
            window = xs[last - 3:last + 1] if last >= 3 else []
            if len(window) == 4 and not any(pd.isna(v) for v in window):
                cells = tuple((v, float(ts[j].hour)) for v, j in zip(window, range(last - 3, last + 1)))
                want[key, ts[i]] = (cells, float(ts[i].hour))
    assert mine == want and want


@pytest.mark.parametrize("next_step", [False, True])
def test_sequences_bridge_no_gap(spark, next_step):
    rng = np.random.default_rng(5)
    hours = [("a", h) for h in range(90) if h % 17 != 3] + [("b", h) for h in range(5, 40) if h != 20]
    rows = [(k, START + dt.timedelta(hours=h), None if rng.random() < 0.05 else float(h), None if rng.random() < 0.1 else 1.0 * h) for k, h in hours]
    df = spark.createDataFrame(rows, "group string, ts timestamp_ntz, x double, y double")
    got = Sr.sequences(df, ["x"], "y", next_step, ["group"], "ts", length=4, block=11, step_seconds=3600)
    known = {(k, t): (x, y) for k, t, x, y in rows}
    want = {}
    for k, t, _, y in rows:
        stamps = [t - dt.timedelta(hours=i + next_step) for i in (3, 2, 1, 0)]
        cells = [known.get((k, s), (None, None))[0] for s in stamps]
        if y is not None and None not in cells:
            want[k, t] = (cells, y)
    assert {(r["group"], r["ts"]): ([c[0] for c in r["sequence"]], r["target"]) for r in got.collect()} == want
    whole = Sr.sequences(df, ["x"], "y", next_step, ["group"], "ts", length=4)
    assert len(want) < whole.count()


def test_context_and_persistence(spark):
    df, pdf = series(spark, 60, seed=4)
    cut = sorted(pdf[pdf.group == "a"]["ts"])[40]
    train, test = df.filter(F.col("ts") < F.lit(cut)), df.filter(F.col("ts") >= F.lit(cut))
    out = Sr.with_context(train, test, ["group"], "ts", length=5)
    n_train = {k: min(5, len(p[p.ts < cut])) for k, p in pdf.groupby("group")}
    assert {r["group"]: r["count"] for r in out.filter("NOT is_test").groupBy("group").count().collect()} == {
        k: v for k, v in n_train.items() if v}
    lagged = Sr.persistence(df.fillna(0.0), "x", ["group"], ["ts"], block=7)
    assert lagged.count() == len(pdf) - 2


def test_causal_scales_add_up(spark):
    df, _ = series(spark, 200, seed=6)
    df = df.fillna(1.0).withColumnRenamed("ts", "forecast_kst_dtm")
    out = Sr.causal_scales(df, "x", spans=(12, 6, 3), block=20)
    total = sum((F.col(f"x_scale_{n}") for n in (12, 6, 3, 1)), F.lit(0.0))
    assert out.filter(F.abs(total - F.col("x")) > 1e-9).count() == 0


def test_complete_axis(spark):
    stamps = [("a", 0), ("a", 3), ("b", 300)]
    df = spark.createDataFrame([(k, START + dt.timedelta(minutes=3 + 10 * i), 1.0) for k, i in stamps],
                               "turbine string, kst_dtm timestamp_ntz, v double")
    out = Sr.complete_axis(df)
    assert out.count() == 2 * 301 and out.filter("v IS NOT NULL").count() == 3
    assert out.agg(F.max("kst_dtm")).first()[0] == START + dt.timedelta(minutes=3003)
