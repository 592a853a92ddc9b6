"""Sources and sinks on small files."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid.session import new_folder, shared_dir
from zephyrgrid.sources import catalog as Ca
from zephyrgrid.sources import store as St


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿kst_dtm,x\n2024-01-01 01:00:00,1.5\n2024-01-01 02:00:00,\n".encode())
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("day_date,y\n2024-03-01,1\nnot a date,2\n")
    (tmp_path / "c.xlsx").write_bytes(b"x")
    return str(tmp_path)


def test_catalog(spark, folder):
    source = Ca.Catalog(spark, {"a": f"{folder}/a.csv", "b": f"{folder}/b.csv.gz", "gone": f"{folder}/gone.csv"})
    assert source["a"].columns == ["kst_dtm", "x"] and source["a"] is source["a"]
    assert source.load("a", force=True) is not None
    assert source.check_paths() == {"a": True, "b": True, "gone": False}
    tables, failures = source.load_all()
    assert set(tables) == {"a", "b"} and "no such source" in failures["gone"]
    assert set(source.register_views("v_")) == {"v_a", "v_b"} and spark.table("v_b").count() == 2
    profile = {r["column"]: (r["first"], r["last"]) for r in source.summarize("b").collect()}
    assert profile["day_date"][0] == profile["day_date"][1] and profile["day_date"][0].year == 2024
    for bad in ("nobody", "gone"):
        with pytest.raises(Ca.SourceError):
            source.load(bad)


def test_scan_any(spark, folder):
    df = spark.range(1)
    assert Ca.scan_any(spark, df) is df
    declared = T.StructType([T.StructField("kst_dtm", T.TimestampNTZType()), T.StructField("x", T.DoubleType())])
    assert Ca.scan_any(spark, f"{folder}/a.csv", declared).filter("x > 1").count() == 1
    with pytest.raises(Ca.SourceError, match="unsupported"):
        Ca.scan_any(spark, f"{folder}/c.xlsx")
    with pytest.raises(Ca.SourceError, match="temporal"):
        Ca.date_profile(df)


def test_results(spark, folder):
    rows = spark.createDataFrame([("g1", "m", 0.1, 0.5)], "group string, model_name string, nmae double, ficr double")
    St.write_results(rows, f"{folder}/baseline_1_results.csv")
    St.write_results(rows.withColumn("mae", F.lit(2.0)), f"{folder}/baseline_2_results.csv")
    St.write_results(rows.select("group"), f"{folder}/baseline_3_results.csv")
    out = St.read_results(spark, f"{folder}/baseline_*_results.csv").orderBy("baseline").collect()
    assert [(r["model_id"], r["mae"]) for r in out] == [("baseline_1_results/m", None), ("baseline_2_results/m", 2.0)]
    with pytest.raises(Ca.SourceError):
        St.read_results(spark, f"{folder}/none_*")
    with pytest.raises(Ca.SourceError):
        St.read_results(spark, f"{folder}/baseline_3_results.csv")


def test_a_hundred_result_files_in_one_scan(spark, folder):
    import os
    os.makedirs(f"{folder}/many")
    for i in range(100):
        with open(f"{folder}/many/run_{i}_results.csv", "w", encoding="utf-8") as f:
            f.write(("\ufeff" if i == 3 else "") + ("group,ficr,nmae,model_name,extra\r\n" if i % 2 else "model_name,nmae,group,ficr\n"))
            for g in ("g1", "g2"):
                f.write(f'{g},{i},0.5,"m, {i}",x\r\n' if i % 2 else f"m{i},0.5,{g},\n")
    out = St.read_results(spark, f"{folder}/many/run_*_results.csv")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    rows = {(r["baseline"], r["group"]): r for r in out.collect()}
    assert len(rows) == 200 and rows["run_3_results", "g2"]["model_name"] == "m, 3" and rows["run_3_results", "g1"]["ficr"] == 3.0
    assert rows["run_4_results", "g1"]["ficr"] is None and rows["run_4_results", "g1"]["model_id"] == "run_4_results/m4"


def test_feature_cache(spark, folder):
    rows = spark.createDataFrame([(s, g, 1.0) for s in ("train", "test") for g in ("g1", "g2")], "split string, group string, x double")
    cache = St.FeatureCache(spark, f"{folder}/cache", ["g1", "g2"])
    assert not cache.is_complete()
    assert cache.build(lambda: rows) and cache.is_complete() and not cache.build(lambda: rows)
    assert cache.build(lambda: rows.withColumn("x", F.lit(2.0)), force=True)
    part = cache.load("g1", "train")
    assert part.first()["x"] == 2.0 and part.count() == 1
    assert "PartitionFilters: [" in part._jdf.queryExecution().toString()
    assert cache.versions() == [1, 2] and {r["n_rows"] for r in cache.manifest().collect()} == {1}
    some = St.FeatureCache(spark, f"{folder}/some", ["g1", "g2"])
    assert some.build(lambda: rows.filter("group = 'g2' AND split = 'train'")) and some.is_complete() and not some.build(lambda: rows)
    assert {(r["split"], r["group"]): r["n_rows"] for r in some.manifest().collect()} == {
        ("train", "g1"): 0, ("train", "g2"): 1, ("test", "g1"): 0, ("test", "g2"): 0}
    assert some.load("g1", "test").columns == ["x", "split", "group"] and some.load("g1", "test").count() == 0
    none = St.FeatureCache(spark, f"{folder}/none", ["g1"])
    assert none.build(lambda: rows.limit(0)) and none.is_complete() and none.load().count() == 0

    def broken():
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        cache.build(broken, force=True)
    assert cache.versions() == [1, 2] and cache.load("g1", "train").first()["x"] == 2.0
    wider = St.FeatureCache(spark, f"{folder}/cache", ["g1", "g2", "g3"])
    assert not wider.is_complete()
    with pytest.raises(Ca.SourceError):
        St.FeatureCache(spark, f"{folder}/absent", ["g1"]).load()


def test_submission_rows_and_order(spark):
    sample = spark.createDataFrame([(2, "t2", None), (1, "t1", None), (3, "t3", None)], "forecast_id int, ts string, p double")
    ready = spark.createDataFrame([("t1", 1.0), ("t3", 3.0), ("t9", 9.0)], "ts string, p double")
    out = St.align_submission(sample, ready, "ts", ["p"])
    assert out.columns == sample.columns and [tuple(r) for r in out.collect()] == [(1, "t1", 1.0), (2, "t2", None), (3, "t3", 3.0)]


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from zephyrgrid import session
    assert session.local_master("local[8]") and session.local_master("local")
    assert not session.local_master("local-cluster[3,2,1024]") and not session.local_master("yarn")

    class Context:
        master = "yarn"
        getConf = staticmethod(lambda: {})

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isEmpty = staticmethod(lambda: True)

    class Session:
        sparkContext = Context
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
