"""Steps that several fits share are taken once, and fits that do not need each other run side by side."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid.models import experiments as X
from zephyrgrid.plans import bindings as B
from zephyrgrid.session import stable, together


@pytest.fixture
def lines(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(rng.integers(0, 40)), int(rng.integers(0, 30)), 1, float(rng.integers(1, 50)), float(rng.integers(9, 9999)) / 100,
             float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, datetime(1995, 1, 1 + i % 9)) for i in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_both_sources_are_made_from_means_written_once(spark, lines):
    means = stable(B.grid_means(spark, lines))
    for raw in (B.ldaps_raw, B.gfs_raw):
        plain, shared = raw(spark, lines), raw(spark, "/nowhere", means)
        assert plain.count() == shared.count() > 0
        assert plain.exceptAll(shared).isEmpty() and shared.exceptAll(plain).isEmpty()


def test_variants_of_a_group_share_its_medians(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 2}", None if i % 11 == 0 else float(a), float(b), float(a + b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    train = spark.createDataFrame(rows, "group string, a double, b double, y double")
    seen, plain = [], X.stats.medians
    monkeypatch.setattr(X.stats, "medians", lambda df, columns: seen.append(1) or plain(df, columns))
    made = X.fitted_variants(train, ["g0", "g1"], ["a", "b"], "y", {"all": {}, "corr_filtered": {}, "pca": {}})
    assert len(seen) == 2
    for (g, v), variant in made.items():
        alone = X.make_variant(v).fit(train.filter(F.col("group") == g), ["a", "b"], "y")
        assert variant.fill == alone.fill and variant.columns == alone.columns


def test_an_error_of_a_job_is_not_lost(spark):
    assert together(spark, {"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    with pytest.raises(ZeroDivisionError):
        together(spark, {"a": lambda: 1, "b": lambda: 1 // 0})
