"""Selection and regression on synthetic relations with a known answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid.models import boosting as Bo
from zephyrgrid.models import experiments as X
from zephyrgrid.models import regress as R
from zephyrgrid.models import selection as Se
from zephyrgrid.operators import metrics as M

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 600
    a, c, d = rng.normal(size=(3, n))
    b = a + rng.normal(scale=0.05, size=n)
    y = np.clip(0.5 + 0.2 * a + 0.05 * c, 0, 1)
    rows = [(i, "kpx_group_1" if i % 2 else "kpx_group_2", "train" if i < 450 else "valid", *map(float, r), float(t), float(t) * 100, 100.0)
            for i, (r, t) in enumerate(zip(np.c_[a, b, c, d], y))]
    return spark.createDataFrame(rows, "id int, group string, split string, a double, b double, c double, d double, "
                                       "target double, actual double, capacity double").repartition(4).cache(), np.c_[a, b, c, d]


def parts(data):
    return data[0].filter("split = 'train'"), data[0].filter("split = 'valid'")


def test_correlation_filters(data):
    df, x = data
    np.testing.assert_allclose(Se.correlation(df, COLUMNS), np.corrcoef(x.T), atol=1e-9)
    assert Se.drop_correlated(df, COLUMNS) == ["a", "c", "d"]
    report = Se.ranked_selection(df, {"a": 0.4, "b": 0.5, "c": 0.09, "d": 0.001}, noise_floor=0.01, cumulative=0.8)
    assert {f: r for f, _, r in report} == {"b": "selected", "a": "duplicate(b)", "c": "tail", "d": "noise"}


def test_dropped_columns_still_count_in_order_filter(spark):
    """x2 is close to x1 and x3 is close to x2 only: the order filter drops both, the ranked keeps x3."""
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(2, 4000))
    x1, x2, x3 = u, u + 0.25 * v, u + 0.5 * v
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[x1, x2, x3]], "x1 double, x2 double, x3 double")
    assert Se.drop_correlated(df, ["x1", "x2", "x3"]) == ["x1"]
    report = {f: r for f, _, r in Se.ranked_selection(df, {"x1": 3.0, "x2": 2.0, "x3": 1.0})}
    assert report == {"x1": "selected", "x2": "duplicate(x1)", "x3": "selected"}


def test_principal_parts(data):
    df, x = data
    fitted = Se.PrincipalParts(0.95).fit(df, COLUMNS)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1] / 4
    np.testing.assert_allclose(fitted.ratios, values, atol=1e-9)
    assert fitted.count == int(np.searchsorted(np.cumsum(values), 0.95, side="right")) + 1 == 3
    out = fitted.transform(df, ["id"]).toPandas().sort_values("id")
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(out["pca_001"].var(ddof=0), values[0] * 4, rtol=1e-6)
    assert abs(np.corrcoef(out["pca_001"], z[:, 0])[0, 1]) > 0.9


def test_information_and_mrmr(data):
    df, x = data
    found = {r["column"]: r["relevance"] for r in Se.mutual_information(df, COLUMNS, "target").collect()}
    y = df.toPandas().sort_values("id")["target"].to_numpy()
    cut = lambda v: np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 10), 9).astype(int)
    joint = np.histogram2d(cut(x[:, 2]), cut(y), bins=[range(11), range(11)])[0] / len(y)
    mask = joint > 0
    by_hand = (joint * np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0)) , where=mask, out=np.zeros_like(joint))).sum()
    assert found["c"] == pytest.approx(by_hand)
    assert not Se.relevance_is_flat(found)
    r, picked = np.abs(np.corrcoef(x.T)), []
    for _ in range(3):
        rest = [i for i in range(4) if i not in picked]
        picked.append(max(rest, key=lambda i: found[COLUMNS[i]] - (r[i, picked].mean() if picked else 0.0)))
    assert [f for f, _, _ in Se.mrmr(df, COLUMNS, "target", 3)] == [COLUMNS[i] for i in picked]


def test_importances(data):
    train, valid = parts(data)
    model = Bo.Booster(COLUMNS, "target", least_rows=5).fit(train, rounds=5)
    for found in X.swapped_importance(model, valid, ["id"]).values():
        assert max(found["a"], found["b"]) > found["c"] > found["d"]
    partner = Se.shuffled_partner(valid, ["a"], ["id"])
    assert partner.count() == 150 and partner.select("other.a").distinct().count() == 150
    assert partner.filter(F.col("other.a") == F.col("a")).count() == 0
    own = Se.shuffled_partner(valid, ["a", "group"], ["id"], keys=["group"])
    assert own.count() == 150 and own.filter(F.col("other.group") != F.col("group")).count() == 0
    kept, floor = X.noise_floor_importance(train, valid, COLUMNS, "target", ["id"], rounds=5, least_rows=5)
    for g in ("kpx_group_1", "kpx_group_2"):
        assert max(kept[g]["a"], kept[g]["b"]) > floor[g] >= 0 and set(kept[g]) == set(COLUMNS)
    forest = R.forest_importance(train, COLUMNS, "target", trees=5)
    assert sum(forest.values()) == pytest.approx(1.0) and forest["d"] < 0.1
    assert len(Se.top_features(dict.fromkeys(map(str, range(40)), 1.0))) == 14
    assert len(Se.top_features(dict.fromkeys("abc", 1.0))) == 3


def test_regressors_beat_the_mean(data):
    train, valid = parts(data)
    middle = train.agg(F.avg("actual")).first()[0]
    floor = M.group_summary(valid.withColumn("pred", F.lit(middle)), []).first()["mae"]
    evaluator = R.SettlementEvaluator()
    trees = Bo.Booster(COLUMNS, "target", least_rows=5).fit(train, valid, 30, 10)
    settled = Bo.settlement_booster(train, valid, COLUMNS, "target", 15, 5, least_rows=5)
    kernel = R.predicted(R.KernelBaseline(COLUMNS, "target").fit(train), valid, COLUMNS)
    for scored in (trees.energy(valid), settled.energy(valid), kernel):
        assert M.group_summary(scored, []).first()["mae"] < floor * 0.6
        assert 0 < evaluator.evaluate(scored) <= 1
    assert R.SettlementEvaluator(metric="neg_mae").evaluate(scored) < 0 and evaluator.isLargerBetter()


def test_kernel_features_are_cosines(data):
    df, x = data
    kernel = R.KernelBaseline(COLUMNS, "target", width=5)
    kernel.params = {c: (float(x[:, i].mean()), float(x[:, i].std())) for i, c in enumerate(COLUMNS)}
    got = np.array([r["features"].toArray() for r in kernel._expand(df).orderBy("id").collect()])
    waves = np.array(kernel.waves)
    z = (x - x.mean(0)) / x.std(0)
    np.testing.assert_allclose(got, np.cos(z @ waves[:, :4].T + waves[:, 4]) * np.sqrt(2 / 5), atol=1e-9)


def test_experiments(data):
    df, _ = data
    groups = ["kpx_group_1", "kpx_group_2"]
    out = X.experiment_matrix(df, groups, COLUMNS, "target", {"all": {}, "corr_filtered": {}, "pca": {}}, ["trees", "kernel"], rounds=10, least_rows=5)
    rows = {(r["group"], r["model_version"], r["feature_version"]): r for r in out.collect()}
    assert len(rows) == 12 and {v: rows["kpx_group_1", "trees", v]["n_features"] for v in ("all", "corr_filtered", "pca")} == {
        "all": 4, "corr_filtered": 3, "pca": 3}
    alone = Bo.Booster(["a", "c", "d"], "target", least_rows=5).fit(*parts(data), rounds=10)
    score = {r["group"]: r["score"] for r in M.group_summary(alone.energy(parts(data)[1]), ["group"]).collect()}
    for g in groups:
        assert rows[g, "trees", "corr_filtered"]["score"] == pytest.approx(score[g], abs=0.01)  # quantile cuts are approximate
    with pytest.raises(ValueError, match="unknown models"):
        X.experiment_matrix(df, groups, COLUMNS, "target", {"all": {}}, ["forest"])
    train, valid = parts(data)
    gate = {r["group"]: r for r in X.feature_gate(train, valid, ["d"], ["a"], "target", rounds=10, least_rows=5).collect()}
    assert set(gate) == set(groups)
    for r in gate.values():
        assert r["score_after"] > r["score_before"] and r["adopt"] == (r["score_after"] - r["score_before"] >= 0.005)
    table = X.gain_table(train, COLUMNS, "target", rounds=5, least_rows=5).collect()
    assert table[0]["feature"] in "ab" and sum(r["kpx_group_1"] for r in table) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown variant"):
        X.make_variant("none")
    assert type(X.make_variant(" PCA ")).__name__ == "Compressed"


def test_search_halves_the_draws(data):
    train, valid = parts(data)
    tried = X.search_settlement(valid, valid, train, COLUMNS, "target", draws=6, warmup=3, steps=4, halve_every=2, depth=2, least_rows=5).collect()
    for g in ("kpx_group_1", "kpx_group_2"):
        own = [r for r in tried if r["group"] == g]
        best = max(own, key=lambda r: r["tune_score"])
        assert 3 <= len(own) <= 6 and [r["chosen"] for r in own].count(True) == 1
        assert best["chosen"] and best["audit_score"] == pytest.approx(best["tune_score"])
        alone = Bo.settlement_booster(train, None, COLUMNS, "target", 3, 4, None, [Bo.Settlement(best["steepness"], best["weight"])], depth=2, least_rows=5)
        score = M.group_summary(alone.energy(valid.filter(F.col("group") == g)), []).first()["score"]
        assert score == pytest.approx(best["tune_score"])


def test_median_fill_uses_train_rows(spark):
    train = spark.createDataFrame([(1.0,), (None,), (3.0,), (9.0,)], "x double")
    fitted = X.make_variant("all").fit(train, ["x"], "x")
    assert fitted.transform(spark.createDataFrame([(None,)], "x double")).first()["x"] == 3.0
