"""Histogram boosting against plain loops over the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid.functions import scalars as S
from zephyrgrid.models import boosting as Bo

COLUMNS = ["a", "b", "c"]
SCHEMA = "id int, group string, a double, b double, c double, y double"


def table(n=400, seed=0, groups=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 3)).astype(float)
    g = rng.integers(0, groups, n)
    y = np.clip(0.1 * x[:, 0] * (g + 1) / groups - 0.02 * x[:, 1] * (x[:, 2] > 5) + rng.normal(scale=0.05, size=n) + 0.3, 0, 1)
    return x, g, y


def frame(spark, x, g, y, parts=3):
    rows = [(i, f"g{k}", *map(lambda v: None if np.isnan(v) else float(v), r), float(t)) for i, (r, k, t) in enumerate(zip(x, g, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain_tree(x, grad, hess, depth, penalty, least_rows, least_curvature):
    """Best-gain splits by trying every feature and value; a function from rows to leaf values."""
    def build(rows, level):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for v in np.unique(x[:, f])[:-1]:
                    low = x[rows, f] <= v
                    hl, nl = hess[rows][low].sum(), low.sum()
                    if min(nl, len(rows) - nl) < least_rows or min(hl, h - hl) < least_curvature:
                        continue
                    gl = grad[rows][low].sum()
                    gain = gl ** 2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g ** 2 / (h + penalty)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, v
        if best is None:
            return -g / (h + penalty)
        _, f, v = best
        low = x[rows, f] <= v
        return f, v, build(rows[low], level + 1), build(rows[~low], level + 1)

    def walk(node, r):
        while isinstance(node, tuple):
            node = node[2] if r[node[0]] <= node[1] else node[3]
        return node
    root = build(np.arange(len(x)), 0)
    return lambda rows: np.array([walk(root, r) for r in rows])


def test_gradients_are_those_of_the_expressions(spark):
    e = np.linspace(-0.3, 0.3, 61)
    g, h = S.settlement_gradient(F.col("e"), 25.0, 0.6)
    rows = spark.createDataFrame([(float(v),) for v in e], "e double").select("e", g.alias("g"), h.alias("h")).orderBy("e").toPandas()
    mine = Bo.Settlement(25.0, 0.6).steps(rows["e"].to_numpy())
    np.testing.assert_allclose(mine, [rows["g"], rows["h"]], rtol=1e-12)


@pytest.mark.parametrize("curvature", [0.05, 30.0])
def test_newton_trees_of_all_groups_equal_plain_ones(spark, curvature):
    x, g, y = table()
    settings = [Bo.Settlement(40.0, 0.7), Bo.Settlement(20.0, 0.55)]
    model = Bo.Booster(COLUMNS, "y", depth=3, rate=0.3, least_rows=5, least_curvature=curvature, cut_every=2).begin(frame(spark, x, g, y))
    model.grow(3, settings)
    assert model.keys == ["g0", "g1"] and len(model.trees) == 3
    for k, loss in enumerate(settings):
        for i in range(2):
            own, now = x[g == i], np.full((g == i).sum(), model.start[i])
            for _ in range(3):
                tree = plain_tree(own, *loss.steps(now - y[g == i]), 3, 1.0, 5, curvature)
                now = now + 0.3 * tree(own)
            got = model.transform(frame(spark, own, np.full(len(own), i), y[g == i]), setting=k).orderBy("id").toPandas()["prediction"]
            np.testing.assert_allclose(got, now, atol=1e-9)
    both = model.transform_settings(frame(spark, x, g, y)).orderBy("id").select("predictions").toPandas()["predictions"]
    one = model.transform(frame(spark, x, g, y), setting=1).orderBy("id").toPandas()["prediction"]
    np.testing.assert_allclose([p[1] for p in both], one, atol=1e-12)


def test_leaves_of_absolute_error_are_medians(spark):
    x, g, y = table(seed=2)
    model = Bo.Booster(COLUMNS, "y", depth=2, rate=1.0, least_rows=5).begin(frame(spark, x, g, y)).grow(1, [Bo.Absolute()])
    tree, _ = model.trees[0]
    for i in range(2):
        own = x[g == i]
        bins = np.stack([1 + np.searchsorted(model.edges[f], own[:, f]) for f in range(3)], 1)
        leaf = tree.node(bins, np.full(len(own), i), 2)
        for l in np.unique(leaf):
            left = np.sort(y[g == i][leaf == l] - model.start[i])
            low, high = left[(len(left) - 1) // 2], left[len(left) // 2]
            assert low - 2e-3 <= tree.value[i, l] <= high + 2e-3


def test_best_round_and_patience_equal_a_loop(spark):
    x, g, y = table(600, seed=3)
    rng = np.random.default_rng(9)
    y = np.clip(y + rng.normal(scale=0.3, size=len(y)), 0, 1)  # noise, so that later rounds do harm
    train, valid = np.arange(600) < 420, np.arange(600) >= 420
    f_train, f_valid = frame(spark, x[train], g[train], y[train]), frame(spark, x[valid], g[valid], y[valid])
    model = Bo.Booster(COLUMNS, "y", depth=4, rate=0.5, least_rows=3, cut_every=4).fit(f_train, f_valid, rounds=40, patience=6)
    loss = np.full((len(model.trees), 2), np.nan)
    for t in range(len(model.trees)):
        made = model.transform(f_valid, rounds=np.full(2, t + 1)).toPandas()
        for i in range(2):
            own = made[made["group"] == f"g{i}"]
            loss[t, i] = (own["prediction"] - own["y"]).abs().mean()
    np.testing.assert_allclose(np.array(model.history)[:, :, 0], loss, atol=1e-9)
    assert model.best.tolist() == (loss.argmin(axis=0) + 1).tolist()
    # it stops at the first look at which every group has waited long enough
    stop = next((t for t in range(4, 41, 4) if all(t - (loss[:t, i].argmin() + 1) >= 6 for i in range(2))), 40)
    assert len(model.trees) == stop < 40
    made = model.transform(f_valid).toPandas()
    assert (made["prediction"] - made["y"]).abs()[made["group"] == "g0"].mean() == pytest.approx(loss[:, 0].min())


def test_missing_values_unknown_groups_and_empty_rows(spark):
    x, g, y = table(300, seed=4)
    x[::5, 0] = np.nan
    y[::5] = 0.95  # missing tells something
    df = frame(spark, x, g, y)
    model = Bo.Booster(COLUMNS, "y", depth=2, rate=0.5).fit(df.union(df.limit(3).withColumn("group", F.lit(None).cast("string"))), rounds=8)
    made = model.transform(df.union(df.limit(1).withColumn("group", F.lit("other")))).toPandas()
    assert made["prediction"].isna().sum() == 1
    assert made[made["a"].isna()]["prediction"].mean() > 0.8 > made[made["a"].notna()]["prediction"].mean() + 0.1
    assert model.transform(df.limit(0)).count() == 0
    none = Bo.Booster(COLUMNS, "y").begin(df.limit(0)).grow(2, [Bo.Absolute()])
    assert none.keys == [] and none.transform(df.limit(2)).toPandas()["prediction"].isna().all()


def test_swap_effects_equal_brute_force(spark):
    x, g, y = table(300, seed=5)
    x = np.c_[x, np.random.default_rng(1).integers(0, 4, (300, 2))]
    names = [*COLUMNS, "d", "e"]
    df = spark.createDataFrame([(i, f"g{k}", *map(float, r), float(t)) for i, (r, k, t) in enumerate(zip(x, g, y))],
                               "id int, group string, " + ", ".join(f"{n} double" for n in names) + ", y double")
    model = Bo.Booster(names, "y", depth=3, rate=0.4, least_rows=5).fit(df, rounds=5)
    other = np.random.default_rng(2).permutation(300)
    pairs = spark.createDataFrame([(i, int(other[i])) for i in range(300)], "id int, o int").join(
        df.select(F.col("id").alias("o"), F.struct(*names).alias("other")), "o").join(df, "id")
    got = model.swap_effects(pairs)
    base = model.transform(df).orderBy("id").toPandas()["prediction"].to_numpy()
    for f, name in enumerate(names):
        moved = x.copy()
        moved[:, f] = x[other, f]
        rows = spark.createDataFrame([(i, f"g{k}", *map(float, r)) for i, (r, k) in enumerate(zip(moved, g))],
                                     "id int, group string, " + ", ".join(f"{n} double" for n in names))
        new = model.transform(rows).orderBy("id").toPandas()["prediction"].to_numpy()
        for i in range(2):
            assert got[f"g{i}"][name] == pytest.approx(np.abs(new - base)[g == i].mean(), abs=1e-12)
            if name not in model.used()[f"g{i}"]:
                assert got[f"g{i}"][name] == 0


def test_settings_share_the_warm_up_and_can_be_dropped(spark):
    x, g, y = table(300, seed=6)
    df = frame(spark, x, g, y)
    settings = [Bo.Settlement(10.0, 0.5), Bo.Settlement(40.0, 0.7), Bo.Settlement(90.0, 0.9)]
    model = Bo.settlement_booster(df, df, COLUMNS, "y", 3, 2, None, settings, depth=2)
    assert [len(t.value) for t, _ in model.trees] == [2, 2, 2, 6, 6]
    alone = Bo.settlement_booster(df, df, COLUMNS, "y", 3, 2, None, settings[2:], depth=2)
    last = lambda m, k: m.transform(df, setting=k, rounds=np.full(2, len(m.trees))).orderBy("id").toPandas()["prediction"]
    np.testing.assert_allclose(last(model, 2), last(alone, 0), atol=1e-12)
    model.keep([0, 2]).grow(1, model.losses)
    alone.grow(1, alone.losses)
    np.testing.assert_allclose(last(model, 1), last(alone, 0), atol=1e-12)
