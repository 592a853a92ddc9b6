"""Feature selection, models and the programming interface over the given tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.models import boosting as Bo
from zephyrgrid.models import experiments as X
from zephyrgrid.models import regress as R
from zephyrgrid.models import selection as Se
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators import series as Sr
from zephyrgrid.operators import splits as Sp
from zephyrgrid.operators.ordering import exact_quantiles, long_form, time_slice
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans import features as Ft
from zephyrgrid.plans.bindings import rnd, rnds, rounded
from zephyrgrid.plans.registry import query
from zephyrgrid.plans.series_queries import DAY, SEQ, TS, weights
from zephyrgrid.session import new_folder, stable, together
from zephyrgrid.sources import store as St
from zephyrgrid.sources.catalog import file_versions

TARGET = "utilisation"
IDENTITY = ["group", TS]
GROUPS = list(K.GROUPS)
# labels are sums of order prices; so many units stand for one kWh of the turbines
UNITS_PER_KWH = 20.0
ROUNDS, PATIENCE = 100, 80
_GT = f'"group", {TS}'
_ready: dict[tuple, tuple] = {}


def model_data(spark, d) -> tuple:
    """(rows, columns): the features of both sources for every group and stamp, with label, utilisation and split.

    The split is by time over the labelled stamps; the stamps after the last label are the season to come, ``test``.
    A missing value is filled by the median of the group's train rows, a feature without any by 0. The capacity of
    a group is that of its turbines. Written once for all fits of a session, until a file changes. So are the means of
    the grid points and the labels, which all steps share: order lines and orders are read once each.
    """
    key = spark.sparkContext.applicationId, d, file_versions(spark, [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "supplier")])
    if key not in _ready:
        means = stable(B.grid_means(spark, d))
        w = weights(spark, d, means)
        areas = together(spark, {s: lambda s=s, raw=raw: stable(Ft.area_table(s, raw(spark, d, means), w))
                                 for s, raw in (("ldaps", B.ldaps_raw), ("gfs", B.gfs_raw))})
        sides = [Sr.forecast_ramps(area, s) for s, area in areas.items()]
        both = stable(C.join_by_key(*sides, IDENTITY, "inner"))
        columns = [c for c in C.feature_columns(both, targets=(*K.GROUPS, "target"))]
        labels = stable(C.labels_long(B.labels_wide(spark, d)))
        rows = stable(both.select(*IDENTITY, *[F.col(c).cast("double") for c in columns]).join(labels, IDENTITY, "left"))
        labelled = Sp.time_split(rows.filter("target IS NOT NULL").select(*IDENTITY), ["group"], [TS], slice_by=time_slice(TS))
        end = labels.agg(F.max(TS)).first()[0]  # of all groups: the season begins for all at once
        tops = B.turbines(spark, d).groupBy("group").agg((F.sum("cap_kw") * UNITS_PER_KWH).alias("capacity"))
        season = F.when(F.col(TS) > F.lit(end).cast("timestamp_ntz"), "test")
        marked = rows.join(labelled, IDENTITY, "left").join(F.broadcast(tops), "group").withColumn(
            "split", F.coalesce("split", season)).filter("split IS NOT NULL")
        marked = stable(marked.withColumns({"actual": F.col("target"), TARGET: C.to_utilisation("target", "capacity")}))
        found = exact_quantiles(long_form(marked.filter("split = 'train'"), columns, ["group"]), ["group", "column"], "value", [0.5])
        middle = {(r["group"], r["column"]): r["quantile"] for r in found.collect()}  # groups x features
        fill = spark.createDataFrame([(g, *[float(middle.get((g, c), 0.0)) for c in columns]) for g in GROUPS],
                                     "group string, " + ", ".join(f"`_m_{c}` double" for c in columns))
        filled = marked.join(F.broadcast(fill), "group").select(
            *IDENTITY, "split", "target", "actual", "capacity", TARGET, *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in columns])
        _ready[key] = stable(filled), columns
    return _ready[key]


def _split(spark, d, group=None):
    """Train rows, validation rows without the first day's worth, and the features."""
    rows, columns = model_data(spark, d)
    rows = C.select_group(rows, group)
    valid = Sp.warmup_trim(rows.filter("split = 'valid'"), ["group"], [TS], slice_by=time_slice(TS))
    return rows.filter("split = 'train'"), stable(valid), columns


def _importance_rows(spark, values: dict[str, dict[str, float]]):
    cells = [(g, f, v) for g, found in sorted(values.items()) for f, v in sorted(found.items(), key=lambda x: (-x[1], x[0]))]
    return spark.createDataFrame(cells, "group string, feature string, importance double")


def _by_group(fit, workers: int = 3) -> dict:
    """One fit per group; the fits are independent jobs."""
    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(GROUPS, pool.map(fit, GROUPS)))


# the observations of every order line, for selections that SQL can repeat
PLAIN = ["u", "v", "t2m", "q2m", "rh2m", "sp", "ws_low", "ws_high", "gust", "wd"]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {i} AS i, {j} AS j, corr({a}, {b}) AS r FROM obs" for i, a in enumerate(PLAIN) for j, b in enumerate(PLAIN))
B.VIEWS["pair_corr"] = _PAIRS


@query("corr_filter_order", "SELECT DISTINCT b AS feature FROM pair_corr WHERE b NOT IN (SELECT b FROM pair_corr WHERE i < j AND abs(r) > 0.95)")
def corr_filter_order(spark, d):
    kept = Se.drop_correlated(B.obs(spark, d), PLAIN)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


_BIN = "least(floor(({c} - (SELECT min({c}) FROM obs)) / ((SELECT max({c}) FROM obs) - (SELECT min({c}) FROM obs)) * 10), 9)"


def _information_sql(columns: list[str], target: str) -> str:
    joint = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_BIN.format(c=c)} AS x, {_BIN.format(c=target)} AS y, count(*) AS n FROM obs GROUP BY ALL" for c in columns)
    return f"""SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS relevance FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY feature) AS DOUBLE) AS t,
        CAST(sum(n) OVER (PARTITION BY feature, x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY feature, y) AS DOUBLE) AS ny FROM ({joint})) GROUP BY 1"""


B.VIEWS["information_u"] = _information_sql(PLAIN[1:], "u")
B.VIEWS["information_wd"] = _information_sql(PLAIN[:-1], "wd")
# the greedy walk meets features by importance; those it kept make later ones redundant
_RANKED = f"""WITH RECURSIVE met AS (SELECT i.feature, i.relevance, row_number() OVER (ORDER BY round(i.relevance, 12) DESC, i.feature) AS i,
        (SELECT coalesce(list(p.b), []) FROM pair_corr p WHERE p.a = i.feature AND p.a <> p.b AND abs(p.r) > 0.95) AS near FROM information_wd i WHERE i.relevance > 0),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS VARCHAR) AS twin
        UNION ALL SELECT m.i, CASE WHEN len(list_filter(w.kept, lambda k: list_contains(m.near, k))) = 0 THEN list_append(w.kept, m.feature) ELSE w.kept END,
        m.feature, list_filter(w.kept, lambda k: list_contains(m.near, k))[1] FROM walk w JOIN met m ON m.i = w.i + 1),
    kept AS (SELECT w.feature, sum(f.relevance) OVER (ORDER BY w.i ROWS UNBOUNDED PRECEDING) - f.relevance AS before, sum(f.relevance) OVER () AS whole
        FROM walk w JOIN information_wd f ON w.feature = f.feature WHERE w.i > 0 AND w.twin IS NULL)
    SELECT f.feature, {rnd('f.relevance')} AS importance, CASE WHEN w.feature IS NULL THEN 'noise' WHEN w.twin IS NOT NULL THEN 'duplicate(' || w.twin || ')'
        WHEN k.before / k.whole >= 0.999 THEN 'tail' ELSE 'selected' END AS decision
    FROM information_wd f LEFT JOIN walk w ON w.feature = f.feature LEFT JOIN kept k ON k.feature = f.feature"""
_PICKED = f"""WITH RECURSIVE close AS (SELECT map(list(a || '|' || b), list(abs(r))) AS near FROM pair_corr WHERE a <> 'u' AND b <> 'u'),
    told AS (SELECT map(list(feature), list(relevance)) AS rel, list_sort(list(feature)) AS every FROM information_u),
    walk AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS picked, CAST(NULL AS STRUCT(neg DOUBLE, feature VARCHAR, score DOUBLE)) AS best
        UNION ALL SELECT i + 1, list_append(picked, best.feature), best FROM (SELECT w.i, w.picked, list_sort(list_transform(
            list_filter(t.every, lambda f: NOT list_contains(w.picked, f)), lambda f: {{'neg': -round(t.rel[f] - coalesce(list_avg(list_transform(w.picked, lambda k: c.near[f || '|' || k])), 0), 12),
            'feature': f, 'score': t.rel[f] - coalesce(list_avg(list_transform(w.picked, lambda k: c.near[f || '|' || k])), 0)}}))[1] AS best
            FROM walk w, close c, told t WHERE w.i < 5))
    SELECT best.feature AS feature, {rnd('t.rel[best.feature]')} AS relevance, {rnd('best.score')} AS score FROM walk, told t WHERE i > 0"""


@query("corr_filter_ranked", _RANKED)
def corr_filter_ranked(spark, d):
    rows = B.obs(spark, d)
    importance = {r["column"]: r["relevance"] for r in Se.mutual_information(rows, PLAIN[:-1], "wd").collect()}
    report = Se.ranked_selection(rows, importance, noise_floor=0.0, cumulative=0.999)
    return rounded(spark.createDataFrame(report, "feature string, importance double, decision string"))


@query("pca_95")
def pca_95(spark, d):
    parts = Se.PrincipalParts().fit(B.obs(spark, d), PLAIN)
    return parts.transform(B.obs(spark, d), ["l_orderkey", "l_linenumber"])


@query("tree_importance")
def tree_importance(spark, d):
    train, _, columns = _split(spark, d)
    found = _by_group(lambda g: R.forest_importance(train.filter(F.col("group") == g), columns, TARGET))
    keep = {(g, c) for g in GROUPS for c in Se.top_features(found[g])}
    kept = spark.createDataFrame(sorted(keep), "group string, feature string").withColumn("keep", F.lit(True))
    return _importance_rows(spark, found).join(F.broadcast(kept), ["group", "feature"], "left").fillna(False, ["keep"])


@query("null_importance")
def null_importance(spark, d):
    train, valid, columns = _split(spark, d)
    found, floors = X.noise_floor_importance(train, valid, columns, TARGET, IDENTITY, rounds=20)
    floor = spark.createDataFrame(sorted(floors.items()), "group string, noise_floor double")
    return _importance_rows(spark, found).join(F.broadcast(floor), "group").withColumn("keep", F.col("importance") > F.col("noise_floor"))


@query("permutation_importance")
def permutation_importance(spark, d):
    train, valid, columns = _split(spark, d)
    model = Bo.Booster(columns, TARGET).fit(train, rounds=20)
    return _importance_rows(spark, X.swapped_importance(model, valid, IDENTITY))


def _fit_rows(spark, model, valid, columns):
    """The official figures of each group beside the rounds that were best for it."""
    best = spark.createDataFrame([(g, int(n)) for g, n in zip(model.keys, model.best)], "group string, best_round long")
    return M.group_summary(model.energy(valid), ["group"]).join(F.broadcast(best), "group").withColumn("n_features", F.lit(len(columns)).cast("long"))


@query("newton_boost_ficr")
def newton_boost_ficr(spark, d):
    train, valid, columns = _split(spark, d)
    return _fit_rows(spark, Bo.settlement_booster(train, valid, columns, TARGET), valid, columns)


@query("gbt_l1")
def gbt_l1(spark, d):
    train, valid, columns = _split(spark, d)
    return _fit_rows(spark, Bo.Booster(columns, TARGET).fit(train, valid, ROUNDS, PATIENCE), valid, columns)


@query("refit_full")
def refit_full(spark, d):
    """The season to come, by models of all labelled rows with the rounds that validation found best."""
    train, valid, columns = _split(spark, d)
    best = Bo.Booster(columns, TARGET).fit(train, valid, ROUNDS, PATIENCE).best
    rows, _ = model_data(spark, d)
    model = Bo.Booster(columns, TARGET).fit(rows.filter("split IN ('train', 'valid')"), rounds=int(best.max()))
    model.best = best
    return model.energy(rows.filter("split = 'test'")).select("group", TS, "pred")


@query("kernel_baseline")
def kernel_baseline(spark, d):
    train, valid, columns = _split(spark, d)

    def fit(group):
        own = lambda df: df.filter(F.col("group") == group)
        line = R.KernelBaseline(columns, TARGET).fit(own(train))
        return M.group_summary(R.predicted(line, own(valid), columns), ["group"])
    return reduce(DataFrame.unionByName, _by_group(fit).values())


@query("sequence_regressor")
def sequence_regressor(spark, d):
    """Unbroken histories of a day's worth of stamps, one line per group."""
    rows, _ = model_data(spark, d)
    seqs = Sr.sequences(rows, SEQ, TARGET, next_step=True, step_seconds=DAY)
    seqs = stable(seqs.join(rows.select(*IDENTITY, "split", "actual", "capacity"), IDENTITY))
    ready = R.sequence_features(seqs)

    def fit(group):
        own = ready.filter(F.col("group") == group)
        line = LinearRegression(featuresCol="features", labelCol="target", loss="huber", regParam=1e-3, maxIter=30).fit(own.filter("split = 'train'"))
        scored = line.transform(own.filter("split = 'valid'")).withColumn("pred", C.to_energy("prediction", "capacity"))
        return M.group_summary(scored, ["group"])
    return reduce(DataFrame.unionByName, _by_group(fit).values())


@query("experiment_matrix")
def experiment_matrix(spark, d):
    train, valid, columns = _split(spark, d)
    return X.experiment_matrix(train.unionByName(valid), GROUPS, columns, TARGET, {v: {} for v in X.VARIANTS}, ["trees", "kernel"], rounds=20)


@query("param_search")
def param_search(spark, d):
    train, valid, columns = _split(spark, d)
    # a season of daily stamps has fewer rows than the hours that the guard of a short audit half counts
    halves = stable(Sp.tune_audit(valid, ["group"], [TS], min_audit=K.AUDIT_MINIMUM // 24, slice_by=time_slice(TS)))
    return X.search_settlement(halves.filter("half = 'tune'"), halves.filter("half = 'audit'"), train, columns, TARGET)


@query("mutual_information", f"SELECT feature, {rnd('relevance')} AS relevance FROM information_u")
def mutual_information(spark, d):
    return rounded(Se.mutual_information(B.obs(spark, d), PLAIN[1:], "u").withColumnRenamed("column", "feature"))


@query("mrmr_select", _PICKED)
def mrmr_select(spark, d):
    picked = Se.mrmr(B.obs(spark, d), PLAIN[1:], "u", 5)
    return rounded(spark.createDataFrame(picked, "feature string, relevance double, score double"))


@query("feature_gate")
def feature_gate(spark, d):
    """Whether slow and fast parts of wind speed and power density help the features that say most and repeat least."""
    train, valid, columns = _split(spark, d, "kpx_group_1")
    rows, _ = model_data(spark, d)
    own = C.select_group(rows, "kpx_group_1")
    base = [c for c, _, _ in Se.mrmr(train, [c for c in columns if c not in _flat_columns(train, columns)], TARGET, 40)]
    extra = []
    for name in ("ws10", "gfs_ws_hub"):
        parts = stable(Sr.causal_scales(own.select(*IDENTITY, name), name))
        added = [f"{name}_scale_{n}" for n in (168, 24, 6, 1)]
        train, valid = (df.join(parts.select(*IDENTITY, *added), IDENTITY) for df in (train, valid))
        extra += added
    return X.feature_gate(stable(train), stable(valid), base, extra, TARGET, rounds=40, patience=20)


def _flat_columns(df, columns):
    """Features with one value: they correlate with nothing."""
    ends = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if ends[f"a{i}"] == ends[f"b{i}"]}


@query("gain_table")
def gain_table(spark, d):
    train, _, columns = _split(spark, d)
    return X.gain_table(train, columns, TARGET, rounds=20)


_CHECKED = ["v", "t2m", "ws_high"]


def _checks_sql(c: str) -> str:
    m = lambda p: f"avg(pow({c} - m, {p}))"
    ranked = lambda v: f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2e0"
    return f"""SELECT *, CASE WHEN jb < 5.991e0 AND outliers = 0 THEN 'pearson' ELSE 'spearman' END AS advice,
        {rnd('jb')} AS jarque_bera, {rnd('s')} AS skew, {rnd('k')} AS kurt FROM (SELECT *, n / 6e0 * (s * s + k * k / 4) AS jb FROM (
        SELECT '{c}' AS "column", count({c}) AS n, {rnd(f'pow(corr(u, {c}), 2)')} AS r2, {m(3)} / pow({m(2)}, 1.5) AS s,
        {m(4)} / pow({m(2)}, 2) - 3 AS k, {rnd('any_value(q1)')} AS q1, {rnd('any_value(q3)')} AS q3,
        CAST(sum(CAST({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) AS INT)) AS BIGINT) AS outliers,
        (SELECT {rnd('corr(a, b)')} FROM (SELECT {ranked(c)} AS a, {ranked('u')} AS b FROM obs)) AS spearman
        FROM obs, (SELECT avg({c}) AS m, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM obs)))"""


_CHECKS = ["column", "n", "r2", "skew", "kurt", "q1", "q3", "outliers", "jarque_bera", "spearman", "advice"]


@query("pearson_checks", "SELECT " + ", ".join(f'"{c}"' for c in _CHECKS) + " FROM (" + " UNION ALL ".join(_checks_sql(c) for c in _CHECKED) + ")")
def pearson_checks(spark, d):
    return rounded(Se.normality_checks(B.obs(spark, d), _CHECKED, "u"), *_CHECKS)


@query("correlation_matrix", f"SELECT a, b, {rnd('r')} AS r FROM pair_corr")
def correlation_matrix(spark, d):
    return rounded(Se.correlation_table(B.obs(spark, d), PLAIN))


# --- L: programming interface ------------------------------------------------
@query("template_steps", f"""SELECT {TS}, grid_id, {rnds('ws10', 'wd10', 'air_density', 'ws10_diff_1h', 'ws10_spatial_range')},
    {rnd('sin(radians(wd10))')} AS wd10_sin, t2m < dpt2m AS is_temp_below_dew, coalesce(abs(ws10_diff_1h) > 15, FALSE) AS is_ws_time_jump,
    month({TS}) AS month FROM ldaps_jumped""")
def template_steps(spark, d):
    return rounded(Ft.prepare("ldaps", B.ldaps_raw(spark, d)), TS, "grid_id", "ws10", "wd10", "air_density", "ws10_diff_1h",
                   "ws10_spatial_range", "wd10_sin", "is_temp_below_dew", "is_ws_time_jump", "month")


@query("source_registry", f"""SELECT turbine, kst_dtm, power_qc_flag, {rnd('power_filled * 6')} AS power_kw,
    {rnd('0.5e0 * 1.225e0 * swept_area_m2 * pow(ws_filled, 3) / 1000')} AS p_theory_std_kw, {rnd('sin(radians(wd_clean))')} AS wd_clean_sin
    FROM (SELECT r.*, c.power_qc_flag FROM sensor_ready r JOIN (SELECT turbine AS t, kst_dtm AS k, power_qc_flag FROM coded_axis) c
    ON r.turbine = c.t AND r.kst_dtm = c.k) WHERE "group" = 'kpx_group_1'""")
def source_registry(spark, d):
    df = Ft.prepare("Sensor", B.sensor_long(spark, d), B.sensor_turbines(spark, d), group="kpx_group_1")
    return rounded(df, "turbine", "kst_dtm", "power_qc_flag", "power_kw", "p_theory_std_kw", "wd_clean_sin")


@query("variant_factory")
def variant_factory(spark, d):
    train, _, columns = _split(spark, d)
    fitted = X.fitted_variants(train, GROUPS, columns, TARGET, {n: {} for n in X.VARIANTS})
    return spark.createDataFrame([(g, n, c) for (g, n), v in fitted.items() for c in v.columns], "group string, variant string, feature string")


_BUILT = ["u10", "ws10_3", "ldaps_ws_next3h_max", "gfs_ws_hub", "gfs_wd_rotation", "hour_cos_gfs"]


@query("dataset_builder", f"""SELECT l."group", l.{TS}, {rnd('l.u10')} AS u10, {rnd('l.ws10_3')} AS ws10_3, {rnd('l.ldaps_ws_next3h_max')} AS ldaps_ws_next3h_max,
    {rnd('g.gfs_ws_hub')} AS gfs_ws_hub, {rnd('g.gfs_wd_rotation')} AS gfs_wd_rotation, {rnd('g.hour_cos')} AS hour_cos_gfs, {rnd('t.target / 1e6')} AS target,
    CAST(127 AS BIGINT) AS n_features FROM ldaps_ramps l JOIN gfs_ramps g ON l."group" = g."group" AND l.{TS} = g.{TS}
    JOIN labels_long t ON l."group" = t."group" AND l.{TS} = t.{TS}""")
def dataset_builder(spark, d):
    built = built_dataset(spark, d)
    n = len(Ft.dataset_features(built))
    return rounded(built.select("group", TS, *_BUILT, (F.col("target") / F.lit(1e6)).alias("target"), F.lit(n).alias("n_features")))


def built_dataset(spark, d):
    """The training table of both sources; each area table is written once, as its ramps read it twice."""
    w = weights(spark, d)
    sides = [Sr.forecast_ramps(stable(Ft.area_table(s, raw(spark, d), w)), s) for s, raw in (("ldaps", B.ldaps_raw), ("gfs", B.gfs_raw))]
    return Ft.build_dataset(*sides, B.labels_wide(spark, d))


_CACHED = ["u10", "ws10_3", "gfs_ws_hub", "gfs_wd_rotation", "hour_cos_gfs"]


@query("dataset_cache", f"""SELECT l."group", CASE WHEN year(l.forecast_kst_dtm) < 1998 THEN 'train' ELSE 'test' END AS split, l.forecast_kst_dtm,
    {rnd('l.u10')} AS u10, {rnd('l.ws10_3')} AS ws10_3, {rnd('g.gfs_ws_hub')} AS gfs_ws_hub, {rnd('g.gfs_wd_rotation')} AS gfs_wd_rotation,
    {rnd('g.hour_cos')} AS hour_cos_gfs, {rnd('t.target / 1e6')} AS target FROM ldaps_ramps l JOIN gfs_ramps g ON l."group" = g."group" AND l.forecast_kst_dtm = g.forecast_kst_dtm
    JOIN labels_long t ON l."group" = t."group" AND l.forecast_kst_dtm = t.forecast_kst_dtm WHERE l."group" <> 'kpx_group_3'""")
def dataset_cache(spark, d):
    """The feature tables of all groups and splits, one of them without rows, written and read again."""
    cache = St.FeatureCache(spark, new_folder(spark, "features"), list(K.GROUPS))
    split = F.when(F.year("forecast_kst_dtm") < 1998, "train").otherwise("test").alias("split")
    cache.build(lambda: built_dataset(spark, d).filter(F.col("group") != K.GROUPS[2]).select("*", split))
    assert cache.is_complete() and not cache.build(lambda: None)
    rows = reduce(DataFrame.unionByName, [cache.load(g, s) for g in K.GROUPS for s in ("train", "test")])
    return rounded(rows.select("group", "split", "forecast_kst_dtm", *_CACHED, (F.col("target") / F.lit(1e6)).alias("target")))


@query("score_monitor", f"SELECT {rnd('0.5e0 * (1 - avg(nmae)) + 0.5e0 * avg(ficr)')} AS score FROM result_rows WHERE model_name = '2-HIGH'")
def score_monitor(spark, d):
    rows = B.predictions(spark, d).filter("model_name = '2-HIGH'")
    return rounded(spark.createDataFrame([(R.SettlementEvaluator().evaluate(rows),)], "score double"))
