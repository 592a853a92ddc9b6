"""Sorts, set operations, settlement metrics and decisions over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import decisions as D
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators import splits as Sp
from zephyrgrid.operators import stats as Q
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans.bindings import rnd, rnds, rounded
from zephyrgrid.plans.column_queries import _BUCKET, _PRICE, _RATIO
from zephyrgrid.plans.registry import query
from zephyrgrid.plans.series_queries import BOARD as _BOARD
from zephyrgrid.plans.source_queries import result_rows
from zephyrgrid.session import new_folder, stable
from zephyrgrid.sources.store import append_predictions

_GM = '"group", model_name'
GM = ["group", "model_name"]


# --- I, J: sorts, limits, set operations -------------------------------------
@query("sort_keys", f'SELECT turbine, kst_dtm, {rnd("power_raw")} AS power_raw FROM sensor_long ORDER BY 1, 2')
def sort_keys(spark, d):
    return rounded(B.sensor_long(spark, d), "turbine", "kst_dtm", "power_raw").orderBy("turbine", "kst_dtm")


@query("topk_features", """SELECT p_partkey, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20""")
def topk_features(spark, d):
    return B.table(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20).select("p_partkey", "p_brand")


@query("sample_rows", f"SELECT o_orderkey, {rnd('o_totalprice')} AS o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 5000")
def sample_rows(spark, d):
    return rounded(C.sample_rows(B.table(spark, d, "orders"), "o_orderkey", 5000), "o_orderkey", "o_totalprice")


@query("union_all", f"""SELECT 'forecast' AS source, l_shipdate AS ts, {rnd('l_quantity')} AS value FROM lineitem
    UNION ALL SELECT 'sensor', ts, {rnd('value')} FROM events UNION ALL SELECT 'label', o_orderdate, NULL FROM orders""")
def union_all(spark, d):
    pick = lambda t, ts, v, n: B.table(spark, d, t).select(
        F.lit(n).alias("source"), F.col(ts).alias("ts"), *([F.col(v).alias("value")] if v else []))
    parts = [pick("lineitem", "l_shipdate", "l_quantity", "forecast"), pick("events", "ts", "value", "sensor"),
             pick("orders", "o_orderdate", None, "label")]
    return rounded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


@query("intersect_features", """SELECT l_shipdate AS stamp FROM lineitem INTERSECT SELECT o_orderdate FROM orders WHERE o_custkey % 3 = 0""")
def intersect_features(spark, d):
    picked = B.table(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.col("o_orderdate").alias("stamp"))
    return B.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("stamp")).intersect(picked)


@query("except_columns", """SELECT c_custkey AS custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 250000""")
def except_columns(spark, d):
    ordered = B.table(spark, d, "orders").filter("o_totalprice > 250000").select("o_custkey")
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(ordered)


# --- K: metrics --------------------------------------------------------------
@query("prediction_store", f'SELECT {_GM}, ts, o_orderkey, {rnds("pred", "actual")} FROM store')
def prediction_store(spark, d):
    root = new_folder(spark, "predictions")
    rows = B.store(spark, d).select("group", "model_name", "ts", "o_orderkey", "pred", "actual")
    for models in (["alpha"], ["beta", "gamma"]):
        append_predictions(rows.filter(F.col("model_name").isin(*models)), root)
    return rounded(spark.read.parquet(root), "group", "model_name", "ts", "o_orderkey", "pred", "actual")


@query("nmae", f'SELECT "group", {rnd(f"avg({_RATIO})")} AS nmae FROM predictions GROUP BY 1')
def nmae(spark, d):
    return rounded(B.predictions(spark, d).groupBy("group").agg(M.nmae("pred", "actual", "capacity").alias("nmae")))


_FICR = f"CASE WHEN sum(4 * actual) > 0 THEN sum({_PRICE} * actual) / sum(4 * actual) ELSE 0 END"


@query("ficr", f"""SELECT "group", {rnd(_FICR)} AS ficr FROM (SELECT "group", pred, actual, capacity FROM predictions
    UNION ALL SELECT 'idle', pred, 0, capacity FROM predictions) GROUP BY 1""")
def ficr(spark, d):
    rows = B.predictions(spark, d).select("group", "pred", "actual", "capacity")
    both = rows.unionByName(rows.withColumns({"group": F.lit("idle"), "actual": F.lit(0.0)}))
    return rounded(both.groupBy("group").agg(M.ficr("pred", "actual", "capacity").alias("ficr")))


@query("total_score", f"""SELECT model_name, {rnd('avg(nmae)')} AS mean_nmae, {rnd('avg(ficr)')} AS mean_ficr,
    {rnd('0.5e0 * (1 - avg(nmae)) + 0.5e0 * avg(ficr)')} AS official_score FROM result_rows GROUP BY 1""")
def total_score(spark, d):
    return rounded(M.total_score(result_rows(spark, d), ["model_name"]))


@query("group_summary", f'SELECT {_GM}, {rnds("nmae", "ficr", "mae", "rmse", "score")} FROM result_rows')
def group_summary(spark, d):
    return rounded(M.group_summary(B.predictions(spark, d), GM))


_SOFT = f"(4 - 1 / (1 + exp(-40 * ({_RATIO} - 0.06e0))) - 3 / (1 + exp(-40 * ({_RATIO} - 0.08e0))))"


@query("soft_score_loss", f"""SELECT {_GM}, {rnd(f'0.5e0 * avg({_RATIO}) + 0.5e0 * (1 - sum({_SOFT} * actual) / (sum(actual) + 1e-8) / 4)')} AS soft_loss
    FROM predictions GROUP BY ALL""")
def soft_score_loss(spark, d):
    return rounded(M.soft_score_loss(B.predictions(spark, d), GM))


@query("official_leaderboard", f"SELECT model_name, groups, {rnds(*_BOARD)} FROM board")
def official_leaderboard(spark, d):
    return rounded(M.leaderboard(result_rows(spark, d)))


@query("variant_summary", f"""WITH v AS (SELECT 'v' || (n_features % 2) AS model_version, model_name AS feature_version, nmae, ficr, score FROM result_rows)
    SELECT model_version, feature_version, {rnd('avg(nmae)')} AS mean_nmae, {rnd('avg(ficr)')} AS mean_ficr, {rnd('avg(score)')} AS mean_score, count(*) AS runs
    FROM v GROUP BY GROUPING SETS ((model_version, feature_version), (model_version), (feature_version))""")
def variant_summary(spark, d):
    rows = result_rows(spark, d).select(
        F.concat(F.lit("v"), (F.col("n_features") % 2).cast("string")).alias("model_version"),
        F.col("model_name").alias("feature_version"), "nmae", "ficr", "score")
    return rounded(M.variant_summary(rows))


_BANDS = f"""count(*) AS n_hours, avg(CAST({_RATIO} <= 0.06e0 AS INT)) AS share_le6,
    avg(CAST({_RATIO} > 0.06e0 AND {_RATIO} <= 0.08e0 AS INT)) AS share_6_8, avg(CAST({_RATIO} > 0.08e0 AS INT)) AS share_gt8"""
_SHARES = ["share_le6", "share_6_8", "share_gt8"]
B.VIEWS["bands"] = f"SELECT {_GM}, {_BANDS} FROM predictions GROUP BY ALL"
B.VIEWS["bands_by_hour"] = f'SELECT "group", {_BUCKET.format(h="hour")} AS hour_bucket, {_BANDS} FROM predictions GROUP BY ALL'


@query("error_band", f"SELECT {_GM}, n_hours, {rnds(*_SHARES)} FROM bands")
def error_band(spark, d):
    return rounded(M.error_bands(B.predictions(spark, d), GM))


@query("recommend_action", f"""SELECT {_GM}, CASE WHEN share_gt8 >= 0.24e0 OR (share_6_8 > 0 AND share_gt8 >= 2.4e0 * share_6_8) THEN 'retrain'
    WHEN share_6_8 >= 0.1e0 THEN 'calibrate' ELSE 'keep' END AS action FROM bands""")
def recommend_action(spark, d):
    bands = M.error_bands(B.predictions(spark, d), GM)
    return bands.select(*GM, M.recommended_action(dominance=2.4, floor=0.24).alias("action"))


@query("diurnal_band", f"""SELECT b."group", b.hour_bucket, n_hours, {rnds(*_SHARES)}, {rnd('max(share_gt8) OVER w / avg(share_gt8) OVER w')} AS imbalance,
    max(share_gt8) OVER w / avg(share_gt8) OVER w >= 1.5 AS uneven FROM bands_by_hour b WINDOW w AS (PARTITION BY b."group")""")
def diurnal_band(spark, d):
    bands = M.diurnal_bands(B.predictions(spark, d), ["group"], "hour")
    return rounded(bands.join(M.diurnal_imbalance(bands, ["group"]), "group"))


# --- K: searches -------------------------------------------------------------
def _values(name: str, numbers: list[float]) -> str:
    return f"(VALUES {', '.join(f'({i}, {v!r}::DOUBLE)' for i, v in enumerate(numbers))}) {name}(i, v)"


def _fit_sql(rows: str, keys: str) -> str:
    c = f"least(greatest(a.v * pred + b.v * capacity, 0), capacity)"
    ratio = f"(abs({c} - actual) / capacity)"
    price = f"(CASE WHEN {ratio} <= 0.06e0 THEN 4 WHEN {ratio} <= 0.08e0 THEN 3 ELSE 0 END)"
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 10) DESC, ai, bi) AS r FROM (
        SELECT *, 0.5e0 * (1 - nmae) + 0.5e0 * ficr AS score FROM (SELECT {keys}, a.i AS ai, b.i AS bi, a.v AS a, b.v AS b_ratio, count(*) AS n,
        avg({ratio}) AS nmae, CASE WHEN sum(4 * actual) > 0 THEN sum({price} * actual) / sum(4 * actual) ELSE 0 END AS ficr
        FROM {rows} CROSS JOIN {_values('a', D.SLOPES)} CROSS JOIN {_values('b', D.OFFSETS)} GROUP BY {keys}, a.i, b.i, a.v, b.v))) WHERE r = 1"""


B.VIEWS["halves"] = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_GM} ORDER BY ts, o_orderkey) <= floor(count(*) OVER (PARTITION BY {_GM}) * 0.5e0)
    THEN 'tune' ELSE 'audit' END AS half, {_BUCKET.format(h='hour')} AS hour_bucket FROM predictions"""
B.VIEWS["tune_rows"] = "SELECT * FROM halves WHERE half = 'tune'"
B.VIEWS["fitted"] = _fit_sql("tune_rows", _GM)
B.VIEWS["fitted_by_hour"] = _fit_sql("tune_rows", f"{_GM}, hour_bucket")


# fewer rows than the guard of the operator: the smallest tables hold a hundred orders of a group and priority
AUDIT_ROWS = 20


def halves(spark, d):
    return Sp.tune_audit(B.predictions(spark, d), GM, ["ts", "o_orderkey"], min_audit=AUDIT_ROWS)


_FITTED = ["a", "b_ratio", "nmae", "ficr", "score"]


@query("affine_calibration", f"SELECT {_GM}, n, {rnds(*_FITTED)}, {rnd('b_ratio * 500000')} AS b_kw FROM fitted")
def affine_calibration(spark, d):
    return rounded(D.fit_affine(halves(spark, d).filter("half = 'tune'"), GM))


@query("diurnal_calibration", f"SELECT {_GM}, hour_bucket, n, n < 500 AS few_rows, {rnds(*_FITTED)} FROM fitted_by_hour")
def diurnal_calibration(spark, d):
    return rounded(D.fit_diurnal(halves(spark, d).filter("half = 'tune'"), GM, "hour"),
                   *GM, "hour_bucket", "n", "few_rows", *_FITTED)


def _audit_sql(fit: str, on: str) -> str:
    match = " AND ".join(f"h.{k} = f.{k}" for k in on.split(", "))
    scored = f"""(SELECT h."group", h.model_name, h.pred AS raw, least(greatest(f.a * h.pred + f.b_ratio * h.capacity, 0), h.capacity) AS cal, h.actual, h.capacity
        FROM halves h JOIN {fit} f ON {match} WHERE h.half = 'audit')"""
    score = lambda p: (f"(0.5e0 * (1 - avg(abs({p} - actual) / capacity)) + 0.5e0 * sum(CASE WHEN abs({p} - actual) / capacity <= 0.06e0 THEN 4 "
                       f"WHEN abs({p} - actual) / capacity <= 0.08e0 THEN 3 ELSE 0 END * actual) / sum(4 * actual))")
    return f"""SELECT *, round(after_, 10) > round(before_, 10) AS use_calibrated FROM (SELECT {_GM}, {score('raw')} AS before_, {score('cal')} AS after_
        FROM {scored} GROUP BY ALL)"""


B.VIEWS["audited"] = _audit_sql("fitted", _GM)
B.VIEWS["audited_by_hour"] = _audit_sql("fitted_by_hour", f"{_GM}, hour_bucket")


@query("calibration_audit", f"""SELECT a."group", a.model_name, {rnd('a.before_')} AS score_before, {rnd('a.after_')} AS score_after, a.use_calibrated,
    {rnd('greatest(a.before_, a.after_)')} AS best_score, {rnd('h.after_')} AS score_diurnal, round(h.after_, 10) > round(a.after_, 10) AS adopt_diurnal
    FROM audited a JOIN audited_by_hour h ON a."group" = h."group" AND a.model_name = h.model_name""")
def calibration_audit(spark, d):
    rows = stable(halves(spark, d))
    flat, hourly = D.calibrations(rows.filter("half = 'tune'"), GM, "hour")
    found = D.candidate_audit(D.calibrated_rows(rows.filter("half = 'audit'"), GM, flat, hourly, "hour"), GM)
    tied = lambda c: F.round(c, 10)
    return rounded(found.select(
        *GM, F.col("score_raw").alias("score_before"), F.col("score_flat").alias("score_after"),
        (tied("score_flat") > tied("score_raw")).alias("use_calibrated"), F.greatest("score_raw", "score_flat").alias("best_score"),
        F.col("score_by_hour").alias("score_diurnal"), (tied("score_by_hour") > tied("score_flat")).alias("adopt_diurnal")))


def _blend_sql(rows: str, keys: str) -> str:
    ratio = "(abs(w.v * pred_a + (1 - w.v) * pred_b - actual) / capacity)"
    price = f"(CASE WHEN {ratio} <= 0.06e0 THEN 4 WHEN {ratio} <= 0.08e0 THEN 3 ELSE 0 END)"
    return f"""SELECT *, 0.5e0 * (1 - nmae) + 0.5e0 * ficr AS score FROM (SELECT {keys}, w.i AS wi, w.v AS w, avg({ratio}) AS nmae,
        sum({price} * actual) / sum(4 * actual) AS ficr FROM {rows} CROSS JOIN {_values('w', D.WEIGHTS)} GROUP BY {keys}, w.i, w.v)"""


# decisions over the stored predictions of three models
_price = lambda p: f"CASE WHEN abs({p} - actual) / capacity <= 0.06e0 THEN 4 WHEN abs({p} - actual) / capacity <= 0.08e0 THEN 3 ELSE 0 END"
_score = lambda p: f"(0.5e0 * (1 - avg(abs({p} - actual) / capacity)) + 0.5e0 * sum({_price(p)} * actual) / sum(4 * actual))"
B.VIEWS["stored"] = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {_GM} ORDER BY ts, o_orderkey) <= floor(count(*) OVER (PARTITION BY {_GM}) * 0.5e0)
    THEN 'tune' ELSE 'audit' END AS half, {_BUCKET.format(h='hour')} AS hour_bucket FROM store"""
B.VIEWS["stored_tune"] = "SELECT * FROM stored WHERE half = 'tune'"
B.VIEWS["stored_flat"] = _fit_sql("stored_tune", _GM)
B.VIEWS["stored_hourly"] = _fit_sql("stored_tune", f"{_GM}, hour_bucket")
_line = lambda f: f"least(greatest({f}.a * s.pred + {f}.b_ratio * s.capacity, 0), s.capacity)"
B.VIEWS["stored_lines"] = f"""SELECT s.*, {_line('f')} AS flat, CASE WHEN h.a IS NULL THEN least(greatest(s.pred, 0), s.capacity) ELSE {_line('h')} END AS by_hour FROM stored s
    JOIN stored_flat f ON s."group" = f."group" AND s.model_name = f.model_name
    LEFT JOIN stored_hourly h ON s."group" = h."group" AND s.model_name = h.model_name AND s.hour_bucket = h.hour_bucket"""
B.VIEWS["candidates"] = f"""SELECT *, CASE WHEN round(cal, 10) <= round(raw, 10) THEN 'raw' WHEN hourly_wins THEN 'by_hour' ELSE 'calibrated' END AS kind,
    CASE WHEN round(cal, 10) > round(raw, 10) THEN cal ELSE raw END AS best FROM (SELECT *, round(h, 10) > round(f, 10) AS hourly_wins, CASE WHEN round(h, 10) > round(f, 10) THEN h ELSE f END AS cal
    FROM (SELECT {_GM}, {_score('pred')} AS raw, {_score('flat')} AS f, {_score('by_hour')} AS h FROM stored_lines WHERE half = 'audit' GROUP BY ALL))"""
B.VIEWS["originals"] = f"""SELECT o."group", o.model_name, o.score, c.raw AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 10) DESC, model_name) AS r
    FROM (SELECT {_GM}, {_score('pred')} AS score FROM store WHERE model_name = 'gamma' GROUP BY ALL)) o JOIN candidates c ON o.r = 1 AND o."group" = c."group" AND o.model_name = c.model_name"""
B.VIEWS["ranked_candidates"] = """SELECT c.*, row_number() OVER (PARTITION BY c."group" ORDER BY round(best, 10) DESC, c.model_name) AS r FROM candidates c
    JOIN originals o ON c."group" = o."group" WHERE round(c.best, 10) > round(o.baseline, 10)"""
B.VIEWS["best_rows"] = f"""SELECT s."group", s.o_orderkey, s.actual, s.capacity, s.half, c.r, CASE c.kind WHEN 'raw' THEN s.pred WHEN 'by_hour' THEN s.by_hour ELSE s.flat END AS best_pred
    FROM stored_lines s JOIN ranked_candidates c ON s."group" = c."group" AND s.model_name = c.model_name WHERE c.r <= 2"""
B.VIEWS["blend_pairs"] = """SELECT a."group", a.actual, a.capacity, a.half, a.best_pred AS pred_a, b.best_pred AS pred_b FROM best_rows a
    JOIN best_rows b ON a."group" = b."group" AND a.o_orderkey = b.o_orderkey AND a.r = 1 AND b.r = 2"""
B.VIEWS["blend_pairs_tune"] = "SELECT * FROM blend_pairs WHERE half = 'tune'"
B.VIEWS["blend_pairs_audit"] = "SELECT * FROM blend_pairs WHERE half = 'audit'"
B.VIEWS["blend_tune"] = _blend_sql("blend_pairs_tune", '"group"')
B.VIEWS["blend_audit"] = _blend_sql("blend_pairs_audit", '"group"')
B.VIEWS["blend_choice"] = """SELECT x."group", a.model_name AS a, b.model_name AS b, x.w, x.score AS ensemble_score, a.best AS solo_best, round(x.score, 10) > round(a.best, 10) AS adopt
    FROM blend_audit x JOIN (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 10) DESC, wi) AS r FROM blend_tune) t
    ON x."group" = t."group" AND x.wi = t.wi AND t.r = 1 JOIN ranked_candidates a ON a."group" = x."group" AND a.r = 1
    JOIN ranked_candidates b ON b."group" = x."group" AND b.r = 2"""


def decisions(spark, d):
    rows = Sp.tune_audit(B.store(spark, d), GM, ["ts", "o_orderkey"], min_audit=AUDIT_ROWS)
    # the least exact of the three stands for what an earlier experiment had found best
    earlier = M.group_summary(B.store(spark, d).filter("model_name = 'gamma'"), GM)
    return D.decide(stable(rows), GM, ["o_orderkey"], "hour", earlier)


@query("blend_weight", f"""SELECT "group", a, b, {rnds('w', 'ensemble_score', 'solo_best')}, adopt FROM blend_choice""")
def blend_weight(spark, d):
    return rounded(decisions(spark, d)[1], "group", "a", "b", "w", "ensemble_score", "solo_best", "adopt")


@query("final_choice", f"""WITH cand AS (SELECT "group", model_name, kind, best AS score, 0 AS late FROM candidates UNION ALL
        SELECT "group", a || '+' || b, 'ensemble', ensemble_score, 1 FROM blend_choice WHERE adopt),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(score, 10) DESC, late, model_name) AS r FROM cand) WHERE r = 1)
    SELECT o."group", CASE WHEN round(t.score, 10) > round(o.baseline, 10) THEN t.model_name ELSE o.model_name END AS model_name,
    CASE WHEN round(t.score, 10) > round(o.baseline, 10) THEN t.kind ELSE 'raw' END AS kind,
    {rnd('CASE WHEN round(t.score, 10) > round(o.baseline, 10) THEN t.score ELSE o.score END')} AS score FROM originals o JOIN top t ON o."group" = t."group" """)
def final_choice(spark, d):
    return rounded(decisions(spark, d)[2])


@query("apply_calibration", f"""SELECT h.o_orderkey, {rnd('least(greatest(f.a * h.pred + f.b_ratio * h.capacity, 0), h.capacity)')} AS pred_global,
    {rnd('least(greatest(g.a * h.pred + g.b_ratio * h.capacity, 0), h.capacity)')} AS pred_by_hour,
    {rnd('CASE WHEN u.use_calibrated THEN least(greatest(f.a * h.pred + f.b_ratio * h.capacity, 0), h.capacity) ELSE h.pred END')} AS pred_final
    FROM halves h JOIN fitted f ON h."group" = f."group" AND h.model_name = f.model_name JOIN audited u ON h."group" = u."group" AND h.model_name = u.model_name
    JOIN fitted_by_hour g ON h."group" = g."group" AND h.model_name = g.model_name AND h.hour_bucket = g.hour_bucket""")
def apply_calibration(spark, d):
    rows = stable(halves(spark, d))
    flat, hourly = D.calibrations(rows.filter("half = 'tune'"), GM, "hour")
    df = stable(D.calibrated_rows(rows, GM, flat, hourly, "hour"))
    audited = D.candidate_audit(df.filter("half = 'audit'"), GM).withColumn(
        "use_calibrated", F.round("score_flat", 10) > F.round("score_raw", 10))
    df = D.pick_calibrated(df, stable(audited), GM, calibrated="pred_flat").withColumnsRenamed(
        {"pred_flat": "pred_global"})
    return rounded(df, "o_orderkey", "pred_global", "pred_by_hour", "pred_final")


@query("baseline_gap", f"""SELECT "group", {rnd('best_score')} AS best_score, 0.6e0 AS baseline_score, {rnd('best_score - 0.6e0')} AS gap FROM
    (SELECT "group", max(score) AS best_score FROM result_rows WHERE model_name <> '1-URGENT' GROUP BY 1)""")
def baseline_gap(spark, d):
    results = result_rows(spark, d)
    baseline = results.select("group").distinct().withColumn("baseline_score", F.lit(0.6))
    return rounded(M.baseline_gap(results, baseline, oracle="1-URGENT"))
