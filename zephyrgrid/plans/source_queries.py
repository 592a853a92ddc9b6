"""Scans, caches and sinks over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrgrid import constants as K
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import metrics as M
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans.bindings import rnd, rnds, rounded
from zephyrgrid.plans.registry import query
from zephyrgrid.session import new_folder
from zephyrgrid.sources import store as St
from zephyrgrid.sources.catalog import Catalog, scan_any

LABEL_SCHEMA = T.StructType([T.StructField("kst_dtm", T.TimestampNTZType())]
                            + [T.StructField(g, T.DoubleType()) for g in K.GROUPS])
NAMES = ["customer", "events", "lineitem", "orders", "supplier"]


def _catalog(spark, d, extra: dict[str, str] | None = None) -> Catalog:
    return Catalog(spark, {n: f"{d}/{n}.parquet" for n in NAMES} | (extra or {}))


def _count(df, name):
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in NAMES)


@query("scan_csv", f"SELECT kst_dtm, {rnds(*K.GROUPS)} FROM labels_wide")
def scan_csv(spark, d):
    path = new_folder(spark, "labels") + ".csv"
    St.write_results(B.labels_wide(spark, d), path)
    source = Catalog(spark, {"train_labels": path}, {"train_labels": LABEL_SCHEMA})
    return rounded(source["train_labels"])


@query("catalog", _COUNTS)
def catalog(spark, d):
    _catalog(spark, d).register_views("named_")
    return _union([_count(spark.table(f"named_{n}"), n) for n in NAMES])


@query("scan_all", f"SELECT *, TRUE AS loaded FROM ({_COUNTS}) UNION ALL SELECT 'absent', 0, FALSE")
def scan_all(spark, d):
    tables, failures = _catalog(spark, d, {"absent": f"{d}/absent.parquet"}).load_all()
    good = [_count(df, n).withColumn("loaded", F.lit(True)) for n, df in tables.items()]
    bad = [spark.range(1).select(F.lit(n).alias("name"), F.lit(0).cast("bigint").alias("n_rows"),
                                 F.lit(False).alias("loaded")) for n in failures]
    return _union(good + bad)


@query("check_paths", f"SELECT *, TRUE AS found FROM ({_COUNTS}) UNION ALL SELECT 'absent', 0, FALSE")
def check_paths(spark, d):
    source = _catalog(spark, d, {"absent": f"{d}/absent.parquet"})
    parts = []
    for name, found in source.check_paths().items():
        rows = _count(source[name], name) if found else spark.range(1).select(
            F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("n_rows"))
        parts.append(rows.withColumn("found", F.lit(found)))
    return _union(parts)


@query("date_range_profile", """SELECT 'l_shipdate' AS "column", min(l_shipdate) AS "first", max(l_shipdate) AS "last" FROM lineitem
    UNION ALL SELECT 'o_orderdate', min(o_orderdate), max(o_orderdate) FROM orders""")
def date_range_profile(spark, d):
    source = _catalog(spark, d)
    return _union([source.summarize("lineitem"), source.summarize("orders")])


@query("scan_any", """SELECT 'table' AS kind, count(*) AS n_rows FROM orders UNION ALL SELECT 'csv', count(*) FROM orders
    UNION ALL SELECT 'parquet', count(*) FROM orders""")
def scan_any_kinds(spark, d):
    orders = B.table(spark, d, "orders")
    path = new_folder(spark, "orders") + ".csv"
    St.write_results(orders, path)
    kinds = {"table": orders, "csv": path, "parquet": f"{d}/orders.parquet"}
    schema = orders.schema
    return _union([scan_any(spark, x, schema).agg(F.count(F.lit(1)).alias("n_rows"))
                   .select(F.lit(k).alias("kind"), "n_rows") for k, x in kinds.items()])


_SUMMARY = """SELECT {keys}, avg(abs(pred - actual) / capacity) AS nmae,
    CASE WHEN sum(4 * actual) > 0 THEN sum(CASE WHEN abs(pred - actual) / capacity <= 0.06e0 THEN 4 WHEN abs(pred - actual) / capacity <= 0.08e0
    THEN 3 ELSE 0 END * actual) / sum(4 * actual) ELSE 0 END AS ficr,
    avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse FROM {rows} GROUP BY {keys}"""
B.VIEWS["result_base"] = _SUMMARY.format(keys='"group", model_name', rows="predictions")
B.VIEWS["result_rows"] = """SELECT *, 0.5e0 * (1 - nmae) + 0.5e0 * ficr AS score,
    CAST(length(model_name) AS BIGINT) AS n_features FROM result_base"""


def result_rows(spark, d):
    """One result row per (group, model) of the predictions."""
    return M.group_summary(B.predictions(spark, d), ["group", "model_name"]).withColumn(
        "n_features", F.length("model_name").cast("bigint"))


_RESULTS = rnds("nmae", "ficr", "score")


@query("results_glob_union", f"""SELECT baseline, baseline || '/' || model_name AS model_id, "group", model_name, {_RESULTS}, {rnd('mae')} AS mae
    FROM (SELECT 'baseline_1_results' AS baseline, "group", model_name, nmae, ficr, score, mae FROM result_rows
    UNION ALL SELECT 'baseline_2_results', "group", model_name, nmae, ficr, score, NULL FROM result_rows)""")
def results_glob_union(spark, d):
    root = new_folder(spark, "results")
    rows = result_rows(spark, d)
    St.write_results(rows, f"{root}/baseline_1_results.csv")
    St.write_results(rows.drop("mae"), f"{root}/baseline_2_results.csv")
    St.write_results(rows.select("group", "mae"), f"{root}/baseline_3_results.csv")
    return rounded(St.read_results(spark, f"{root}/baseline_*_results.csv"),
                   "baseline", "model_id", "group", "model_name", "nmae", "ficr", "score", "mae")


@query("results_sink", f'SELECT "group", model_name, {rnds("nmae", "ficr", "score", "mae", "rmse")}, n_features FROM result_rows')
def results_sink(spark, d):
    path = St.write_results(result_rows(spark, d), new_folder(spark, "summary"), "parquet")
    return rounded(spark.read.parquet(path))


@query("submission_align", f"""SELECT c.c_custkey AS forecast_id, o.forecast_kst_dtm, {", ".join(f"{rnd('l.' + g)} AS {g}" for g in K.GROUPS)}
    FROM customer c JOIN (SELECT o_custkey, min(o_orderdate) + INTERVAL 1 DAY AS forecast_kst_dtm FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
    LEFT JOIN labels_wide l ON l.kst_dtm = o.forecast_kst_dtm""")
def submission_align(spark, d):
    sample = _sample(spark, d)
    ready = B.labels_wide(spark, d).withColumnRenamed("kst_dtm", "forecast_kst_dtm")
    return rounded(St.align_submission(sample, ready, "forecast_kst_dtm", list(K.GROUPS)))


def _sample(spark, d):
    """A sample table: one row per customer and the day after the first order."""
    first = B.table(spark, d, "orders").groupBy("o_custkey").agg(
        (F.min("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("forecast_kst_dtm"))
    ids = B.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return ids.join(first, "o_custkey").select(
        F.col("o_custkey").alias("forecast_id"), "forecast_kst_dtm", *[F.lit(None).cast("double").alias(g) for g in K.GROUPS])


@query("dummy_labels", "SELECT DISTINCT l_shipdate AS kst_dtm, 0e0 AS kpx_group_1, 0e0 AS kpx_group_2, 0e0 AS kpx_group_3 FROM lineitem")
def dummy_labels(spark, d):
    return St.dummy_labels(B.table(spark, d, "lineitem"), "l_shipdate", list(K.GROUPS))
