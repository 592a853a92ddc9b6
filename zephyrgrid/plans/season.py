"""From features to the submission in one piece: fit, store, calibrate, choose, refit, predict, align, check.

Also the stream of hourly coverage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.models import boosting as Bo
from zephyrgrid.models import regress as R
from zephyrgrid.operators import contracts as C
from zephyrgrid.operators import decisions as D
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators import splits as Sp
from zephyrgrid.operators.ordering import time_slice
from zephyrgrid.plans import bindings as B
from zephyrgrid.plans.model_queries import GROUPS, TARGET, model_data
from zephyrgrid.plans.registry import query
from zephyrgrid.plans.series_queries import TS
from zephyrgrid.session import new_folder, stable, together
from zephyrgrid.sources import store as St
from zephyrgrid.streaming import hourly as H

GM = ["group", "model_name"]
KEPT = ["group", TS, "actual", "capacity"]


def kernel_energy(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions of a kernel line per group."""
    def one(group: str) -> DataFrame:
        own = lambda df: df.filter(F.col("group") == group)
        return R.predicted(R.KernelBaseline(columns, TARGET).fit(own(train)), own(rows), columns)
    return reduce(DataFrame.unionByName, together(rows.sparkSession, {g: lambda g=g: one(g) for g in GROUPS}).values())


def fitted(train: DataFrame, valid: DataFrame, columns: list[str], rounds: int, patience: int) -> dict[str, Bo.Booster]:
    return together(train.sparkSession, {
        "trees": lambda: Bo.Booster(columns, TARGET).fit(train, valid, rounds, patience),
        "settled": lambda: Bo.settlement_booster(train, valid, columns, TARGET, patience=patience)})


def refitted(rows: DataFrame, models: dict[str, Bo.Booster], columns: list[str], warmup: int = 10) -> dict[str, Bo.Booster]:
    """The same models over all labelled rows, each group with the rounds that validation found best."""
    best = {name: model.best for name, model in models.items()}
    made = together(rows.sparkSession, {
        "trees": lambda: Bo.Booster(columns, TARGET).fit(rows, rounds=int(best["trees"].max())),
        "settled": lambda: Bo.settlement_booster(rows, None, columns, TARGET, warmup, int(best["settled"].max()) - warmup, None)})
    for name, model in made.items():
        model.best = best[name]
    return made


def stored(models: dict[str, Bo.Booster], kernel: DataFrame, rows: DataFrame, root: str) -> DataFrame:
    """Predictions of all models, added to a prediction store and read from there."""
    for name, model in models.items():
        St.append_predictions(model.energy(rows).select(*KEPT, "pred").withColumn("model_name", F.lit(name)), root)
    St.append_predictions(kernel.select(*KEPT, "pred").withColumn("model_name", F.lit("kernel")), root)
    return rows.sparkSession.read.parquet(root).withColumn("hour", F.hour(TS))


def season(spark, d, rounds: int = 20, patience: int = 20, audit_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(submission, choice): energy of every group and stamp of the season to come, and what each group's values come from."""
    rows, columns = model_data(spark, d)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    valid = stable(Sp.warmup_trim(rows.filter("split = 'valid'"), ["group"], [TS], slice_by=time_slice(TS)))
    labelled = rows.filter("split IN ('train', 'valid')")
    first = together(spark, {
        "models": lambda: fitted(train, valid, columns, rounds, patience),
        "kernel": lambda: kernel_energy(train, valid, columns),
        "coming": lambda: kernel_energy(labelled, test, columns)})
    models = first["models"]

    def decided():
        known = stored(models, first["kernel"], valid, new_folder(spark, "predictions"))
        halves = stable(Sp.tune_audit(known, GM, [TS], min_audit=audit_rows, slice_by=time_slice(TS)))
        # the kernel line is what there was before
        earlier = M.group_summary(halves.filter("model_name = 'kernel'"), GM)
        params = D.calibrations(halves.filter("half = 'tune'"), GM, "hour")
        candidates, blends, choice = D.decide(halves, GM, [TS], "hour", earlier, params)
        return params, candidates, blends, stable(choice)

    # the models of the season are fitted while it is decided what becomes of them
    then = together(spark, {"decided": decided, "coming": lambda: stored(
        refitted(labelled, models, columns), first["coming"], test, new_folder(spark, "season"))})
    (params, candidates, blends, choice), coming = then["decided"], then["coming"]
    ready = D.calibrated_rows(coming, GM, *params, "hour").join(F.broadcast(candidates.select(*GM, "kind")), GM).withColumn(
        "pred_best", D.best_prediction())
    cells = ready.groupBy("group", TS).pivot("model_name", ["trees", "settled", "kernel"]).agg(
        F.first("pred").alias("raw"), F.first("pred_best").alias("best"))
    named = cells.join(F.broadcast(choice), "group").join(F.broadcast(blends.select("group", "a", "b", "w")), "group", "left")
    pick = lambda name, what: F.coalesce(*[F.when(F.col(name) == m, F.col(f"{m}_{what}")) for m in ("trees", "settled", "kernel")])
    mixed = pick("a", "best") * F.col("w") + pick("b", "best") * (1 - F.col("w"))
    value = F.when(F.col("kind") == "ensemble", mixed).when(F.col("kind") == "raw", pick("model_name", "raw")).otherwise(pick("model_name", "best"))
    wide = named.withColumn("value", value).groupBy(TS).pivot("group", GROUPS).agg(F.first("value"))

    stamps = test.select(TS).distinct()
    sample = stamps.withColumn("forecast_id", F.datediff(TS, F.lit("1970-01-01").cast("timestamp_ntz"))).select(
        "forecast_id", TS, *[F.lit(None).cast("double").alias(g) for g in GROUPS])
    ready = stable(St.align_submission(sample, wide, TS, GROUPS))
    tops = {r["group"]: r["capacity"] for r in rows.select("group", "capacity").distinct().collect()}  # one row per group
    faults = C.submission_violations(ready, sample, tops).first()
    if faults["n_null"] or faults["n_negative"] or faults["n_above_capacity"] or not faults["columns_equal"] or faults["n_rows"] != faults["n_expected"]:
        raise C.ContractError(f"the submission breaks its contract: {faults}")
    return ready, choice


@query("season_submission")
def season_submission(spark, d):
    return season(spark, d)[0]


_STAMP = "time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR"


@query("hourly_coverage_stream", f"""SELECT 'wtg' || (user_id % 3) AS turbine, {_STAMP} AS hour_end, count(value) AS n_valid,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, CAST(0 AS BIGINT) AS n_late FROM events GROUP BY 1, 2""")
def hourly_coverage_stream(spark, d):
    rows = H.arriving(spark, f"{d}/events.parquet").select(
        F.concat(F.lit("wtg"), (F.col("user_id") % 3).cast("string")).alias("turbine"), F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    made = H.follow(rows, ["turbine"], "ts", "cents")
    return made.table(["turbine"]).select("turbine", F.col("hour_end").cast("timestamp_ntz").alias("hour_end"), "n_valid",
                                          F.col("total").cast("bigint"), F.lit(made.late).cast("bigint").alias("n_late"))
