"""Scaling, imputation, profiles and small ranked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.operators.ordering import exact_quantiles, long_form
from zephyrgrid.session import attach, stable


def _rows(df: DataFrame, columns: list[str], build, names: list[str]) -> DataFrame:
    """One aggregation over all columns, returned as one row per column."""
    agg = df.agg(*[F.struct(*[c.alias(n) for n, c in zip(names, build(x))]).alias(x) for x in columns])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("column"), *[F.col(f"`{x}`.{n}").alias(n) for n in names]) for x in columns])))


def scale_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) with a sample deviation; a flat or unknown deviation counts as 1."""
    raw = _rows(df, columns, lambda c: [F.avg(c), F.stddev_samp(c)], ["mean", "std"])
    usable = (F.col("std") > 1e-8) & ~F.isnan("std") & (F.col("std") != float("inf"))
    return raw.withColumn("std", F.when(usable, F.col("std")).otherwise(1.0))


def minmax_params(df: DataFrame, columns: list[str]) -> DataFrame:
    return _rows(df, columns, lambda c: [F.min(c).cast("double"), F.max(c).cast("double")], ["low", "high"])


def as_dict(params: DataFrame) -> dict[str, tuple]:
    """Scale parameters on the driver: one row per feature column, so a few hundred at most."""
    return {r["column"]: tuple(r)[1:] for r in params.collect()}


def standardise(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in params.items() if c in df.columns})


def unstandardise(value: Column, params: tuple[float, float]) -> Column:
    return value * params[1] + params[0]


def minmax_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """To 0..1 of the training range, not clipped; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - lo) / ((hi - lo) or 1.0) for c, (lo, hi) in params.items()})


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median) over all rows, without gathering a column in one task."""
    return exact_quantiles(long_form(df, columns), ["column"], "value", [0.5]).select(
        "column", F.col("quantile").alias("median"))


def impute(df: DataFrame, medians_: dict[str, float]) -> DataFrame:
    """Fill nulls by the train medians and fix the column order by the train table."""
    rest = [c for c in df.columns if c not in medians_]
    return df.select(*rest, *[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in medians_.items()])


def describe(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max as one row per column (and key)."""
    keys = list(keys)
    cells = long_form(df, columns, keys)
    base = cells.groupBy(*keys, "column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = exact_quantiles(cells, [*keys, "column"], "value", [0.25, 0.5, 0.75])
    at = lambda s, n: F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n)
    wide = quart.groupBy(*keys, "column").agg(at(0.25, "q25"), at(0.5, "q50"), at(0.75, "q75"))
    return base.join(wide, [*keys, "column"], "left")


def value_counts(df: DataFrame, column: str, share: bool = False) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if not share:
        return counts
    total = counts.agg(F.sum("count").alias("_total")).withColumn("_one", F.lit(1))
    return (counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
            .select(column, "count", (F.col("count") / F.col("_total")).alias("share")))


def cumulative_share(ranked: DataFrame, value: str, name: str, ratio: float) -> DataFrame:
    """Running share of importance, largest first, and whether a feature is within the ratio.

    The table has one row per feature, so a single ordered window is a small sort.
    """
    order = Window.orderBy(F.col(value).desc(), F.col(name))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = ranked.withColumn("cumulative", F.sum(value).over(upto) / F.sum(value).over(Window.partitionBy()))
    return share.withColumn("keep", F.coalesce(F.lag("cumulative").over(order) < ratio, F.lit(True)))


def score_pivot(results: DataFrame, models: list[str], value: str = "score", by: str = "group") -> DataFrame:
    return results.groupBy(by).pivot("model_name", models).agg(F.first(value))


def latest(df: DataFrame, keys: list[str], sequence) -> DataFrame:
    """Keep the last written row per key: a max over a struct, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.max_by(F.struct(*rest), sequence).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*").select(*df.columns)


def best_by(df: DataFrame, keys: list[str], score: str, name: str) -> DataFrame:
    """The best row per key; equal scores go to the first name."""
    low = F.min_by(F.struct(*df.columns), F.struct(-F.col(score), F.col(name))).alias("_row")
    return df.groupBy(*keys).agg(low).select("_row.*")


def power_curve(df: DataFrame, speed: str, power: str, model: str, width: float = 0.5) -> DataFrame:
    """Median power per (model, speed bin); bins may be of any size."""
    bins = df.filter(F.col(speed).isNotNull() & F.col(power).isNotNull()).select(
        model, (F.floor(F.col(speed) / width) * width).alias("ws_bin"), F.col(power).cast("double").alias("power"))
    return exact_quantiles(bins, [model, "ws_bin"], "power", [0.5]).select(
        model, "ws_bin", F.col("quantile").alias("power_median"), "n")


def curve_power(df: DataFrame, curve: DataFrame, speed: str, model: str, cut_in: float, cut_out,
                turbines, width: float = 0.5) -> DataFrame:
    """Look the forecast speed up in the curve; nothing below cut-in or from cut-out on."""
    binned = df.withColumn("ws_bin", F.floor(F.col(speed) / width) * width)
    found = attach(binned, stable(curve.select(model, "ws_bin", "power_median")), [model, "ws_bin"], "left")
    running = (F.col(speed) >= cut_in) & (F.col(speed) < cut_out)
    return found.withColumn("curve_power", F.when(
        F.col(speed).isNotNull(), F.when(running, F.col("power_median")).otherwise(0.0)) * turbines)
