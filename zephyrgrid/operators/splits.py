"""Splits in time, never shuffled. Positions come from slices, so no group is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.operators.contracts import ContractError
from zephyrgrid.operators.ordering import numbered


def time_split(df: DataFrame, keys: list[str], order: list[str], test_ratio: float = K.TEST_RATIO,
               slice_by: Column | None = None) -> DataFrame:
    """``split`` is train for the first floor(n * (1 - ratio)) rows of a key, else valid."""
    placed = numbered(df, keys, order, slice_by, position="_pos", total="_n")
    cut = F.floor(F.col("_n") * F.lit(1.0 - test_ratio))
    return placed.withColumn("split", F.when(F.col("_pos") <= cut, "train").otherwise("valid")).drop("_pos", "_n")


def tune_audit(df: DataFrame, keys: list[str], order: list[str], ratio: float = K.TUNE_RATIO,
               min_audit: int = K.AUDIT_MINIMUM, slice_by: Column | None = None) -> DataFrame:
    """``half`` is tune or audit; a key with too short an audit half is an error."""
    placed = numbered(df, keys, order, slice_by, position="_pos", total="_n")
    n = F.col("_n")
    cut = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(ratio))))
    marked = placed.withColumn("half", F.when(F.col("_pos") <= cut, "tune").otherwise("audit"))
    if min_audit:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        m = F.col("n")
        short = sizes.filter(m - F.greatest(F.lit(1), F.least(m - 1, F.floor(m * F.lit(ratio)))) < min_audit)
        found = short.limit(5).collect()
        if found:
            raise ContractError(f"audit half too short: {found}")
    return marked.drop("_pos", "_n")


def warmup_trim(df: DataFrame, keys: list[str], order: list[str], rows: int = K.SEQUENCE_LENGTH,
                slice_by: Column | None = None) -> DataFrame:
    return numbered(df, keys, order, slice_by, position="_pos").filter(F.col("_pos") > rows).drop("_pos")


def fold_number(ts: str, origin: str, months: int = 3) -> Column:
    """The window of ``months`` that a stamp falls into, counted from ``origin``; negative before it."""
    start = F.lit(origin).cast("timestamp_ntz")
    elapsed = (F.year(ts) - F.year(start)) * 12 + F.month(ts) - F.month(start)
    return F.floor(elapsed / F.lit(months))


def fold_rows(df: DataFrame, ts: str, origin: str, months: int = 3, folds: int | None = None) -> DataFrame:
    """Each row with every ``fold`` it belongs to, and its ``side``: valid in the window it falls into, train in all later ones.

    Validation windows begin at ``origin``; rows before it train in every fold. A row is repeated once per fold, of which there
    are as many as windows with rows, or ``folds``: the folds are named by one aggregation and a row meets those whose window is not
    before its own.
    """
    numbered_rows = df.withColumn("_own", fold_number(ts, origin, months))
    known = numbered_rows.filter("_own >= 0").groupBy("_own").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(r["_own"] for r in known.collect())[:folds]  # one row per window of months
    names = F.lit(found) if found else F.array().cast("array<bigint>")
    later = F.filter(names, lambda f: f >= F.col("_own"))
    return (numbered_rows.withColumn("fold", F.explode(later))
            .withColumn("side", F.when(F.col("fold") == F.col("_own"), "valid").otherwise("train")).drop("_own"))


def rolling_folds(df: DataFrame, ts: str, value: str, origin: str, months: int = 3,
                  keys: list[str] = ()) -> DataFrame:
    """Per fold of ``months``: rows and mean of the window and of everything before it.

    Each row falls into one window; the train side is a running sum over the few windows, so
    rows are not repeated for every later fold.
    """
    keys = list(keys)
    windows = df.withColumn("fold", fold_number(ts, origin, months)).groupBy(*keys, "fold").agg(
        F.count(F.lit(1)).alias("n_valid"), F.count(value).alias("_c"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return windows.select(
        *keys, "fold", "n_valid", F.try_divide("_s", "_c").alias("valid_mean"),
        F.coalesce(F.sum("n_valid").over(earlier), F.lit(0)).alias("n_train"),
        F.try_divide(F.sum("_s").over(earlier), F.sum("_c").over(earlier)).alias("train_mean"),
    ).filter(F.col("n_train") > 0)


def fold_report(folds: DataFrame, score: str, keys: list[str] = ()) -> DataFrame:
    return folds.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), F.avg(score).alias("fold_mean"),
                                    F.stddev_samp(score).alias("fold_std"))
