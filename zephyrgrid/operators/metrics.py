"""Settlement metrics: error, settlement share, leaderboards and error bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S


def nmae(pred, actual, capacity) -> Column:
    return F.avg(S.error_ratio(pred, actual, capacity))


def ficr(pred, actual, capacity, hours: float = 1.0) -> Column:
    """Earned over possible settlement; 0 when nothing could be earned."""
    energy = S.as_col(actual) * hours
    earned = F.sum(S.unit_price(S.error_ratio(pred, actual, capacity)) * energy)
    return share_of_maximum(earned, F.sum(energy * 4.0))


def share_of_maximum(earned: Column, possible: Column) -> Column:
    return F.when(possible > 0, earned / possible).otherwise(0.0)


def score_of(nmae_value, ficr_value) -> Column:
    return (F.lit(1.0) - S.as_col(nmae_value)) * 0.5 + S.as_col(ficr_value) * 0.5


def group_summary(df: DataFrame, keys: list[str], pred: str = "pred", actual: str = "actual",
                  capacity: str = "capacity") -> DataFrame:
    """nmae, ficr, score, mae and rmse per key in one pass with map-side sums."""
    gap = F.col(pred) - F.col(actual)
    return df.groupBy(*keys).agg(
        nmae(pred, actual, capacity).alias("nmae"), ficr(pred, actual, capacity).alias("ficr"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
    ).withColumn("score", score_of("nmae", "ficr"))


def total_score(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Official score: the means over groups are taken first, then combined."""
    return summary.groupBy(*keys).agg(
        F.avg("nmae").alias("mean_nmae"), F.avg("ficr").alias("mean_ficr"),
    ).withColumn("official_score", score_of("mean_nmae", "mean_ficr"))


def leaderboard(results: DataFrame, model: str = "model_name") -> DataFrame:
    return results.groupBy(model).agg(
        F.avg("nmae").alias("mean_nmae"), F.avg("ficr").alias("mean_ficr"), F.avg("mae").alias("mean_mae"),
        F.avg("rmse").alias("mean_rmse"), F.avg("n_features").alias("mean_features"),
        F.count_distinct("group").alias("groups"),
    ).withColumn("official_score", score_of("mean_nmae", "mean_ficr"))


def ranked_leaderboard(board: DataFrame, score: str = "official_score", name: str = "model_name") -> DataFrame:
    """Rank by score; the board has one row per model, so one small sort."""
    from pyspark.sql import Window
    order = Window.orderBy(F.col(score).desc(), F.col(name))
    return board.withColumn("rank", F.row_number().over(order))


def soft_score_loss(df: DataFrame, keys: list[str], pred: str = "pred", actual: str = "actual",
                    capacity: str = "capacity", steepness: float = K.SOFT_STEEPNESS,
                    nmae_weight: float = 0.5) -> DataFrame:
    ratio = S.error_ratio(pred, actual, capacity)
    a = F.col(actual)
    soft = F.sum(S.soft_price(ratio, steepness) * a) / (F.sum(a) + K.TINY) / 4.0
    return df.groupBy(*keys).agg(
        (F.avg(ratio) * nmae_weight + (F.lit(1.0) - soft) * (1 - nmae_weight)).alias("soft_loss"))


def variant_summary(results: DataFrame) -> DataFrame:
    """Means by (model, features), by model alone and by features alone in one aggregation."""
    sets = results.groupingSets(
        [["model_version", "feature_version"], ["model_version"], ["feature_version"]],
        "model_version", "feature_version")
    return sets.agg(F.avg("nmae").alias("mean_nmae"), F.avg("ficr").alias("mean_ficr"),
                    F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("runs"))


def _band(name: str, condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0)).alias(name)


def error_bands(df: DataFrame, keys: list[str], pred: str = "pred", actual: str = "actual",
                capacity: str = "capacity") -> DataFrame:
    r = S.error_ratio(pred, actual, capacity)
    return df.filter(r.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"), _band("share_le6", r <= 0.06),
        _band("share_6_8", (r > 0.06) & (r <= 0.08)), _band("share_gt8", r > 0.08))


def recommended_action(high="share_gt8", middle="share_6_8", dominance: float = 1.5,
                       floor: float = 0.15, middle_floor: float = 0.10) -> Column:
    high, middle = S.as_col(high), S.as_col(middle)
    retrain = (high >= floor) | ((middle > 0) & (high >= middle * dominance))
    return F.when(retrain, "retrain").when(middle >= middle_floor, "calibrate").otherwise("keep")


def diurnal_bands(df: DataFrame, keys: list[str], hour: str, **columns) -> DataFrame:
    return error_bands(df.withColumn("hour_bucket", S.hour_bucket(hour)), [*keys, "hour_bucket"], **columns)


def diurnal_imbalance(bands: DataFrame, keys: list[str], threshold: float = 1.5) -> DataFrame:
    mean = F.avg("share_gt8")
    ratio = F.when(mean > 0, F.max("share_gt8") / mean).otherwise(1.0)
    return (bands.groupBy(*keys).agg(ratio.alias("imbalance"))
            .withColumn("uneven", F.col("imbalance") >= threshold))


def baseline_gap(results: DataFrame, baseline: DataFrame, oracle: str = K.ORACLE_MODEL) -> DataFrame:
    """Best score per group without the oracle model, minus the earlier baseline."""
    best = results.filter(F.col("model_name") != oracle).groupBy("group").agg(F.max("score").alias("best_score"))
    return best.join(baseline, "group").withColumn("gap", F.col("best_score") - F.col("baseline_score"))
