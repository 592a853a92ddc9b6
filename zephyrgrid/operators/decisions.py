"""Searches on stored predictions: calibration, blending and the final choice.

All candidates of a search are sums over the same rows. A row is repeated for the 21 slopes
only; the 21 offsets are columns of one aggregation, so a task keeps 21 rows of sums per key
and the shuffle does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid import constants as K
from zephyrgrid.functions import scalars as S
from zephyrgrid.operators import metrics as M
from zephyrgrid.operators.contracts import clip_between
from zephyrgrid.session import attach, stable


def even_steps(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


SLOPES = even_steps(*K.SLOPE_RANGE, K.CALIBRATION_STEPS)
OFFSETS = even_steps(*K.OFFSET_RANGE, K.CALIBRATION_STEPS)
WEIGHTS = [i * 0.05 for i in range(K.BLEND_STEPS)]


def _tied(score: Column) -> Column:
    # sums in another order differ in the last bits; equal to 10 places is a tie
    return F.round(score, 10)


def _candidate_sums(candidates: list[Column], actual: Column, capacity: Column) -> list[Column]:
    made = []
    for i, c in enumerate(candidates):
        ratio = F.abs(c - actual) / capacity
        made += [F.sum(ratio).alias(f"_e{i}"), F.sum(S.unit_price(ratio) * actual).alias(f"_s{i}")]
    return made


def _candidate_rows(possible: Column, values: list[float], name: str) -> Column:
    rows = []
    for i, v in enumerate(values):
        share = M.share_of_maximum(F.col(f"_s{i}"), possible)
        rows.append(F.struct(F.lit(i).alias(f"_{name}"), F.lit(v).alias(name),
                             (F.col(f"_e{i}") / F.col("_n")).alias("nmae"), share.alias("ficr")))
    return F.array(*rows)


def search_sums(df: DataFrame, keys: list[str], pred: str = "pred", actual: str = "actual",
                capacity: str = "capacity") -> DataFrame:
    """Sums of every (slope, offset) candidate per key: one row per key and slope, to be added up over coarser keys."""
    slopes = F.array(*[F.struct(F.lit(i).alias("_a"), F.lit(v).alias("a")) for i, v in enumerate(SLOPES)])
    p, y, cap = F.col(pred), F.col(actual), F.col(capacity)
    rows = df.select(*keys, p.alias("_p"), y.alias("_y"), cap.alias("_cap"), F.inline(slopes))
    line = F.col("a") * F.col("_p")
    clipped = [clip_between(line + F.col("_cap") * b, 0.0, F.col("_cap")) for b in OFFSETS]
    return rows.groupBy(*keys, "_a", "a").agg(
        F.sum(F.col("_y") * 4.0).alias("_possible"), F.first("_cap").alias("_cap"), F.count(F.lit(1)).alias("n"),
        F.count(F.col("_p") - F.col("_y")).alias("_n"),
        *_candidate_sums(clipped, F.col("_y"), F.col("_cap")))


def best_line(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b_ratio, b_kw, nmae, ficr, score, n) of the best candidate, from sums of these or finer keys."""
    add = ["_possible", "n", "_n", *[f"_{x}{i}" for i in range(len(OFFSETS)) for x in "es"]]
    whole = sums.groupBy(*keys, "_a", "a").agg(F.first("_cap").alias("_cap"), *[F.sum(c).alias(c) for c in add])
    scored = whole.select(*keys, "_a", "a", "_cap", "n",
                          F.inline(_candidate_rows(F.col("_possible"), OFFSETS, "b_ratio")))
    scored = scored.withColumn("score", M.score_of("nmae", "ficr"))
    best = F.max_by(F.struct("a", "b_ratio", (F.col("b_ratio") * F.col("_cap")).alias("b_kw"), "nmae", "ficr",
                             "score", "n"),
                    F.struct(_tied(F.col("score")), -F.col("_a"), -F.col("_b_ratio")))
    return scored.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def fit_affine(df: DataFrame, keys: list[str], pred: str = "pred", actual: str = "actual",
               capacity: str = "capacity") -> DataFrame:
    """(keys, a, b_ratio, b_kw, nmae, ficr, score) of the best clip(a * pred + b, 0, capacity).

    Equal scores go to the smallest slope, then the smallest offset.
    """
    return best_line(search_sums(df, keys, pred, actual, capacity), keys)


def fit_diurnal(df: DataFrame, keys: list[str], hour: str, minimum: int = K.AUDIT_MINIMUM, **columns) -> DataFrame:
    """One calibration per hour bucket; ``few_rows`` warns of a thin bucket."""
    fitted = fit_affine(df.withColumn("hour_bucket", S.hour_bucket(hour)), [*keys, "hour_bucket"], **columns)
    return fitted.withColumn("few_rows", F.col("n") < minimum)


def calibrations(df: DataFrame, keys: list[str], hour: str, minimum: int = K.AUDIT_MINIMUM, **columns) -> tuple[DataFrame, DataFrame]:
    """The calibration per key and that per key and hour bucket, from one search over the rows."""
    sums = stable(search_sums(df.withColumn("hour_bucket", S.hour_bucket(hour)), [*keys, "hour_bucket"], **columns))
    hourly = best_line(sums, [*keys, "hour_bucket"]).withColumn("few_rows", F.col("n") < minimum)
    return stable(best_line(sums, keys)), stable(hourly)


def apply_calibration(df: DataFrame, params: DataFrame, on: list[str], pred: str = "pred",
                      capacity: str = "capacity", out: str = "pred_calibrated") -> DataFrame:
    """Use stored (a, b_ratio); rows without parameters keep their prediction, clipped."""
    joined = attach(df, params.select(*on, "a", "b_ratio"), on, "left")
    cap = F.col(capacity)
    line = F.coalesce(F.col("a"), F.lit(1.0)) * F.col(pred) + F.coalesce(F.col("b_ratio"), F.lit(0.0)) * cap
    return joined.withColumn(out, clip_between(line, 0.0, cap)).drop("a", "b_ratio")


def calibration_audit(halves: DataFrame, keys: list[str], hour: str | None = None) -> DataFrame:
    """Fit on the tune half, score raw and calibrated on the audit half, keep the better."""
    tune = halves.filter(F.col("half") == "tune")
    audit = halves.filter(F.col("half") == "audit")
    if hour:
        audit = audit.withColumn("hour_bucket", S.hour_bucket(hour))
        params, on = fit_diurnal(tune, keys, hour), [*keys, "hour_bucket"]
    else:
        params, on = fit_affine(tune, keys), keys
    # the search is run once, its few rows are then counted and joined
    scored = apply_calibration(audit, stable(params), on)
    p, c, y, cap = "pred", "pred_calibrated", "actual", "capacity"
    out = scored.groupBy(*keys).agg(
        M.score_of(M.nmae(p, y, cap), M.ficr(p, y, cap)).alias("score_before"),
        M.score_of(M.nmae(c, y, cap), M.ficr(c, y, cap)).alias("score_after"),
        M.ficr(p, y, cap).alias("ficr_before"), M.ficr(c, y, cap).alias("ficr_after"))
    better = _tied(F.col("score_after")) > _tied(F.col("score_before"))
    return out.withColumns({"use_calibrated": better,
                            "best_score": F.greatest("score_before", "score_after")})


def calibrated_rows(rows: DataFrame, keys: list[str], flat: DataFrame, hourly: DataFrame, hour: str) -> DataFrame:
    """Rows with ``pred_flat`` and ``pred_by_hour`` beside the raw prediction."""
    rows = apply_calibration(rows.withColumn("hour_bucket", S.hour_bucket(hour)), flat, keys, out="pred_flat")
    return apply_calibration(rows, hourly, [*keys, "hour_bucket"], out="pred_by_hour")


def candidate_audit(audit: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the raw and both calibrated predictions of the audit rows, and the kind that is best.

    The calibration by hour replaces the flat one only where it is better, and a calibration the raw prediction likewise.
    """
    score = lambda p: M.score_of(M.nmae(p, "actual", "capacity"), M.ficr(p, "actual", "capacity"))
    out = audit.groupBy(*keys).agg(score("pred").alias("score_raw"), score("pred_flat").alias("score_flat"),
                                   score("pred_by_hour").alias("score_by_hour"))
    by_hour = _tied(F.col("score_by_hour")) > _tied(F.col("score_flat"))
    out = out.withColumn("score_calibrated", F.when(by_hour, F.col("score_by_hour")).otherwise(F.col("score_flat")))
    better = _tied(F.col("score_calibrated")) > _tied(F.col("score_raw"))
    return out.withColumns({
        "kind": F.when(better & by_hour, "by_hour").when(better, "calibrated").otherwise("raw"),
        "best_score": F.when(better, F.col("score_calibrated")).otherwise(F.col("score_raw"))})


def best_prediction() -> Column:
    """The prediction of the kind that the audit chose."""
    return F.when(F.col("kind") == "by_hour", F.col("pred_by_hour")).when(F.col("kind") == "calibrated", F.col("pred_flat")).otherwise(F.col("pred"))


def best_pairs(candidates: DataFrame, baseline: DataFrame, group: str = "group", model: str = "model_name") -> DataFrame:
    """(group, a, b, solo_best): the two best candidates of each group that beat its ``baseline_score``, if there are two."""
    able = candidates.join(F.broadcast(baseline.select(group, "baseline_score")), group).filter(
        _tied(F.col("best_score")) > _tied(F.col("baseline_score")))
    # one row per model of a group
    order = F.sort_array(F.collect_list(F.struct((-_tied(F.col("best_score"))).alias("s"), F.col(model).alias("m"), F.col("best_score").alias("best"))))
    return able.groupBy(group).agg(order.alias("_o")).filter(F.size("_o") >= 2).select(
        group, F.col("_o")[0]["m"].alias("a"), F.col("_o")[1]["m"].alias("b"), F.col("_o")[0]["best"].alias("solo_best"))


def chosen_pairs(rows: DataFrame, pairs: DataFrame, on: list[str], group: str = "group", model: str = "model_name") -> DataFrame:
    """The best predictions of a group's pair side by side, with the half of each row, by one aggregation.

    ``rows`` hold (on, group, model, pred_best, actual, capacity, half); a pair of one group per row of ``pairs``.
    """
    named = rows.join(F.broadcast(pairs.select(group, "a", "b")), group).filter((F.col(model) == F.col("a")) | (F.col(model) == F.col("b")))
    pick = lambda m: F.max(F.when(F.col(model) == F.col(m), F.col("pred_best")))
    return named.groupBy(group, *on).agg(pick("a").alias("pred_a"), pick("b").alias("pred_b"), F.first("actual").alias("actual"),
                                         F.first("capacity").alias("capacity"), F.first("half").alias("half")).dropna(subset=["pred_a", "pred_b"])


def blend_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Score of w * a + (1 - w) * b for all weights in one pass, no row is repeated."""
    y, cap = F.col("actual"), F.col("capacity")
    mixes = [F.col("pred_a") * w + F.col("pred_b") * (1 - w) for w in WEIGHTS]
    sums = pairs.groupBy(*keys).agg(F.sum(y * 4.0).alias("_possible"), F.count(y).alias("_n"), *_candidate_sums(mixes, y, cap))
    rows = sums.select(*keys, F.inline(_candidate_rows(F.col("_possible"), WEIGHTS, "w")))
    return rows.withColumn("score", M.score_of("nmae", "ficr"))


def fit_blend(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The best weight (the smallest on ties), the better of both alone, and whether to adopt."""
    rows = blend_scores(pairs, keys)
    best = F.max_by(F.struct("w", "score"), F.struct(_tied(F.col("score")), -F.col("_w")))
    solo = F.max(F.when((F.col("_w") == 0) | (F.col("_w") == len(WEIGHTS) - 1), F.col("score")))
    out = rows.groupBy(*keys).agg(best.alias("_b"), solo.alias("solo_best"))
    return out.select(*keys, "_b.w", F.col("_b.score").alias("ensemble_score"), "solo_best",
                      (_tied(F.col("_b.score")) > _tied(F.col("solo_best"))).alias("adopt"))


def audited_blend(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The weight is fitted on the tune half and judged on the audit half."""
    tune = fit_blend(pairs.filter(F.col("half") == "tune"), keys).select(*keys, "w")
    audit = blend_scores(pairs.filter(F.col("half") == "audit"), keys)
    solo = audit.filter(F.col("_w").isin(0, len(WEIGHTS) - 1)).groupBy(*keys).agg(F.max("score").alias("solo_best"))
    return (audit.join(tune, [*keys, "w"]).join(solo, keys)
            .select(*keys, "w", F.col("score").alias("ensemble_score"), "solo_best",
                    (_tied(F.col("score")) > _tied(F.col("solo_best"))).alias("adopt")))


def final_choice(candidates: DataFrame, ensembles: DataFrame, originals: DataFrame) -> DataFrame:
    """Per group: raw, calibrated (flat or by hour) or ensemble, whichever scores best; else the original model.

    candidates: group, model_name, kind, best_score. ensembles: group, label, ensemble_score, adopt. originals: group,
    original_name, original_score, baseline_score.
    """
    solo = candidates.select("group", "model_name", "kind", F.col("best_score").alias("score"), F.lit(0).alias("_late"))
    blends = ensembles.filter("adopt").select(
        "group", F.col("label").alias("model_name"), F.lit("ensemble").alias("kind"),
        F.col("ensemble_score").alias("score"), F.lit(1).alias("_late"))
    top = solo.unionByName(blends).groupBy("group").agg(F.min_by(
        F.struct("model_name", "kind", "score"),
        F.struct(-_tied(F.col("score")), F.col("_late"), F.col("model_name"))).alias("_t"))
    both = originals.join(top, "group", "left")
    wins = S.known(_tied(F.col("_t.score")) > _tied(F.col("baseline_score")))
    pick = lambda new, old: F.when(wins, F.col(new)).otherwise(old)
    return both.select("group", pick("_t.model_name", F.col("original_name")).alias("model_name"),
                       pick("_t.kind", F.lit("raw")).alias("kind"),
                       pick("_t.score", F.col("original_score")).alias("score"))


def decide(rows: DataFrame, keys: list[str], on: list[str], hour: str, earlier: DataFrame | None = None,
           params: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, blends, choice) for the stored predictions of all models, ``rows`` with their ``half``.

    ``keys`` are group and model, ``on`` names a row of a group. The best model of ``earlier`` results (group, model, score), by default of
    the raw scores over all rows, is the original of its group; its raw score on the audit half is the baseline that a decision has to beat.
    ``params`` are the results of :func:`calibrations`, where they are known already.
    """
    group, model = keys
    flat, hourly = params or calibrations(rows.filter("half = 'tune'"), keys, hour)
    ready = stable(calibrated_rows(rows, keys, flat, hourly, hour))
    candidates = stable(candidate_audit(ready.filter("half = 'audit'"), keys))
    whole = M.group_summary(rows, keys) if earlier is None else earlier
    first = whole.groupBy(group).agg(F.min_by(
        F.struct(F.col(model).alias("original_name"), F.col("score").alias("original_score")),
        F.struct(-_tied(F.col("score")), F.col(model))).alias("_o")).select(group, "_o.*")
    baseline = stable(first.join(candidates.select(group, F.col(model).alias("original_name"), F.col("score_raw").alias("baseline_score")),
                                 [group, "original_name"]))
    pairs = stable(best_pairs(candidates, baseline, group, model))
    best = ready.join(F.broadcast(candidates.select(*keys, "kind")), keys).withColumn("pred_best", best_prediction())
    blends = audited_blend(stable(chosen_pairs(best, pairs, on, group, model)), [group]).drop("solo_best", "adopt")
    blends = stable(blends.join(F.broadcast(pairs), group).withColumns({
        "label": F.concat("a", F.lit("+"), "b"), "adopt": _tied(F.col("ensemble_score")) > _tied(F.col("solo_best"))}))
    return candidates, blends, final_choice(candidates, blends, baseline)


def pick_calibrated(df: DataFrame, audited: DataFrame, on: list[str], raw: str = "pred",
                    calibrated: str = "pred_calibrated", out: str = "pred_final") -> DataFrame:
    """The calibrated prediction where the audit chose it, else the raw one."""
    joined = attach(df, audited.select(*on, "use_calibrated"), on, "left")
    return joined.withColumn(out, F.when(S.known(F.col("use_calibrated")), F.col(calibrated)).otherwise(
        F.col(raw))).drop("use_calibrated")
