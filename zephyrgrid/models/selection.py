"""Feature selection. Spark does the passes over rows; what comes back is one value per feature
or per pair of features, and the greedy walks run on that small table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrgrid.operators import stats
from zephyrgrid.operators.ordering import average_ranks, exact_quantiles, long_form, numbered
from zephyrgrid.session import stable


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> np.ndarray:
    """The matrix of a few hundred features, from one distributed pass."""
    return Correlation.corr(assemble(df.select(*columns), columns, "_v"), "_v", method).first()[0].toArray()


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    matrix = correlation(df, columns)
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Keep a column unless it is too close to any earlier one, dropped or not."""
    r = np.abs(correlation(df, columns))
    return [c for j, c in enumerate(columns) if not (r[:j, j] > threshold).any()]


def ranked_selection(df: DataFrame, importance: dict[str, float], noise: dict[str, float] | None = None,
                     noise_floor: float = -math.inf, threshold: float = 0.95,
                     cumulative: float = 1.0) -> list[tuple[str, float, str]]:
    """(feature, importance, decision) by noise floor, closeness to a kept feature and share.

    Features are met in the order of importance; only kept ones can make a later one redundant.
    """
    known = noise or importance
    alive = [c for c in importance if known.get(c, 0.0) > noise_floor]
    place = {c: i for i, c in enumerate(alive)}
    r = np.abs(correlation(df, alive)) if alive else np.zeros((0, 0))
    kept: list[str] = []
    reason = {c: "noise" for c in importance if c not in place}
    # equal to twelve places is a tie, which goes by name
    for c in sorted(alive, key=lambda x: (-round(importance[x], 12), x)):
        twin = next((k for k in kept if r[place[c], place[k]] > threshold), None)
        if twin is None:
            kept.append(c)
        else:
            reason[c] = f"duplicate({twin})"
    if cumulative < 1.0 and kept:
        share = np.cumsum([importance[c] for c in kept]) / sum(importance[c] for c in kept)
        last = int((share < cumulative).sum()) + 1
        reason.update({c: "tail" for c in kept[last:]})
    report = [(c, float(v), reason.get(c, "selected")) for c, v in importance.items()]
    return sorted(report, key=lambda x: (-x[1], x[0]))


def top_features(importance: dict[str, float], keep_ratio: float = 0.35, minimum: int = 8) -> list[str]:
    keep = min(len(importance), max(minimum, math.ceil(len(importance) * keep_ratio)))
    return sorted(importance, key=lambda c: (-importance[c], c))[:keep]


def population_params(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


class PrincipalParts:
    """Standardised features compressed to the components that keep a share of the variance."""

    def __init__(self, variance: float = 0.95):
        self.variance = variance

    def fit(self, df: DataFrame, columns: list[str]) -> PrincipalParts:
        self.columns, self.params = columns, population_params(df, columns)
        scaled = assemble(stats.standardise(df, self.params), columns, "_x")
        self.model = PCA(k=len(columns), inputCol="_x", outputCol="_pc").fit(scaled)
        self.ratios = self.model.explainedVariance.toArray()
        self.count = min(len(columns), int(np.searchsorted(np.cumsum(self.ratios), self.variance, side="right")) + 1)
        self.names = [f"pca_{i + 1:03d}" for i in range(self.count)]
        return self

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scaled = assemble(stats.standardise(df, self.params), self.columns, "_x")
        parts = self.model.transform(scaled).withColumn("_a", vector_to_array("_pc"))
        return parts.select(*keep, *[F.col("_a")[i].alias(n) for i, n in enumerate(self.names)])


def shuffled_partner(df: DataFrame, columns: list[str], identity: list[str], seed: int = 42, keys: list[str] = ()) -> DataFrame:
    """Each row with the columns of another row of its key, as ``other``: a shift by half in random order.

    Positions come from hash slices and are unique, so the self-join has no heavy key and all
    features share it.
    """
    keys = list(keys)
    digest = F.xxhash64(*[F.col(c) for c in identity], F.lit(seed))
    mixed = df.withColumn("_h", digest)
    placed = stable(numbered(mixed, keys, ["_h", *identity], F.shiftright("_h", 50), position="_p", total="_t").drop("_h"))
    half = F.floor(F.col("_t") / 2)
    other = placed.select(*keys, ((F.col("_p") + half - 1) % F.col("_t") + 1).alias("_p"),
                          F.struct(*columns).alias("other"))
    return placed.join(other, [*keys, "_p"]).drop("_p", "_t")


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """(column, relevance) from counts in equal-width bins; rows are reduced to bins² counts."""
    ends = stats.as_dict(stats.minmax_params(df, [*columns, target]))

    def binned(c):
        low, high = ends[c]
        return F.least(F.floor((F.col(c) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), binned(c).alias("x")) for c in columns])
    joint = df.select(binned(target).alias("y"), F.inline(cells)).groupBy("column", "x", "y").agg(
        F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    over = lambda *k: F.sum("n").over(Window.partitionBy("column", *k))
    term = F.col("n") / F.col("_t") * F.ln(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y")))
    return (joint.withColumns({"_t": over(), "_x": over("x"), "_y": over("y")})
            .groupBy("column").agg(F.sum(term).alias("relevance")))


def mrmr(df: DataFrame, columns: list[str], target: str, count: int, bins: int = 10) -> list[tuple[str, float, float]]:
    """Greedy picks (feature, relevance, score) of relevance minus mean closeness to the picked."""
    relevance = {r["column"]: float(r["relevance"]) for r in mutual_information(df, columns, target, bins).collect()}
    r = np.abs(correlation(df, columns))
    place = {c: i for i, c in enumerate(columns)}
    picked: list[tuple[str, float, float]] = []
    while len(picked) < min(count, len(columns)):
        chosen = [place[c] for c, _, _ in picked]
        rest = [c for c in columns if place[c] not in chosen]
        score = lambda c: relevance[c] - (r[place[c], chosen].mean() if chosen else 0.0)
        best = min(rest, key=lambda c: (-round(score(c), 12), c))
        picked.append((best, relevance[best], float(score(best))))
    return picked


def relevance_is_flat(relevance: dict[str, float], tolerance: float = 1e-6) -> bool:
    return max(relevance.values()) - min(relevance.values()) <= tolerance


def spearman(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, spearman): the correlation of average ranks with those of the target, over rows that have both.

    Rows are counted per pair of values first; ranks come from the counted values and meet these counts.
    """
    cells = long_form(df, columns, [F.col(target).cast("double").alias("_y")], "column", "_x").dropna(subset=["_x", "_y"])
    pairs = stable(cells.groupBy("column", "_x", "_y").agg(F.count(F.lit(1)).alias("_c")))
    side = lambda v, out: average_ranks(pairs.groupBy("column", v).agg(F.sum("_c").alias("_n")), ["column"], v, "_n").select(
        "column", v, (F.col("rank") - (F.col("n") + 1) / 2.0).alias(out))
    both = pairs.join(side("_x", "_rx"), ["column", "_x"]).join(side("_y", "_ry"), ["column", "_y"])
    total = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_c"))
    return both.groupBy("column").agg(
        F.try_divide(total("_rx", "_ry"), F.sqrt(total("_rx", "_rx") * total("_ry", "_ry"))).alias("spearman"))


def normality_checks(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Fit, moments, outliers and rank correlation per column, with advice on the kind of correlation."""
    cells = long_form(df, columns, [target], "column", "value").filter(F.col("value").isNotNull())
    moments = cells.groupBy("column").agg(
        F.count("value").alias("n"), F.regr_r2(F.col(target), F.col("value")).alias("r2"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))
    quart = exact_quantiles(cells.select("column", "value"), ["column"], "value", [0.25, 0.75])
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("quantile")))
    fences = quart.groupBy("column").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = F.col("q3") - F.col("q1")
    outside = (F.col("value") < F.col("q1") - wide * 1.5) | (F.col("value") > F.col("q3") + wide * 1.5)
    # one row of fences per column
    marked = cells.join(F.broadcast(fences), "column").groupBy("column").agg(
        F.sum(outside.cast("bigint")).alias("outliers"), F.first("q1").alias("q1"), F.first("q3").alias("q3"))
    joined = moments.join(marked, "column").join(F.broadcast(spearman(df, columns, target)), "column", "left")  # one row per column
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    normal = (F.col("jarque_bera") < 5.991) & (F.col("outliers") == 0)
    return joined.withColumn("jarque_bera", jb).withColumn(
        "advice", F.when(normal, "pearson").otherwise("spearman"))
