"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Twenty statistics of a whole text are standardised and mapped to random cosines, whose inner products
approximate a Gaussian kernel. Every partition of the training rows adds up its normal equations; the sums give
ridge weights. An isotonic fit on labelled rows that the weights have not seen turns scores into shares.

Defined cases: a null text is an empty text and gets a score like any other; a label counts once per id
(the greatest of several), null labels and ids do not count. Without labels every score is 0.5. Training
uses a sample of at most about ``TRAIN_ROWS`` labelled rows, drawn by the hash of the id.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zephyrgrid.llm.bitmap import in_bitmap
from zephyrgrid.llm.langid import held_out, remainder
from zephyrgrid.llm.texts import map_texts
from zephyrgrid.session import stable

TRAIN_ROWS = 200_000
COSINES = 320
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 3.0
ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
STATISTICS = ("log_chars", "log_words", "word_length", "word_spread", "letters", "digits", "marks", "upper", "spaces",
              "distinct", "repeats", "pairs", "log_lines", "line_copies", "line_length", "odd_words", "odd_chars",
              "short_words", "squeezed", "entropy")


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split("\n")
    n, w = len(text), max(1, len(words))
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / len(raw)
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    odd = ODD.findall(text)
    odd_words = sum(1 for x in words if ODD.search(x)) if odd else 0
    ascii_letters = counts[65:91].sum() + counts[97:123].sum()
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(),
        (ascii_letters + counts[192:].sum()) / n, counts[48:58].sum() / n,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / n,
        counts[65:91].sum() / n, (counts[9:14].sum() + counts[32]) / n,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        odd_words / w, len(odd) / n, float((sizes <= 3).mean()),
        len(zlib.compress(raw, 1)) / len(raw), float(-(share * np.log2(share)).sum())]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the array ``_llm_stats`` of a text's statistics."""
    return map_texts(docs, keep, "_llm_stats array<double>", lambda: lambda texts: [[statistics(t) for t in texts]])


@dataclass
class Kernel:
    """Standardisation, random cosines and ridge weights; then the steps of the calibration."""

    centre: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: tuple = ((0.0, 1.0), (0.0, 1.0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.spread, -6, 6)
        return np.c_[np.ones(len(z)), np.cos(z @ self.waves + self.shifts) * np.sqrt(2 / len(self.shifts))]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated shares; a fiftieth of the raw score keeps an order within the steps."""
        raw = self.raw(stats)
        return np.clip(0.98 * np.interp(raw, *self.steps) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), len(STATISTICS))


def fit(rows: DataFrame, most: int = TRAIN_ROWS) -> Kernel | float:
    """A calibrated scorer from (doc_id, _llm_stats, quality); a constant where only one label, or none, is there.

    A fifth of the rows, by the hash of the id, is kept for the calibration.
    """
    n = rows.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, most / max(1, n)))
    # at most about ``most`` rows of twenty numbers, in a fixed number of partitions
    train = stable(rows.filter(drawn).repartition(8, "doc_id"))
    base = train.agg(F.avg("quality").alias("m"), F.count(F.lit(1)).alias("n"),
                     *[F.avg(F.col("_llm_stats")[i]).alias(f"a{i}") for i in range(len(STATISTICS))],
                     *[F.stddev_pop(F.col("_llm_stats")[i]).alias(f"s{i}") for i in range(len(STATISTICS))]).first()
    if not base.n or base.m in (0.0, 1.0):
        return 0.5 if base.m is None else float(base.m)
    random = np.random.default_rng(11)
    size = len(STATISTICS)
    spread = np.array([base[f"s{i}"] for i in range(size)])
    kernel = Kernel(np.array([base[f"a{i}"] for i in range(size)]), np.where(spread > 1e-9, spread, 1.0),
                    random.normal(0, 1 / WIDTH, (size, COSINES)), random.uniform(0, 2 * np.pi, COSINES), None)
    apart = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0

    def equations(batches):
        left, right = np.zeros((COSINES + 1, COSINES + 1)), np.zeros(COSINES + 1)
        for pdf in batches:
            z = kernel.features(_matrix(pdf["_llm_stats"]))
            left += z.T @ z
            right += z.T @ pdf["quality"].to_numpy(float)
        yield pd.DataFrame({"left": [left.tobytes()], "right": [right.tobytes()]})

    parts = train.filter(~apart).select("_llm_stats", "quality").mapInPandas(equations, "left binary, right binary").collect()
    left = sum(np.frombuffer(p.left) for p in parts).reshape(COSINES + 1, COSINES + 1)
    kernel.weights = np.linalg.solve(left + RIDGE * np.eye(COSINES + 1), sum(np.frombuffer(p.right) for p in parts))

    def raw(batches):
        for pdf in batches:
            yield pd.DataFrame({"raw": kernel.raw(_matrix(pdf["_llm_stats"])), "label": pdf["quality"].astype(float)})

    seen = train.filter(apart).select("_llm_stats", "quality").mapInPandas(raw, "raw double, label double")
    if not seen.head(1):
        return kernel
    model = IsotonicRegression(featuresCol="raw", labelCol="label").fit(seen)
    kernel.steps = (model.boundaries.toArray(), model.predictions.toArray())
    return kernel


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, _llm_stats, quality) of the rows that may be learned from."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder(F.col("doc_id"), 5) != 0)
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    return stats.select("doc_id", "_llm_stats").join(known, "doc_id")


def scored(stats: DataFrame, model: Kernel | float, name: str = "score") -> DataFrame:
    """The rows with a score in place of the statistics."""
    if isinstance(model, float):
        return stats.drop("_llm_stats").withColumn(name, F.lit(model))
    shared = stats.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in stats.columns if c != "_llm_stats"]

    def score(batches):
        for batch in batches:
            values = batch.column("_llm_stats").flatten().to_numpy(zero_copy_only=False)
            made = shared.value.score(values.reshape(batch.num_rows, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made)], names=[*kept, name])

    source = stats.select(*kept, "_llm_stats")
    return source.mapInArrow(score, StructType(source.schema.fields[:-1]).add(name, "double"))


def scored_texts(docs: DataFrame, keep: list[str], model: Kernel | float, name: str = "score") -> DataFrame:
    """The columns ``keep`` with the score of the text; a worker measures and scores it in one go."""
    if isinstance(model, float):
        return docs.select(*keep, F.lit(model).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, f"{name} double", lambda: lambda texts: [
        shared.value.score(np.array([statistics(t) for t in texts], float))])


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    stats = stable(measured(docs, ["doc_id"]))
    marked = scored(stats, fit(labelled(stats, labels)))
    return marked.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that score at least ``threshold``, with their columns.

    Texts are read twice and not moved: once for the statistics of rows that may be labelled, as a bitmap of the labels' ids
    tells, once for the scores.
    """
    entry = F.xxhash64("doc_id").alias("entry")
    known = in_bitmap(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", entry), labels.filter("doc_id IS NOT NULL").select(entry))
    model = fit(labelled(stable(measured(known, ["doc_id"])), labels))
    marked = scored_texts(docs, docs.columns, model, "_llm_score")
    return marked.filter(F.col("_llm_score") >= threshold).select(*docs.columns)
