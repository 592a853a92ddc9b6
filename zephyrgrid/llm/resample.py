"""Target-distribution importance resampling over hashed word features.

Features of a text are its runs of one and two consecutive words; each falls into the bucket of its CRC-32. Bucket counts
of the corpus and of a target collection give every bucket a gain, the log of the ratio of their smoothed shares; a
document weighs the mean gain of its features. Gumbel noise drawn by the hash of its id turns the highest scores
into a sample without replacement in proportion to the weights' exponentials.

The CRCs of a batch are made from matrices: the distinct features are grouped by their length in bytes, those of one length are a
matrix of bytes, and its CRCs advance together, one column at a time, before they are scattered back.

Buckets are written once, two bytes a feature, and counted from there over all documents; tasks send at most one sum per
bucket. Ranks come from rows dealt by ranges of the score and numbered within each range.

Defined cases: a null text has no features; a text without words weighs 0. Only documents with an id and at least
``LEAST_WORDS`` words are drawn; others have no rank, those without an id no score either. All count for the corpus. Rows that share an id share
their noise and are ranked one by one. Empty tables give no rows or, as a target, gains by the corpus alone. A text is
read whole in one task, which takes some twenty times its size. Other columns stay out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid.llm.ship import ship
from zephyrgrid.llm.texts import map_texts
from zephyrgrid.llm.words import flat_words, numbered, owners
from zephyrgrid.session import stable

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32
MATRIX = 4_000_000  # bytes of a matrix
LONG = 2048  # features with more bytes are so few in a batch that a matrix of them has nearly no rows
# lower case of A-Z; what is neither a letter, a digit nor beyond ASCII parts words
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def crc_steps() -> np.ndarray:
    """What a byte contributes to the state."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    return step


STEPS = crc_steps()


def crc32s(values: pa.BinaryArray) -> np.ndarray:
    """The CRC-32 of each value."""
    if not len(values):
        return np.zeros(0, np.uint32)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lengths, out = np.diff(ends), np.zeros(len(values), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for bucket in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        size = int(lengths[bucket[0]])
        if size > LONG:
            out[bucket] = [zlib.crc32(data[ends[i]:ends[i] + size].tobytes()) for i in bucket]
            continue
        step = max(1, MATRIX // max(size, 1))
        for low in range(0, len(bucket), step):
            rows = bucket[low:low + step]
            # a row of the matrix is one byte place of all features
            matrix = data[ends[rows][None, :] + np.arange(size)[:, None]]
            state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                state = STEPS[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
            out[rows] = state ^ np.uint32(0xFFFFFFFF)
    return out


def batch_buckets(texts: list[str | None], buckets: int = BUCKETS) -> tuple[list[int], list[bytes]]:
    """The number of words of each text and the buckets of its features, as little-endian 16-bit integers."""
    words, codes, bounds = flat_words([t.encode().translate(WORD_BYTES).split() if t else [] for t in texts])
    text = owners(bounds)
    single = (crc32s(words) % buckets).astype("<u2")[codes]
    first = np.flatnonzero(text[:-1] == text[1:])
    keys, kinds = numbered(codes[first] * max(len(words), 1) + codes[first + 1])
    joined = pc.binary_join_element_wise(
        words.take(pa.array(kinds // max(len(words), 1))), words.take(pa.array(kinds % max(len(words), 1))), pa.scalar(b" ", pa.binary()))
    double = (crc32s(joined) % buckets).astype("<u2")[keys]
    ends = np.searchsorted(first, bounds)  # pairs before each text
    return np.diff(bounds).tolist(), [single[a:b].tobytes() + double[c:d].tobytes()
                                      for a, b, c, d in zip(bounds, bounds[1:], ends, ends[1:])]


def features(docs: DataFrame, keep: list[str], buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_words`` and ``buckets``; at most 65,536 buckets."""
    if not 0 < buckets <= 65_536:
        raise ValueError("between 1 and 65,536 buckets")
    return map_texts(docs, keep, "n_words long, buckets binary", lambda: lambda texts: batch_buckets(texts, buckets), text)


def count_buckets(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of each bucket over all rows; a task sends one sum per bucket."""
    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    sums = found.select("buckets").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most one row per bucket
        total[row.bucket] = row.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of the smoothed shares' ratio, floored, per bucket."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(found: DataFrame, keep: list[str], gains: np.ndarray) -> DataFrame:
    """The columns ``keep`` with ``n_features`` and ``weight``, the floored mean gain."""
    def run(batches):
        for batch in batches:
            values = [gains[np.frombuffer(v.as_buffer(), "<u2")] for v in batch.column(batch.num_columns - 1)]
            made = [pa.array([len(v) for v in values], pa.int64()),
                    pa.array([int(v.sum()) // len(v) if len(v) else 0 for v in values], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*keep, "n_features", "weight"])

    source = found.select(*keep, "buckets")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, floored, from the hash of seed and id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform)))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """All rows of ``scored`` (doc_id, score, ...) with ``rank``: the place of the drawn ones among the eligible.

    Drawn are the ``percent`` of the eligible rows with the highest scores, ties to smaller ids. Rows are dealt by
    ranges of (score, id); the driver receives one count per range.
    """
    spark = scored.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_out"), F.desc("score"), F.col("doc_id")]
    dealt = stable(scored.withColumn("_out", ~eligible)).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the id of a row holds its range and its place there
    placed = stable(dealt.withColumn("_at", F.monotonically_increasing_id()))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_out")).alias("able")).orderBy("_range").collect()
    before, total, able = {}, 0, 0
    for r in sizes:
        before[r._range] = total
        total, able = total + r.n, able + r.able
    drawn = percent * able // 100
    rows = spark.createDataFrame(list(before.items()) or [(0, 0)], "_range long, _before long")
    rank = F.col("_before") + place + 1
    return (placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(rows), "_range", "left")
            .select(*[c for c in scored.columns if c != "_out"],
                    F.when(~F.col("_out") & (rank <= drawn), rank).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document (doc_id, text), towards the texts of ``target``."""
    ship(docs.sparkSession)
    found = stable(features(docs, ["doc_id"], buckets))
    gains = bucket_gains(count_buckets(found, buckets), count_buckets(features(target, [], buckets), buckets))
    weighed = weigh(found, ["doc_id", "n_words"], gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    return draw(weighed, able, percent).select("doc_id", "n_features", "weight", "score", "rank")
