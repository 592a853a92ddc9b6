"""Approximate nearest neighbours by cosine: a forest of sorted hash strings.

Every vector gets one string of ``BITS`` signs of random projections per tree. A tree over a block of candidates is the sorted array of
their strings: candidates that share a prefix with a query lie next to each other. A query descends every tree
to its longest matching prefix by binary search; then all trees ascend together, one bit at a time, and each new candidate is
compared exactly. A candidate of cosine c shares a prefix of x bits with probability p(c)^x, p(c) = 1 - arccos(c) / pi, in each
tree alone, so after depth x it was missed by all trees with probability (1 - p(c)^x)^trees. The ascent ends where that is at most
``MISS`` for the cosine of the k-th best candidate found; those nearer are missed more seldom still. The depth
follows from the data alone: alike vectors end deep, unstructured ones near the top.

Queries and candidates meet in blocks of bounded size, twice: first each block is asked for a few candidates of
the longest prefixes, which gives each query a k-th best cosine over all blocks; then every block ascends to the depth for it.
All rows are in the index. Of equal vectors the k + 1 smallest ids are candidates: no query can need more.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id.
Of rows that share an id the least vector counts. Vectors meet only vectors of the same length. Equal cosines go to smaller
ids. A query with fewer than k candidates returns all that are found at depth 0, that is all. Empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.llm.ship import ship
from zephyrgrid.session import stable

TREES, BITS, MISS, SEED = 128, 32, 0.1, 20
PROBE = 32  # candidates of a block and query that are compared before the depth is known
CANDIDATE_BYTES, QUERY_BYTES, LEAST_BLOCK = 48_000_000, 24_000_000, 2048
INDEX = "vec_id long, vector array<double>, dim int, strings binary"
FOUND = "query_id long, vec_id long, score double"


def usable_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that have an id and a whole, finite vector other than zero."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return (df.filter(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select(F.col("vec_id").cast("long"), x.alias("vector"))
            .groupBy("vec_id").agg(F.min("vector").alias("vector")))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values, wherever they stand."""
    vectors, query = scaled(vectors), scaled(query[None])
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum(1)))


def hash_strings(vectors: np.ndarray, trees: int = TREES) -> np.ndarray:
    """A string of ``BITS`` signs per tree and vector, as unsigned integers; the projections follow from seed and length."""
    dim = vectors.shape[1]
    made = scaled(vectors).astype(np.float32)
    out = np.zeros((len(made), trees), np.uint32)
    random = np.random.default_rng([SEED, dim])
    for tree in range(trees):
        planes = random.standard_normal((dim, BITS), np.float32)
        out[:, tree] = np.packbits(made @ planes > 0, axis=1).view(">u4")[:, 0]
    return out


def index(vectors: DataFrame, trees: int = TREES) -> DataFrame:
    """Vectors with their length and their strings."""
    ship(vectors.sparkSession)

    def measure(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vector"].map(len)):
                strings = hash_strings(np.array(part["vector"].tolist(), float).reshape(len(part), dim), trees)
                yield pd.DataFrame({"vec_id": part["vec_id"], "vector": part["vector"], "dim": np.int32(dim),
                                    "strings": [s.tobytes() for s in strings]})
    return vectors.mapInPandas(measure, INDEX)


def missed(cosine: np.ndarray | float, depth: int, trees: int) -> np.ndarray:
    """The probability that no tree holds a candidate of this cosine under the query's prefix of this depth."""
    same = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return (1 - same ** depth) ** trees


class Forest:
    """The sorted strings of a block of candidates, one array per tree."""

    def __init__(self, strings: np.ndarray):
        self.rows, self.trees = strings.shape
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(strings.T, self.order, 1).astype(np.int64)

    def longest(self, queries: np.ndarray) -> np.ndarray:
        """The longest prefix of each query that some candidate shares in some tree."""
        most = np.zeros(len(queries), np.int64)
        for tree, column in enumerate(self.sorted):
            at = np.searchsorted(column, queries[:, tree])
            for near in (np.maximum(at - 1, 0), np.minimum(at, self.rows - 1)):
                apart = column[near] ^ queries[:, tree]
                most = np.maximum(most, BITS - np.frexp(apart.astype(float))[1])
        return most

    def spans(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the candidates under each query's prefix of this depth begin and end."""
        first = queries >> (BITS - depth) << (BITS - depth)
        after = first + (1 << (BITS - depth))
        low = [np.searchsorted(column, first[:, t]) for t, column in enumerate(self.sorted)]
        high = [np.searchsorted(column, after[:, t]) for t, column in enumerate(self.sorted)]
        return np.stack(low, 1), np.stack(high, 1)

    def under(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The candidates in the spans of one query, those in several trees several times."""
        sizes = high - low
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(low - (ends - sizes) + np.arange(self.trees) * self.rows, sizes)
        return self.order.ravel()[place]


def search_block(q: pd.DataFrame, c: pd.DataFrame, k: int, trees: int, miss: float, probe: int | None) -> pd.DataFrame:
    """The best k candidates found in this block for each query of this block.

    With ``probe`` the ascent ends after so many candidates. Without, it begins at the depth that the column ``known``, a k-th best
    cosine of each query, asks for, and ends by the rule of this module.
    """
    dim = len(c["vector"].iloc[0])
    matrix = lambda pdf: np.array(pdf["vector"].tolist(), float).reshape(len(pdf), dim)
    strings = lambda pdf: np.frombuffer(b"".join(pdf["strings"]), np.uint32).reshape(len(pdf), trees)
    vectors, c_ids = matrix(c), c["vec_id"].to_numpy()
    unit = scaled(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    forest = Forest(strings(c))
    out = []
    for start in range(0, len(q), 128):
        part = q.iloc[start:start + 128]
        own, hashed, q_ids = matrix(part), strings(part).astype(np.int64), part["vec_id"].to_numpy()
        way = scaled(own)
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        known = part["known"].to_numpy(float) if probe is None else np.full(len(part), -1.0)
        begin = forest.longest(hashed)
        if probe is None:
            enough = np.stack([missed(known, depth, trees) <= miss for depth in range(BITS, -1, -1)], 1)
            begin = np.minimum(begin, BITS - enough.argmax(1))
        seen = np.zeros((len(part), len(c)), bool)
        rows = [np.zeros(0, np.int64)] * len(part)
        near = [np.zeros(0)] * len(part)
        open_ = np.ones(len(part), bool)
        for depth in range(int(begin.max(initial=0)), -1, -1):
            active = np.flatnonzero(open_ & (begin >= depth))
            low, high = forest.spans(hashed[active], depth)
            for i, a, b in zip(active, low, high):
                mark = np.zeros(len(c), bool)
                mark[forest.under(a, b)] = True
                fresh = np.flatnonzero(mark & ~seen[i] & (c_ids != q_ids[i]))
                seen[i] |= mark
                # all of the k best so far, and what may equal the last of them, are kept
                r, s = np.concatenate([rows[i], fresh]), np.concatenate([near[i], unit[fresh] @ way[i]])
                if len(r) > k:
                    last = np.partition(s, len(s) - k)[len(s) - k]
                    kept = s >= last - 1e-9
                    r, s = r[kept], s[kept]
                    known[i] = max(known[i], last)
                elif len(r) == k:
                    known[i] = max(known[i], s.min())
                rows[i], near[i] = r, s
                if probe is not None:
                    open_[i] = seen[i].sum() < probe
                else:
                    open_[i] = known[i] <= -1 or missed(known[i], depth, trees) > miss
        for i, r in enumerate(rows):
            exact = cosines(vectors[r], own[i]) if len(r) else np.zeros(0)
            best = np.lexsort((c_ids[r], -exact))[:k]
            out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[r][best], "score": exact[best]}))
    return pd.concat(out)


def nearest(table: DataFrame, queries: Column, k: int = 5, trees: int = TREES, miss: float = MISS,
            probe: int = PROBE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which the condition ``queries`` on ``vec_id`` holds.

    ``table`` comes from :func:`index`, with as many trees; candidates are all rows but the query's own.
    """
    spark = table.sparkSession
    ship(spark)
    table = stable(table)
    equal = Window.partitionBy("dim", "vector").orderBy("vec_id")
    held = stable(table.withColumn("_copy", F.row_number().over(equal)).filter(F.col("_copy") <= k + 1).drop("_copy"))
    asked = table.filter(queries)
    n, dim = held.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(0))).first()
    m = asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = 8 * dim + 12 * trees
    q_blocks = max(1, math.ceil(m * row / QUERY_BYTES))
    c_blocks = max(1, math.ceil(n * row / CANDIDATE_BYTES), min(math.ceil(tasks / q_blocks), n // LEAST_BLOCK))
    spread = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    right = held.withColumns({"c_block": spread(c_blocks), "q_block": every(q_blocks)})
    cell = ["dim", "q_block", "c_block"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def meet(asking: DataFrame, budget: int | None) -> DataFrame:
        def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if q.empty or c.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                    {"query_id": "int64", "vec_id": "int64", "score": "float64"})
            return search_block(q, c, k, trees, miss, budget)
        left = asking.withColumns({"q_block": spread(q_blocks), "c_block": every(c_blocks)})
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, FOUND)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    known = meet(asked, probe).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    sure = stable(asked.join(stable(known), "vec_id", "left").fillna(-1.0, ["known"]))
    return meet(sure, None).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: Column, k: int = 5) -> float:
    """The share of the true k nearest neighbours that ``found`` holds, by comparing all: for tables of moderate size."""
    rows = vectors.collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.vector for r in rows], float)
    asked = {r.vec_id for r in vectors.filter(queries).select("vec_id").collect()}
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    hits = total = 0
    for i in np.flatnonzero(np.isin(ids, list(asked))):
        score = cosines(data, data[i])
        score[i] = -np.inf
        true = np.lexsort((ids, -score))[:min(k, len(ids) - 1)]
        hits, total = hits + sum((ids[i], ids[j]) in got for j in true), total + len(true)
    return hits / max(total, 1)
