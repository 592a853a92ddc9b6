"""Exact top-k search by inner product with a pivot table.

Every vector carries its distances to the same pivots. For a query q and a candidate c each pivot p gives
|q - c| >= |d(q, p) - d(c, p)|; the largest of these bounds the inner product from above by
(|q|^2 + |c|^2 - bound^2) / 2. Candidates are evaluated in the order of that bound until it falls below the k-th
best score, so the result is exact whatever the pivots are. Pivots are rows of the table themselves: a
query's k-th best score among them is the first threshold of every block.

Queries and candidates meet in a grid of blocks of bounded size. A block of candidates is sent once for each
block of queries and the other way round; each pair of blocks yields at most k rows per query.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without an id. Of rows that share an id the least vector counts. Vectors meet only vectors of the same
length. Scaled components are cut to the range of a 64-bit integer, and so are scores. A query with
fewer than k candidates returns all. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zephyrgrid.llm.ship import ship
from zephyrgrid.session import stable

PIVOTS, PIVOT_SAMPLE = 32, 512
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK = 4096, 131_072, 2048
TABLE = "vec_id long, vector array<long>, dim int, dist binary, norm2 double"


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component x, for vectors that are whole and finite."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return (df.filter(F.col("vec_id").isNotNull() & whole)
            .select("vec_id", F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("vector"))
            .groupBy("vec_id").agg(F.min("vector").alias("vector")))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, tuple]:
    """For each length of vectors: ids and vectors of pivots far from each other, out of a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    pivots = {}
    for dim in {len(r.vector) for r in rows}:
        ids = np.array([r.vec_id for r in rows if len(r.vector) == dim])
        table = np.array([r.vector for r in rows if len(r.vector) == dim], float).reshape(len(ids), dim)
        chosen, away = [0], np.full(len(ids), np.inf)
        while len(chosen) < min(count, len(ids)):
            away = np.minimum(away, np.linalg.norm(table - table[chosen[-1]], axis=1))
            if away.max() == 0:
                break
            chosen.append(int(away.argmax()))
        exact = [[int(v) for v in r.vector] for r in rows if len(r.vector) == dim]
        pivots[dim] = ids[chosen], table[chosen], [exact[i] for i in chosen]
    return pivots


def pivot_table(vectors: DataFrame, pivots: dict[int, tuple]) -> DataFrame:
    """Vectors with their distances to the pivots of their length, and their squared norm."""
    def measure(batches):
        for pdf in batches:
            dims = pdf["vector"].map(len)
            for dim, part in pdf.groupby(dims):
                table = np.array(part["vector"].tolist(), float).reshape(len(part), dim)
                marks = pivots.get(dim, (None, np.zeros((0, dim)), None))[1]
                dist = np.sqrt(((table[:, None, :] - marks[None]) ** 2).sum(2)) if dim * len(marks) * len(part) < 4e6 \
                    else np.stack([np.linalg.norm(table - p, axis=1) for p in marks], 1) if len(marks) \
                    else np.zeros((len(part), 0))
                yield pd.DataFrame({"vec_id": part["vec_id"], "vector": part["vector"], "dim": np.int32(dim),
                                    "dist": [d.tobytes() for d in dist], "norm2": (table ** 2).sum(1)})
    return vectors.mapInPandas(measure, TABLE)


def _exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest number type in which all inner products of rows of a and b are exact."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else object


def cut(score: int) -> int:
    return min(max(score, -2 ** 63), 2 ** 63 - 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(q: pd.DataFrame, c: pd.DataFrame, k: int, pivots: dict[int, tuple]) -> pd.DataFrame:
    """The k best candidates of this block for each query of this block."""
    dim = len(q["vector"].iloc[0])
    queries = np.array(q["vector"].tolist(), np.int64).reshape(len(q), dim)
    table = np.array(c["vector"].tolist(), np.int64).reshape(len(c), dim)
    exact = _exact_type(queries, table)
    queries, table = queries.astype(exact), table.astype(exact)
    near = lambda pdf: np.frombuffer(b"".join(pdf["dist"]), float).reshape(len(pdf), -1)
    q_dist, c_dist = near(q), np.ascontiguousarray(near(c).T)
    q_norm, c_norm = q["norm2"].to_numpy(), c["norm2"].to_numpy()
    q_ids, c_ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
    pivot_ids, _, pivot_vectors = pivots.get(dim, (np.zeros(0, int), None, []))
    out = {"query_id": [], "vec_id": [], "score": []}
    for start in range(0, len(q), 16):
        rows = range(start, min(start + 16, len(q)))
        bound = np.zeros((len(rows), len(c)))
        for p in range(len(c_dist)):
            own = q_dist[rows.start:rows.stop, p, None]
            # distances are rounded in proportion to their size, which a far pivot makes large
            np.maximum(bound, np.abs(own - c_dist[p]) - 1e-12 * (own + c_dist[p]), out=bound)
        sizes = q_norm[rows.start:rows.stop, None] + c_norm
        # the slack covers the rounding of norms
        upper = (sizes - bound ** 2) / 2 + 1 + 1e-5 * sizes
        for i, row in enumerate(rows):
            query = queries[row]
            known = sorted((cut(sum(a * int(b) for a, b in zip(v, query))) for v, j in zip(pivot_vectors, pivot_ids)
                            if j != q_ids[row]), reverse=True)
            least = known[k - 1] if len(known) >= k else -math.inf
            ahead = np.flatnonzero((upper[i] >= least) & (c_ids != q_ids[row]))
            ahead = ahead[np.argsort(-upper[i, ahead])]
            scores, ids, at, step = np.zeros(0, exact), np.zeros(0, np.int64), 0, 64
            while at < len(ahead) and upper[i, ahead[at]] >= least:
                some = ahead[at:at + step]
                made = table[some] @ query
                if exact is object:
                    made = np.array([cut(int(v)) for v in made], object)
                scores, ids = np.concatenate([scores, made]), np.concatenate([ids, c_ids[some]])
                keep = _best(scores, ids, k)
                scores, ids = scores[keep], ids[keep]
                if len(scores) == k:
                    least = max(least, scores[-1])
                at, step = at + step, step * 4
            out["query_id"] += [q_ids[row]] * len(ids)
            out["vec_id"] += ids.tolist()
            out["score"] += [int(s) for s in scores]
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})


def top_k(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which the condition ``queries`` on ``vec_id`` holds.

    ``vectors`` comes from :func:`integer_vectors`; candidates are all rows but the query's own; ties go
    to the smaller id.
    """
    spark = vectors.sparkSession
    ship(spark)
    pivots = choose_pivots(vectors)
    table = stable(pivot_table(vectors, pivots))
    asked = table.filter(queries)
    n, m = table.count(), asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(1, math.ceil(m / QUERY_BLOCK))
    c_blocks = max(1, math.ceil(n / CANDIDATE_BLOCK), min(math.ceil(tasks / q_blocks), n // LEAST_BLOCK))
    spread = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.withColumns({"q_block": spread(q_blocks), "c_block": every(c_blocks)})
    right = table.withColumns({"c_block": spread(c_blocks), "q_block": every(q_blocks)})
    cell = ["dim", "q_block", "c_block"]

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_block(q, c, k, pivots)

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
