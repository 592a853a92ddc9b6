import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.llm import topk


def brute(rows, k, asked):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        made = [int(np.floor(256 * x)) for x in v]
        vectors[i] = min(vectors.get(i, made), made)
    out = []
    for q in filter(asked, vectors):
        found = sorted((-topk.cut(sum(a * b for a, b in zip(vectors[q], v))), i) for i, v in vectors.items()
                       if i != q and len(v) == len(vectors[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, step=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % step == 0, k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("scale", [0.1, 3e4, 3e7])
def test_same_as_all_pairs(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 30)
    random = np.random.default_rng(1)
    centres = random.normal(size=(6, 8))
    rows = [(i, (scale * (centres[i % 6] + 0.05 * random.normal(size=8))).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # many equal vectors: ties go to smaller ids
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 3 == 0)


def test_exact_with_a_far_pivot(spark, monkeypatch):
    """A vector a million times longer is among the pivots; distances to it hardly tell near copies apart."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 200)
    random = np.random.default_rng(8)
    rows = [(1000, (1e6 * random.normal(size=8)).tolist())]
    for g in range(6):
        centre = random.normal(size=8)
        rows += [(40 * g + i, (centre + 1e-3 * random.normal(size=8)).tolist()) for i in range(40)]
    pivots = topk.choose_pivots(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert 1000 in pivots[8][0]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 3 == 0)


def test_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (3, None), (6, [None, 1.0]), (9, [float("nan"), 1.0]),
            (12, [float("inf"), 0.0]), (None, [1.0, 1.0]), (15, [0.1, -0.1]), (1, [0.0, 0.0]), (18, [1.0]), (21, [])]
    assert run(spark, rows) == brute(rows, 5, lambda q: q % 3 == 0)
    assert run(spark, []) == []
    huge = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (3, [-1e300, 1.0])]
    assert {r[3] for r in run(spark, huge)} == {2 ** 63 - 1, -2 ** 63}


def test_block_stops_early():
    random = np.random.default_rng(2)
    table = np.floor(256 * random.normal(size=(400, 4)))
    pivots = {4: (np.arange(3), table[:3], [[int(x) for x in v] for v in table[:3]])}
    frame = pd.DataFrame({"vec_id": range(400), "vector": list(table.astype(np.int64)), "norm2": (table ** 2).sum(1), "dist": [
        np.linalg.norm(table[:3] - v, axis=1).tobytes() for v in table]})
    got = topk.search_block(frame[:20], frame, 3, pivots)
    rows = [(i, (v / 256).tolist()) for i, v in enumerate(table)]
    want = [(q, i, s) for q, _, i, s in brute(rows, 3, lambda q: q < 20)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
