import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from zephyrgrid.llm import forest
from zephyrgrid.llm.queries import QUERIES

ASKED = "vec_id % 5 = 0"


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return forest.usable_vectors(df.withColumns({n: F.lit(1) for n in ("score", "dim", "strings", "known", "_copy", "rank")}))


def search(spark, rows, k=5, **options):
    vectors = table(spark, rows)
    found = forest.nearest(forest.index(vectors), F.expr(ASKED), k, **options)
    return vectors, sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def brute(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            vectors[i] = min(vectors.get(i, v), v)
    out = []
    for q in sorted(i for i in vectors if i % 5 == 0):
        cos = {i: float(forest.cosines(np.array([v], float), np.array(vectors[q], float))[0])
               for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
        out += [(q, r + 1, i, cos[i]) for r, i in enumerate(sorted(cos, key=lambda i: (-cos[i], i))[:k])]
    return out


def clustered(seed, groups, size, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(g * size + i, (centres[g] + spread * rng.normal(size=dim)).tolist()) for g in range(groups) for i in range(size)]


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_recall_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_BLOCK", 150)
    rows = clustered(3, 60, 10, 24, spread)
    _, got = search(spark, rows)
    true = {r[:1] + r[2:3] for r in brute(rows)}
    assert len({(q, i) for q, _, i, _ in got} & true) >= 0.9 * len(true)
    cos = {(q, i): s for q, _, i, s in brute(rows, 599)}
    assert all(cos[q, i] == s for q, _, i, s in got)
    for q in {r[0] for r in got}:
        own = [(-s, i) for p, _, i, s in got if p == q]
        assert own == sorted(own) and len(own) == 5


def test_depth_follows_the_data():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(100, 32))
    alike = np.repeat(centres, 20, axis=0) + 0.05 * rng.normal(size=(2000, 32))
    loose = rng.normal(size=(2000, 32))
    looked = {}
    for name, data in (("alike", alike), ("loose", loose)):
        pdf = pd.DataFrame({"vec_id": range(2000), "vector": list(data),
                            "strings": [s.tobytes() for s in forest.hash_strings(data)]})
        first = forest.search_block(pdf[:50], pdf, 5, forest.TREES, forest.MISS, forest.PROBE)
        known = first.groupby("query_id")["score"].min().to_numpy()
        count, under = [], forest.Forest.under

        def counted(self, low, high):
            made = under(self, low, high)
            count.append(len(np.unique(made)))
            return made
        forest.Forest.under = counted
        try:
            got = forest.search_block(pdf[:50].assign(known=known), pdf, 5, forest.TREES, forest.MISS, None)
        finally:
            forest.Forest.under = under
        looked[name] = sum(count) / 50
        unit = data / np.linalg.norm(data, axis=1)[:, None]
        near = unit[:50] @ unit.T
        near[range(50), range(50)] = -2
        true = {(i, j) for i in range(50) for j in np.argsort(-near[i])[:5]}
        assert len(true & set(zip(got.query_id, got.vec_id))) >= 0.9 * 250
    assert looked["alike"] < 200 < looked["loose"]


def test_spans_hold_what_shares_the_prefix():
    rng = np.random.default_rng(5)
    strings = rng.integers(0, 2 ** 32, (300, 3), dtype=np.uint32)
    strings[:40, 0] = strings[0, 0] ^ np.arange(40)
    made, asked = forest.Forest(strings), strings[:50].astype(np.int64)
    share = lambda a, b: 32 - int(a ^ b).bit_length()
    for depth in (0, 1, 7, 20, 31, 32):
        low, high = made.spans(asked, depth)
        for i in range(50):
            want = sorted(j for t in range(3) for j in range(300) if share(asked[i, t], int(strings[j, t])) >= depth)
            assert sorted(made.under(low[i], high[i]).tolist()) == want
    other = rng.integers(0, 2 ** 32, (50, 3)).astype(np.int64)
    assert made.longest(other).tolist() == [max(share(int(q[t]), int(strings[j, t])) for t in range(3) for j in range(300)) for q in other]


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_BLOCK", 5)
    same = [2.0, 1.0, 0.5]
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 9.0]), (5, None), (10, [None, 1.0]), (15, [float("nan"), 1.0]),
            (20, [float("inf"), 0.0]), (None, [1.0, 1.0]), (25, [0.0, -0.0]), (30, []), (1, [3.0, 1.0]), (35, [1.0]),
            (40, [1e300, 1e300]), (45, [1e-300, 2e-300])] + [(100 + i, same) for i in range(40)] + [(200, [4.0, 2.0, 1.0])]
    assert search(spark, rows)[1] == brute(rows)
    assert search(spark, [])[1] == []
    assert search(spark, [(0, [1.0]), (5, None)])[1] == []


def test_query_reaches_the_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    vectors = forest.usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = QUERIES["op13_nearest_neighbours"](spark, sf_dir)
    assert found.count() == 5 * vectors.filter("vec_id % 50 = 0").count()
    assert forest.recall(found, vectors, F.col("vec_id") % 50 == 0) >= 0.9
