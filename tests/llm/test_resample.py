import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from zephyrgrid.llm import resample
from zephyrgrid.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) by plain loops."""
    made = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, found in made for b in found)
    t = Counter(b for text in target for b in features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, words, found in made:
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, len(words) >= 20 and i is not None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = able[:25 * len(able) // 100]
    rank = {id(r): n + 1 for n, r in enumerate(drawn)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_crcs_of_matrices():
    values = [b"", b"a", b"ab", b"ba", b"\xff\x00", b"x" * 5000, b"y" * 5000, *[bytes([i, 255 - i]) * 7 for i in range(256)]]
    assert resample.crc32s(pa.array(values, pa.binary())).tolist() == [zlib.crc32(v) for v in values]
    assert resample.crc32s(pa.array(values, pa.binary()).slice(2, 5)).tolist() == [zlib.crc32(v) for v in values[2:7]]


def test_buckets_of_batches():
    texts = [None, "", "Hello, World! ÄÖ é9 x", "a" * 5000 + " b", "x", "! !", "\x85\xa0 中1É"]
    n, made = resample.batch_buckets(texts)
    for text, size, buckets in zip(texts, n, made):
        words, found = features(text)
        assert size == len(words) and np.frombuffer(buckets, "<u2").tolist() == found
    assert resample.batch_buckets([]) == ([], [])


def test_query_equals_brute_force_on_whole_tables(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), [t for t, in read("benchmark", "text")])
    got = rows_of(QUERIES["op12_importance_resampling"](spark, sf_dir))
    assert got == want
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 20


def test_defined_cases(spark, docs):
    text = " ".join(f"w{i % 7}" for i in range(25))
    rows = [(i, f"{text} d{i}") for i in range(40)] + [(5, f"{text} d5")] * 3 + [(None, text), (None, None), (90, None), (91, ""), (92, "! ?"),
            (93, " ".join(["a"] * 19)), (94, " ".join(["a"] * 20)), (95, "Ünï code " * 30_000)]
    goal = [(1, "w1 w2 w3"), (2, None), (None, "w2")]
    assert rows_of(resample.resample(docs(rows), docs(goal))) == brute(rows, [t for _, t in goal])
    assert rows_of(resample.resample(docs(rows), docs([]))) == brute(rows, [])
    assert rows_of(resample.resample(docs([]), docs(goal))) == []


def test_ranks_do_not_depend_on_the_ranges(spark):
    scored = spark.range(3000).selectExpr("id as doc_id", "id % 3 as score", "id % 2 = 0 as able").repartition(7)
    for ranges in (1, 5, 40):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        try:
            got = {r.doc_id: r["rank"] for r in resample.draw(scored, scored.able, 50).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        order = sorted((i for i in range(3000) if i % 2 == 0), key=lambda i: (-(i % 3), i))
        assert got == {i: None for i in range(3000)} | {i: n + 1 for n, i in enumerate(order[:750])}


def test_buckets_are_bounded(docs):
    with pytest.raises(ValueError):
        resample.features(docs([(1, "a")]), ["doc_id"], 70_000)
