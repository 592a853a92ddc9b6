import hashlib
import random

import pytest
from pyspark.sql import functions as F

from zephyrgrid.llm import fingerprint as fp


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_edits_follow_descending_ids(spark, docs, partitions):
    made = texts(150)
    rows = [(7 * i * i - 300, t) for i, t in enumerate(made)] + [(None, "no id at all"), (99_999_999, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in fp.compare_edits(docs(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, n = t or "", len(t or "")
        edited = t[:n - n // 2] + (after or "")[:n // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].n_within is None) == (i is None or i % 50 != 0)


def test_equal_texts_and_small_edits(spark, docs):
    base = texts(1, 5)[0] * 3 + " tail"
    rows = [(0, base), (1, base), (2, base + " more"), (3, None), (4, ""), (4, ""), (5, texts(1, 9)[0])]
    got = fp.compare_edits(docs(rows)).collect()
    marks = {r.doc_id: r.fingerprint for r in got}
    assert len(got) == 7 and marks[0] == marks[1] and marks[3] == marks[4] == "0" * 32
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert far(marks[0], marks[2]) < 20 < far(marks[0], marks[5])
    assert fp.compare_edits(docs([])).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_tables_find_all_within_radius(spark, radius):
    r = random.Random(radius)
    centres = [r.getrandbits(128) for _ in range(6)]
    marks = {c ^ sum(1 << b for b in r.sample(range(128), r.randint(0, 9))) for c in centres for _ in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    split = lambda m: (signed(m >> 64), signed(m & (1 << 64) - 1))
    df = spark.createDataFrame([split(m) for m in marks], "hi long, lo long")
    got = {((r.q_hi, r.q_lo), (r.hi, r.lo)) for r in fp.within_radius(df.filter(F.col("lo") % 3 == 0), df, radius).collect()}
    want = {(split(a), split(b)) for a in marks for b in marks
            if (a ^ b).bit_count() <= radius and split(a)[1] % 3 == 0}
    assert {(a, b) for a, b in got} == want


def test_no_python_in_the_plan(spark, docs):
    plan = fp.simhash(docs([(1, "a b")]), ["doc_id"], "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
