import random

import numpy as np
import pytest

from zephyrgrid.llm import jaccard as J
from zephyrgrid.llm.components import components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, rule):
    sets = [shingles(t, rule.words) for _, t in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rule.linked(len(a & sets[j]), len(a), len(sets[j])):
                label[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return sorted((d, len(sets[i]), first[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, size=14):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        if g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(size if g else 4 * size):
            text = base[:]
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows) * 3 % 1009, r.choice([" ", "\t", "\n "]).join(text).upper() if r.random() < 0.2
                         else " ".join(text)))
    return rows


@pytest.mark.parametrize("rule", [J.Rule(3, 90, 100), J.Rule(5, 80, 100), J.Rule(1, 50, 100)])
@pytest.mark.parametrize("frequent", [1, 16])
def test_same_as_all_pairs(spark, docs, rule, frequent, monkeypatch):
    monkeypatch.setattr(J, "COUNTED", 8)
    monkeypatch.setattr(J.frequent_shingles, "__defaults__", (frequent, 5000))
    monkeypatch.setattr(J.verified_links, "__defaults__", (20,))
    rows = corpus(rule.words)
    got = sorted(tuple(r) for r in J.report(docs(rows), rule).collect())
    assert got == brute(rows, rule)


def test_every_similar_pair_shares_enough_entries():
    """For sets over few, mostly frequent, tokens: k common singles or a common pair, whatever is frequent."""
    r = np.random.default_rng(7)
    for rule in (J.Rule(1, 90, 100), J.Rule(1, 80, 100), J.Rule(1, 60, 100)):
        for _ in range(400):
            n = int(r.integers(2, 150))
            tokens = r.choice(2 ** 40, n + 40, replace=False).astype(np.uint64)
            a = tokens[:n]
            drop = int(r.integers(0, n - rule.least(n) + 1))
            b = np.r_[a[drop:], tokens[n:n + int(r.integers(0, 3))]]
            if not rule.linked(len(np.intersect1d(a, b)), len(a), len(b)) or len(b) == 0:
                continue
            frequent = r.permutation(tokens)[:int(r.integers(0, n + 40))]
            index = J.Indexer(rule, frequent)
            (s, p), (t, q) = index.entries(np.sort(a)), index.entries(np.sort(b))
            k = min(rule.extension(len(a)), rule.extension(len(b)))
            assert len(np.intersect1d(s, t)) >= k or len(np.intersect1d(p, q)) or set(a) == set(b)


def test_defined_cases(spark, docs):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (2, "ONE"), (9, "one two"), (4, "one two"), (4, "one two"),
            (11, "é Ä"), (12, "É ä"), (13, "a\x0bb\x0cc d"), (14, "a b c d")]
    got = sorted(tuple(r) for r in J.report(docs(rows)).collect())
    assert got == brute(rows, J.Rule(3, 90, 100))
    kept = J.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 7, 11, 12, 13]
    assert J.report(docs([])).count() == 0 and J.keep_one(docs([])).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100


def test_one_row_of_each_component_stays(spark, docs):
    text = "one two three four five six seven eight nine ten eleven twelve"
    other = "a b c d e f g h i j k l m n"
    rows = [(None, text)] * 20 + [(None, text + " thirteen")] * 3 + [(7, other), (7, other + " o"), (7, other), (None, other)]
    rows += [(None, "")] * 2 + [(9, ""), (9, ""), (3, "only this text stands alone here now")]
    kept = J.keep_one(docs(rows), J.Rule(5, 80, 100)).collect()
    assert sorted((r.doc_id, r.text[:1]) for r in kept if r.doc_id is not None) == [(3, "o"), (7, "a"), (9, "")]
    assert sorted(r.text[:3] for r in kept if r.doc_id is None) == ["", "", "one"]


def test_blocks_are_bounded_by_shingles(spark):
    """Few classes of long texts make as many blocks as their shingles need, as one task holds two blocks whole."""
    classes = spark.createDataFrame([(k, k, 500 if k < 60 else 1) for k in range(100)], "key long, text_hash long, n long")
    clusters = spark.createDataFrame([(k, 0 if k < 60 else 60) for k in range(100)], "node long, root long")
    rows = J.in_blocks(classes, clusters, block=1000, shingles=5000).collect()
    assert len(rows) == 100
    assert {r.cluster: r.blocks for r in rows} == {0: 6, 60: 1}
    assert max(sum(r.n for r in rows if (r.cluster, r.block) == (0, b)) for b in range(6)) <= 3 * 5000


@pytest.mark.parametrize("columns", [3, 2048])
def test_shared_counts_in_parts(columns, monkeypatch):
    monkeypatch.setattr(J, "COLUMNS", columns)
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 30))).astype(np.uint64) for _ in range(25)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (J.shared_counts(sets[:10], sets[10:]) == want[:10, 10:]).all()
    made = J.shared_counts(sets, sets, True)
    apart = ~np.eye(len(sets), dtype=bool)
    assert (made[apart] == want[apart]).all()
    assert not J.shared_counts(sets[:5] + [np.zeros(0, np.uint64)] * 3, [np.array([99], np.uint64)] * 6).any()
