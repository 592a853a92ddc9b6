import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from zephyrgrid.llm import jaccard, pii
from zephyrgrid.llm.queries import ORACLE, QUERIES, tokenizer_file


def test_stages_keep_columns_and_take_effect(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        before = corpus_pipeline.stable(after)
        seen.append(before.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] == seen[4] > 0
    left = jaccard.report(before, jaccard.Rule(5, 80, 100))
    assert before.filter("text LIKE '%@%.example.com%'").count() == 0
    assert left.select("component_id").distinct().count() >= 0.99 * seen[4]
    last = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.select("doc_id").distinct().count() == seen[4]


def plain_survivors(rows):
    """The smallest id of each group of documents linked by five-word shingles, by comparing all pairs; others stay."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets, key=lambda i: len(sets[i]))
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(sets[a]) * 100 < 80 * len(sets[b]) or not sets[a]:
                break
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in root if find(i) == i}


def test_run_equals_plain_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    accepted = corpus_pipeline.stable(corpus_pipeline.good(spark, corpus_pipeline.stable(corpus_pipeline.language(spark, docs, sf_dir)), sf_dir))
    rows = [(r.doc_id, r.text) for r in accepted.select("doc_id", "text").collect()]
    kept = plain_survivors(rows)
    library, want = Tokenizer.from_file(tokenizer_file(spark, "word_bpe_49k.json")), set()
    for doc_id, text in rows:
        if doc_id in kept:
            ids = [*library.encode(pii.replaced(text, pii.base_spans(text)), add_special_tokens=False).ids, 0]
            for piece, at in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[at:at + 2048], "<u4")
                want.add((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 2048


def test_thirteen_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)
