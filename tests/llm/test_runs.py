import hashlib
import random
import re
import zlib

import pytest

from zephyrgrid.llm import runs
from zephyrgrid.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, power=4):
    """Every period by itself: maximal stretches in which words that far apart are equal."""
    out, n = set(), len(words)
    for period in range(1, n // power + 1):
        at = 0
        while at + period < n:
            end = at
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(least, power * period):
                part = words[at:end + period]
                if all(any(part[i] != part[i + q] for i in range(length - q)) for q in range(1, period)):
                    out.add((at, length, period))
            at = max(end, at + 1)
    return sorted(out)


def edited(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = edited(doc_id, text)
    found = brute(words)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{length},{p}\n" for s, length, p in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (1, 3), (9, 5)])
def test_automaton_finds_the_runs_of_brute_force(least, power):
    rng = random.Random(power)
    for _ in range(700):
        alphabet, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 70)
        words = [rng.randrange(alphabet) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            period, begin = rng.randint(1, 9), rng.randrange(n)
            words = words[:begin] + [words[begin:][:period][i % len(words[begin:][:period])] for i in range(n - begin)]
            words += [rng.randrange(alphabet) for _ in range(rng.randint(0, 25))]
        assert runs.repetitions(words, least, power) == brute(words, least, power)
        text = " ".join(map(str, words))
        found, _ = runs.collapse_batch(["7 7 7 7 7 7 8", None, text, text], least, power)
        assert [(r["start"], r["length"], r["period"]) for r in found[2]] == brute(words, least, power)
        assert found[2] == found[3]


def test_nested_and_touching_runs():
    line = ["a"] * 6 + ["b"]
    assert runs.repetitions((line * 4)) == brute(line * 4)
    assert (0, 28, 7) in runs.repetitions(line * 4)
    assert runs.repetitions(["a"] * 5) == [] and runs.repetitions(["a"] * 6) == [(0, 6, 1)]


def test_query_equals_brute_force_on_whole_tables(spark, sf_dir):
    got = rows_of(QUERIES["op11_periodic_runs"](spark, sf_dir))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == sorted((expected(r.doc_id, r.text) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_defined_cases(spark, docs):
    some = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    long = "x " + "la le " * 30_000 + "  y"
    rows = [(other, None), (other + 200, ""), (other + 400, " \t\n"), (some, None), (some, ""), (some, "one"), (some, "\x0bé \x85 a b c d e f"),
            (None, "a a a a a a a"), (None, "a a a a a a a"), (other, "a b\ta\nb\x0ca b\ra b a"), (other, "a b\ta\nb\x0ca b\ra b a"),
            (other, "w" * 100_000), (other, long)]
    # the brute force takes too long for the long text; its only run is known
    got = rows_of(runs.report(docs(rows)))
    short = [r for r in rows if r[1] != long]
    assert [r for r in got if r[3] != 60_000] == sorted((expected(i, t) for i, t in short), key=str)
    assert [r[1:6] for r in got if r[3] == 60_000] == [(1, 1, 60_000, 2, 30_000_000)]
    assert rows_of(runs.report(docs([]))) == []
    kept = runs.collapse(docs([(3, "a b a b a b a b c")]), ["doc_id", "n_chars", "key"]).first()
    assert kept.collapsed == "a b c" and kept.key == "s" and [tuple(r) for r in kept.runs] == [(0, 8, 2)]
