import math
import random

import pytest

from zephyrgrid.llm import pii


def plain_terms(texts, support=3, share=0.8):
    """The terms of each text that disclose an entity, from sets of texts."""
    texts = {t or "" for t in texts}
    words, entities = {}, {}
    for t in texts:
        taken = pii.base_spans(t)
        for m in pii.re.finditer(r"[^\W\d_]+", t):
            if not any(s < m.end() and m.start() < e for _, s, e in taken):
                words.setdefault(m.group().lower(), set()).add(t)
        for k, s, e in taken:
            entities.setdefault((k, t[s:e].lower()), set()).add(t)
    flagged = set()
    for e in entities.values():
        content = math.log2(len(texts) / len(e))
        for term, w in words.items():
            both = len(w & e)
            if both >= support and content > 0 and math.log2(both * len(texts) / len(w) / len(e)) >= share * content:
                flagged.add(term)
    return {t: found for t in texts if (found := sorted(w for w in flagged if t in words[w]))}


def terms(df):
    keys = {r.key: r.text or "" for r in df.selectExpr("md5(coalesce(text, '')) AS key", "text").collect()}
    return {keys[r.key]: r.terms for r in pii.disclosing(df).collect()}


def test_terms_from_the_whole_text(spark, docs):
    fill = [f"common words of an ordinary day number {'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(26)]
    above = [f"Name: Emma Fischer\nEmail: emma.f@mail.example.com\n{w}" for w in ("one", "two", "three", "four")]
    far = [f"Ng was the person that we had asked, {w}, to answer letters sent to 10.1.2.3" for w in ("red", "blue", "grey")]
    short = [f"李明 {'x' * i} 10.9.8.7" for i in range(4, 8)]
    apart = [f"Quist {'z' * i} and then {'some more text ' * 30} qu.i@mail.example.com" for i in range(4)]
    apart += [f"Quist qu.i@mail.example.com {'y' * i}" for i in range(4)]
    rows = list(enumerate(fill + above + far + short + apart))
    got = terms(docs(rows))
    assert all({"emma", "fischer"} <= set(got[t]) for t in above) and all("ng" in got[t] for t in far)
    assert all(got[t] == ["李明"] for t in short) and all("quist" in got[t] for t in apart)
    assert got == plain_terms([t for _, t in rows])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(rows)).collect()}
    assert clean[26].split("\n")[0].endswith("[TERM] [TERM]") and clean[0] == fill[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_are_those_of_brute_force(spark, docs, seed):
    r = random.Random(seed)
    names = [f"{a}{b}" for a in "abcdefgh" for b in ("", "o", "en", "İx", "ß")]
    marks = [f"{n}.{i}@mail.example.com" for i, n in enumerate("abcdef")] + ["10.0.0.1", "+1 555 123 4567"]
    rows = []
    for _ in range(300):
        words = r.choices(["the", "of", "and"], k=5) + r.choices(names, k=r.randint(0, 3))
        for m in r.sample(range(len(marks)), r.choice([0, 0, 1, 2])):
            words += [marks[m]] + r.sample([names[m], names[m + 8], names[m + 9].upper()], r.randint(0, 3))
        r.shuffle(words)
        rows.append(r.choice([" ", "\n"]).join(words))
    rows += r.choices(rows, k=200) + [rows[0]] * 100 + [None, "", None]
    got = terms(docs(list(enumerate(rows))).repartition(7))
    assert got == plain_terms(rows) and got
