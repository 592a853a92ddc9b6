import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephyrgrid.llm import langid, pii, quality

VOICES = {"en": "the of and that with for was is on are", "fr": "le la les des que dans pour est une pas",
          "de": "der die und das nicht mit ist ein von zu"}


def prose(lang, r, n=60):
    return " ".join(r.choice(VOICES[lang].split()) + r.choice(["", "x" + lang * 2]) for _ in range(n))


def labelled(spark, n=240):
    r = random.Random(2)
    rows = [(i, prose(lang := list(VOICES)[i % 3], r), lang, "s", 1.5, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string")


def test_language_of_held_out(spark):
    got = langid.predict(labelled(spark)).join(labelled(spark).select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert 30 < len(out) < 90 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)


def test_language_cases(spark):
    model = langid.learn(labelled(spark))
    rows = [(1, None), (2, ""), (3, "12 ++ 7"), (4, "²³"), (5, "Xenen XENEN unseenen"), (6, "le que xfrfr"), (7, "и"), (None, "die und")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[3].score == 0
    assert got[5].lang_pred == "en" and got[6].lang_pred == "fr" and got[None].lang_pred == "de"
    assert got[7].lang_pred in VOICES
    nothing = langid.learn(labelled(spark).filter("false"))
    assert {r.lang_pred for r in langid.identify(df, nothing, ["doc_id"]).collect()} == {"und"}
    kept = langid.reject(labelled(spark).unionByName(df.select("doc_id", "text"), allowMissingColumns=True))
    assert kept.columns == labelled(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(range(240)) and not ids & {r.doc_id for r in kept.filter("text IS NULL OR text = ''").collect()}
    twice = langid.predict(labelled(spark, 30).union(labelled(spark, 30)))
    assert twice.count() == 60 and twice.distinct().count() == 30 and langid.predict(labelled(spark).limit(0)).count() == 0
    long = df.limit(1).withColumn("text", F.repeat(F.lit("der und die "), 100_000))
    assert langid.identify(long, model, ["doc_id"]).first().lang_pred == "de"


def plain_language(rows, texts):
    """The language and score of texts by dictionaries and loops."""
    langs = sorted({l for _, l in rows})
    counts = {}
    for text, lang in rows:
        for w in langid.words_of(text):
            marked = f"^{w}$"
            keys = [(0, w)] + [(n, marked[i:i + n]) for n in range(1, 6) for i in range(len(marked) - n + 1)]
            for key in keys:
                counts.setdefault(key, dict.fromkeys(langs, 0))[lang] += 1
    whole = {(n, l): sum(c[l] + 0.1 for k, c in counts.items() if k[0] == n) for n in range(6) for l in langs}
    logs = {k: [math.log((c[l] + 0.1) / whole[k[0], l]) for l in langs] for k, c in counts.items()}
    floor = min(min(v) for k, v in logs.items() if k[0]) - 5
    out = []
    for text in texts:
        total, words = [0.0] * len(langs), langid.words_of(text)
        for w in words:
            marked, score = f"^{w}$", logs.get((0, w))
            if score is None:
                spots = []
                for i in range(len(marked)):
                    found = next(((5 - n, logs[n, marked[i:i + n]]) for n in range(5, 0, -1)
                                  if i + n <= len(marked) and (n, marked[i:i + n]) in logs), None)
                    spots.append([v - found[0] for v in found[1]] if found else [floor] * len(langs))
                score = [sum(s[l] for s in spots) / len(spots) for l in range(len(langs))]
            total = [t + s for t, s in zip(total, score)]
        total = [t / math.sqrt(len(words)) for t in total]
        best = max(range(len(langs)), key=lambda l: (total[l], -l))
        out.append((langs[best], 1 / sum(math.exp(t - total[best]) for t in total)))
    return out


def test_same_as_plain_scorer(spark):
    rows = [(r.text, r.lang) for r in labelled(spark, 60).collect()]
    texts = ["der lexfrfr und xx", "the notde", "quy zz", "unseenen лес word", "la", "estest dass", "a b c d e f g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = langid.identify(df, langid.learn(labelled(spark, 60)), ["doc_id"]).orderBy("doc_id").collect()
    for r, (lang, score) in zip(got, plain_language(rows, texts)):
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-4))


def test_rare_words_are_counted(spark):
    rows = [(i, f"die und seltenwort{'abcdefghij'[i]}q", "de") for i in range(10)] + [(20 + i, "the and of", "en") for i in range(10)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.keys[0]) == 15 and model.find(0, langid.word_keys(["seltenwortcq", "the", "thee"]))[1].tolist() == [True, True, False]


def test_shorter_grams_are_tried_last():
    codes, owner = langid._codes(["abcdef", "uvwxyz"])
    found = {}
    for n in range(1, 6):
        keys, inside = langid._grams(codes, owner, n)
        known, index = np.unique(keys[inside], return_inverse=True)
        found[n] = known, np.stack([np.bincount(index, 5.0 * (owner[inside] == l), len(known)) for l in (0, 1)], 1)
    model = langid.Model(["a", "b"], found)
    scores = model.unseen(["abcdez", "uvwxya", "q"])
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0] and scores[2, 0] == scores[2, 1]


def test_quality_learns_and_calibrates(spark):
    r = random.Random(3)
    rows = []
    for i in range(900):
        text = prose("en", r, 80)
        good = r.random() < 0.8
        rows.append((i, text if good else re.sub(r"(\w) ", r"\1### ", text), int(good)))
    df = spark.createDataFrame([(i, t, "x", 2.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1), (5000, 0), (2, rows[2][2])],
                                   "doc_id long, quality int")
    extra = df.unionByName(spark.createDataFrame([(9001, None, "x", 0.0), (9002, "", "x", 0.0), (9002, "", "x", 0.0),
                                                  (None, "word " * 30_000, "x", 0.0)], df.schema))
    got = quality.predict(extra, labels).collect()
    truth = {i: q for i, _, q in rows}
    out = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(got) == 904 and all(0 <= g.score <= 1 for g in got)
    assert sum(g.predicted == truth[g.doc_id] for g in out) > 0.97 * len(out) > 100
    kept = quality.reject(extra, labels)
    assert kept.columns == extra.columns
    ids = {g.doc_id for g in kept.collect()}
    assert len(ids & {i for i, q in truth.items() if q}) > 0.98 * sum(truth.values())
    assert quality.predict(df.filter("false"), labels).count() == 0
    assert {g.score for g in quality.predict(df, labels.filter("false")).collect()} == {0.5}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.mark.parametrize("pool", ["a@.b", "@.a- 1", "1.2 5", "+1 (2)-.3", "a@b.c+1.2 3-", "12.", "0 4-"])
def test_spans_are_the_patterns(pool):
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1((" * 75_000, "1 " * 150_000):
        pii.base_spans(text)


def test_terms_that_disclose(spark, docs):
    secret = "jo.doe@mail.example.com"
    rows = [(i, f"line {i}\nplease ask Mustermann {secret} about word{'abcdefgh'[i]}") for i in range(5)]
    rows += [(10 + i, f"please ask about the plain weather number {'abcdefghijklmnop'[i]}") for i in range(15)]
    rows += [(40, "Mustermann was here"), (41, None), (42, ""), (42, "")]
    got = {r.doc_id: r for r in pii.report(docs(rows)).collect()}
    # "line" and the name are in exactly the texts that hold the entity, anywhere in them
    assert got[0].n_email == 1 and got[0].spans == "email:29:52,term:0:4,term:18:28" and got[40].spans == "term:0:10"
    assert all(got[i].spans == "" for i in (10, 41, 42))
    clean = {r.doc_id: r for r in pii.sanitise(docs(rows)).collect()}
    assert clean[0].text == "[TERM] 0\nplease ask [TERM] [EMAIL] about worda" and clean[0].n_chars == len(clean[0].text)
    assert clean[41].text is None and clean[42].text == "" and clean[10].text == rows[5][1]
    assert pii.sanitise(docs(rows)).columns == docs(rows).columns and pii.sanitise(docs(rows)).count() == len(rows)
    assert pii.report(docs([])).count() == 0


def test_overlaps_are_replaced_once():
    text = "call +1 555 123 4567.1.1.1 now"
    found = pii.base_spans(text)
    assert pii.replaced(text, found).startswith("call [PHONE]") and pii.replaced("x", []) == "x"


def test_texts_meet_one_worker_at_a_time(spark, docs):
    """Measuring and scoring are one step, so a task needs one worker; batches are as large as a call takes."""
    from zephyrgrid.llm import texts
    rows = docs([(i, f"word{i} and more " * (1 + i % 5)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.reject(rows, labels)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert int(spark.conf.get(texts.BATCH_ROWS)) <= texts.ROWS
    stats = quality.stable(quality.measured(rows, ["doc_id"]))
    model = quality.fit(quality.labelled(stats, labels))
    plain = {r.doc_id: r.score for r in quality.scored(stats, model).collect()}
    assert not isinstance(model, float)
    for r in quality.scored_texts(rows, ["doc_id"], model).collect():
        assert abs(r.score - plain[r.doc_id]) < 1e-9


def test_counts_of_a_task_leave_it_in_parts(spark, docs, monkeypatch):
    """A task that meets more words than it may hold passes them on within a batch."""
    keyed = docs([(i, " ".join(chr(97 + (i * 7 + j) % 26) * (1 + j % 9) for j in range(40))) for i in range(40)]).selectExpr("string(doc_id) AS key", "text")
    whole = lambda: {r.term: r.n for r in pii._counted_by_task(keyed, lambda: lambda k, t: (0, 1.0, pii.words(t))).groupBy("term").sum("n").toDF("term", "n").collect()}
    got, found = whole(), {}
    for r in keyed.collect():
        for w in pii.words(r.text):
            found[w] = found.get(w, 0) + 1
    assert got == found and pii.HELD_WORDS <= 100_000
