"""Language identification: known words by frequency, unseen words by backoff to character n-grams.

The model holds log frequencies per language of words and of character n-grams of lengths 1 to 5, counted over all
words of a bounded sample of labelled documents, which is read once. Words and n-grams are 64-bit keys, sorted, with a row of 32-bit numbers each. A word of the model scores its log frequency in each language. An
unseen word scores, at each of its positions, the longest n-gram that the model knows; shorter n-grams
are tried only where the longer one is unknown, and each step down costs a constant.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text when
nothing could be learned. Ties go to the language first in alphabetical order. Texts of any length
are read whole. Rows without an id are predicted but not learned from. Other columns stay out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zephyrgrid.llm.ship import ship
from zephyrgrid.llm.texts import let_go, map_texts, pieces, small_batches

SAMPLE_DOCS = 4000  # labelled documents per language that counts are taken from, in expectation
GRAM = 5
STEP_DOWN = -1.0
WORDS = re.compile(r"[^\W\d_]+")
MEMO = 200_000
HELD_WORDS = 200_000  # words that a task counts before it passes them on


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def held_out(doc_id: Column, divisor: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == rest, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def has_letter(text: str, words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with a mark before and after each, and the word of each code point."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.repeat(np.arange(len(words)), [len(m) for m in marked])


def _grams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A key of the n code points from each position, and whether they lie in one word."""
    keys = np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)
    if n > len(codes):
        return keys, ~inside
    for i in range(n):
        keys[:len(codes) - i] = keys[:len(codes) - i] * np.uint64(1_000_003) + codes[i:]
        inside[:len(codes) - i] &= owner[:len(codes) - i] == owner[i:]
        inside[len(codes) - i:] = False
    return keys * np.uint64(8) + np.uint64(n), inside


def word_keys(words: list[str]) -> np.ndarray:
    """A 64-bit key of each whole word."""
    codes, owner = _codes(words)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(codes) else np.zeros(0, int)
    place = np.arange(len(codes)) - starts[owner] if len(codes) else np.zeros(0, int)
    powers = np.cumprod(np.full(place.max(initial=0) + 1, 0x9E3779B97F4A7C15, np.uint64))
    mixed = (codes + np.uint64(7)) * powers[place]
    keys = np.add.reduceat(mixed, starts) if len(codes) else np.zeros(0, np.uint64)
    return keys ^ (keys >> np.uint64(29))


class Model:
    """Log frequencies: sorted keys with rows, of words at size 0 and of n-grams at their size."""

    def __init__(self, langs: list[str], found: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.keys, self.rows = [], []
        for size in range(GRAM + 1):
            keys, counts = found.get(size, (np.zeros(0, np.uint64), np.zeros((0, len(langs)))))
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.rows.append(self._log(counts[order]))
        self.unknown = np.full(len(langs), min([t.min() for t in self.rows[1:] if t.size] or [0.0]) + STEP_DOWN * GRAM)

    def find(self, size: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of keys, and which of them the model holds."""
        known = self.keys[size]
        if not len(known):
            return np.zeros(len(keys), int), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return at, known[at] == keys

    def of_words(self, words: list[str]) -> np.ndarray:
        """Scores of words, known or not."""
        at, known = self.find(0, word_keys(words))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        out[known] = self.rows[0][at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            out[fresh] = self.unseen([words[i] for i in fresh])
        return out

    @staticmethod
    def _log(counts: np.ndarray) -> np.ndarray:
        smooth = counts.astype(float) + 0.1
        return np.log(smooth / smooth.sum(0)).astype(np.float32) if counts.size else counts.astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that the model doesn't hold: the mean over their positions."""
        codes, owner = _codes(words)
        scores = np.tile(self.unknown, (len(codes), 1)).astype(np.float32)
        open_ = np.ones(len(codes), bool)
        for down, n in enumerate(range(GRAM, 0, -1)):
            keys, inside = _grams(codes, owner, n)
            todo = np.flatnonzero(open_ & inside)
            at, hit = self.find(n, keys[todo])
            scores[todo[hit]] = self.rows[n][at[hit]] + STEP_DOWN * down
            open_[todo[hit]] = False
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        return np.add.reduceat(scores, starts, axis=0) / np.diff(np.r_[starts, len(codes)])[:, None]


class Scorer:
    """Scores texts in batches; scores of words are kept for later batches up to a fixed number."""

    def __init__(self, model: Model):
        self.model = model
        self._start()

    def _start(self) -> None:
        self.memo, self.parts = {}, [np.zeros((0, len(self.model.langs)), np.float32)]

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        split = [words_of(t) for t in texts]
        named, sure = np.array(["und"] * len(texts), object), np.zeros(len(texts))
        full = [i for i, w in enumerate(split) if w and has_letter(texts[i], w)]
        if not langs or not full:
            return named.tolist(), sure
        if len(self.memo) > MEMO:
            self._start()
        fresh = list(set().union(*[split[i] for i in full]).difference(self.memo))
        if fresh:
            size = sum(map(len, self.parts))
            for at in range(0, len(fresh), 20_000):
                self.parts.append(self.model.of_words(fresh[at:at + 20_000]))
            self.memo.update(zip(fresh, range(size, size + len(fresh))))
            self.parts = [np.concatenate(self.parts)]
        for i in full:
            rows = self.parts[0][np.fromiter(map(self.memo.__getitem__, split[i]), np.int64, len(split[i]))]
            total = rows.sum(0, dtype=float) / np.sqrt(len(split[i]))
            best = int(total.argmax())
            named[i], sure[i] = langs[best], 1 / np.exp(total - total[best]).sum()
        return named.tolist(), sure


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Count words and n-grams per language over a bounded sample of ``docs`` (doc_id, text, lang), whole texts each.

    A document is in the sample by the hash of its id; each language has about ``sample_docs`` of them,
    all where it has fewer. Counting is distributed, over all words of the sample; the driver receives the model only.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    labelled = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for l in langs for x in (l, min(1.0, sample_docs / sizes[l]))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col("lang")]
    names = [f"n{i}" for i in range(len(langs))]
    columns = ", ".join(f"{n} long" for n in names)

    place = {l: i for i, l in enumerate(langs)}

    def table_of(words: list[str], counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array(c) for c in counts.T]], names=["word", *names])

    def count(batches):
        let_go(all_kept=True)
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    for word, n in Counter(words_of(text)).items():
                        if word not in found:
                            found[word] = np.zeros(len(langs), np.int64)
                        found[word][place[lang]] += n
                if len(found) >= HELD_WORDS:
                    yield table_of(list(found), np.stack(list(found.values())))
                    found = {}
        if found:
            yield table_of(list(found), np.stack(list(found.values())))

    def keyed(batches):
        let_go(all_kept=True)
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), np.stack([batch.column(n).to_numpy() for n in names], 1).astype(float)
            codes, owner = _codes(words)
            for size in range(GRAM + 1):
                keys, inside = _grams(codes, owner, size) if size else (word_keys(words), np.ones(len(words), bool))
                known, index = np.unique(keys[inside], return_inverse=True)
                of = counts[owner[inside]] if size else counts
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), size, np.int32)), pa.array(known.view(np.int64)), *[
                    pa.array(np.bincount(index, of[:, i], len(known)).astype(np.int64)) for i in range(len(names))]], names=["size", "key", *names])
        let_go()

    sums = [F.sum(n).alias(n) for n in names]
    words = labelled.filter(drawn).select("lang", "text").mapInArrow(count, f"word string, {columns}").groupBy("word").agg(*sums)
    table = words.mapInArrow(keyed, f"size int, key long, {columns}").groupBy("size", "key").agg(*sums).toArrow()
    size, key = table.column("size").to_numpy(), table.column("key").to_numpy().view(np.uint64)
    counts = np.stack([table.column(n).to_numpy() for n in names], 1).astype(np.float32)
    return Model(langs, {n: (key[size == n], counts[size == n]) for n in range(GRAM + 1)})


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the predicted language and its score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, f"{names[0]} string, {names[1]} double", lambda: Scorer(shared.value).scores)


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); the model has seen no held-out document."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.filter(~out))
    return identify(docs.withColumn("held_out", out), model, ["doc_id", "held_out"])


def reject(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents in a learned language, with their columns; ``und`` and unsure ones go."""
    model = learn(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    marked = identify(docs, model, docs.columns, ("_llm_lang", "_llm_score"))
    return marked.filter((F.col("_llm_lang") != "und") & (F.col("_llm_score") >= least)).select(*docs.columns)
